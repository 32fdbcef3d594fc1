"""Queries of the audit, linkage, memo and scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions import names as nm
from veloria.functions import values as v
from veloria.functions.columns import tidy
from veloria.functions.dates import month_date
from veloria.operators import audit as op
from veloria.operators import linkage as ln
from veloria.operators import memo as mm
from veloria.operators import text as tx
from veloria.plans.evaluation import _FOUND, _found, summary
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, contrib, people, table

_r = lambda x, n=6: f"round({x}, {n}) + 0.0"


def _agreement(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("long").alias("long"))
    return tidy(op.agreement(table(s, d, "labels").join(docs, "doc_id"), "quality", "long"))


def _repositories(s, d):
    return contrib(s, d).groupBy("actor", "repo").agg(F.count("*").alias("n"), F.bool_or(F.col("flag") == "R").alias("gone"))


def _survivorship(s, d):
    segment = table(s, d, "customer").select(F.col("c_custkey").alias("actor"), F.col("c_mktsegment").alias("segment"))
    return tidy(op.survivorship(_repositories(s, d).join(segment, "actor"), "segment", F.col("gone")))


def _lead(s, d):
    seen = people(s, d).filter("actor % 3 = 0").select("actor", (F.col("b") - F.col("actor") % 60).alias("month"))
    return op.lead_cohorts(_found(s, d), seen)


def _drift(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("actor"), F.col("o_totalprice").alias("contribution"))
    scores = o.groupBy("actor").agg(F.round(F.sum("contribution") + F.when(F.col("actor") % 5 == 0, 0.01).otherwise(0.0), 2).alias("score"))
    return tidy(op.component_drift(scores, o), 2)


def _rotated(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("actor"))
    return op.rotated(c, ["nation"], [F.md5(F.col("actor").cast("string")), F.col("actor")], 17, 5)


def _tags(s, d):
    o = act(s, d).join(people(s, d).select("actor", month_date(F.col("b") - 12).alias("cutoff")), "actor")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T12:30:00"), F.when(F.col("id") % 2 == 0, "Z").otherwise(""))
    day = F.to_date("ts")
    return tidy(o.select("id", v.side_of_cutoff(F.col("ts"), F.col("cutoff")).alias("side"), v.plus_months(day, (F.col("id") % 25).cast("int")).alias("later"), v.months_apart(day, F.col("cutoff")).alias("months"), F.date_format(v.iso_timestamp(iso), "yyyy-MM-dd HH:mm").alias("instant")))


def _months(s, d):
    text = F.when(F.col("id") % 3 > 0, F.concat(F.lit("the detector identified it in "), F.upper(F.date_format("ts", "MMMM")), F.lit(" 20"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit(", May 2031 aside"))).otherwise(F.lit("no month in 2024"))
    return act(s, d).select("id", v.month_in_text(text).alias("month"))


def _names(s, d):
    c = contrib(s, d).select("id", "line", F.concat(F.lit("owner"), F.col("owner").cast("string"), F.when(F.col("line") % 2 == 1, F.concat(F.lit("/p"), F.col("repo").cast("string"))).otherwise("")).alias("repo"), F.concat_ws("_", F.lit("activity"), F.lower("status"), F.concat((F.col("line") * 3).cast("string"), F.lit("m"))).alias("feature"))
    return c.select("id", "line", v.owner_of(F.col("repo")).alias("owner"), v.humanised(F.col("feature")).alias("label"))


def _preferred(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("actor"), (F.col("c_custkey") % 5 + 1).cast("string").alias("company"))
    labels = table(s, d, "orders").select(F.col("o_custkey").alias("actor"), F.substring("o_orderpriority", 1, 1).alias("company"), F.col("o_orderkey").alias("id"))
    return ln.preferred(c, labels, "actor", ["company"], ["company", "id"]).select("actor", "company", "l_company", "l_id")


def _leaks(s, d):
    repos = contrib(s, d).select("actor", F.concat(F.lit("Acme"), (F.col("owner") % 50).cast("string"), F.when(F.col("line") == 1, ".io").otherwise("-tools"), F.lit("/part"), F.col("repo").cast("string")).alias("repo"), (F.col("id") * 10 + F.col("line")).alias("ordinal"))
    own = people(s, d).select("actor", F.array(F.concat(F.lit("corp"), F.col("actor").cast("string"), F.lit(".com")), F.concat(F.lit("acme"), (F.col("actor") % 50).cast("string"), F.lit(".io"))).alias("domains"))
    return ln.domain_leaks(repos, own)


def _graded(s, d):
    rules = [("strong balance", F.col("c_acctbal") > 8000), ("strong segment", (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)), ("medium rare", F.col("c_custkey") % 97 == 0)]
    return ln.graded(table(s, d, "customer"), rules, "unconfirmed").groupBy("grade").agg(F.count("*").alias("n"))


def _snapshot(s, d):
    raw = table(s, d, "customer").select(F.col("c_custkey").alias("person"), "c_name")
    resolved = raw.filter("person % 2 = 0").select("person", F.concat(F.lit("u"), F.col("person").cast("string")).alias("login"), F.when(F.col("person") % 4 == 0, "profile").otherwise("search").alias("method"))
    return ln.founder_snapshot(raw, resolved)


def _strata(s, d):
    pilot = people(s, d).filter("actor % 4 = 0").select("actor", F.when(F.col("actor") % 8 == 0, "rising").otherwise("flat").alias("stratum"))
    return tidy(ln.strata(people(s, d).select("actor", "grp"), summary(s, d).select("actor", "peak"), pilot))


def _companies(s, d):
    k = F.col("s_suppkey")
    one = F.struct((k % 40).cast("string").alias("slug"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name"), F.when(k % 3 == 0, "unknown").otherwise(k.cast("string")).alias("team_size"), F.when(k % 2 == 0, F.to_json(F.array(F.lit("B2B"), F.col("s_nationkey").cast("string")))).alias("industries"), F.when(k % 2 == 1, "Consumer").alias("industry"))
    payload = table(s, d, "supplier").coalesce(1).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), one.alias("c")))), lambda x: x["c"])).alias("payload"))
    return ln.normalise_companies(payload, "payload").select("slug", "name", "team_size", F.array_join("industries", ",").alias("industries"))


def _claims(s, d):
    status = F.element_at(F.array(*map(F.lit, mm.TRUST)), (F.col("id") % 4 + 1).cast("int"))
    c = act(s, d).select("actor", "id", status.alias("status"), (F.col("id") % 10 / 10.0).alias("confidence"), F.when(F.col("id") % 11 == 0, F.col("id") % 5).otherwise(0).alias("contradictions"))
    x = mm.claim_axis(c, ["actor"])
    return tidy(x.withColumn("founder", mm.founder_axis((F.col("actor") % 100) / 100.0, F.col("claims"))))


def _provenance(s, d):
    claim = F.struct(F.col("id").cast("string").alias("claim"), F.array(F.concat(F.lit("activity:"), F.col("m").cast("string")), F.concat(F.lit("type:"), F.col("event_type"))).alias("refs"))
    memos = act(s, d).groupBy(F.col("actor").cast("string").alias("memo")).agg(F.collect_list(claim).alias("claims"))
    return mm.provenance(memos)


def _leaves(s, d):
    doc = F.struct(F.col("s_name").alias("name"), F.struct(F.array(F.lit("x"), F.lit(" "), F.col("s_nationkey").cast("string")).alias("tags")).alias("about"), F.create_map(F.lit("balance"), F.round("s_acctbal").cast("long").cast("string"), F.lit("none"), F.lit(None).cast("string")).alias("facts"))
    return mm.leaves(table(s, d, "supplier").select("s_suppkey", doc.alias("doc")), "s_suppkey", "doc")


def _titles(s, d):
    words = F.split("text", r"\s+")
    three = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("title_id"), F.array_join(F.slice(words, 1, 3), " ").alias("title"))
    one = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("title_id"), F.lit("the").alias("title")).filter("title_id = 'n1'")
    return ln.titles_linked(three.unionByName(one), table(s, d, "documents"))


def _records(s, d):
    """Records in the JSON of an HTML attribute, under the first such list at any depth."""
    people_ = F.array(F.struct(F.col("s_name").alias("name"), F.lit("R&D").alias("team")), F.struct(F.concat(F.lit("deputy of "), F.col("s_suppkey").cast("string")).alias("name"), F.lit("<ops>").alias("team")))
    document = F.to_json(F.struct(F.struct(F.lit(1).alias("id"), F.struct(people_.alias("people")).alias("company")).alias("props")))
    escaped = document
    for sign, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(entity))
    html = F.concat(F.lit('<html><div id="x" data-page="'), escaped, F.lit('"></div></html>'))
    found = table(s, d, "supplier").select("s_suppkey", nm.first_list("people")(tx.json_first(html, "data-page")).alias("j"))
    return found.select("s_suppkey", F.inline(F.from_json("j", "array<struct<name:string,team:string>>")))


def _logins(s, d):
    """Account names in the links of made-up search results."""
    k = F.col("c_custkey").cast("string")
    links = F.array(F.concat(F.lit("https://github.com/User"), k, F.lit("/repo")), F.lit("https://github.com/features"), F.concat(F.lit("http://www.github.com/user"), k), F.concat(F.lit("https://example.org/user"), k), F.concat(F.lit("https://github.com/other"), (F.col("c_custkey") % 3).cast("string"), F.lit("?tab=x")))
    return table(s, d, "customer").select("c_custkey", F.array_join(nm.logins_of(links, "github.com", ["features"]), ",").alias("logins"))


_W = r"array_to_string(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), ' ')"
_NULLS = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "documents": ["doc_id", "text", "lang", "source", "n_chars"]}
_MONTH = "list_position(['" + "', '".join(m.lower() for m in v.MONTH_NAMES) + "'], {})"

QUERIES = {
    "agreement_counts": _agreement,
    "survivorship_shares": _survivorship,
    "lead_cohorts": _lead,
    "component_drift": _drift,
    "text_eligibility": lambda s, d: op.text_eligible(act(s, d)),
    "admin_owners": lambda s, d: op.admin_owners(contrib(s, d), (F.col("flag") == "A") & (F.col("line") == 1)),
    "main_repositories": lambda s, d: op.main_repositories(_repositories(s, d).drop("gone")),
    "rotated_take": _rotated,
    "existence_probe": lambda s, d: op.exists_in({"purchases": table(s, d, "events").filter("event_type = 'purchase'"), "nation 99": table(s, d, "customer").filter("c_nationkey = 99"), "documents": table(s, d, "documents")}),
    "coverage_gaps": lambda s, d: op.covered(act(s, d).select("actor"), people(s, d), ["actor"]),
    "data_card": lambda s, d: op.card({t: table(s, d, t) for t in _NULLS}, {"orders": "o_orderdate"}),
    "cutoff_tags": _tags,
    "months_in_text": _months,
    "names_for_people": _names,
    "wire_transport": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(v.from_wire(v.over_wire(F.coalesce("text", F.lit("")))), 256).alias("sha256")),
    "preferred_label": _preferred,
    "domain_leaks": _leaks,
    "graded_evidence": _graded,
    "founder_snapshot": _snapshot,
    "pilot_strata": _strata,
    "company_rows": _companies,
    "claim_axis": _claims,
    "provenance_edges": _provenance,
    "document_leaves": _leaves,
    "title_grades": _titles,
    "html_records": _records,
    "search_logins": _logins,
}

_REPOS = "SELECT actor, repo, count(*) AS n, bool_or(flag = 'R') AS gone FROM contrib GROUP BY ALL"
ORACLES = {
    "agreement_counts": f"WITH x AS (SELECT quality::BIGINT AS a, (n_chars >= 1000)::BIGINT AS b FROM labels JOIN documents USING (doc_id)) SELECT a, b, count(*) AS n, {_r('(SELECT avg((a = b)::INT) FROM x)')} AS agreement FROM x GROUP BY a, b",
    "survivorship_shares": sql(f"SELECT segment, sum(n)::BIGINT AS repos, sum(k)::BIGINT AS dead, {_r('sum(k)::DOUBLE / sum(n)')} AS dead_share, count(*) AS actors, {_r('avg((k > 0)::INT)')} AS any_dead_share FROM (SELECT r.actor, c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE gone) AS k FROM r JOIN customer ON c_custkey = r.actor GROUP BY ALL) GROUP BY segment", "contrib", r=_REPOS),
    "lead_cohorts": sql("SELECT CASE WHEN detected IS NULL THEN 'undetected' WHEN month IS NULL THEN 'not yet' WHEN month > detected THEN 'after' WHEN month < detected THEN 'miss' ELSE 'same month' END AS cohort, count(*) AS n FROM found LEFT JOIN (SELECT actor, b - actor % 60 AS month FROM people WHERE actor % 3 = 0) USING (actor) GROUP BY 1", "scored", found=_FOUND),
    "component_drift": "SELECT actor, round(score, 2) + 0.0 AS score, round(total, 2) + 0.0 AS total FROM (SELECT o_custkey AS actor, sum(o_totalprice) AS total, round(sum(o_totalprice) + CASE WHEN o_custkey % 5 = 0 THEN 0.01::DOUBLE ELSE 0 END, 2) AS score FROM orders GROUP BY o_custkey) WHERE abs(total - score) > 0.001 + 1e-12",
    "text_eligibility": sql("SELECT actor, count(*) AS items, count(DISTINCT m // 3) AS quarters FROM act GROUP BY actor HAVING count(*) >= 20", "act"),
    "admin_owners": sql("SELECT actor, count(DISTINCT owner) AS owners, array_to_string(list_sort(list_distinct(list(owner))), ',') AS list FROM contrib WHERE flag = 'A' AND line = 1 AND owner <> actor GROUP BY actor", "contrib"),
    "main_repositories": sql("SELECT actor, repo, n, n = max(n) OVER w AS is_max, repo = min(CASE WHEN n = t THEN repo END) OVER w AS main FROM (SELECT *, max(n) OVER (PARTITION BY actor) AS t FROM r) WINDOW w AS (PARTITION BY actor)", "contrib", r=_REPOS),
    "rotated_take": "SELECT nation, actor, place FROM (SELECT c_nationkey::BIGINT AS nation, c_custkey AS actor, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 - 17) % count(*) OVER (PARTITION BY c_nationkey) + count(*) OVER (PARTITION BY c_nationkey)) % count(*) OVER (PARTITION BY c_nationkey) + 1 AS place FROM customer) WHERE place <= 5",
    "existence_probe": "SELECT 'purchases' AS part, count(*) > 0 AS found FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'nation 99', count(*) > 0 FROM customer WHERE c_nationkey = 99 UNION ALL SELECT 'documents', count(*) > 0 FROM documents",
    "coverage_gaps": "SELECT c_custkey AS actor FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "data_card": " UNION ALL ".join(f"SELECT '{t}' AS part, count(*) AS rows, {len(cols)}::BIGINT AS columns, ({' + '.join(f'count(*) - count({c})' for c in cols)})::BIGINT AS nulls, {'min(o_orderdate)::DATE' if t == 'orders' else 'NULL::DATE'} AS first_day, {'max(o_orderdate)::DATE' if t == 'orders' else 'NULL::DATE'} AS last_day FROM {t}" for t, cols in _NULLS.items()),
    "cutoff_tags": sql(f"SELECT id, CASE WHEN ts::DATE < cutoff THEN 'pre_cutoff' ELSE 'post_cutoff' END AS side, (ts::DATE + to_months((id % 25)::INT))::DATE AS later, {_r('datediff(' + chr(39) + 'day' + chr(39) + ', cutoff, ts::DATE) / 30.44::DOUBLE')} AS months, strftime(ts, '%Y-%m-%d') || ' 12:30' AS instant FROM act JOIN (SELECT actor, make_date((b - 12) // 12, (b - 12) % 12 + 1, 1) AS cutoff FROM people) USING (actor)", "act", "people"),
    "months_in_text": sql(f"SELECT id, CASE WHEN id % 3 > 0 THEN make_date((2000 + id % 100)::BIGINT, {_MONTH.format('lower(monthname(ts))')}::BIGINT, 1) END AS month FROM act", "act"),
    "names_for_people": sql("SELECT id, line, CASE WHEN line % 2 = 1 THEN 'owner' || owner END AS owner, 'Activity ' || upper(status) || ' Last ' || (line * 3) || ' Months' AS label FROM contrib", "contrib"),
    "wire_transport": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "preferred_label": "SELECT actor, company, l_company, l_id FROM (SELECT c_custkey AS actor, (c_custkey % 5 + 1)::VARCHAR AS company, substr(o_orderpriority, 1, 1) AS l_company, o_orderkey AS l_id, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_custkey % 5 + 1)::VARCHAR = substr(o_orderpriority, 1, 1) DESC, substr(o_orderpriority, 1, 1), o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey) WHERE k = 1",
    "domain_leaks": sql("SELECT actor, repo, domain, 'company_website_domain_in_pre_cutoff_repo_name' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ordinal, nth, repo) AS k FROM (SELECT c.actor, 'Acme' || (owner % 50) || CASE WHEN line = 1 THEN '.io' ELSE '-tools' END || '/part' || repo AS repo, id * 10 + line AS ordinal, nth, domain FROM contrib c JOIN (SELECT actor, unnest([0, 1]) AS nth, unnest(['corp' || actor || '.com', 'acme' || (actor % 50) || '.io']) AS domain FROM people) p ON p.actor = c.actor) WHERE contains(lower(repo), domain) OR list_has_any(list_filter(string_split_regex(lower(repo), '[/._-]+'), lambda x: x <> ''), [domain, split_part(domain, '.', 1)])) WHERE k = 1", "contrib", "people"),
    "graded_evidence": "SELECT CASE WHEN c_acctbal > 8000 THEN 'strong balance' WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'strong segment' WHEN c_custkey % 97 = 0 THEN 'medium rare' ELSE 'unconfirmed' END AS grade, count(*) AS n FROM customer GROUP BY 1",
    "founder_snapshot": "SELECT c_custkey AS person, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey END AS login, CASE WHEN c_custkey % 4 = 0 THEN 'profile' WHEN c_custkey % 2 = 0 THEN 'search' END AS method FROM customer",
    "pilot_strata": sql(f"SELECT s.actor, s.grp, {_r('s.peak')} AS peak, CASE WHEN s.actor % 8 = 0 THEN 'rising' WHEN s.actor % 4 = 0 THEN 'flat' ELSE 'new' END AS stratum FROM summary s", "scored", summary="SELECT actor, any_value(grp) AS grp, max(score) AS peak FROM scored GROUP BY actor"),
    "company_rows": "SELECT slug, name, team_size, industries FROM (SELECT (s_suppkey % 40)::VARCHAR AS slug, trim(s_name) AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS team_size, CASE WHEN s_suppkey % 2 = 0 THEN 'B2B,' || s_nationkey ELSE 'Consumer' END AS industries, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey) AS k FROM supplier) WHERE k = 1",
    "claim_axis": sql(f"SELECT actor, count(*) AS claims, {_r('1 + 9 * avg(w)')} AS axis, CASE WHEN sum(k) > 0 THEN 'declining' WHEN 2 * count(*) FILTER (WHERE id % 4 = 0) >= count(*) THEN 'improving' ELSE 'stable' END AS trend, {_r('1 + 9 * (0.78::DOUBLE * (actor % 100) / 100.0::DOUBLE + 0.22::DOUBLE * least(count(*) / 40.0::DOUBLE, 1.0::DOUBLE))')} AS founder FROM (SELECT *, (id % 10) / 10.0::DOUBLE * (CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.68 WHEN 2 THEN 0.32 ELSE 0.0 END)::DOUBLE * (1 - least(k * 0.16::DOUBLE, 0.48::DOUBLE)) AS w FROM (SELECT actor, id, CASE WHEN id % 11 = 0 THEN id % 5 ELSE 0 END AS k FROM act)) GROUP BY actor", "act"),
    "provenance_edges": sql("SELECT DISTINCT 'memo:' || actor AS source, 'claim:' || id AS target, 'states' AS kind FROM act UNION SELECT 'claim:' || id, 'activity:' || m, 'cites' FROM act UNION SELECT 'claim:' || id, 'type:' || event_type, 'cites' FROM act", "act"),
    "document_leaves": "SELECT s_suppkey, unnest(['doc.name', 'doc.about.tags[0]', 'doc.about.tags[2]', 'doc.facts.balance']) AS path, unnest([s_name, 'x', s_nationkey::VARCHAR, round(s_acctbal)::BIGINT::VARCHAR]) AS text FROM supplier",
    "html_records": "SELECT s_suppkey, unnest([s_name, 'deputy of ' || s_suppkey]) AS name, unnest(['R&D', '<ops>']) AS team FROM supplier",
    "search_logins": "SELECT c_custkey, 'User' || c_custkey || ',other' || (c_custkey % 3) AS logins FROM customer",
    "title_grades": f"WITH t AS (SELECT title_id, {_W.format('title')} AS title FROM (SELECT item_id::VARCHAR AS title_id, array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') AS title FROM benchmark UNION ALL SELECT 'n1', 'the')), d AS (SELECT doc_id, {_W.format('text')} AS body FROM documents) SELECT title_id, doc_id, CASE WHEN body = title THEN 'exact' WHEN starts_with(body || ' ', title || ' ') THEN 'start' ELSE 'inside' END AS grade FROM t JOIN d ON contains(' ' || body || ' ', ' ' || title || ' ') WHERE title <> ''",
}
