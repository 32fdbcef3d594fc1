"""Queries of the finer reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import draw, tidy
from veloria.operators import detail as op
from veloria.plans.evaluation import _FOUND, _SECOND, _SUMMARY, _found, _second, scored, summary
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, contrib, people, table

# Content classes and their patterns.
CONTENT = {"licence": r"(?i)licen[sc]e", "numbers": r"\d{2}", "lists": r"\n", "questions": r"\?", "long_words": r"[a-z]{9}"}
FLAGS = {"flag_a": "A", "flag_n": "N", "flag_r": "R"}
END = 1998 * 12 + 7
ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
_r = lambda x, n=6: f"round({x}, {n}) + 0.0"


def _context(s, d):
    return tidy(op.as_of_context(contrib(s, d).withColumn("kind", F.col("flag")), people(s, d), FLAGS, [12, 18, 24]))


def _series(s, d):
    return op.repository_series(contrib(s, d).filter(F.col("m") <= END), F.col("status") == "F")


def _rates(s, d):
    o = table(s, d, "orders").select(F.element_at(F.split("o_orderpriority", "-"), 1).alias("method"), F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderstatus") == "F").alias("resolved"))
    g = o.groupBy("method", "year").agg(F.count("*").alias("n"), F.avg(F.col("resolved").cast("double")).alias("rate"))
    return tidy(g, 4)


def _accounting(s, d):
    rows = people(s, d).join(act(s, d).groupBy("actor").agg(F.count("*").alias("n")), "actor", "left")
    return op.accounted(rows, [("not a positive", F.col("positive")), ("no activity", F.col("n") > 0), ("too early", F.col("b") > 2000 * 12), ("too quiet", F.col("n") >= 8)])


def _clients(s, d):
    c = table(s, d, "customer")
    return c.filter(F.lower("c_name").contains("customer#") & F.lower("c_name").contains("7") & (F.lower("c_mktsegment") == "building") & (F.col("c_acctbal") >= 1000)).select("c_custkey", "c_name", "c_acctbal")


def _odds(s, d):
    o = table(s, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if((F.col("o_orderstatus") == st) & big).alias(name) for name, st, big in (("a", "F", F.col("o_totalprice") > 150000), ("b", "F", F.col("o_totalprice") <= 150000), ("c", "O", F.col("o_totalprice") > 150000), ("e", "O", F.col("o_totalprice") <= 150000))))
    return tidy(o.select("o_orderpriority", (F.col("a") * F.col("e") / F.nullif(F.col("b") * F.col("c"), F.lit(0))).alias("odds")))


def _budget(s, d):
    return op.text_budget(table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", [F.desc("turn"), F.col("text")], 120, 3)


def _filled(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), F.coalesce("lang", F.lit("-")).alias("lang"))
    return op.filled_sample(docs, ["quality"], "lang", [F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")], 40)


def _named(s, d):
    c = contrib(s, d)
    return c.withColumn("name", F.concat(F.lit("Owner"), F.col("owner").cast("string"), F.when(F.col("repo") % 10 > 0, "/").otherwise("-"), F.lit("p"), F.col("repo").cast("string")))


def _universe(s, d):
    c = _named(s, d)
    owners = people(s, d).filter("positive").select(F.concat(F.lit("OWNER"), F.col("actor").cast("string")).alias("owner"))
    return op.universe(c.filter("flag = 'A'"), c.filter("line = 1"), owners)


def _rooms(s, d):
    counts = _named(s, d).filter("status = 'F'").groupBy("name").agg(F.count_distinct("actor").alias("actors"))
    return op.split_rooms(_universe(s, d), counts, 2)


def _checks(s, d):
    return op.column_checks(table(s, d, "customer"), ["c_name", "c_nationkey"], ["c_acctbal"], ["c_acctbal", "c_custkey"])


def _either(s, d):
    cohort = people(s, d).filter("positive").select(F.col("actor").alias("p"))
    c = contrib(s, d).select("id", "line", F.monotonically_increasing_id().alias("row"), F.array_distinct(F.array("actor", "owner")).alias("both"))
    held = c.select("id", "line", "row", F.explode("both").alias("p")).join(cohort, "p", "left_semi")
    return held.dropDuplicates(["row"]).select("id", "line")


def _accounts(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(k.alias("person"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    k, n = F.col("person"), F.col("n")
    score = op.account_score((k + n) % 4 == 0, (k * n) % 5 == 0, (k + 2 * n) % 3 == 0, ((k + n) % 10) / 9.0, k % 7 == 0, (k * n) % 13 == 0)
    return op.best_account(rows.select("person", F.concat(F.lit("acc"), n.cast("string")).alias("account"), score.alias("score")), "person", "account", "score")


def _top_detected(s, d):
    x = summary(s, d).join(_found(s, d).filter("detected is not null"), "actor")
    return tidy(x.orderBy(F.desc("current"), F.desc_nulls_last("momentum"), F.asc("actor")).limit(30).select("actor", "current", "momentum", "detected"))


def _excluded(s, d):
    out = table(s, d, "nation").select(F.upper("n_name").alias("x"))
    names = table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("nAtIoN_"), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name")).alias("name"))
    return names.join(out.select(F.lower("x").alias("_x")), F.lower("name") == F.col("_x"), "left_anti")


def _running(s, d):
    c = contrib(s, d).groupBy("actor", "repo").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("n"), "repo"))
    return c.withColumn("place", r.cast("long")).filter("place <= 6")


def _hybrid(s, d):
    x = summary(s, d).withColumn("newer", F.when(draw(3, "actor") == 0, F.col("current")))
    return tidy(x.select("actor", F.coalesce("newer", "peak").alias("hybrid")))


QUERIES = {
    "as_of_context": _context,
    "repository_series": _series,
    "repository_flags": lambda s, d: op.repository_flags(_series(s, d), END),
    "trajectory_trend": lambda s, d: tidy(op.trends(scored(s, d))),
    "content_ratios": lambda s, d: tidy(op.content_ratios(table(s, d, "documents").filter("text is not null"), "source", CONTENT)),
    "resolution_rates": _rates,
    "value_histogram": lambda s, d: op.histogram(table(s, d, "customer"), "c_acctbal", [0.0, 2500.0, 5000.0, 7500.0]),
    "drop_accounting": _accounting,
    "client_filters": _clients,
    "budget_metrics": lambda s, d: tidy(op.budget_metrics(summary(s, d))),
    "tie_diagnostics": lambda s, d: tidy(op.tie_diagnostics(summary(s, d), [10, 50])),
    "alpha_grid": lambda s, d: tidy(op.alpha_grid(_second(s, d), ALPHAS)),
    "frozen_ranks": lambda s, d: tidy(op.frozen_ranks(act(s, d), people(s, d), 2000 * 12, 6, 18)),
    "odds_ratio": _odds,
    "text_budget": _budget,
    "filled_sample": _filled,
    "repo_universe": _universe,
    "room_split": _rooms,
    "column_checks": _checks,
    "either_member": _either,
    "account_match": lambda s, d: tidy(_accounts(s, d)),
    "top_detected": _top_detected,
    "excluded_names": _excluded,
    "running_rank": _running,
    "hybrid_score": _hybrid,
}

_SERIES = f"SELECT repo, m, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS pushes, count(DISTINCT actor) AS actors FROM contrib WHERE m <= {END} GROUP BY ALL"
_HITS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {c}" for c, p in CONTENT.items())
_NAMED = "SELECT *, 'Owner' || owner || CASE WHEN repo % 10 > 0 THEN '/' ELSE '-' END || 'p' || repo AS name FROM contrib"
_UNIVERSE = "SELECT name, lower(split_part(name, '/', 1)) IN (SELECT 'owner' || actor FROM people WHERE positive) AS owned FROM (SELECT DISTINCT name FROM named WHERE flag = 'A' OR line = 1) WHERE regexp_matches(name, '^[^/]+/[^/]+$')"
_CUT = "CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'below 0.0' WHEN c_acctbal < 2500 THEN '0.0 to 2500.0' WHEN c_acctbal < 5000 THEN '2500.0 to 5000.0' WHEN c_acctbal < 7500 THEN '5000.0 to 7500.0' ELSE '7500.0 and above' END"
_ALL = {"summary": _SUMMARY}
ORACLES = {
    "as_of_context": sql(
        f"""SELECT a.actor, a.m, count(c.id) AS n, {', '.join(f"count(c.id) FILTER (WHERE c.flag = '{t}') AS {x}" for x, t in FLAGS.items())}, count(DISTINCT c.repo) AS repos, {_r('coalesce(avg(c.is_own::INT), 0)')} AS own_share, {_r('ln(1 + count(c.id))')} AS log_n, coalesce(a.m - min(c.m), 0) AS tenure, coalesce(a.m - max(c.m), 99) AS recency,
array_to_string(list_resize(coalesce(list(c.repo ORDER BY c.ts DESC, c.id DESC, c.line DESC, c.repo DESC) FILTER (WHERE c.id IS NOT NULL), []), 5, -1), ',') AS last_repos
FROM (SELECT actor, b, b - k AS m FROM people, (SELECT unnest([12, 18, 24]) AS k)) a LEFT JOIN contrib c ON c.actor = a.actor AND c.m < a.m AND c.m >= a.b - 62 GROUP BY a.actor, a.m""",
        "contrib", "people",
    ),
    "repository_series": sql(_SERIES, "contrib"),
    "repository_flags": sql(f"SELECT repo, max(n3) >= 10 AS hot, {END} - max(m) AS tail, count(*) FILTER (WHERE m > {END} - 6) AS active6, coalesce(max(gap), 0) AS silence FROM (SELECT *, sum(n) OVER (PARTITION BY repo ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, m - lag(m) OVER (PARTITION BY repo ORDER BY m) - 1 AS gap FROM series) GROUP BY repo", "contrib", series=_SERIES),
    "trajectory_trend": sql(f"SELECT actor, {_r('regr_slope(score, x)')} AS slope, count(*) AS months, CASE WHEN regr_slope(score, x) > 0.003 THEN 'improving' WHEN regr_slope(score, x) < -0.003 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT actor, score, row_number() OVER (PARTITION BY actor ORDER BY m) - 1 AS x FROM scored) GROUP BY actor", "scored"),
    "content_ratios": f"SELECT *, {', '.join(_r(f'{c}::DOUBLE / greatest(' + ' + '.join(o for o in CONTENT if o != c) + ', 1)') + f' AS {c}_ratio' for c in CONTENT)}, {_r('chars::DOUBLE / greatest(items, 1)')} AS mean_chars FROM (SELECT source, count(*) AS items, {_HITS}, sum(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL GROUP BY source)",
    "resolution_rates": f"SELECT split_part(o_orderpriority, '-', 1) AS method, year(o_orderdate) AS year, count(*) AS n, {_r('avg((o_orderstatus = ' + chr(39) + 'F' + chr(39) + ')::INT)', 4)} AS rate FROM orders GROUP BY ALL",
    "value_histogram": f"SELECT {_CUT} AS band, count(*) AS n FROM customer GROUP BY 1",
    "drop_accounting": sql("SELECT CASE WHEN NOT positive THEN 'not a positive' WHEN coalesce(n, 0) = 0 THEN 'no activity' WHEN b <= 24000 THEN 'too early' WHEN n < 8 THEN 'too quiet' ELSE 'selected' END AS outcome, count(*) AS n FROM people LEFT JOIN (SELECT actor, count(*) AS n FROM act GROUP BY actor) USING (actor) GROUP BY 1", "act", "people"),
    "client_filters": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name), 'customer#') AND contains(lower(c_name), '7') AND lower(c_mktsegment) = 'building' AND c_acctbal >= 1000",
    "budget_metrics": sql(f"SELECT {_r('sum(CASE WHEN r <= ceil(al * 0.1::DOUBLE) THEN positive::INT ELSE 0 END)::DOUBLE / sum(positive::INT)')} AS recall, {_r('avg(positive::INT) FILTER (WHERE r <= ceil(al * 0.01::DOUBLE)) / avg(positive::INT)')} AS lift, count(*) AS people FROM (SELECT positive, row_number() OVER (ORDER BY peak DESC, actor) AS r, count(*) OVER () AS al FROM summary)", "scored", **_ALL),
    "tie_diagnostics": sql("SELECT k::BIGINT AS k, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS tied, count(*) FILTER (WHERE n > 1 AND p > 0 AND p < n) AS mixed_ties, sum(CASE WHEN n > 1 AND cn > k AND cn - n < k THEN n ELSE 0 END)::BIGINT AS at_cut FROM (SELECT *, sum(n) OVER (ORDER BY peak DESC) AS cn FROM (SELECT peak, count(*) AS n, count(*) FILTER (WHERE positive) AS p FROM summary GROUP BY peak)), (SELECT unnest([10, 50]) AS k) GROUP BY k", "scored", **_ALL),
    "alpha_grid": sql(f"SELECT alpha, {_r('ap')} AS ap, alpha = (SELECT alpha FROM g ORDER BY round(ap, 9) DESC, alpha LIMIT 1) AS chosen FROM g", "scored", x=_SECOND.replace("SELECT actor, m, score", "SELECT actor, m, y, score", 1), e=f"SELECT alpha, m, y, round(alpha * ln(score / (1 - score)) + (1 - alpha) * ln(second / (1 - second)), 9) AS s FROM x, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)", c="SELECT *, sum(tp) OVER (PARTITION BY alpha, m ORDER BY s DESC) AS ctp, sum(n) OVER (PARTITION BY alpha, m ORDER BY s DESC) AS cn, sum(tp) OVER (PARTITION BY alpha, m) AS p, sum(n) OVER (PARTITION BY alpha, m) AS al FROM (SELECT alpha, m, s, count(*) AS n, sum(y) AS tp FROM e GROUP BY ALL)", g="SELECT alpha, sum(ap * positives) / sum(positives) AS ap FROM (SELECT alpha, m, sum(tp::DOUBLE / p * ctp / cn) FILTER (WHERE p > 0 AND p < al) AS ap, sum(tp) AS positives FROM c GROUP BY ALL) WHERE ap IS NOT NULL GROUP BY alpha"),
    "frozen_ranks": sql(f"SELECT CASE WHEN b - 24000 <= 6 THEN 'near' ELSE 'far' END AS horizon, count(*) AS people, {_r('quantile_cont(r::DOUBLE / al, 0.5)')} AS median_percentile FROM (SELECT actor, row_number() OVER (ORDER BY n DESC, actor) AS r, count(*) OVER () AS al FROM (SELECT actor, count(*) AS n FROM act WHERE m >= 23988 AND m < 24000 GROUP BY actor)) JOIN people USING (actor) WHERE positive AND b > 24000 AND b <= 24018 GROUP BY 1", "act", "people"),
    "odds_ratio": f"SELECT o_orderpriority, {_r('a::DOUBLE * e / nullif(b * c, 0)')} AS odds FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 150000) AS a, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice <= 150000) AS b, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 150000) AS c, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice <= 150000) AS e FROM orders GROUP BY 1)",
    "text_budget": "SELECT conv_id, turn, place, substr(text, 1, (120 // count(*) OVER (PARTITION BY conv_id))::BIGINT) AS excerpt FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS place FROM conversations) WHERE place <= 3",
    "filled_sample": "WITH d AS (SELECT doc_id, quality::BIGINT AS quality, coalesce(lang, '-') AS lang, sha256('3:' || doc_id) AS h FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY quality, lang ORDER BY h, doc_id) AS r, (SELECT count(DISTINCT lang) FROM d e WHERE e.quality = d.quality) AS s FROM d) SELECT doc_id, quality, lang, pick FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY (r > 40 // s)::INT, h, doc_id) AS pick FROM r WHERE r <= 40) WHERE pick <= 40",
    "repo_universe": sql(_UNIVERSE, "contrib", "people", named=_NAMED),
    "room_split": sql("SELECT name, owned, coalesce(actors, 0) AS actors, CASE WHEN coalesce(actors, 0) <= 2 THEN 'regular' ELSE 'capped' END AS room FROM u LEFT JOIN (SELECT name, count(DISTINCT actor) AS actors FROM named WHERE status = 'F' GROUP BY name) USING (name) WHERE owned OR coalesce(actors, 0) <= 2", "contrib", "people", named=_NAMED, u=_UNIVERSE),
    "column_checks": "SELECT unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_acctbal', 'c_custkey']) AS column, unnest(['not null', 'not null', 'not negative', 'positive', 'positive']) AS rule, unnest([count(*) FILTER (WHERE c_name IS NULL), count(*) FILTER (WHERE c_nationkey IS NULL), count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE NOT c_acctbal > 0 OR c_acctbal IS NULL), count(*) FILTER (WHERE NOT c_custkey > 0 OR c_custkey IS NULL)]) AS violations FROM customer",
    "either_member": sql("SELECT id, line FROM contrib WHERE actor IN (SELECT actor FROM people WHERE positive) OR owner IN (SELECT actor FROM people WHERE positive)", "contrib", "people"),
    "account_match": f"SELECT person, CASE WHEN score > 0 THEN account END AS account, {_r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, account) AS k FROM (SELECT c_custkey AS person, 'acc' || n AS account, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN (c_custkey + n) % 4 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN (c_custkey * n) % 5 = 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN (c_custkey + 2 * n) % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ((c_custkey + n) % 10) / 9.0::DOUBLE >= 0.9 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN (c_custkey * n) % 13 = 0 THEN 0.3::DOUBLE ELSE 0 END)), 6) AS score FROM customer, (SELECT unnest([1, 2, 3]) AS n))) WHERE k = 1",
    "top_detected": sql(f"SELECT actor, {_r('s.current')} AS current, {_r('s.momentum')} AS momentum, detected FROM summary s JOIN found USING (actor) WHERE detected IS NOT NULL ORDER BY s.current DESC, s.momentum DESC NULLS LAST, actor LIMIT 30", "scored", **_ALL, found=_FOUND),
    "excluded_names": "SELECT s_suppkey, name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'nAtIoN_' || s_nationkey ELSE s_name END AS name FROM supplier) WHERE lower(name) NOT IN (SELECT lower(n_name) FROM nation)",
    "running_rank": sql("SELECT actor, repo, n, place FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, repo) AS place FROM (SELECT actor, repo, count(*) AS n FROM contrib GROUP BY ALL)) WHERE place <= 6", "contrib"),
    "hybrid_score": sql(f"SELECT actor, {_r(chr(40) + 'CASE WHEN (' + chr(39) + '0x' + chr(39) + ' || substr(md5(actor::VARCHAR), 1, 8))::BIGINT % 3 = 0 THEN s.current ELSE s.peak END)')} AS hybrid FROM summary s", "scored", **_ALL),
}
