"""Queries of the ingest family."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import conform, tidy
from veloria.operators import ingest as op
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, contrib, people, table

def _traction(s, d):
    return op.received(contrib(s, d), F.col("flag").isin("A", "N") | ((F.col("flag") == "R") & (F.col("line") == 1)))


def _positives(s, d):
    return people(s, d).filter("positive")


def _candidates(s, d):
    return op.hash_candidates(act(s, d), people(s, d), _positives(s, d))


def _totals(s, d):
    p = people(s, d)
    return op.actor_stats(act(s, d), p).join(p.filter("positive").select("actor", (F.col("b") - 12).alias("cutoff")), "actor")


def _band(s, d):
    return op.band_pairs(_totals(s, d), _candidates(s, d))


def _collapse(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") % 100).alias("actor"), (F.col("c_custkey") % 37).alias("cutoff"), F.col("c_mktsegment").alias("tag"), "c_name", "c_acctbal")
    return op.collapse(c, "actor", "cutoff", "tag", (F.trim("c_name") != "") & (F.col("c_acctbal") >= 0) & F.col("c_name").isNotNull())


def _violations(s, d):
    p, a = people(s, d), act(s, d)
    rows = op.in_window(a, p).withColumn("cutoff", F.col("b") - 12)
    monthly = op.monthly_activity(a, p)
    checks = [
        op.check("activity before cutoff", op.leakage(rows, "m", "cutoff")),
        op.check("monthly key unique", op.require_unique(monthly, "actor", "month", "event_type", "is_weekend")),
        op.check("no negative counts", monthly.filter(F.col("event_count").isNull() | (F.col("event_count") <= 0))),
        op.check("positives among candidates", _candidates(s, d).join(_positives(s, d), "actor", "left_semi")),
        op.check("late events exist", op.leakage(a.join(p, "actor").withColumn("cutoff", F.col("b") - 12), "m", "cutoff")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


_WINDOW = "a.m >= p.b - 60 AND a.m < p.b - 12"
_CAND = """SELECT e.actor, c.cutoff, count(*)::BIGINT AS total_events, any_value(f.y) AS first_seen_year, e.bucket
FROM (SELECT *, ('0x' || substr(md5(actor::VARCHAR), 1, 8))::BIGINT % 40 AS bucket FROM act) e
JOIN (SELECT DISTINCT b - 12 AS cutoff FROM people) c ON e.m < c.cutoff AND e.m >= c.cutoff - 48
JOIN (SELECT actor, min(year(ts)) AS y FROM act GROUP BY actor) f ON f.actor = e.actor
WHERE e.bucket < 3 AND e.actor NOT IN (SELECT actor FROM people WHERE positive) GROUP BY ALL HAVING count(*) >= 3"""
_STATS = f"SELECT q.actor, coalesce(t.total_events, 0)::BIGINT AS total_events, coalesce(t.y, 0)::BIGINT AS first_seen_year FROM people q LEFT JOIN (SELECT a.actor, count(*) FILTER (WHERE {_WINDOW}) AS total_events, min(year(a.ts)) AS y FROM act a JOIN people p USING (actor) GROUP BY a.actor) t USING (actor)"
_BAND = """SELECT p.actor AS positive, c.actor AS candidate, c.cutoff, row_number() OVER (PARTITION BY p.actor, c.cutoff ORDER BY md5(c.actor::VARCHAR), c.actor) AS order_rank
FROM cand c JOIN (SELECT s.*, p.b - 12 AS cutoff FROM stats s JOIN people p USING (actor) WHERE p.positive) p ON c.cutoff = p.cutoff
WHERE c.total_events >= 0.5 * p.total_events AND c.total_events <= 2 * p.total_events AND abs(c.first_seen_year - p.first_seen_year) <= 1"""
_SPLIT = """SELECT r.person, date_trunc('month', r.ts)::DATE AS month, count(*) FILTER (WHERE person = r.actor AND is_own) AS own, count(*) FILTER (WHERE person = r.actor AND NOT is_own) AS other,
count(DISTINCT r.actor) FILTER (WHERE person = owner AND r.actor <> owner) AS distinct_collab
FROM (SELECT *, unnest(list_distinct([actor, owner])) AS person FROM contrib) r JOIN people p ON p.actor = r.person GROUP BY ALL"""
_MONTHLY = "SELECT actor, date_trunc('month', ts)::DATE AS month, event_type, isodow(ts) IN (6, 7) AS is_weekend, make_date((b - 12) // 12, (b - 12) % 12 + 1, 1) AS t_cutoff, count(*) AS event_count FROM inwin GROUP BY ALL"

QUERIES = {
    "baseline_monthly_totals": lambda s, d: op.monthly_totals(act(s, d)),
    "monthly_activity": lambda s, d: op.monthly_activity(act(s, d), people(s, d)),
    "no_activity_sentinels": lambda s, d: op.no_activity_sentinels(act(s, d), people(s, d)),
    "owned_traction": _traction,
    "ownership_split_collab": lambda s, d: op.ownership_split(contrib(s, d), people(s, d)),
    "ownership_unpivot": lambda s, d: op.unpivot_ownership(op.ownership_split(contrib(s, d), people(s, d))),
    "repo_first_creations": lambda s, d: op.first_creations(contrib(s, d)),
    "actor_stats": lambda s, d: op.actor_stats(act(s, d), people(s, d)),
    "hash_sample_candidates": _candidates,
    "band_match_eligible": _band,
    "greedy_match": lambda s, d: op.greedy_match(_band(s, d), offset=op.MATCH_OFFSET),
    "cohort_collapse": _collapse,
    "leakage_violations": _violations,
    "schema_conform": lambda s, d: tidy(conform(table(s, d, "customer"), {"c_custkey": "string", "c_name": "int", "c_acctbal": "double", "c_nationkey": "long", "missing": "string"})),
}

ORACLES = {
    "baseline_monthly_totals": sql("SELECT date_trunc('month', ts)::DATE AS month, event_type, count(*) AS event_count FROM act GROUP BY ALL", "act"),
    "monthly_activity": sql(_MONTHLY, "inwin"),
    "no_activity_sentinels": sql("SELECT actor, make_date((b - 12) // 12, (b - 12) % 12 + 1, 1) AS month, '__NO_ACTIVITY__' AS event_type, 0::BIGINT AS event_count FROM people WHERE actor NOT IN (SELECT actor FROM inwin)", "inwin"),
    "owned_traction": sql("SELECT owner, date_trunc('month', ts)::DATE AS month, count(*) AS event_count FROM contrib WHERE actor <> owner AND (flag IN ('A', 'N') OR (flag = 'R' AND line = 1)) GROUP BY ALL", "contrib"),
    "ownership_split_collab": sql(_SPLIT, "contrib", "people"),
    "ownership_unpivot": sql("SELECT person, month, true AS is_own, own AS event_count FROM s WHERE own > 0 UNION ALL SELECT person, month, false, other FROM s WHERE other > 0", "contrib", "people", s=_SPLIT),
    "repo_first_creations": sql("SELECT actor, repo, min(ts) AS first_ts FROM contrib GROUP BY ALL", "contrib"),
    "actor_stats": sql(_STATS, "act", "people"),
    "hash_sample_candidates": sql(_CAND, "act", "people"),
    "band_match_eligible": sql(_BAND, "act", "people", cand=_CAND, stats=_STATS),
    "cohort_collapse": "SELECT c_custkey % 100 AS actor, min(c_custkey % 37) AS t_cutoff, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS tags FROM customer WHERE trim(c_name) <> '' AND c_acctbal >= 0 GROUP BY 1",
    "leakage_violations": sql("""SELECT 'activity before cutoff' AS "check", count(*) AS violations FROM inwin WHERE m >= b - 12
UNION ALL SELECT 'monthly key unique', count(*) FROM (SELECT 1 FROM monthly GROUP BY actor, month, event_type, is_weekend HAVING count(*) > 1)
UNION ALL SELECT 'no negative counts', count(*) FROM monthly WHERE event_count <= 0
UNION ALL SELECT 'positives among candidates', count(*) FROM cand WHERE actor IN (SELECT actor FROM people WHERE positive)
UNION ALL SELECT 'late events exist', count(*) FROM act JOIN people USING (actor) WHERE m >= b - 12""", "inwin", monthly=_MONTHLY, cand=_CAND),
    "schema_conform": "SELECT c_custkey::VARCHAR AS c_custkey, TRY_CAST(c_name AS BIGINT) AS c_name, round(c_acctbal, 6) AS c_acctbal, c_nationkey::BIGINT AS c_nationkey, NULL::VARCHAR AS missing FROM customer",
}
