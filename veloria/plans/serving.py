"""Queries of the serving and sampling families."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import evaluation as ev
from veloria.operators import sampling as sm
from veloria.operators import serving as op
from veloria.plans.evaluation import _SUMMARY, items, scored, summary
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, table


def _claims(s, d):
    o = table(s, d, "orders")
    key = F.col("o_orderkey")
    refs = F.array(F.concat(F.lit("e"), key.cast("string")), F.concat(F.lit("e"), (key * 3).cast("string")), F.when(key % 5 == 0, F.concat(F.lit("https://example.org/"), key.cast("string"))))
    claims = o.select(key.alias("claim"), F.filter(refs, lambda x: x.isNotNull()).alias("refs"))
    return op.resolve_claims(claims, o.select(F.concat(F.lit("e"), key.cast("string")).alias("ref")))


def _page(s, d):
    return op.page(summary(s, d), [F.desc("peak"), F.asc("actor")], 25, 50, F.col("positive"))


def _rerank(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("actor"), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_nationkey").isin(1, 2, 3, 4, 5, 6, 7) & F.col("c_acctbal").between(0, 5000)).alias("fit"))
    return op.rerank(ev.person_summary(scored(s, d)).join(c.hint("merge"), "actor"), F.col("fit"))


def _recognition(s, d):
    o = table(s, d, "orders")
    return op.recognition(o.select(F.col("o_custkey").alias("actor"), F.trunc("o_orderdate", "month").alias("month"), F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("label"), F.floor(F.col("o_totalprice") / 10000).alias("confidence")))


def _sql(s, d):
    table(s, d, "nation").createOrReplaceTempView("guarded_nation")
    return op.guarded_sql(s, "SELECT n_regionkey, count(*) AS nations FROM guarded_nation GROUP BY n_regionkey").select(F.col("n_regionkey").cast("long").alias("n_regionkey"), "nations")


_c = lambda x: f"least(greatest({x}, 1.0::DOUBLE), 10.0::DOUBLE)"
_r = lambda x, n=6: f"round({x}, {n}) + 0.0"
_S = {"summary": _SUMMARY}
_MONTH = "(m // 12) || '-' || lpad((m % 12 + 1)::VARCHAR, 2, '0')"
_ADJ = "round(peak * 0.7::DOUBLE + greatest(0.0::DOUBLE, 4 * coalesce(momentum, 0)) * 0.2::DOUBLE + fit::INT * 0.1::DOUBLE, 6)"

QUERIES = {
    "evidence_rollup": lambda s, d: op.evidence_rollup(act(s, d)),
    "claim_resolution": _claims,
    "evidence_filter": lambda s, d: op.evidence(table(s, d, "events"), kind="purchase", after="2024-01-05", before="2024-01-20", limit=200).select("event_id", "ts", "user_id"),
    "candidate_page": lambda s, d: tidy(_page(s, d)),
    "thesis_rerank": lambda s, d: tidy(_rerank(s, d)),
    "axis_screen": lambda s, d: tidy(op.axes(summary(s, d))),
    "timeline_clusters": lambda s, d: op.timeline(table(s, d, "events")),
    "recognition_best": _recognition,
    "health_counts": lambda s, d: op.health({t: table(s, d, t) for t in ("customer", "orders", "documents", "events")}),
    "guarded_sql": _sql,
    "dedupe_keep_first": lambda s, d: sm.keep_one(table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")), ["host"], [F.asc("page_id")]),
    "dedupe_keep_last": lambda s, d: sm.keep_one(table(s, d, "orders").select(F.col("o_custkey").alias("actor"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")), ["actor"], [F.desc("ts"), F.desc("id")]),
    "stratified_sample": lambda s, d: sm.stratified(items(s, d).select("doc_id", "lang", "y"), ["lang", "y"], "doc_id", 10, "11"),
    "uniform_sample": lambda s, d: sm.uniform(items(s, d).select("doc_id", "lang"), "doc_id", 50, "5"),
    "set_ops": lambda s, d: sm.set_counts(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"))),
}

ORACLES = {
    "evidence_rollup": sql(f"SELECT sha256('activity' || chr(31) || actor || chr(31) || {_MONTH}) AS evidence_id, actor, min(ts) AS ts, count(*) || ' events in ' || {_MONTH} AS detail FROM act GROUP BY actor, m", "act"),
    "claim_resolution": "WITH r AS (SELECT o_orderkey AS claim, unnest(['e' || o_orderkey, 'e' || (o_orderkey * 3), CASE WHEN o_orderkey % 5 = 0 THEN 'https://example.org/' || o_orderkey END]) AS ref FROM orders) SELECT claim, ref, CASE WHEN ref IN (SELECT 'e' || o_orderkey FROM orders) THEN 'evidence' WHEN regexp_matches(ref, '^https?://') THEN 'url' ELSE 'dangling' END AS resolved FROM r WHERE ref IS NOT NULL",
    "evidence_filter": "SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 200",
    "candidate_page": sql(f"SELECT actor, grp, positive, {_r('peak')} AS peak, {_r('current')} AS current, {_r('first_score')} AS first_score, {_r('momentum')} AS momentum, (SELECT count(*) FROM summary WHERE positive) AS total FROM summary WHERE positive ORDER BY summary.peak DESC, actor LIMIT 25 OFFSET 50", "scored", **_S),
    "thesis_rerank": sql("SELECT actor, adjusted + 0.0 AS adjusted, row_number() OVER (ORDER BY peak DESC, actor) AS rank_before, row_number() OVER (ORDER BY adjusted DESC, actor) AS rank, row_number() OVER (ORDER BY peak DESC, actor) - row_number() OVER (ORDER BY adjusted DESC, actor) AS rank_delta FROM x", "scored", **_S, x=f"SELECT *, {_ADJ} AS adjusted FROM (SELECT s.*, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4, 5, 6, 7) AND c_acctbal BETWEEN 0 AND 5000 AS fit FROM summary s JOIN customer ON c_custkey = actor)"),
    "axis_screen": sql(f"SELECT actor, {_r(_c('1 + 9 * (0.78::DOUBLE * peak + 0.22::DOUBLE * least(current / 0.4::DOUBLE, 1.0::DOUBLE))'))} AS founder, {_r(_c('1 + 9 * current'))} AS market, {_r(_c('1 + 9 * first_score / peak'))} AS idea, CASE WHEN momentum > 0.003::DOUBLE THEN 'improving' WHEN momentum < -0.003::DOUBLE THEN 'declining' ELSE 'stable' END AS trend FROM summary", "scored", **_S),
    "timeline_clusters": "SELECT day, sum(n)::BIGINT AS events, count(*) AS types, max(event_type) FILTER (WHERE r = 1) AS dominant, sum(sum(n)) OVER (ORDER BY day)::BIGINT AS so_far FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS r FROM (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)) GROUP BY day",
    "recognition_best": "SELECT actor, month, label FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY confidence DESC, month DESC, label DESC) AS r FROM (SELECT o_custkey AS actor, date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority || ':' || o_orderkey AS label, floor(o_totalprice / 10000) AS confidence FROM orders)) WHERE r = 1",
    "health_counts": " UNION ALL ".join(f"SELECT '{t}' AS part, count(*) AS rows FROM {t}" for t in ("customer", "orders", "documents", "events")),
    "guarded_sql": "SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS nations FROM nation GROUP BY ALL",
    "dedupe_keep_first": "SELECT min(page_id) AS page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages GROUP BY 2",
    "dedupe_keep_last": "SELECT actor, id, ts FROM (SELECT o_custkey AS actor, o_orderkey AS id, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "stratified_sample": sql("SELECT * FROM (SELECT doc_id, lang, y::BIGINT AS y, row_number() OVER (PARTITION BY lang, y ORDER BY sha256('11:' || doc_id), doc_id) AS pick FROM items) WHERE pick <= 10", "items"),
    "uniform_sample": sql("SELECT doc_id, lang FROM items ORDER BY md5('5:' || doc_id), doc_id LIMIT 50", "items"),
    "set_ops": "WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT l_suppkey AS k FROM lineitem) SELECT 'union all' AS op, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
}
