"""Queries of the audit and profile family."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import profile as op
from veloria.operators import text as tx
from veloria.plans.evaluation import scored
from veloria.plans.sqltext import sql
from veloria.plans.text import ORACLES as TEXT_ORACLES
from veloria.plans.text import _searchable
from veloria.sources.tables import act, table

_r = lambda x, n=6: f"round({x}, {n}) + 0.0"
_AT = 23960
_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
_EDGES = [0, 50000, 100000, 200000, 500000]

QUERIES = {
    "price_bands": lambda s, d: table(s, d, "orders").groupBy(op.band(F.col("o_totalprice"), _EDGES).alias("band")).agg(F.count("*").alias("n")),
    "label_shares": lambda s, d: tidy(op.shares(table(s, d, "labels"), ["quality"], ["toxic"])),
    "group_stats": lambda s, d: tidy(op.describe(table(s, d, "documents"), "lang", "n_chars", 1000), 4),
    "repeated_keys": lambda s, d: op.repeated_keys(table(s, d, "events"), ["user_id", "event_type"]),
    "null_audit": lambda s, d: op.audit(table(s, d, "orders"), _COLUMNS),
    "failure_window": lambda s, d: op.failure_windows(table(s, d, "events"), "event_type", ["ts", "event_id"], F.col("value") < 6, 100),
    "as_of_month": lambda s, d: tidy(op.as_of(scored(s, d), "actor", "m", "score", _AT)),
    "scrubbed_momentum": lambda s, d: tidy(op.mean_step(scored(s, d), "actor", "m", "score")),
    "quarter_bundles": lambda s, d: op.bundles(act(s, d).select("actor", F.floor(F.col("m") / 3).alias("quarter"), "id"), ["actor", "quarter"], "id", "id"),
    "search_grouped": lambda s, d: op.hits_by_kind(tx.search(_searchable(s, d), "the rest")),
}

ORACLES = {
    "price_bands": "SELECT CASE " + " ".join(f"WHEN o_totalprice >= {a} AND o_totalprice < {b} THEN '[{a},{b})'" for a, b in zip(_EDGES, _EDGES[1:], strict=False)) + " END AS band, count(*) AS n FROM orders GROUP BY 1",
    "label_shares": f"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, n, {_r('n::DOUBLE / sum(n) OVER (PARTITION BY quality)')} AS share FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)",
    "group_stats": f"SELECT lang, count(*) AS n, {_r('avg(n_chars)', 4)} AS mean, {_r('median(n_chars)', 4)} AS median, {_r('stddev_samp(n_chars)', 4)} AS sd, {_r('avg((n_chars >= 1000)::INT)', 4)} AS large_share FROM documents GROUP BY lang",
    "repeated_keys": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "null_audit": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} < 0) AS negatives FROM orders" for c in _COLUMNS),
    "failure_window": "SELECT event_type, ts, event_id, seen, failures FROM (SELECT event_type, ts, event_id, count(*) OVER w AS seen, count(*) FILTER (WHERE value < 6) OVER w AS failures FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) WHERE seen = 100 AND failures > 5",
    "as_of_month": sql(f"SELECT actor, max(m) AS month, {_r('max_by(score, m)')} AS value, count(*) AS rows FROM scored WHERE m <= {_AT} GROUP BY actor", "scored"),
    "scrubbed_momentum": sql(f"SELECT actor, m, {_r('CASE WHEN count(*) OVER w > 1 THEN (score - first_value(score) OVER w) / (count(*) OVER w - 1) ELSE 0 END')} AS step FROM scored WINDOW w AS (PARTITION BY actor ORDER BY m ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "scored"),
    "quarter_bundles": sql("SELECT actor, m // 3 AS quarter, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS items FROM act GROUP BY ALL", "act"),
    "search_grouped": f"SELECT kind, count(*) AS hits, string_agg(doc_id::VARCHAR, ',' ORDER BY score DESC, doc_id) AS doc_ids FROM ({TEXT_ORACLES['search_bm25']}) GROUP BY kind",
}
