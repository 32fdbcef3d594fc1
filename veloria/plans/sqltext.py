"""Shared pieces of the SQL twins (the dialect of the checking engine)."""

from __future__ import annotations

VIEWS = {
    "act": "SELECT o_orderkey AS id, o_custkey AS actor, o_orderdate AS ts, o_orderpriority AS event_type, o_orderstatus AS action, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders",
    "contrib": "SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, o_custkey AS actor, l_partkey AS repo, l_suppkey AS owner, l_shipdate AS ts, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m, l_returnflag AS flag, l_linestatus AS status, l_suppkey % 10 = o_custkey % 10 AS is_own FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "people": "SELECT c_custkey AS actor, c_name AS name, c_custkey // 6 AS grp, c_custkey % 6 = 0 AS positive, (1999 * 12 + (c_custkey // 6) % 30)::BIGINT AS b FROM customer",
    "inwin": "SELECT a.*, p.b, p.positive FROM act a JOIN people p USING (actor) WHERE a.m >= p.b - 60 AND a.m < p.b - 12",
    "mc": "SELECT actor, m, count(*) AS n FROM inwin GROUP BY ALL",
    "spine": "SELECT p.actor, p.grp, p.positive, p.b, t.m FROM people p, LATERAL (SELECT unnest(generate_series(p.b - 62, p.b - 12)) AS m) t",
    "dense": "SELECT s.*, coalesce(mc.n, 0) AS n FROM spine s LEFT JOIN mc USING (actor, m)",
    "panel": "SELECT actor, grp, positive, b, m, (positive AND m BETWEEN b - 15 AND b - 12)::BIGINT AS y, CASE WHEN b < 2000 * 12 THEN 'train' WHEN b < 2001 * 12 THEN 'valid' ELSE 'test' END AS split FROM spine WHERE m >= b - 48",
    "counted": "SELECT *, sum(n) OVER (PARTITION BY actor ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, sum(n) OVER (PARTITION BY actor ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS n12 FROM dense",
    "scored": "SELECT p.actor, p.grp, p.positive, p.b, p.m, p.y, p.split, round(0.02::DOUBLE + 0.9::DOUBLE * (2 * c.n3 + c.n12 + p.actor % 3) / (2 * c.n3 + c.n12 + p.actor % 3 + 10), 4) AS score FROM panel p JOIN counted c USING (actor, m)",
    "summary": "SELECT actor, any_value(grp) AS grp, bool_or(positive) AS positive, max(score) AS peak, max_by(score, m) AS current, min_by(score, m) AS first_score, (max_by(score, m) - max(score) FILTER (WHERE m = b - 14)) / 2 AS momentum FROM scored GROUP BY actor",
    "items": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality AS y, round(least(1.0::DOUBLE, length(d.text)::DOUBLE / 4000), 2) AS score FROM documents d JOIN labels l USING (doc_id)",
}
_NEEDS = {
    "inwin": ["act", "people"], "mc": ["inwin"], "spine": ["people"], "dense": ["spine", "mc"], "panel": ["spine"], "counted": ["dense"], "scored": ["panel", "counted"], "summary": ["scored"],
}


def _all(name: str, seen: list[str]) -> None:
    for n in _NEEDS.get(name, ()):
        _all(n, seen)
    if name not in seen:
        seen.append(name)


def sql(body: str, *views: str, **more: str) -> str:
    """body with the named views, what they need, and further ones in order, as common tables."""
    names: list[str] = []
    for v in views:
        _all(v, names)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
