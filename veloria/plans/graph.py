"""Queries of the graph family."""

from __future__ import annotations

from veloria.functions.columns import tidy
from veloria.operators import graph as op
from veloria.plans.panel import CLASSES
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, contrib, people, table

SMALL, CAP, ROOM = 30, 3, 500
CODES = {t: k + 1 for k, t in enumerate(CLASSES.values())}


def _edges(s, d):
    c = contrib(s, d)
    return op.edges(c, op.rooms(c, SMALL), CAP)


_MONTHLY = "SELECT repo, m, actor, count(*) AS n FROM contrib WHERE repo IN (SELECT repo FROM contrib GROUP BY repo HAVING bool_or(is_own) OR count(DISTINCT actor) <= 30) GROUP BY ALL"
_EDGES = "SELECT a.actor, t.actor AS neighbour, a.repo, a.m, a.n AS events, t.n AS neighbour_events FROM monthly a JOIN (SELECT *, row_number() OVER (PARTITION BY repo, m ORDER BY n DESC, actor) AS r FROM monthly) t ON t.repo = a.repo AND t.m = a.m AND t.r <= 3 WHERE a.actor <> t.actor"
_PAIRS = "SELECT actor, neighbour, min(m) AS first_m, max(m) AS last_m, count(DISTINCT m) AS months, count(DISTINCT repo) AS repos, sum(events)::BIGINT AS events, sum(neighbour_events)::BIGINT AS neighbour_events FROM edges GROUP BY ALL"
_M = {"monthly": _MONTHLY, "edges": _EDGES}
_r = lambda x, n=6: f"round({x}, {n}) + 0.0"

QUERIES = {
    "coactivity_edges": _edges,
    "neighbor_pairs": lambda s, d: op.pairs(_edges(s, d), people(s, d)),
    "degree_distribution": lambda s, d: tidy(op.degrees(op.pairs(_edges(s, d), people(s, d)))),
    "pair_onset": lambda s, d: op.onsets(contrib(s, d), people(s, d), ROOM),
    "ego_context": lambda s, d: tidy(op.ego(contrib(s, d), people(s, d))),
    "dark_repos": lambda s, d: op.dark(contrib(s, d), 4, 6),
    "quarter_deltas": lambda s, d: tidy(op.quarter_changes(act(s, d), CODES)),
    "identity_numbering": lambda s, d: op.pseudonyms(contrib(s, d)),
    "vector_cosine": lambda s, d: tidy(op.cosine_to_centroid(table(s, d, "embeddings"))),
}

ORACLES = {
    "coactivity_edges": sql("SELECT * FROM edges", "contrib", **_M),
    "neighbor_pairs": sql("SELECT p.*, coalesce(q.b <= p.first_m, false) AS known_before FROM pairs p LEFT JOIN people q ON q.actor = p.neighbour AND q.positive", "contrib", "people", **_M, pairs=_PAIRS),
    "degree_distribution": sql(f"SELECT count(*) AS actors, min(k) AS least, {_r('quantile_cont(k, 0.25)')} AS p25, {_r('quantile_cont(k, 0.5)')} AS p50, {_r('quantile_cont(k, 0.75)')} AS p75, {_r('quantile_cont(k, 0.9)')} AS p90, {_r('quantile_cont(k, 0.99)')} AS p99, max(k) AS most, {_r('avg(k)')} AS mean FROM (SELECT actor, count(DISTINCT neighbour) AS k FROM edges GROUP BY actor)", "contrib", **_M),
    "pair_onset": sql("SELECT actor, other, onset, b - onset AS lead, shared, CASE WHEN shared >= 2 THEN 'strong' WHEN b - onset >= 12 THEN 'early' ELSE 'late' END AS tier FROM (SELECT x.actor, y.actor AS other, x.b, min(greatest(x.f, y.f)) AS onset, count(*) AS shared FROM f x JOIN f y ON x.repo = y.repo AND x.actor < y.actor AND x.b = y.b GROUP BY ALL) WHERE onset < b", "contrib", "people", f="SELECT c.actor, c.repo, p.b, min(c.m) AS f FROM contrib c JOIN people p USING (actor) WHERE c.repo IN (SELECT repo FROM contrib GROUP BY repo HAVING bool_or(is_own) OR count(DISTINCT actor) <= 500) GROUP BY ALL"),
    "ego_context": sql(f"SELECT actor, count(*) AS events, {_r('avg(is_own::INT)')} AS own_share, count(DISTINCT repo) AS repos, any_value(b) - 12 - min(m) AS tenure, any_value(b) - 12 - max(m) AS recency, {_r('ln(1 + count(*))')} AS log_events, string_agg(repo::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= 5) AS last_repos FROM (SELECT c.*, p.b, row_number() OVER (PARTITION BY c.actor ORDER BY c.ts DESC, c.id DESC, c.line DESC, c.repo DESC) AS r FROM contrib c JOIN people p USING (actor) WHERE c.m < p.b - 12) GROUP BY actor", "contrib", "people"),
    "dark_repos": sql("SELECT repo, max(n3) >= 4 AS hot, (SELECT max(m) FROM contrib) - max(m) AS silence, max(n3) >= 4 AND (SELECT max(m) FROM contrib) - max(m) >= 6 AS dark FROM (SELECT repo, m, sum(n) OVER (PARTITION BY repo ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3 FROM (SELECT repo, m, count(*) AS n FROM contrib GROUP BY ALL)) GROUP BY repo", "contrib"),
    "quarter_deltas": sql("SELECT l.*, l.level - k.level AS delta FROM lv l LEFT JOIN lv k ON k.actor = l.actor AND k.q = l.q - 1", "act", lv="SELECT actor, m // 3 AS q, count(*) AS n, sum(CASE event_type " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in CODES.items()) + " END)::BIGINT AS level, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS is_{c}" for t, c in CODES.items()) + " FROM act GROUP BY ALL"),
    "identity_numbering": sql("SELECT actor, owner, (CASE WHEN own THEN 'OWN' ELSE 'P' END) || row_number() OVER (PARTITION BY actor, own ORDER BY f, owner) AS pseudonym FROM (SELECT actor, owner, min((ts, id, line)) AS f, bool_or(is_own) AS own FROM contrib GROUP BY ALL)", "contrib"),
    "vector_cosine": f"WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(x) AS c FROM e GROUP BY ALL) SELECT vec_id, {_r('CASE WHEN sum(x * x) > 0 AND sum(c * c) > 0 THEN sum(x * c) / sqrt(sum(x * x) * sum(c * c)) END')} AS cosine FROM e JOIN c USING (label, k) GROUP BY vec_id",
}
