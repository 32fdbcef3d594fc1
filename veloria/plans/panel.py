"""Queries of the panel family."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import panel as op
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, contrib, people

# Event classes of the panel.
CLASSES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unstated": "4-NOT SPECIFIED", "low": "5-LOW"}


# Received kinds, and the flag that stands for each.
RECEIVED = {"stars": "A", "forks": "N", "issues": "R"}


def rates(s, d):
    p = people(s, d)
    return op.per_million(act(s, d), p, CLASSES)


def counted(s, d):
    return op.monthly_counts(act(s, d), people(s, d), CLASSES)


def new_repositories(s, d):
    first = contrib(s, d).groupBy("actor", "repo").agg(F.min("m").alias("m"))
    return op.bounded(first, people(s, d)).groupBy("actor", "m").agg(F.count("*").alias("new_repos"))


def owned(s, d):
    return op.bounded(contrib(s, d).select("actor", "m", "is_own"), people(s, d)).groupBy("actor", "m").agg(F.count_if("is_own").alias("own"), F.count("*").alias("total"))


def received(s, d):
    """What others did on a person's repositories: distinct others, and events of each kind."""
    met = contrib(s, d).filter("actor != owner").select(F.col("owner").alias("actor"), "m", F.col("actor").alias("other"), "flag")
    return op.bounded(met, people(s, d)).groupBy("actor", "m").agg(F.count_distinct("other").alias("collab"), *(F.count_if(F.col("flag") == f).alias(f"received_{k}") for k, f in RECEIVED.items()))


def dense(s, d, *facts):
    return op.together(people(s, d), [f(s, d) for f in facts])


def flagship(s, d):
    kinds = list(CLASSES)
    rated = rates(s, d).select("actor", "m", *(F.col(c).alias(f"rate_{c}") for c in kinds))
    frame = op.with_begun(op.together(people(s, d), [rated, *(f(s, d) for f in (counted, new_repositories, owned, received))]))
    blocks = [*op.activity(kinds, "rate_"), *op.bursts(["n", "urgent"]), *op.repositories(), *op.weekend_and_tenure(), *op.ownership(), *op.traction(list(RECEIVED))]
    windows = frame.select("actor", "grp", "positive", "b", "m", "begun", *blocks, *op.compositions(kinds), op.history().alias("_history"))
    done = windows.select("*", op.gini(F.col("_history")), op.divergence(kinds)).drop("_history", "begun", *(f"{k}_{c}" for k in "rp" for c in kinds))
    labels = op.label_columns()
    return tidy(op.trimmed(done).select("actor", "m", "grp", "b", *labels, *done.columns[5:]))


def fold_audit(s, d):
    panel = op.labelled(op.spine(people(s, d)))
    return panel.groupBy("grp").agg(F.count_distinct("split").alias("folds"), F.bool_or("positive").alias("has_positive"), F.bool_or(~F.col("positive")).alias("has_control"), F.sum("y").alias("labels"))


def _w(first, last):
    frame = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING"
    return f"OVER (PARTITION BY actor ORDER BY m RANGE BETWEEN {frame(first)} AND {frame(last)})"


_EVER = "OVER (PARTITION BY actor ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TRIM = "WHERE m >= b - 48"


def _z(c):
    w = _w(-14, -3)
    return f"CASE WHEN max({c}) {w} IS NULL OR max({c}) {w} = min({c}) {w} THEN 0.0::DOUBLE ELSE (sum({c}) {_w(-2, 0)} / 3.0::DOUBLE - sum({c}) {w} / 12.0::DOUBLE) / sqrt(sum({c} * {c}) {w} / 12.0::DOUBLE - (sum({c}) {w} / 12.0::DOUBLE) * (sum({c}) {w} / 12.0::DOUBLE)) END"


def _share(num, den, first, last):
    w = _w(first, last)
    return f"CASE WHEN coalesce(sum({den}) {w}, 0) = 0 THEN 0.0::DOUBLE ELSE sum({num}) {w}::DOUBLE / sum({den}) {w} END"


def _r(x, digits):
    return f"round({x}, {digits}) + 0.0"


_RATES = "SELECT i.actor, i.m, " + ", ".join(f"sum(CASE WHEN i.event_type = '{t}' THEN i.n * 1e6::DOUBLE / t.total ELSE 0.0::DOUBLE END) AS {c}" for c, t in CLASSES.items()) + " FROM (SELECT actor, m, event_type, count(*) AS n FROM inwin GROUP BY ALL) i JOIN (SELECT m, event_type, count(*) AS total FROM act GROUP BY ALL) t USING (m, event_type) GROUP BY ALL"
_RATED = "SELECT s.*, " + ", ".join(f"coalesce(r.{c}, 0.0::DOUBLE) AS {c}" for c in CLASSES) + " FROM spine s LEFT JOIN rates r USING (actor, m)"
_TYPED = "SELECT s.*, coalesce(x.n, 0) AS n, coalesce(x.weekend, 0) AS weekend, " + ", ".join(f"coalesce(x.{c}, 0) AS {c}" for c in CLASSES) + " FROM spine s LEFT JOIN (SELECT actor, m, count(*) AS n, count(*) FILTER (WHERE isodow(ts) IN (6, 7)) AS weekend, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {c}" for c, t in CLASSES.items()) + " FROM inwin GROUP BY ALL) x USING (actor, m)"


def _activity_sql():
    out = []
    for c in CLASSES:
        out += [f"sum({c}) {_w(-(k - 1), 0)} AS {c}_{k}m" for k in (1, 3, 6, 12)]
        recent, prior = f"sum({c}) {_w(-2, 0)} / 3.0::DOUBLE", f"coalesce(sum({c}) {_w(-14, -3)} / 12.0::DOUBLE, 0.0::DOUBLE)"
        out += [f"({recent} + 1) / ({prior} + 1) AS {c}_ratio", f"{recent} - {prior} AS {c}_delta"]
    return f"SELECT actor, b, m, {', '.join(out)} FROM rated"


_ACT_COLUMNS = [f"{c}_{k}" for c in CLASSES for k in ("1m", "3m", "6m", "12m", "ratio", "delta")]
_REPOS = f"SELECT actor, b, m, sum(k) {_w(-2, 0)}::BIGINT AS new_3m, sum(k) {_w(-5, 0)}::BIGINT AS new_6m, sum(k) {_w(-11, 0)}::BIGINT AS new_12m, coalesce(m - max(CASE WHEN k > 0 THEN m END) {_EVER}, 49)::BIGINT AS months_since, sum(k) {_EVER}::BIGINT AS cumulative FROM (SELECT s.*, coalesce(x.k, 0) AS k FROM spine s LEFT JOIN (SELECT f.actor, f.m, count(*) AS k FROM (SELECT actor, repo, min(m) AS m FROM contrib GROUP BY ALL) f JOIN people p USING (actor) WHERE f.m >= p.b - 60 AND f.m < p.b - 12 GROUP BY ALL) x USING (actor, m))"
_WEEKEND = f"SELECT actor, b, m, {_share('weekend', 'n', -2, 0)} AS weekend_3m, {_share('weekend', 'n', -14, -3)} AS weekend_prior, {_share('weekend', 'n', -2, 0)} - {_share('weekend', 'n', -14, -3)} AS weekend_delta, coalesce(m - min(CASE WHEN n > 0 THEN m END) {_EVER} + 1, 0)::BIGINT AS tenure, (min(CASE WHEN n > 0 THEN m END) {_EVER} IS NULL)::BIGINT AS no_activity FROM typed"
_GINI = """SELECT s.actor, s.b, s.m, coalesce(g.gini, 0.0::DOUBLE) AS gini FROM spine s LEFT JOIN (
SELECT actor, m, CASE WHEN sum(v) > 0 THEN 2.0::DOUBLE * sum(rk * v) / (count(*) * sum(v)) - (count(*) + 1)::DOUBLE / count(*) ELSE 0.0::DOUBLE END AS gini FROM (
SELECT a.actor, a.m, h.n AS v, row_number() OVER (PARTITION BY a.actor, a.m ORDER BY h.n, h.m) AS rk FROM typed a JOIN typed h ON a.actor = h.actor AND h.m <= a.m
JOIN (SELECT actor, min(m) AS f FROM typed WHERE n > 0 GROUP BY actor) f ON f.actor = a.actor AND h.m >= f.f) GROUP BY ALL) g USING (actor, m)"""
_OWNERSHIP = f"SELECT actor, b, m, {_share('own', 'total', -2, 0)} AS own_3m, {_share('own', 'total', -2, 0)} - {_share('own', 'total', -14, -3)} AS own_delta, sum(collab) {_w(-2, 0)}::BIGINT AS collab_3m, sum(collab) {_w(-2, 0)} / 3.0::DOUBLE - coalesce(sum(collab) {_w(-14, -3)} / 12.0::DOUBLE, 0.0::DOUBLE) AS collab_delta, {_z('collab')} AS collab_z FROM (SELECT s.*, coalesce(o.own, 0) AS own, coalesce(o.total, 0) AS total, coalesce(k.collab, 0) AS collab FROM spine s LEFT JOIN (SELECT c.actor, c.m, count(*) FILTER (WHERE c.is_own) AS own, count(*) AS total FROM contrib c JOIN people p USING (actor) WHERE c.m >= p.b - 60 AND c.m < p.b - 12 GROUP BY ALL) o USING (actor, m) LEFT JOIN (SELECT c.owner AS actor, c.m, count(DISTINCT c.actor) AS collab FROM contrib c JOIN people p ON p.actor = c.owner WHERE c.actor <> c.owner AND c.m >= p.b - 60 AND c.m < p.b - 12 GROUP BY ALL) k USING (actor, m))"
_DIV = "SELECT actor, b, m, CASE WHEN m - 6 - begun + 1 >= 6 AND r2 > 0 AND p2 > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - dot / sqrt(r2 * p2))) END AS divergence FROM (SELECT actor, b, m, begun, " + " + ".join(f"r_{c} * p_{c}" for c in CLASSES) + " AS dot, " + " + ".join(f"r_{c} * r_{c}" for c in CLASSES) + " AS r2, " + " + ".join(f"p_{c} * p_{c}" for c in CLASSES) + f" AS p2 FROM (SELECT actor, b, m, min(CASE WHEN n > 0 THEN m END) {_EVER} AS begun, " + ", ".join(f"sum({c}) {_w(-5, 0)}::DOUBLE AS r_{c}, sum({c}) OVER (PARTITION BY actor ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)::DOUBLE AS p_{c}" for c in CLASSES) + " FROM typed))"
_RECEIVED = "SELECT s.*, " + ", ".join(f"coalesce(x.received_{k}, 0) AS received_{k}" for k in RECEIVED) + " FROM spine s LEFT JOIN (SELECT c.owner AS actor, c.m, " + ", ".join(f"count(*) FILTER (WHERE c.flag = '{f}') AS received_{k}" for k, f in RECEIVED.items()) + " FROM contrib c JOIN people p ON p.actor = c.owner WHERE c.actor <> c.owner AND c.m >= p.b - 60 AND c.m < p.b - 12 GROUP BY ALL) x USING (actor, m)"


def _traction_sql():
    out = []
    for k in RECEIVED:
        recent, prior = f"sum(received_{k}) {_w(-2, 0)} / 3.0::DOUBLE", f"coalesce(sum(received_{k}) {_w(-14, -3)} / 12.0::DOUBLE, 0.0::DOUBLE)"
        out += [f"sum(received_{k}) {_w(-2, 0)}::BIGINT AS traction_{k}_3m", f"sum(received_{k}) {_w(-11, 0)}::BIGINT AS traction_{k}_12m", f"({recent} + 1) / ({prior} + 1) AS traction_{k}_ratio", f"{recent} - {prior} AS traction_{k}_delta"]
    return f"SELECT actor, b, m, {', '.join(out)} FROM ({_RECEIVED})"


_BURST = f"SELECT actor, b, m, {_z('n')} AS n_z, {_z('urgent')} AS urgent_z FROM typed"
_BASE = {"rates": _RATES, "rated": _RATED, "typed": _TYPED}
_VIEWS = ("act", "inwin", "spine", "contrib")


def _pick(block, columns, ints, digits=6):
    return "SELECT actor, m, " + ", ".join(c if c in ints else f"{_r(c, digits)} AS {c}" for c in columns) + f" FROM {block} {_TRIM}"


_INTS = {"new_3m", "new_6m", "new_12m", "months_since", "cumulative", "tenure", "no_activity", "collab_3m", *(f"traction_{k}_{n}m" for k in RECEIVED for n in (3, 12))}
_BLOCKS = {
    "fa": (_activity_sql(), _ACT_COLUMNS), "fb": (_BURST, ["n_z", "urgent_z"]), "fr": (_REPOS, ["new_3m", "new_6m", "new_12m", "months_since", "cumulative"]),
    "fw": (_WEEKEND, ["weekend_3m", "weekend_prior", "weekend_delta", "tenure", "no_activity"]), "fg": (_GINI, ["gini"]), "fo": (_OWNERSHIP, ["own_3m", "own_delta", "collab_3m", "collab_delta", "collab_z"]), "fd": (_DIV, ["divergence"]),
    "ft": (_traction_sql(), [f"traction_{k}_{x}" for k in RECEIVED for x in ("3m", "12m", "ratio", "delta")]),
}


def _block(name):
    body, columns = _BLOCKS[name]
    return sql(_pick("x", columns, _INTS), *_VIEWS, **_BASE, x=body)


QUERIES = {
    "panel_spine": lambda s, d: op.labelled(op.spine(people(s, d))).select("actor", "m", "y", "split"),
    "panel_activity_windows": lambda s, d: tidy(op.block(dense(s, d, rates), op.activity(list(CLASSES)))),
    "panel_burst": lambda s, d: tidy(op.block(dense(s, d, counted), op.bursts(["n", "urgent"]))),
    "panel_repos": lambda s, d: tidy(op.block(dense(s, d, new_repositories), op.repositories())),
    "panel_traction": lambda s, d: tidy(op.block(dense(s, d, received), op.traction(list(RECEIVED)))),
    "panel_weekend_tenure": lambda s, d: tidy(op.block(dense(s, d, counted), op.weekend_and_tenure())),
    "panel_gini": lambda s, d: tidy(op.block(op.with_begun(dense(s, d, counted)).withColumn("h", op.history()), [op.gini(F.col("h"))])),
    "panel_ownership": lambda s, d: tidy(op.block(dense(s, d, owned, received), op.ownership())),
    "context_divergence": lambda s, d: tidy(op.block(op.with_begun(dense(s, d, counted)).select("*", *op.compositions(list(CLASSES))), [op.divergence(list(CLASSES))])),
    "flagship_panel": flagship,
    "fold_audit": fold_audit,
}

ORACLES = {
    "panel_spine": sql("SELECT actor, m, y, split FROM panel", "panel"),
    "panel_activity_windows": _block("fa"),
    "panel_burst": _block("fb"),
    "panel_repos": _block("fr"),
    "panel_traction": _block("ft"),
    "panel_weekend_tenure": _block("fw"),
    "panel_gini": _block("fg"),
    "panel_ownership": _block("fo"),
    "context_divergence": _block("fd"),
    "flagship_panel": sql("SELECT p.actor, p.m, p.grp, p.b, p.y, p.split, " + ", ".join(c if c in _INTS else f"{_r(c, 6)} AS {c}" for _, cols in _BLOCKS.values() for c in cols) + " FROM panel p " + " ".join(f"JOIN {n} USING (actor, m)" for n in _BLOCKS), *_VIEWS, "panel", **_BASE, **{n: f"SELECT * EXCLUDE (b) FROM ({body})" for n, (body, _) in _BLOCKS.items()}),
    "fold_audit": sql("SELECT grp, count(DISTINCT split) AS folds, bool_or(positive) AS has_positive, bool_or(NOT positive) AS has_control, sum(y)::BIGINT AS labels FROM panel GROUP BY grp", "panel"),
}
