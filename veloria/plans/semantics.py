"""Queries of the semantic features, over annotations made up from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import panel as pn
from veloria.operators import semantics as op
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, people

_INTENTS = list(op.INTENT)


def _pick(values, index):
    """The value at an index; null beyond the last."""
    return F.try_element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def annotations(s, d, broken: bool = False):
    """One nested annotation a person and quarter; with ``broken`` some rules are violated."""
    x = act(s, d).groupBy("actor", F.floor(F.col("m") / 3).alias("q")).agg(F.count("*").alias("n"))
    a, q, n = F.col("actor"), F.col("q"), F.col("n")
    category, intent = _pick(op.BUILDING, (a + q) % 12), F.element_at(F.array(*map(F.lit, _INTENTS)), (n % 3 + 1).cast("int"))
    cites = F.when((a % 9 == 0) & F.lit(broken), F.array().cast("array<long>")).otherwise(F.array(n))
    scales = {f: F.when((a + n + k * q) % 5 < 4, (a + n + k * q) % 5) for k, f in enumerate(op.SCALES)}
    described = category.isNotNull() if not broken else category.isNotNull() & (a % 8 != 0)
    return x.select(
        "actor", "q", F.when((a + q) % 7 != 0, "ok").otherwise("failed").alias("status"),
        F.struct(category.alias("category"), F.when(described, F.concat(F.lit("work "), n.cast("string"))).alias("description"), cites.alias("citations")).alias("building_what"),
        F.struct(_pick(op.AUDIENCE, (3 * a + q) % 5).alias("value"), cites.alias("citations")).alias("audience_orientation"),
        F.struct(_pick(op.COLLABORATION, (a + 2 * q) % 5).alias("value"), cites.alias("citations")).alias("collaboration_posture"),
        *(F.struct((x_ + F.when((a % 10 == 0) & F.lit(broken), 4).otherwise(0)).alias("value"), cites.alias("citations")).alias(f) for f, x_ in scales.items()),
        F.struct(intent.alias("value"), F.when((intent == "explicit") & (F.lit(not broken) | (a % 6 != 0)), "we found").alias("quote"), cites.alias("citations")).alias("stated_founding_intent"),
    )


def _months(s, d):
    return pn.labelled(pn.spine(people(s, d))).select("actor", "m")


def _list(values):
    return "['" + "', '".join(values) + "']"


_ANNOTATED = f"""SELECT actor, q, (actor + q) % 7 <> 0 AS ok, {_list(op.BUILDING)}[(actor + q) % 12 + 1] AS building_what, {_list(op.AUDIENCE)}[(3 * actor + q) % 5 + 1] AS audience_orientation, {_list(op.COLLABORATION)}[(actor + 2 * q) % 5 + 1] AS collaboration_posture,
{', '.join(f'CASE WHEN (actor + n + {k} * q) % 5 < 4 THEN ((actor + n + {k} * q) % 5)::DOUBLE END AS {f}' for k, f in enumerate(op.SCALES))}, (n % 3)::DOUBLE AS stated_founding_intent, n FROM (SELECT actor, m // 3 AS q, count(*) AS n FROM act GROUP BY ALL)"""
_LEVELS = "SELECT actor, q, " + ", ".join(f"coalesce({f} = '{x}', false)::INT::DOUBLE AS {f}_{x}" for f, xs in (("building_what", op.BUILDING), ("audience_orientation", op.AUDIENCE), ("collaboration_posture", op.COLLABORATION)) for x in xs) + ", " + ", ".join([*op.SCALES, "stated_founding_intent"]) + " FROM an WHERE ok"
_CHANGED = "SELECT l.*, " + ", ".join(f"l.{c} - k.{c} AS {c}_delta" for c in op.level_names()) + " FROM lv l LEFT JOIN lv k ON k.actor = l.actor AND k.q = l.q - 1"
_ALL = {"an": _ANNOTATED, "lv": _LEVELS, "ch": _CHANGED}
# Fixed order: what each broken rule of the made-up annotations needs, in SQL.
_BROKEN = {
    "category and description go together": "building_what IS NOT NULL AND actor % 8 = 0",
    "a category needs citations": "building_what IS NOT NULL AND actor % 9 = 0",
    "explicit intent needs quote and citations": "n % 3 = 2 AND (actor % 6 = 0 OR actor % 9 = 0)",
    "implicit intent needs citations": "n % 3 = 1 AND actor % 9 = 0",
    **{f"{f} needs citations": f"{f} IS NOT NULL AND actor % 9 = 0" for f in ("audience_orientation", "collaboration_posture", *op.SCALES)},
    **{f"{f} is from 0 to 3": f"{f} IS NOT NULL AND actor % 10 = 0" for f in op.SCALES},
}

QUERIES = {
    "semantic_features": lambda s, d: tidy(op.with_changes(op.levels(annotations(s, d)))),
    "semantic_panel": lambda s, d: tidy(op.attach(_months(s, d), op.with_changes(op.levels(annotations(s, d))))),
    "annotation_violations": lambda s, d: op.violations(annotations(s, d, True)),
}

ORACLES = {
    "semantic_features": sql("SELECT * FROM ch", "act", **_ALL),
    "semantic_panel": sql("SELECT p.actor, p.m, ch.* EXCLUDE (actor, q) FROM panel p LEFT JOIN ch ON ch.actor = p.actor AND ch.q = p.m // 3", "panel", "act", **_ALL),
    "annotation_violations": sql(" UNION ALL ".join(f"SELECT actor, q, '{rule}' AS rule FROM an WHERE {where}" for rule, where in _BROKEN.items()), "act", an=_ANNOTATED),
}
