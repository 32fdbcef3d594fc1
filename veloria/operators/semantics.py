"""Features of validated quarterly annotations: levels, changes, and their months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloria.functions.values import coded

# The annotation's enumerations.
BUILDING = ["developer_tool", "application", "infrastructure", "data_ai", "security", "fintech", "health_bio", "hardware", "research", "content_community", "other"]
AUDIENCE = ["self", "developers", "end_users", "customers"]
COLLABORATION = ["solo", "contributing", "leading", "team_forming"]
SCALES = ["productization_markers", "commercial_language", "seriousness", "domain_shift"]
INTENT = {"none": 0.0, "implicit": 1.0, "explicit": 2.0}

_ONE_HOT = {"building_what": BUILDING, "audience_orientation": AUDIENCE, "collaboration_posture": COLLABORATION}


def level_names() -> list[str]:
    return [*(f"{field}_{v}" for field, values in _ONE_HOT.items() for v in values), *SCALES, "stated_founding_intent"]


def violations(annotations: DataFrame) -> DataFrame:
    """(actor, q, rule) of each rule of the nested document that a row breaks.

    annotations has a struct column for each field: building_what (category,
    description, citations), audience_orientation, collaboration_posture and the
    scales (value, citations), stated_founding_intent (value, quote, citations).
    """
    cited = lambda f: F.coalesce(F.size(F.col(f)["citations"]), F.lit(0)) > 0
    building, intent = F.col("building_what"), F.col("stated_founding_intent")
    rules = {
        "category and description go together": building["category"].isNull() != building["description"].isNull(),
        "a category needs citations": building["category"].isNotNull() & ~cited("building_what"),
        "a description has 240 signs at most": F.char_length(building["description"]) > 240,
        "an unknown category": building["category"].isNotNull() & ~building["category"].isin(BUILDING),
        "explicit intent needs quote and citations": (intent["value"] == "explicit") & ((F.coalesce(intent["quote"], F.lit("")) == "") | ~cited("stated_founding_intent")),
        "only explicit intent has a quote": (intent["value"] != "explicit") & intent["quote"].isNotNull(),
        "implicit intent needs citations": (intent["value"] == "implicit") & ~cited("stated_founding_intent"),
    }
    for f, allowed in {"audience_orientation": AUDIENCE, "collaboration_posture": COLLABORATION}.items():
        rules[f"{f} needs citations"] = F.col(f)["value"].isNotNull() & ~cited(f)
        rules[f"an unknown {f}"] = F.col(f)["value"].isNotNull() & ~F.col(f)["value"].isin(allowed)
    for f in SCALES:
        rules[f"{f} needs citations"] = F.col(f)["value"].isNotNull() & ~cited(f)
        rules[f"{f} is from 0 to 3"] = ~F.col(f)["value"].between(0, 3)
    broken = F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))
    return annotations.select("actor", "q", F.explode(F.array_compact(broken)).alias("rule"))


def levels(annotations: DataFrame) -> DataFrame:
    """24 levels of each valid person-quarter; an unknown intent fails the query, a missing scale stays null."""
    value = {"building_what": F.col("building_what")["category"], **{f: F.col(f)["value"] for f in ("audience_orientation", "collaboration_posture")}}
    hot = [F.coalesce(value[f] == v, F.lit(False)).cast("double").alias(f"{f}_{v}") for f, values in _ONE_HOT.items() for v in values]
    scales = [F.col(f)["value"].cast("double").alias(f) for f in SCALES]
    return annotations.filter("status = 'ok'").select("actor", "q", *hot, *scales, coded(F.col("stated_founding_intent")["value"], INTENT, "founding intent").alias("stated_founding_intent"))


def with_changes(rows: DataFrame) -> DataFrame:
    """Levels with their change from exactly the quarter before; null without one."""
    names = level_names()
    before = rows.select("actor", (F.col("q") + 1).alias("q"), *(F.col(c).alias(f"_{c}") for c in names))
    return rows.join(before, ["actor", "q"], "left").select(*rows.columns, *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in names))


def attach(months: DataFrame, features: DataFrame) -> DataFrame:
    """Months (actor, m, ...) with the features of the quarter that holds them; filled within the quarter only."""
    return months.withColumn("q", F.floor(F.col("m") / 3)).join(features, ["actor", "q"], "left").drop("q")
