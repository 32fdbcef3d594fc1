"""Checks and counts over derived tables: agreement, survivorship, lead cohorts, drift, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_none(violations: DataFrame, what: str) -> None:
    """Fails with the first violations, if there is any."""
    if rows := violations.limit(3).collect():  # three rows, for the message
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How often each pair of values meets, and the share of rows in which both agree."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    whole = pairs.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    return pairs.join(F.broadcast(whole))  # one row


def survivorship(repos: DataFrame, by: str, dead: Column) -> DataFrame:
    """Shares of dead repositories, and of actors with one at least, by a class of actors.

    repos has actor, the class and what ``dead`` needs; one row a repository of an actor.
    """
    actors = repos.groupBy("actor", by).agg(F.count("*").alias("n"), F.count_if(dead).alias("d"))
    return actors.groupBy(by).agg(F.sum("n").alias("repos"), F.sum("d").alias("dead"), (F.sum("d") / F.sum("n")).alias("dead_share"), F.count("*").alias("actors"), F.avg((F.col("d") > 0).cast("double")).alias("any_dead_share"))


def lead_cohorts(found: DataFrame, recognised: DataFrame) -> DataFrame:
    """Detections that were recognised later, in the same month, earlier (a miss), or not yet.

    found: actor, detected (months, may be null); recognised: actor, month.
    """
    lead = F.col("month") - F.col("detected")
    cohort = F.when(F.col("detected").isNull(), "undetected").when(F.col("month").isNull(), "not yet").when(lead > 0, "after").when(lead < 0, "miss").otherwise("same month")
    return found.join(recognised.select("actor", "month"), "actor", "left").groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"))


def component_drift(scores: DataFrame, components: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Actors whose components do not add up to their score; those without components are left out."""
    total = components.groupBy("actor").agg(F.sum("contribution").alias("total"))
    return scores.join(total, "actor").filter(F.abs(F.col("total") - F.col("score")) > F.lit(tolerance + 1e-12)).select("actor", "score", "total")


def text_eligible(items: DataFrame, least: int = 20) -> DataFrame:
    """Actors with enough items, with their items and distinct quarters."""
    return items.groupBy("actor").agg(F.count("*").alias("items"), F.count_distinct(F.floor(F.col("m") / 3)).alias("quarters")).filter(F.col("items") >= least)


def admin_owners(events: DataFrame, evidence: Column) -> DataFrame:
    """Owners other than themselves for whom an actor has shown an administrator's rights."""
    return events.filter(evidence & F.col("owner").isNotNull() & (F.col("owner") != F.col("actor"))).groupBy("actor").agg(F.array_sort(F.collect_set("owner")).alias("_o")).select("actor", F.size("_o").cast("long").alias("owners"), F.array_join(F.transform("_o", lambda x: x.cast("string")), ",").alias("list"))


def main_repositories(repos: DataFrame) -> DataFrame:
    """Each repository's rows with whether it has its actor's most events, and the first such one by name."""
    own = Window.partitionBy("actor")
    x = repos.withColumn("is_max", F.col("n") == F.max("n").over(own))
    return x.withColumn("main", F.min(F.when(F.col("is_max"), F.col("repo"))).over(own) == F.col("repo"))


def rotated(rows: DataFrame, by: list[str], order: list[Column], offset: int, k: int) -> DataFrame:
    """The first k rows of each group's list after turning it by ``offset`` places (modulo its length)."""
    n, r = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", (F.pmod(r - 1 - F.lit(offset), n) + 1).cast("long")).filter(F.col("place") <= k)


def exists_in(parts: dict[str, DataFrame]) -> DataFrame:
    """Whether each part has a row; of each no more than one is read."""
    out = None
    for name, df in parts.items():
        row = df.limit(1).agg((F.count("*") > 0).alias("found")).select(F.lit(name).alias("part"), "found")
        out = row if out is None else out.unionByName(row)
    return out


def covered(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keys that rows do not cover."""
    return keys.select(*on).distinct().join(rows.select(*on), on, "left_anti")


def card(parts: dict[str, DataFrame], time: dict[str, str] | None = None) -> DataFrame:
    """A data card's facts: rows, columns, nulls of each table, and the span of its time column."""
    out = None
    for name, df in parts.items():
        t = (time or {}).get(name)
        nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        span = [F.min(F.to_date(t)).alias("first_day"), F.max(F.to_date(t)).alias("last_day")] if t else [F.lit(None).cast("date").alias("first_day"), F.lit(None).cast("date").alias("last_day")]
        row = df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls"), *span).select(F.lit(name).alias("part"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "nulls", "first_day", "last_day")
        out = row if out is None else out.unionByName(row)
    return out


def card_text(facts: DataFrame, title: str) -> str:
    """A card as Markdown; one line a table."""
    lines = [f"# {title}", "", "| part | rows | columns | nulls | first day | last day |", "|-|-|-|-|-|-|"]
    for r in facts.orderBy("part").collect():  # one row a table
        lines.append(f"| {r['part']} | {r['rows']} | {r['columns']} | {r['nulls']} | {r['first_day'] or '-'} | {r['last_day'] or '-'} |")
    return "\n".join(lines) + "\n"
