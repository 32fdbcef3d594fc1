"""Audits and profiles: bands, shares, nulls, repeated keys, sliding failure rates, views as of a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(value: Column, edges: list[float]) -> Column:
    """The half-open band [a,b) that holds the value; null outside of all."""
    out = F
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((value >= a) & (value < b), f"[{a},{b})")
    return out


def shares(rows: DataFrame, whole: list[str], part: list[str]) -> DataFrame:
    """Counts of each part and its share of the whole it belongs to."""
    counted = rows.groupBy(*whole, *part).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*whole)))


def describe(rows: DataFrame, by: str, value: str, large: float) -> DataFrame:
    """Mean, median, deviation and share of large values of each group."""
    v = F.col(value).cast("double")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.avg((v >= large).cast("double")).alias("large_share"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and negative values of each column, in one pass."""
    one = rows.agg(*(x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_0"), F.count_if(F.col(c) < 0).alias(f"{c}_1"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_0").alias("nulls"), F.col(f"{c}_1").alias("negatives")) for c in columns))))


def failure_windows(rows: DataFrame, by: str, order: list[str], failed: Column, size: int = 500, most: float = 0.05) -> DataFrame:
    """Rows at which more than a share of the last ``size`` rows of their stream failed, full windows only."""
    last = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - size, 0)
    x = rows.select(by, *order, F.count("*").over(last).alias("seen"), F.count_if(failed).over(last).alias("failures"))
    return x.filter((F.col("seen") == size) & (F.col("failures") > most * size))


def as_of(rows: DataFrame, by: str, month: str, value: str, at: int) -> DataFrame:
    """Each key's latest value at a month, with how many rows led there."""
    return rows.filter(F.col(month) <= at).groupBy(by).agg(F.max(month).alias("month"), F.max_by(value, month).alias("value"), F.count("*").alias("rows"))


def mean_step(rows: DataFrame, by: str, month: str, value: str, back: int = 3) -> DataFrame:
    """The mean step to each point from at most ``back`` points before it; 0 at the first."""
    w = Window.partitionBy(by).orderBy(month).rowsBetween(-back, 0)
    steps = F.count("*").over(w) - 1
    return rows.select(by, month, F.when(steps > 0, (F.col(value) - F.first(value).over(w)) / steps).otherwise(F.lit(0.0)).alias("step"))


def bundles(rows: DataFrame, by: list[str], order: str, item: str) -> DataFrame:
    """The items of each bundle in order, as one text, with their count."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["i"].cast("string")), ",").alias("items"))


def hits_by_kind(hits: DataFrame) -> DataFrame:
    """Search hits of each kind in the order of their rank."""
    parts = F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("o"), F.col("doc_id").alias("i"))))
    return hits.groupBy("kind").agg(F.count("*").alias("hits"), F.array_join(F.transform(parts, lambda x: x["i"].cast("string")), ",").alias("doc_ids"))
