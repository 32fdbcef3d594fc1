"""Deterministic samples, keyed deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def stratified(rows: DataFrame, strata: list[str], key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows of each stratum in the order of a seeded hash (the group limit is pushed below the sort)."""
    order = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    return rows.withColumn("pick", F.row_number().over(order).cast("long")).filter(F.col("pick") <= size)


def uniform(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(size)


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the usual set operations on two one-column relations."""
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    parts = [count("union all", a.unionByName(b)), count("union", a.unionByName(b).distinct()), count("intersect", a.intersect(b)), count("except", a.subtract(b))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
