"""Running sums and positions over a whole table without one task that sorts all of it.

Values are dealt into ``BUCKETS`` ranges by approximate quantiles (one row,
broadcast).  Sums of the ranges give each range's offset; a window runs within
a range only.  Quantiles only decide how even the ranges are: results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``_bucket``, which never falls as the key rises; null keys come first."""
    edges = rows.agg(F.percentile_approx(key, F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS))), 1000).alias("_e"))
    below = F.size(F.filter(F.coalesce("_e", F.array().cast("array<double>")), lambda e: e < F.col(key)))
    return rows.join(F.broadcast(edges)).withColumn("_bucket", F.when(F.col(key).isNull(), -1).otherwise(below)).drop("_e")  # one row of edges


def running(rows: DataFrame, key: str, values: list[str], by: list[str], falling: bool = True) -> DataFrame:
    """rows (one for each ``by`` and key) with c_<value>, summed up to and with the row, and t_<value>, the group's total."""
    order = (lambda c: F.col(c).desc()) if falling else (lambda c: F.col(c).asc())
    x = bucketed(rows, key)
    sums = x.groupBy(*by, "_bucket").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    before = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    whole = Window.partitionBy(*by)
    offsets = sums.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_bucket"]), *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values), *(F.sum(f"_s_{v}").over(whole).alias(f"t_{v}") for v in values))
    meet = F.col("_bucket") == F.col("_k__bucket")
    for c in by:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = x.join(offsets if by else F.broadcast(offsets), meet)
    within = Window.partitionBy(*by, "_bucket").orderBy(order(key))
    out = joined.select("*", *((F.sum(v).over(within) + F.col(f"_o_{v}")).alias(f"c_{v}") for v in values))
    return out.drop("_bucket", *(f"_k_{c}" for c in [*by, "_bucket"]), *(f"_o_{v}" for v in values))


def numbered(rows: DataFrame, key: str, ties: list[Column], name: str = "rank") -> DataFrame:
    """rows with their position from 1, the largest key first, ties in the given order; ``_all`` is their number."""
    x = bucketed(rows, key)
    counts = x.groupBy("_bucket").count()
    before = Window.partitionBy().orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS + 1 rows
    offsets = counts.select(F.col("_bucket").alias("_k"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"), F.sum("count").over(Window.partitionBy()).alias("_all"))
    own = Window.partitionBy("_bucket").orderBy(F.col(key).desc(), *ties)
    return x.join(F.broadcast(offsets), F.col("_bucket") == F.col("_k")).withColumn(name, F.row_number().over(own) + F.col("_o")).drop("_k", "_o", "_bucket")
