"""Memos as tables: claim scores, trends, provenance edges, sections as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The trust that each verification status earns.
TRUST = {"verified": 1.0, "single_source": 0.68, "unverified": 0.32, "not_disclosed": 0.0}


def claim_axis(claims: DataFrame, by: list[str]) -> DataFrame:
    """Axis of 1 to 10 and trend of each group of claims.

    claims: status, confidence, contradictions (their number).  A claim's weight
    is confidence x trust, less 0.16 of it a contradiction, 0.48 at most.  Any
    contradiction makes the trend decline; half verified or more, improve.
    """
    from veloria.functions.values import coded

    penalty = F.least(F.col("contradictions") * F.lit(0.16), F.lit(0.48))
    weight = F.col("confidence") * coded(F.col("status"), TRUST, "status") * (1 - penalty)
    g = claims.groupBy(*by).agg(F.avg(weight).alias("w"), F.sum("contradictions").alias("c"), F.count_if(F.col("status") == "verified").alias("v"), F.count("*").alias("claims"))
    trend = F.when(F.col("c") > 0, "declining").when(2 * F.col("v") >= F.col("claims"), "improving").otherwise("stable")
    return g.select(*by, "claims", (1 + 9 * F.col("w")).alias("axis"), trend.alias("trend"))


def founder_axis(score: Column, claims: Column) -> Column:
    """1 + 9 x (0.78 score + 0.22 of the claims, 40 at most)."""
    return 1 + 9 * (F.lit(0.78) * score + F.lit(0.22) * F.least(claims / F.lit(40.0), F.lit(1.0)))


def provenance(memos: DataFrame) -> DataFrame:
    """Edges (source, target, kind) from memos to claims and from claims to evidence.

    memos: memo, claims: array of (claim, refs).
    """
    claims = memos.select("memo", F.explode("claims").alias("c"))
    own = claims.select(F.concat(F.lit("memo:"), "memo").alias("source"), F.concat(F.lit("claim:"), "c.claim").alias("target"), F.lit("states").alias("kind"))
    refs = claims.select(F.concat(F.lit("claim:"), "c.claim").alias("source"), F.explode("c.refs").alias("target"), F.lit("cites").alias("kind"))
    return own.unionByName(refs).distinct()


def leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, text) of every text in a nested column: structs, arrays and maps of any depth.

    The schema is walked when the query is planned; rows stay in the JVM.
    """
    from pyspark.sql import types as T

    def walk(column: Column, kind: T.DataType, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*(walk(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind))
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(F.coalesce(column, F.array().cast(kind)), lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        if isinstance(kind, T.MapType):
            entries = F.coalesce(F.map_entries(column), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))
            return F.flatten(F.transform(entries, lambda e: walk(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
        return F.array_compact(F.array(F.when(column.isNotNull() & (F.trim(column.cast("string")) != ""), F.struct(path.alias("path"), column.cast("string").alias("text")))))

    return df.select(key, F.inline(walk(F.col(document), df.schema[document].dataType, F.lit(document))))
