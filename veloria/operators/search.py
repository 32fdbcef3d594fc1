"""A stored full-text index: several weighted columns, kinds of documents, prefix queries, snippets.

The index is three tables in a folder: ``postings`` (token, kind, doc_id and the
counts in each column, sorted by token, so that a prefix prunes row groups),
``sizes`` and ``texts``.  It is built beside its place, verified and published.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloria.operators.text import snippet, tokens
from veloria.sources.sinks import publish, write_json

# The columns of a document and what a hit in each is worth.
WEIGHTS = {"kind": 0.2, "ref": 0.5, "title": 5.0, "about": 2.0, "body": 1.0, "tags": 0.0}


def postings(docs: DataFrame) -> DataFrame:
    """(token, kind, doc_id, one count a column); each column is tokenised once."""
    own = lambda k, c: F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("token"), F.lit(k).alias("part")))
    parts = F.flatten(F.array(*(own(k, c) for k, c in enumerate(WEIGHTS))))
    x = docs.select("kind", "doc_id", F.inline(parts))
    return x.groupBy("token", "kind", "doc_id").agg(*(F.count_if(F.col("part") == k).alias(f"n_{c}") for k, c in enumerate(WEIGHTS)))


def build(docs: DataFrame, folder: str) -> dict:
    """Indexes docs (kind, ref, doc_id, title, about, body, tags) into a folder; returns its counts.

    (kind, doc_id) must be unique; the staged index is checked against the
    documents before it takes the old one's place.
    """
    spark, staged = docs.sparkSession, f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    docs.select("doc_id", *WEIGHTS).write.parquet(f"{staged}/texts")
    texts = spark.read.parquet(f"{staged}/texts")
    postings(texts).repartitionByRange("token").sortWithinPartitions("token", "kind", "doc_id").write.parquet(f"{staged}/postings")
    index = spark.read.parquet(f"{staged}/postings")
    total = sum((F.col(f"n_{c}") for c in WEIGHTS), F.lit(0))
    index.groupBy("kind", "doc_id").agg(F.sum(total).alias("size")).write.parquet(f"{staged}/sizes")
    sizes = spark.read.parquet(f"{staged}/sizes").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).head()
    own = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in WEIGHTS), F.lit(0))
    there = texts.agg(F.count("*").alias("n"), F.count_distinct("kind", "doc_id").alias("ids"), F.coalesce(F.sum(own), F.lit(0)).alias("tokens")).head()
    if there["tokens"] != sizes["tokens"] or there["ids"] != there["n"]:
        raise ValueError(f"the index holds {sizes['tokens']} tokens of {there['tokens']}, and {there['ids']} ids of {there['n']} documents")
    about = {"documents": there["n"], "tokens": there["tokens"]}
    write_json(spark, f"{staged}/about.json", about)
    publish(spark, staged, folder)
    return about


def find(spark: SparkSession, folder: str, query: str, *, kinds: list[str] | None = None, weights: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, limit: int = 50, marked: bool = False) -> DataFrame:
    """Documents that have a word with each of the query's prefixes, by column-weighted BM25; ``marked`` adds a snippet."""
    wanted = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    if not wanted:
        raise ValueError("an empty query")
    worth = WEIGHTS | (weights or {})
    index, sizes = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/sizes")
    n = spark.read.parquet(f"{folder}/texts").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("size").alias("tokens")).join(F.broadcast(n)).select("n", (F.col("tokens") / F.col("n")).alias("mean"))
    some = F.lit(False)
    for w in wanted:
        some = some | F.col("token").startswith(w)
    each = F.array_compact(F.array(*(F.when(F.col("token").startswith(w), F.lit(k)) for k, w in enumerate(wanted))))
    weighted = sum((F.lit(worth[c]) * F.col(f"n_{c}") for c in WEIGHTS), F.lit(0.0))
    hits = index.filter(some).select("kind", "doc_id", weighted.alias("w"), F.explode(each).alias("q")).groupBy("q", "kind", "doc_id").agg(F.sum("w").alias("f"))
    often = hits.groupBy("q").agg(F.count("*").alias("df"))
    x = hits.filter(F.col("kind").isin(kinds)) if kinds is not None else hits
    x = x.join(F.broadcast(often), "q").join(sizes, ["kind", "doc_id"]).join(F.broadcast(totals))  # one row a prefix; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = x.groupBy("kind", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("got")).filter(F.col("got") == len(wanted)).drop("got")
    best = scored.orderBy(F.desc(F.round("score", 6)), "kind", "doc_id").limit(limit)
    if not marked:
        return best
    texts = spark.read.parquet(f"{folder}/texts").select("kind", "doc_id", "title", snippet(F.col("body"), wanted[0]).alias("snippet"))
    return texts.join(F.broadcast(best), ["kind", "doc_id"])  # at most ``limit`` rows


def by_kind(hits: DataFrame) -> DataFrame:
    """Hits of each kind in the order of their scores, the kind of the best hit first."""
    row = F.struct((-F.round("score", 6)).alias("s"), "doc_id")
    g = hits.groupBy("kind").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))
    return g.select("kind", "best", "n", F.transform("rows", lambda x: x["doc_id"]).alias("doc_ids"))
