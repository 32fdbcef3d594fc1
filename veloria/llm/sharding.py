"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  Groups are
sorted by size and each goes to the least-loaded shard, kept in a heap.

The heap runs over a bounded number of items, however many documents there
are: groups of at least 1/(shards x ``FINE``) of all bytes are items of
their own (there cannot be more than shards x FINE of them), and all smaller
groups are dealt by a hash into shards x FINE bundles, each an item.  A
bundle is about 1/FINE of a shard and the heap evens out what differs.

Slots number a shard's rows without gaps: an item's rows are split into cells
of about ``CELL_ROWS`` by a hash of the id and of the row's place in the stored
table (so that rows with one id, or none, are split too), cells get running
offsets from their counts, and rows are numbered within their cell, so no task
sorts a whole shard or a whole group.

Defined results: a null text counts as an empty one (size 16) and belongs to
the group of empty texts; repeated rows get slots of their own; a null id is
dealt like any other; an empty table gives an empty table; columns other than
the id are not carried along (join them by the id).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloria.llm.blocks import stored

#: Items of the heap for each shard, for large groups and for bundles.
FINE = 256
#: Rows of a cell, on average.
CELL_ROWS = 400
#: Added to each text's bytes.
OVERHEAD = 16


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The shard of each item (size, item): largest first, to the least-loaded shard."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, *, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g1"), F.xxhash64(F.lit(1), body).alias("g2"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows)
    groups = stored(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes")).head()[0] or 0
    most = shards * FINE
    large = groups.filter(F.col("bytes") * most >= total).orderBy("g1", "g2").collect()  # at most shards x FINE
    of_large = spark.createDataFrame([(r.g1, r.g2, k + most) for k, r in enumerate(large)], "g1 long, g2 long, large int")
    bundle = F.pmod(F.col("g1"), F.lit(most)).cast("int")
    small = groups.filter(F.col("bytes") * most < total).groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()  # at most shards x FINE
    items = [(r.bytes, k + most, r.n) for k, r in enumerate(large)] + [(r.bytes, r.item, r.n) for r in small]
    shard = longest_first([(b, i) for b, i, _ in items], shards)
    of_item = spark.createDataFrame([(i, shard[i], max(1, -(-n // CELL_ROWS))) for _, i, n in items], "item int, shard int, cells int")

    dealt = rows.join(F.broadcast(of_large), ["g1", "g2"], "left").withColumn("item", F.coalesce("large", bundle)).join(F.broadcast(of_item), "item")
    dealt = stored(dealt.select("id", "size", "text_crc32", "item", "shard", F.pmod(F.xxhash64("id", "size", "row"), F.col("cells")).cast("int").alias("cell"), "row"))
    cells = dealt.groupBy("shard", "item", "cell").count()
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("item", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("item", "cell").orderBy("id", "text_crc32", "row")
    numbered = dealt.withColumn("k", F.row_number().over(within) - 1).join(cells, ["item", "cell"])
    return numbered.select(F.col("id").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents in 40 shards of nearly equal bytes."""
    done = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shards=40)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
