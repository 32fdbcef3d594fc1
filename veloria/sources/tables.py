"""Table sources and the analogue views that the person-event operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.functions.dates import month_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: one row an event of an actor."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderstatus").alias("action"), month_index("o_orderdate").alias("m"))


def contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of an actor on an owner's repository."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), F.col("o_custkey").alias("actor"), F.col("l_partkey").alias("repo"), F.col("l_suppkey").alias("owner"),
        F.col("l_shipdate").alias("ts"), month_index("l_shipdate").alias("m"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_suppkey") % 10 == F.col("o_custkey") % 10).alias("is_own"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort: matched groups of one positive and five controls; ``b`` is the batch month."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("actor"), F.col("c_name").alias("name"), F.floor(F.col("c_custkey") / 6).alias("grp"), (F.col("c_custkey") % 6 == 0).alias("positive"), (F.lit(1999 * 12) + F.floor(F.col("c_custkey") / 6) % 30).cast("long").alias("b"))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    r"""Tab-separated text with a header and ``\N`` for null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, or JSON (an array or one object a line), by suffix."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        reader = spark.read.option("multiLine", path.endswith(".json"))
        return (reader.schema(schema) if schema is not None else reader).json(path)
    return spark.read.parquet(path)


def read_collection(spark: SparkSession, *paths: str) -> DataFrame:
    """Several parquet collections united by name, missing columns as null."""
    frames = [spark.read.option("mergeSchema", "true").parquet(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal relation."""
    return spark.createDataFrame(rows, schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and sha256 of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites a parquet table through Spark's commit protocol."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def query_cached(spark: SparkSession, sql: str, folder: str) -> DataFrame:
    """The result of a query, kept under the sha256 of its text."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(sql.encode()).hexdigest()}.parquet"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        spark.sql(sql).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
