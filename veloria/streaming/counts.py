"""Event-time windows as Structured Streaming (an extension of the batch operators).

Windows are appended to a table once the watermark has closed them, so state
holds no more than the open ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.sources.shared import shared_folder

#: The time of the mark that ends a bounded stream.
END = "2200-01-01 00:00:00"


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; a window closes when the watermark has passed it."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user, split where nothing happens for ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "events", files: int | None = None) -> DataFrame:
    """A table as a stream; times become instants in UTC, as watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def appended(result: DataFrame, table: str, checkpoint: str) -> None:
    """Adds what is closed by now to a Parquet table; a repeated call goes on where the last one ended."""
    query = result.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def drained(spark: SparkSession, folder: str, window: Callable[[DataFrame], DataFrame], name: str = "events", files: int | None = None) -> DataFrame:
    """All windows of a bounded stream, as a table in the shared folder.

    The stream is read to its end; then a mark far in the future moves the
    watermark past everything, which closes the windows that are still open.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{base}/marks")
    marks = spark.readStream.schema(schema).parquet(f"{base}/marks").withColumn("ts", F.col("ts").cast("timestamp"))
    result = window(stream(spark, folder, schema, name, files).unionByName(marks))
    appended(result, f"{base}/table", f"{base}/checkpoint")
    mark = spark.range(1).select(*(F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in schema))
    mark.write.mode("append").parquet(f"{base}/marks")
    appended(result, f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{base}/table")
