"""Connectors that need no network of their own: SQLite, paged text, injected transports, limits.

A transport is a function from a request to bytes; whoever has a network passes
one in.  Results are kept by the request's sha256.
"""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SlidingLimit:
    """At most ``most`` calls in any ``seconds``; ``wait`` sleeps until the next is allowed."""

    def __init__(self, most: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep, self.calls = most, seconds, clock, sleep, deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.most:
                self.calls.append(now)
                return
            self.sleep(self.calls[0] + self.seconds - now)


class TooManyRows(Exception):
    """A transport's sign that a request must be made smaller."""


def remote_query(spark: SparkSession, sql: str, schema: str, transport: Callable[[str], bytes], folder: str, retries: int = 3, limit: SlidingLimit | None = None) -> DataFrame:
    r"""The rows of a remote statement (tab-separated with names, ``\N`` for null), kept by the statement's sha256."""
    from veloria.sources.sinks import _path, write_text
    from veloria.sources.tables import read_tsv

    path = f"{folder}/{hashlib.sha256(sql.encode()).hexdigest()}.tsv"
    fs, kept = _path(spark, path)
    if not fs.exists(kept):
        for attempt in range(retries):
            if limit is not None:
                limit.wait()
            try:
                write_text(spark, path, transport(sql).decode("utf-8", "replace"))
                break
            except OSError:
                if attempt == retries - 1:
                    raise
    return read_tsv(spark, path, schema)


def bisected(keys: list, fetch: Callable[[list], pd.DataFrame], most: int = 1000) -> Iterator[pd.DataFrame]:
    """Answers for all keys; a request that is too large is halved until it fits, a single key's failure is raised."""
    todo = deque(keys[k : k + most] for k in range(0, len(keys), most))
    while todo:
        own = todo.popleft()
        try:
            yield fetch(own)
        except (TooManyRows, TimeoutError, MemoryError):
            if len(own) == 1:
                raise
            todo.extendleft([own[len(own) // 2 :], own[: len(own) // 2]])


class SqliteSource(DataSource):
    """A read-only table of an SQLite file: ``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``.

    The file must be where executors can read it.  Rows are dealt by rowid ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with self._connect() as db:
            rows = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], kinds.get(r[2].upper(), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema: T.StructType):
        self.source, self.names, self.parts = source, schema.names, int(source.options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with self.source._connect() as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.source.options["table"]}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition):
        columns = ", ".join(f'"{c}"' for c in self.names)
        with self.source._connect() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.source.options["table"]}" WHERE rowid BETWEEN ? AND ?', partition.value)


def pages_of(files: DataFrame, text: str = "value") -> DataFrame:
    """One row a page that is not blank, of texts whose pages end in form feeds; pages count from 1."""
    x = files.select(*(c for c in files.columns if c != text), F.posexplode(F.split(text, "\f")).alias("_p", "text"))
    return x.filter(F.trim(F.translate("text", "\n\r\t", "   ")) != "").withColumn("page", (F.col("_p") + 1).cast("long")).drop("_p")


def annotated(items: DataFrame, annotate: Callable[[str, str | None], dict], check: Callable[[dict], str | None], schema: str, *, key: str = "item", text: str = "text", retries: int = 2, window: int = 20, most_failures: int = 10) -> DataFrame:
    """What an annotator makes of each text, checked; a complaint goes back to it, ``retries`` times.

    Rows that stay invalid have status failed.  A task whose last ``window``
    rows hold more than ``most_failures`` failures ends with an error.
    schema: the annotation's columns; the result has key, status, attempts and these.
    """
    fields = T.StructType.fromDDL(schema)

    def run(batches):
        recent: deque[bool] = deque(maxlen=window)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                complaint, got, attempt = None, {}, 0
                for attempt in range(1, retries + 2):
                    got = annotate(t, complaint)
                    complaint = check(got)
                    if complaint is None:
                        break
                recent.append(complaint is not None)
                if sum(recent) > most_failures:
                    raise RuntimeError(f"{sum(recent)} of the last {len(recent)} annotations failed: {complaint}")
                rows.append((k, "failed" if complaint else "ok", attempt, *((None if complaint else got.get(f)) for f in fields.names)))
            yield pd.DataFrame(rows, columns=[key, "status", "attempts", *fields.names])

    made = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("status", T.StringType()), T.StructField("attempts", T.LongType()), *fields])
    return items.select(key, text).mapInPandas(run, made)
