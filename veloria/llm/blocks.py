"""Blocks of documents that look distinct keys up in one global, hash-sharded table.

Several operators here need, for every document, facts about keys that the
whole corpus shares (words, contexts, word windows).  A row per occurrence
would shuffle many times the input.  Instead

1. ``ask``: each block of consecutive documents (at most ``BLOCK_BYTES`` of
   text, unless one document is longer) lists its distinct keys once, packed
   by bucket (a range of the key's hash);
2. ``resolve``: each bucket meets the lists of all blocks, works every
   distinct key out once and answers each block in the order it asked;
3. ``finish``: a block's documents meet the block's answers.

What is shuffled grows with distinct keys a block, not with occurrences; a
key in a third of all rows is one entry a block, so there is no hot group.
There are enough buckets for the input's bytes, so what a bucket holds does
not grow with the corpus.

The source is read twice, so it must deal its rows alike both times.  ``steady``
stores one that is the result of a shuffle; a scan of files is read as it is.
A block's number holds its partition, its order there and a checksum of its
texts, so that a source that deals its rows differently all the same makes
``finish`` raise instead of guessing.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20
#: Documents in a block at most, whatever their length.
BLOCK_ROWS = 100_000
#: Buckets for each shuffle partition, at least.
BUCKETS_PER_PARTITION = 3
#: Bytes of the source as stored for each bucket, at most.
BUCKET_BYTES = 8 << 20
#: Bytes of answers in one Arrow batch, beyond which the next batch begins.
BATCH_BYTES = 64 << 20


def trim() -> None:
    """Gives freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pack(data: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def unpack(data: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_planes(a: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which compresses well."""
    return pack(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unpack_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(unpack(data).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_rising(a: np.ndarray) -> bytes:
    """Sorted unsigned integers, as their differences."""
    return pack_planes(np.diff(a, prepend=a.dtype.type(0)))


def unpack_rising(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack_planes(data, dtype), dtype=dtype)


def frame(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unframe(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 + 8 * n + np.cumsum(np.frombuffer(data, np.int64, n, 8))
    starts = [8 + 8 * n, *ends[:-1].tolist()]
    return [data[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def bucket_count(df: DataFrame) -> int:
    """Enough buckets for the shuffle partitions and for the bytes that the optimiser expects of the source."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    for_bytes = size // BUCKET_BYTES if size < 1 << 55 else 0  # beyond: the size is unknown
    return max(16, BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), for_bytes)


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted 64-bit hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _number(partition: int, ordinal: int, table: pa.Table, text: str) -> int:
    """A block's number: partition, order and 24 bits of a checksum of the texts."""
    column = table.column(text)
    check = zlib.crc32(np.array(pc.fill_null(pc.binary_length(column), -1), np.int64).tobytes())
    for chunk in column.chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            offsets = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_string(chunk.type) else np.int32)
            check = zlib.crc32(memoryview(chunk.buffers()[2])[offsets[chunk.offset] : offsets[chunk.offset + len(chunk)]], check)
    return (partition << 40) | (ordinal << 24) | (check >> 8)


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.Table]]:
    partition, ordinal, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right"))
            upto = min(max(upto, at if held else at + 1), at + BLOCK_ROWS - rows, batch.num_rows)
            if upto > at:
                held.append(batch.take(pa.array(np.arange(at, upto))) if upto - at < batch.num_rows else batch)
                size, rows, at = size + int(ends[upto - 1] - before), rows + upto - at, upto
            if at < batch.num_rows:
                table = pa.Table.from_batches(held)
                yield _number(partition, ordinal, table, text), table
                del table
                ordinal, held, size, rows = ordinal + 1, [], 0, 0
    if held:
        table = pa.Table.from_batches(held)
        yield _number(partition, ordinal, table, text), table


_ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "bucket", "payload"])


def ask(docs: DataFrame, text: str, also: list[str], extract: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """One row (block, bucket, payload) for each (bucket, payload) that extract makes of a block."""

    def run(batches):
        for block, table in _cut(batches, text):
            if rows := [(block, bucket, payload) for bucket, payload in extract(table)]:
                yield _rows(rows)
            del table, rows
            trim()

    return docs.select(*dict.fromkeys([*also, text])).mapInArrow(run, _ASKED)


def resolve(asked: DataFrame, answer: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Answers (block, payload) for each bucket, from the packed lists of all blocks."""

    def run(key, table):
        bucket = key[0].as_py()
        lists = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        batches, rows, size = [], [], 0
        for block, payload in answer(bucket, lists):
            if rows and size + len(payload) > BATCH_BYTES:
                batches.append(_rows(rows))
                rows, size = [], 0
            rows.append((block, bucket, payload))
            size += len(payload)
        return pa.Table.from_batches([*batches, _rows(rows)])

    return asked.groupBy("bucket").applyInArrow(run, _ASKED)


def meet(docs: DataFrame, text: str, keep: list[str], answers: DataFrame, prepare: Callable[[pa.Table], bytes], conclude: Callable[[int, pa.Table, bytes, list[bytes]], Iterator[pa.RecordBatch] | pa.Table], schema: T.StructType) -> DataFrame:
    """What conclude makes of a block's number, its kept columns, what prepare packed, and its answers by bucket."""
    packed = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("payload", T.BinaryType())])

    def run(batches):
        for block, table in _cut(batches, text):
            sink = pa.BufferOutputStream()
            own = table.select(keep) if keep else pa.table({"_": pa.nulls(table.num_rows)})
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([prepare(table)], pa.binary())], names=["block", "rows", "payload"])
            del table, own, sink
            trim()

    def join(left, right):
        if left.num_rows != 1:
            raise RuntimeError("the source dealt its rows differently when it was read again; write it to a table first")
        own = pa.ipc.open_stream(left.column("rows")[0].as_py()).read_all()
        lists = sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        out = conclude(left.column("block")[0].as_py(), own, left.column("payload")[0].as_py(), lists)
        del own, lists
        trim()
        return out

    source = docs.select(*dict.fromkeys([*keep, text]))
    return source.mapInArrow(run, packed).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, schema)


def finish(docs: DataFrame, text: str, keep: list[str], answers: DataFrame, prepare: Callable[[pa.Table], bytes], conclude: Callable[[bytes, list[tuple[int, bytes]], int], dict[str, pa.Array]], made: T.StructType, need: list[str] | None = None) -> DataFrame:
    """docs with the columns that conclude makes of what prepare packed and of the answers by bucket.

    ``conclude`` also gets the kept and needed columns of the block's rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name for f in made}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType, True) for c in keep), *made])
    target = to_arrow_schema(schema)

    def whole(block, own, payload, lists):
        new = conclude(payload, lists, own)
        columns = [own.column(c) for c in keep] + [new[f.name] for f in made]
        return pa.table([c.cast(t.type) if c.type != t.type else c for c, t in zip(columns, target, strict=True)], schema=target)

    return meet(docs, text, list(dict.fromkeys([*keep, *(need or [])])), answers, prepare, whole, schema)


def pack_text(table: pa.Table, text: str) -> bytes:
    """A block's texts, to be read by unpack_text."""
    missing = np.packbits(np.array(pc.is_null(table.column(text)), bool)).tobytes()
    column = pc.fill_null(table.column(text), "").cast(pa.large_string())
    lengths, parts = np.array(pc.binary_length(column), np.int64), []
    for c in column.chunks:
        if len(c) and c.buffers()[2] is not None:
            offsets = np.frombuffer(c.buffers()[1], np.int64)
            parts.append(memoryview(c.buffers()[2])[offsets[c.offset] : offsets[c.offset + len(c)]])
    return frame(lengths.tobytes(), pack(b"".join(parts), 3), missing)


def unpack_text(data: bytes) -> pa.Array:
    """The texts of a block; null ones are empty here."""
    lengths, raw, _ = unframe(data)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(unpack(raw)))


def original_text(data: bytes) -> pa.Array:
    """The texts of a block as they were."""
    texts, missing = unpack_text(data), unframe(data)[2]
    return pc.if_else(pa.array(np.unpackbits(np.frombuffer(missing, np.uint8), count=len(texts)).astype(bool)), pa.scalar(None, texts.type), texts)


def joined(answers: list[tuple[int, bytes]]) -> list[bytes]:
    return [payload for _, payload in answers]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a session on one machine that names none gets its own."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def deleted(spark: SparkSession, folder: str) -> None:
    """Removes a folder of a store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def steady(df: DataFrame) -> DataFrame:
    """df, stored if its rows come out of a shuffle, whose order may change when it runs again."""
    return stored(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def dealt(asked: DataFrame, buckets: int) -> DataFrame:
    """What blocks ask, dealt by bucket and stored, so that several passes over the buckets share one shuffle.

    A stored table keeps its partitioning only if its plan is not adaptive.
    """
    conf = asked.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return stored(asked.repartition(buckets, "bucket"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
