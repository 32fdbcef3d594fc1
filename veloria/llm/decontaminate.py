"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items are cut into windows of ``n`` consecutive words (an item of
fewer words, but not none, is one window).  The windows' 64-bit hashes form
a set that is broadcast; training texts are scanned once, each hash hit is
verified on the words themselves, and every word that lies inside an
occurrence is hit.  Then spans or documents are removed.

The set has a proven bound: items are read in passes of at most about
``pass_bytes`` of text each.  A benchmark of any size is handled whole: passes
run one after the other, each as a job of its own whose result is stored, and a
pass's set is dropped before the next is made, so that neither the driver nor a
worker holds more than one.

Defined results: a null or empty text (on either side) has no words, so it
is neither hit nor a window; equal windows of several items count for each
of those items; repeated rows are judged one by one; an empty benchmark hits
nothing; an empty table gives an empty table; columns other than the ones
named are carried along untouched, and one that clashes with a made column
(``_words``, ``_n_hit``, ``_hits``, ``_items``) is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import arrowmap
from veloria.llm.blocks import stored
from veloria.llm.textbytes import LOWER, NON_ALNUM, Slice, covered, hash_spans, ngram_hashes, singles, slices

#: Benchmark text held by one pass, in bytes.
PASS_BYTES = 16 << 20


class WindowSet:
    """Windows of benchmark items, by length, then by hash."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int):
        self.ids = ids
        self.texts: list[list[bytes]] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, piece in enumerate(singles(pa.array(texts, pa.large_string()))):
            buf = LOWER[piece.buf]
            starts, ends, _ = Slice(0, buf, piece.offsets).words(NON_ALNUM)
            self.texts.append([buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
            if size := min(n, len(starts)):
                for at, h in enumerate(ngram_hashes(hash_spans(buf, starts, ends), size).tolist()):
                    found.setdefault(size, {}).setdefault(h, []).append((k, at))
        self.by_length = {}
        for size, windows in sorted(found.items()):
            hashes = np.array(sorted(windows), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes >> np.uint64(44)] = True
            self.by_length[size] = (hashes, sieve, [windows[h] for h in hashes.tolist()])

    def scan(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        """Yields (start word, length, items) of each verified occurrence."""
        words = hash_spans(buf, starts, ends)
        for size, (hashes, sieve, where) in self.by_length.items():
            grams = ngram_hashes(words, size)
            if not len(grams):
                continue
            maybe = np.flatnonzero(sieve[grams >> np.uint64(44)] & (doc[: len(grams)] == doc[size - 1 :]))
            slot = np.minimum(np.searchsorted(hashes, grams[maybe]), len(hashes) - 1)
            true = hashes[slot] == grams[maybe]
            for at, k in zip(maybe[true].tolist(), slot[true].tolist(), strict=True):
                own = [buf[starts[j] : ends[j]].tobytes() for j in range(at, at + size)]
                items = {i for i, w in where[k] if self.texts[i][w : w + size] == own}
                if items:
                    yield at, size, items


SCHEMA = arrowmap.schema("_words long, _n_hit long, _hits binary, _items array<string>")


def _passes(spark: SparkSession, items: DataFrame, id_column: str, text_column: str, n: int, pass_bytes: int):
    """(set, whether more may follow) for each pass over the items."""
    rows = items.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 16)).head()[0] or 0
    parts = max(1, -(-2 * int(total) // pass_bytes)) if total > pass_bytes else 1
    for p in range(parts):
        chosen = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        got = sorted(((r.i or "", r.t) for r in chosen.toLocalIterator()), key=lambda x: (x[0], x[1] or ""))
        yield spark.sparkContext.broadcast(WindowSet([i for i, _ in got], [t for _, t in got], n)), p + 1 < parts


def find_hits(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, keep: list[str] | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Adds _words (count), _hits (byte flags per word) and _items (ids, sorted) to docs."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in SCHEMA.names]
    out, earlier = docs, False
    for shared, more in _passes(docs.sparkSession, items, item_id, item_text, n, pass_bytes):

        def make(cols: dict[str, pa.Array], shared=shared, earlier=earlier) -> dict[str, pa.Array]:
            known = shared.value
            n_words, hits, item_lists = [], [], []
            for piece in slices(cols[text]):
                buf = LOWER[piece.buf]
                starts, ends, doc = Slice(0, buf, piece.offsets).words(NON_ALNUM)
                per = np.bincount(doc, minlength=len(piece))
                found = [*known.scan(buf, starts, ends, doc)]
                flags = covered(np.array([a for a, _, _ in found], np.int64), np.array([s for _, s, _ in found], np.int64), len(starts))
                ids: dict[int, set[str]] = {}
                for at, _, which in found:
                    ids.setdefault(int(doc[at]), set()).update(known.ids[i] for i in which)
                ends_at = np.cumsum(per)
                for k in range(len(piece)):
                    own = flags[ends_at[k] - per[k] : ends_at[k]]
                    hits.append(own.tobytes() if own.any() else b"")
                    item_lists.append(sorted(ids.get(k, ())))
                n_words.append(per)
            if earlier:
                for k, (h, i) in enumerate(zip(cols["_hits"].to_pylist(), cols["_items"].to_pylist(), strict=True)):
                    if h:
                        hits[k] = (np.frombuffer(h, bool) | np.frombuffer(hits[k], bool)).tobytes() if hits[k] else h
                        item_lists[k] = sorted({*i, *item_lists[k]})
            return {"_words": pa.array(np.concatenate(n_words), pa.int64()), "_n_hit": pa.array([sum(h) for h in hits], pa.int64()), "_hits": pa.array(hits, pa.binary()), "_items": pa.array(item_lists, pa.list_(pa.string()))}

        out = arrowmap.append(out, [text, *(["_hits", "_items"] if earlier else [])], list(dict.fromkeys([*keep, text])), SCHEMA, make)
        earlier = True
        if more:
            out = stored(out)
            shared.destroy()
    return out.select(*keep, *SCHEMA.names)


def remove_spans(text: str | None, flags: bytes) -> str | None:
    """The text without the bytes from each run of hit words' start to its end."""
    if not flags:
        return text
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = Slice(0, LOWER[raw], np.array([0, len(raw)])).words(NON_ALNUM)
    hit = np.frombuffer(flags, bool)
    drop = np.zeros(len(raw), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        drop[starts[a] : ends[b - 1]] = True
    return raw[~drop].tobytes().decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", drop_share: float = 1.0, **options) -> DataFrame:
    """docs with hit spans cut out; documents hit in at least ``drop_share`` of their words go."""
    kept = docs.columns
    made = T.StructType([T.StructField(text, T.StringType())])

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        return {text: pa.array([remove_spans(t, h) for t, h in zip(cols[text].to_pylist(), cols["_hits"].to_pylist(), strict=True)], pa.string())}

    hits = find_hits(docs, items, text=text, **options)
    hits = hits.filter((F.col("_n_hit") == 0) | (F.col("_n_hit") < F.lit(float(drop_share)) * F.col("_words")))
    return arrowmap.append(hits, [text, "_hits"], [c for c in kept if c != text], made, make).select(*kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: word and item hits of every document, with 10-word windows."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_hits(docs.select("doc_id", "text"), items, n=10, keep=["doc_id"])
    made = arrowmap.schema("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        n_hit = cols["_n_hit"].to_pylist()
        ids = cols["_items"].to_pylist()
        return {
            "n_words": cols["_words"], "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(set(i)) for i in ids], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(set(i))).encode()).hexdigest() for i in ids]), "contaminated": pa.array([x > 0 for x in n_hit]),
        }

    return arrowmap.append(found, ["_words", "_n_hit", "_items"], ["doc_id"], made, make)
