"""MinHash near-duplicate detection with tensored banding and exact verification.

A document's set is its distinct shingles of ``shingle`` words.  Documents
with equal sets form a class, found by a 128-bit hash of the set; the rest
works on one representative a class, so exact copies cost nothing more.

Tensored banding: two collections of ``m`` tuples of ``K`` minhashes are
made, and every pair of a tuple of the one and a tuple of the other is a
table key.  m x m tables thus need 2 x m x K minhashes instead of
2 x m x m x K.  m is the least number with which a pair at the threshold is
missed with a probability of at most ``MISS``.

Only tuples that several classes have can make a key that several have, so
the 2 x m tuples are counted first, and keys are made of the shared ones; most
documents share none and are done.

Documents that share a key are candidates.  All pairs of a bucket are never
made.  Each bucket has one leader, the least id, which is compared with the
members; buckets within one component are then done.  Members of the other
buckets can still be linked with each other: they go through an exact
prefix-filter join, rare shingles first, which loses no link and, unlike
their buckets, does not bring together what only shares a common passage.
Sizes and a sketch (the minhashes' low bits) sort out unlikely pairs, and
each link is confirmed on the words of both full texts, compared byte by
byte.  Components come from alternating stars.

Defined results: an empty set (null, empty or wordless text) is linked with
nothing; fewer words than a shingle make one shingle; repeated rows with one
id are one document; a null id is linked with nothing, has a null component
and is kept; an empty table gives an empty table; other columns are carried
along whatever they are called, but a column called n_shingles, component_id
or kept is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import arrowmap
from veloria.llm.blocks import pack_planes, stored, unpack_planes
from veloria.llm.components import components
from veloria.llm.textbytes import LOWER, SPACE, Slice, distinct_spans, hash_spans, mix, ngram_hashes, slices

#: Minhashes in a tuple.
K = 3
#: Most probable loss of a pair that is just similar enough.
MISS = 5e-4
_U = np.uint64


def tuples_needed(threshold: float) -> int:
    return math.ceil(math.log(MISS / 2) / math.log(1 - threshold**K))


#: Bins of the sketch, and 64-bit words that hold them: four planes of one bit a bin.
BINS, WORDS = 512, 32


def _sets(piece: Slice, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of all documents of a slice, and where each begins."""
    buf = LOWER[piece.buf]
    starts, ends, doc = Slice(0, buf, piece.offsets).words(SPACE)
    words = hash_spans(buf, starts, ends)
    hashes, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    grams = ngram_hashes(words, shingle)
    whole = np.flatnonzero(doc[: len(grams)] == doc[len(words) - len(grams) :]) if len(grams) else np.zeros(0, np.int64)
    hashes.append(grams[whole])
    owners.append(doc[whole])
    per = np.bincount(doc, minlength=len(piece))
    for k in np.flatnonzero((per > 0) & (per < shingle)).tolist():
        a = int(np.searchsorted(doc, k))
        hashes.append(ngram_hashes(words[a : a + per[k]], int(per[k])))
        owners.append(np.array([k]))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(piece) + 1))


_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 2048, dtype=np.uint64) * _U(2) + _U(1)
SIGNED = arrowmap.schema("_n long, _s1 long, _s2 long, _t array<long>")
BODY = arrowmap.schema("_n long, _k array<long>")
#: Bytes of text whose pairs are compared at once.
PAIR_BYTES = 1 << 20
#: Ids of removed documents that may be broadcast.
BROADCAST_IDS = 1 << 20


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _signed(docs: DataFrame, key: str, text: str, shingle: int, m: int) -> DataFrame:
    """key, set size, set hash, and the tuples of both collections, one after the other."""

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        n_all, s1, s2, tuples = [], [], [], []
        for piece in slices(cols[text]):
            h, begins = _sets(piece, shingle)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            low = np.zeros((len(piece), 2 * m * K), _U)
            sums = np.zeros((2, len(piece)), _U)
            if len(some):
                at = begins[:-1][some]
                sums[0, some] = np.add.reduceat(mix(h ^ _U(0xA0761D6478BD642F)), at)
                sums[1, some] = np.add.reduceat(mix(h ^ _U(0xE7037ED1A0B428DB)), at)
                for j in range(2 * m * K):
                    low[some, j] = np.minimum.reduceat((h ^ _SEEDS[j + 1024]) * _SEEDS[j], at)
            low = mix(low)
            tuples.append(mix(np.add.reduce(low.reshape(len(piece), 2 * m, K) * _SEEDS[:K], axis=2)))
            n_all.append(n)
            s1.append(sums[0].view(np.int64))
            s2.append(sums[1].view(np.int64))
        return {"_n": pa.array(np.concatenate(n_all)), "_s1": pa.array(np.concatenate(s1)), "_s2": pa.array(np.concatenate(s2)), "_t": _lists(np.concatenate(tuples).view(np.int64))}

    return arrowmap.append(docs, [text], [key], SIGNED, make)


def _bodies(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """_id, text, set size, and a one-permutation sketch: each bin's least hash, as four bits; an empty bin is 0."""

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        n_all, sketches = [], []
        for piece in slices(cols[text]):
            h, begins = _sets(piece, shingle)
            n = np.diff(begins)
            bins = np.zeros((len(piece), BINS), np.uint8)
            if len(h):
                cell = np.repeat(np.arange(len(piece)), n) * BINS + (h >> _U(55)).astype(np.int64)
                least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                bins.reshape(-1)[cell[least]] = 1 + (mix(h[least]) % _U(15)).astype(np.uint8)
            sketches.append(np.concatenate([np.packbits((bins >> p) & 1, axis=1) for p in range(4)], axis=1).view(np.int64))
            n_all.append(n)
        return {"_n": pa.array(np.concatenate(n_all)), "_k": _lists(np.concatenate(sketches))}

    return arrowmap.append(docs, [text], ["_id", text], BODY, make)


def _alike(left: pa.Array, right: pa.Array, shingle: int, num: int) -> np.ndarray:
    """Whether the shingle sets of each two texts are similar enough, on the words' own bytes."""
    out = np.zeros(len(left), bool)
    ends_at = np.cumsum(np.array(pc.add(pc.binary_length(left), pc.binary_length(right)), np.int64))
    first = 0
    while first < len(left):
        upto = max(first + 1, int(np.searchsorted(ends_at, PAIR_BYTES + (ends_at[first - 1] if first else 0), "right")))
        part = pa.concat_arrays([x.slice(first, upto - first).cast(pa.large_string()) for x in (left, right)])
        pieces = [p for p in slices(part.take(pa.array(np.arange(len(part)).reshape(2, -1).T.reshape(-1))), 1 << 62)]
        buf, offsets = LOWER[pieces[0].buf], pieces[0].offsets
        starts, ends, doc = Slice(0, buf, offsets).words(SPACE)
        word = distinct_spans(buf, starts, ends)[2].astype(np.int64)
        gram, m = word, len(word)
        per = np.bincount(doc, minlength=2 * (upto - first))
        for j in range(1, shingle):  # exact: a gram's number and the next word's number in one integer
            m = max(0, len(word) - j)
            gram = np.unique(gram[:m] * (len(word) + 1) + word[j : j + m], return_inverse=True)[1].astype(np.int64)
        whole = np.flatnonzero(doc[:m] == doc[len(word) - m :])
        gram, owner = gram[whole], doc[whole]
        short = np.flatnonzero((per > 0) & (per < shingle))
        if len(short):  # its words as one shingle; equal only to the same words
            begin = np.cumsum(per) - per
            names: dict[tuple[int, ...], int] = {}
            more = [names.setdefault(tuple(word[begin[k] : begin[k] + per[k]].tolist()), len(word) + len(names)) for k in short.tolist()]
            gram, owner = np.concatenate([gram, np.array(more, np.int64)]), np.concatenate([owner, short])
        span = int(gram.max()) + 1 if len(gram) else 1
        own = np.unique(owner * span + gram)
        owner, gram = own // span, own % span
        size = np.bincount(owner, minlength=2 * (upto - first)).reshape(-1, 2).sum(axis=1)
        both = (owner // 2) * span + gram
        both.sort()
        common = np.bincount(both[1:][both[1:] == both[:-1]] // span, minlength=upto - first)
        out[first:upto] = (common > 0) & (100 * common >= num * (size - common))
        first = upto
    return out


def _confirmed(pairs: DataFrame, bodies: DataFrame, text: str, shingle: int, num: int) -> DataFrame:
    """The pairs (u, v) whose full texts are similar enough."""
    left = bodies.select(F.col("_id").alias("u"), F.col(text).alias("_tu"))
    right = bodies.select(F.col("_id").alias("v"), F.col(text).alias("_tv"))
    joined = pairs.join(left, "u").join(right, "v")
    make = lambda cols: {"_ok": pa.array(_alike(cols["_tu"], cols["_tv"], shingle, num))}
    return arrowmap.append(joined, ["_tu", "_tv"], ["u", "v"], T.StructType([T.StructField("_ok", T.BooleanType())]), make).filter("_ok").select("u", "v")


def _near(num: int, a: str, b: str, nu: str, nv: str):
    """Whether the sketches differ in no more bins than the mean and 4.5 deviations of a pair at the threshold.

    Bins sample the union without replacement, so the deviation also shrinks
    with the share of the union that the filled bins are.  JVM arithmetic.
    """
    differ, filled, t, plane = F.lit(0), F.lit(0), num / 100, BINS // 64
    for w in range(plane):
        x, y = [F.col(f"{a}{w + plane * p}") for p in range(4)], [F.col(f"{b}{w + plane * p}") for p in range(4)]
        differ = differ + F.bit_count(reduce(Column.bitwiseOR, [c.bitwiseXOR(d) for c, d in zip(x, y, strict=True)]))
        filled = filled + F.bit_count(reduce(Column.bitwiseOR, [*x, *y]))
    left = F.greatest(F.lit(0.0), 1 - filled * (1 + t) / (F.col(nu) + F.col(nv)))
    return differ <= (1 - t) * filled + 4.5 * F.sqrt(t * (1 - t) * filled * left) + 1


_COUNTERS, _CHUNK = 1 << 18, 1 << 12
#: Tokens before a prefix token that are looked at for an earlier common one.
EARLIER = 8


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of bodies (_id, text)."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for piece in slices(batch.column(1)):
            h, begins = _sets(piece, shingle)
            yield ids[piece.first : piece.first + len(piece)], [h[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _rarity(bodies: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles fall on each of a fixed number of counters."""

    def count(batches):
        total = np.zeros(_COUNTERS, np.int64)
        for _, sets in _set_batches(batches, shingle):
            for h in sets:
                np.add.at(total, (h % _U(_COUNTERS)).astype(np.int64), 1)
        parts = total.reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array([pack_planes(p) for p in parts], pa.binary())], names=["part", "counts"])

    def add(key, table):
        total = np.sum([unpack_planes(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([pack_planes(total)], pa.binary())})

    rows = bodies.mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    out = np.zeros((_COUNTERS // _CHUNK, _CHUNK), np.int64)  # the model's size does not depend on the data
    for r in rows:
        out[r.part] = unpack_planes(bytes(r.counts), np.int64)
    return out.reshape(-1)


def _prefixes(bodies: DataFrame, shingle: int, num: int) -> DataFrame:
    """Tokens of each set's prefix, for a self-join that loses no pair of num percent.

    In an order that is the same for all, the longer of two similar sets has a
    common token in its first n - ceil(t n) + 1, the shorter in its first
    n - ceil(2 t n / (1 + t)) + 1 (``short``).  Rare tokens come first, so what
    many documents share brings few together.  ``free`` is the number of
    tokens that some other set may have.
    """
    shared = bodies.sparkSession.sparkContext.broadcast(_rarity(bodies, shingle))

    def make(batches):
        for ids, sets in _set_batches(batches, shingle):
            out, before, lengths = [[], [], [], [], []], [], []
            for i, h in zip(ids, sets, strict=True):
                often = shared.value[(h % _U(_COUNTERS)).astype(np.int64)]
                n, alone = len(h), int((often == 1).sum())
                first = h[np.lexsort((h, often))[: n - -(-num * n // 100) + 1]]
                first = first[alone:]  # no other set has these
                short = n - -(-2 * num * n // (100 + num)) + 1
                for part, own in zip(out, (np.full(len(first), i), first.view(np.int64), np.full(len(first), n), np.full(len(first), n - alone), np.arange(alone, alone + len(first)) < short), strict=True):
                    part.append(own)
                tokens = first.view(np.int64)
                before += [tokens[max(0, k - EARLIER) : k] for k in range(len(tokens))]
                lengths.append(np.minimum(np.arange(len(tokens)), EARLIER))
            if not lengths:
                continue
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *before])))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(part)) for part in out), lists], names=["_id", "t", "n", "free", "short", "before"])

    rows = stored(bodies.mapInArrow(make, "_id long, t long, n long, free long, short boolean, before array<long>"))
    several = rows.groupBy("t").agg(F.count("*").alias("k"), F.bool_or("short").alias("any")).filter("k > 1 and any").select("t")
    return rows.join(several, "t")


def _membership(docs: DataFrame, key: str, text: str, shingle: int, threshold: float) -> DataFrame:
    """_id, n_shingles, component_id and kept of every row."""
    m = tuples_needed(threshold)
    num = round(threshold * 100)
    signed = stored(_signed(docs, key, text, shingle, m))
    some = signed.filter(F.col(key).isNotNull() & (F.col("_n") > 0))
    classes = stored(some.groupBy("_s1", "_s2").agg(F.min(key).alias("_id"), F.first("_t").alias("_t")))

    tuples = classes.select("_id", F.posexplode("_t").alias("_i", "_x")).select("_id", (F.col("_i") >= m).alias("_second"), F.xxhash64("_i", "_x").alias("_x"))
    shared = tuples.groupBy("_x").agg(F.count("*").alias("n")).filter("n > 1").select("_x")
    own = lambda second: F.collect_list(F.when(F.col("_second") == second, F.col("_x")))  # noqa: E731  at most m
    alive = stored(tuples.join(shared, "_x").groupBy("_id").agg(own(False).alias("_a"), own(True).alias("_b")).filter((F.size("_a") > 0) & (F.size("_b") > 0)))
    entries = alive.select("_id", F.explode("_a").alias("_x"), "_b").select("_id", "_x", F.explode("_b").alias("_y")).select(F.xxhash64("_x", "_y").alias("key"), "_id")
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    entries = stored(entries.join(shared, "key"))  # what shares no key is done
    chosen = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(entries.select("_id").distinct(), "_id", "left_semi")
    bodies = stored(_bodies(chosen.dropDuplicates(["_id"]), "_text", shingle))
    members = bodies.select("_id", "_n", *(F.col("_k")[w].alias(f"k{w}") for w in range(WORDS)))

    sizes = 100 * F.least("nu", "nv") >= num * F.greatest("nu", "nv")
    side = lambda frame, name, sketch: frame.select(F.col("_id").alias(name), F.col("_n").alias(f"n{name}"), *(F.col(f"k{w}").alias(f"{sketch}{w}") for w in range(WORDS)))

    leader = entries.groupBy("key").agg(F.min("_id").alias("v"))
    stars = entries.join(leader, "key").filter("_id != v").select(F.col("_id").alias("u"), "v").distinct()
    likely = stars.join(side(members, "u", "p"), "u").join(side(members, "v", "q"), "v").filter(sizes & _near(num, "p", "q", "nu", "nv"))
    links = stored(_confirmed(likely.select("u", "v"), bodies, "_text", shingle, num))

    now = members.join(components(links).withColumnRenamed("node", "_id"), "_id", "left").withColumn("c", F.coalesce("component", "_id")).drop("component")
    mixed = entries.join(now.select("_id", "c"), "_id").groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1")
    open_ = stored(bodies.select("_id", "_text").join(entries.join(mixed.select("key"), "key").select("_id").distinct(), "_id", "left_semi"))
    rows = _prefixes(open_, shingle, num).join(now, "_id")
    x = rows.select("t", F.col("before").alias("bu"), F.col("c").alias("cu"), F.col("free").alias("fu"), F.col("_id").alias("u"), F.col("n").alias("nu"), *(F.col(f"k{w}").alias(f"p{w}") for w in range(WORDS)))
    y = rows.filter("short").select(F.col("t").alias("t2"), F.col("before").alias("bv"), F.col("c").alias("cv"), F.col("free").alias("fv"), F.col("_id").alias("v"), F.col("n").alias("nv"), *(F.col(f"k{w}").alias(f"q{w}") for w in range(WORDS)))
    longer = (F.col("nu") > F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") > F.col("v")))
    enough = (100 + num) * F.least("fu", "fv") >= num * (F.col("nu") + F.col("nv"))
    pairs = x.join(y, (F.col("t") == F.col("t2")) & (F.col("cu") != F.col("cv")) & longer & sizes & enough & _near(num, "p", "q", "nu", "nv") & ~F.arrays_overlap("bu", "bv")).select("u", "v").distinct()
    links = stored(links.unionByName(_confirmed(pairs, bodies, "_text", shingle, num)))
    of = components(links)
    named = classes.join(of, classes["_id"] == of["node"], "left").select("_s1", "_s2", F.coalesce("component", "_id").alias("component_id"))
    rows = signed.select(F.col(key).alias("_id"), "_s1", "_s2", F.col("_n").alias("n_shingles"))
    result = rows.join(named, ["_s1", "_s2"], "left").select("_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("_id").isNotNull(), F.col("component_id"))).otherwise(F.col("_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))


def find_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``) with n_shingles, component_id and kept."""
    result = _membership(docs.select(key, text), key, text, shingle, threshold)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_shingles", "component_id", "kept")]
    if keep == [key]:
        return result.withColumnRenamed("_id", key)
    once = result.filter(F.col("_id").isNotNull()).dropDuplicates(["_id"])
    names = [f"_c{k}" for k in range(len(keep))]  # no column of docs clashes with a made one
    plain = docs.select(F.col(key).alias("_key"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    made = plain.join(once, F.col("_key") == F.col("_id"), "left")
    return made.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id", F.coalesce("kept", F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that are their group's representative; those without an id too.

    Only the ids that go meet the texts, and are broadcast if they are few.
    """
    gone = _membership(docs.select(key, text), key, text, shingle, threshold).filter(~F.col("kept")).select(F.col("_id").alias("_gone")).distinct()
    gone = stored(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the near-duplicate component of every document, 3-word shingles, 85 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_groups(docs, shingle=3, threshold=0.85, keep=["doc_id"])
