"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is a string of bytes (A-Z lower-cased) and one end sign.  A byte is
decided by binary steps: is it the end, then its bits from the highest.  Each
step has, at every depth of preceding bytes from 0 to ``depth``, a node with
a Krichevsky-Trofimov estimate.  Context-tree weighting mixes all depths: a
node's evidence is half its own estimate's and half the product of its
children's, which gives the weight of stopping at that depth, and the
probability of a bit is the mixture along the path.  The tree is learnt from
all training texts and then frozen; a child that training never reached does
not exist, so its parent keeps the whole weight that is left.

Each block of documents lists its distinct (context, byte) pairs with
training counts; buckets, ranges of a hash of the three nearest context
bytes, add them up over the whole corpus.  Nodes of depth 3 and more live in
one bucket.  Those of depth 0 to 2 are summed up over the buckets; they are
broadcast, with the bound that the alphabet gives (257 x 257 contexts of 257
nodes).  Each bucket then works out the code length of every distinct pair
once (in steps of 2^-18 digits), and the blocks add up their texts.

Beside it stands the base: log10((c + 1) / (N + 1 * (V + 1))) over words and
one end a text.

Defined results: a null text is scored as an empty one (an end only);
repeated rows are scored, and if they are training rows counted, one by one;
with no training row every step has probability 1/2; a null id is a training
row; an empty table gives an empty table; other columns are carried along, and
one called n_tokens, n_known, train_tokens, base_score, score, n_bytes or
bits_per_byte is replaced.  Words are counted by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloria.llm import arrowmap, blocks
from veloria.llm.textbytes import LOWER, SPACE, Slice, hash_spans, mix, slices

END, PAD = 256, 257
#: Bits of a symbol: one says whether it is the end, eight are the byte.
STEPS = 9
#: Bytes of context; a node's key (9 bits a byte, 10 for the step) holds six in 64 bits.
DEPTH = 6
#: Code lengths travel as whole multiples of 1/SCALE digits.
SCALE = 1 << 18
_U = np.uint64
#: The hash that stands for the end among words.
_END_WORD = _U(0)


def _symbols(texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, ``depth`` pads before each and an end behind; documents' first places."""
    parts, sizes = [], []
    for piece in slices(texts):
        lengths = np.diff(piece.offsets)
        n = len(piece)
        out = np.full(len(piece.buf) + n * (depth + 1), PAD, np.int16)
        shift = np.repeat(np.arange(n), lengths) * (depth + 1) + depth
        out[np.arange(len(piece.buf)) + shift] = LOWER[piece.buf]
        out[piece.offsets[1:] + np.arange(1, n + 1) * (depth + 1) - 1] = END
        parts.append(out)
        sizes.append(lengths + depth + 1)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int16)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _pairs(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, symbol) codes in order, each scored place, and its code's rank.

    A code holds the context, the nearest byte first, and the symbol, in 9 bits each.
    """
    at = np.flatnonzero(symbols != PAD).astype(np.int32)
    if not len(at):
        return np.zeros(0, _U), at, np.zeros(0, np.int64)
    n = len(symbols)
    code = symbols[depth - 1 : n - 1].astype(_U)
    for back in (*range(2, depth + 1), 0):
        code <<= _U(9)
        code |= symbols[depth - back : n - back].astype(_U)
    found = pa.array(code).dictionary_encode()  # a hash table, in the order of appearance
    del code
    codes, rank = found.dictionary.to_numpy(), found.indices.to_numpy()
    del found
    order = np.argsort(codes)
    codes = codes[order]
    real = (codes & _U(511)) != _U(PAD)  # pads are context only
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(real, dtype=np.int32) - 1
    return codes[real], at, place[rank[at - depth]]


def _bucket_of(codes: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    return (mix(codes >> _U(9 * (depth + 1 - min(depth, 3)))) % _U(buckets)).astype(np.int32)


def _words(texts) -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
    """Word hashes and documents of each slice, without the ends."""
    for piece in slices(texts):
        buf = LOWER[piece.buf]
        starts, ends, doc = Slice(0, buf, piece.offsets).words(SPACE)
        h = hash_spans(buf, starts, ends)
        h[h == _END_WORD] = _U(1)
        yield piece, h, doc


def lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2) - log gamma(1/2), for whole n."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(x), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift - 0.5 * np.log(np.pi)


def lgamma_one(n: np.ndarray) -> np.ndarray:
    """log n! for whole n."""
    x = n + 1.0
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(x), shift)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


_FEW = np.arange(4096.0)
_FEW_HALF, _FEW_ONE = lgamma_half(_FEW), lgamma_one(_FEW)


def _looked_up(few: np.ndarray, f, n: np.ndarray) -> np.ndarray:
    """f of whole n, small ones from a table."""
    out, many = few[np.minimum(n, len(few) - 1).astype(np.int64)], np.flatnonzero(n >= len(few))
    out[many] = f(n[many])
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives to a zeros and b ones."""
    return _looked_up(_FEW_HALF, lgamma_half, a) + _looked_up(_FEW_HALF, lgamma_half, b) - _looked_up(_FEW_ONE, lgamma_one, a + b)


def _steps(symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step the node (1 to 511), the bit, and where the step is taken."""
    for j in range(STEPS):
        yield (1 << j) | (symbol >> (STEPS - j)), (symbol >> (STEPS - 1 - j)) & 1, (symbol != END) | (j == 0)


class Level:
    """Nodes of one depth: sorted keys (context, step node), zeros, ones, log evidence, own weight."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.keys, self.a, self.b = keys, a, b
        own = log_kt(a, b)
        if below is None:
            self.evidence, self.weight = own, np.ones(len(keys))
        else:
            self.evidence = np.logaddexp(own, below) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return slot, self.keys[slot] == keys

    def parents(self, key_of) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(key_of(self.keys), return_inverse=True)
        return keys, place


def _up(keys: np.ndarray) -> np.ndarray:
    """The node one byte of context nearer the root."""
    return ((keys >> _U(19)) << _U(10)) | (keys & _U(1023))


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def leaves(codes: np.ndarray, counts: np.ndarray) -> Level:
    """The deepest level, from trained codes, in order, and their counts."""
    context, symbol = (codes >> _U(9)) << _U(10), (codes & _U(511)).astype(np.int64)
    keys, zeros, ones = [np.zeros(0, _U)], [np.zeros(0)], [np.zeros(0)]
    for node, bit, taken in _steps(symbol):  # a step's nodes are in order, as the codes are
        own, n = (context | node.astype(_U))[taken], counts[taken].astype(np.float64)
        if len(own):
            begin = _groups(own)
            keys.append(own[begin])
            ones.append(np.add.reduceat(n * bit[taken], begin))
            zeros.append(np.add.reduceat(n, begin) - ones[-1])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return Level(keys[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], None)


def shorter(level: Level) -> Level:
    keys, place = level.parents(_up)
    n = len(keys)
    return Level(keys, np.bincount(place, level.a, n), np.bincount(place, level.b, n), np.bincount(place, level.evidence, n))


def _mixed(levels: list[Level]) -> list[np.ndarray]:
    """For each node, the probability of a one after a context whose deepest trained node it is.

    Down the path every depth takes its weight of what those above have left,
    and the deepest node takes the rest.
    """
    out, taken, left = [], np.zeros(1), np.ones(1)
    for d, level in enumerate(levels):
        up = np.searchsorted(levels[d - 1].keys, _up(level.keys)) if d else np.zeros(len(level.keys), np.int64)
        own, rest, kt = (taken[up], left[up], (level.b + 0.5) / (level.a + level.b + 1)) if len(level.keys) else (np.zeros(0),) * 3
        out.append(own + rest * kt)
        taken, left = own + rest * level.weight * kt, rest * (1 - level.weight)
    return out


def log10_probability(codes: np.ndarray, levels: list[Level], depth: int) -> np.ndarray:
    """log10 of the symbol given its context for each code, in order; levels by depth, the root first."""
    total, mixed = np.zeros(len(codes)), _mixed(levels)
    context, symbol = codes >> _U(9), (codes & _U(511)).astype(np.int64)
    for node, bit, taken in _steps(symbol):
        key = (context << _U(10)) | node.astype(_U)
        begin = _groups(key)
        own, one = key[begin], np.full(len(begin), 0.5)
        todo = np.arange(len(begin))
        for d in range(depth, -1, -1):  # the deepest trained node on the path
            k = own[todo]
            slot, there = levels[d].find(((k >> _U(10 + 9 * (depth - d))) << _U(10)) | (k & _U(1023)))
            one[todo[there]] = mixed[d][slot[there]]
            todo = todo[~there]
            if not len(todo):
                break
        one = np.repeat(one, np.diff(np.append(begin, len(key))))
        total += np.where(taken, np.log10(np.where(bit == 1, one, 1 - one)), 0.0)
    return total


def score(docs: DataFrame, training, *, text: str = "text", depth: int = DEPTH, keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    ``training`` is a boolean column: the rows that the model learns from.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a node's key holds one to six bytes of context")
    spark = docs.sparkSession
    sc, buckets = spark.sparkContext, blocks.bucket_count(docs)
    keep = keep if keep is not None else docs.columns
    flag = "_train"
    while flag in docs.columns:  # a name of its own beside the caller's columns
        flag += "_"
    docs = blocks.steady(docs.withColumn(flag, F.coalesce(training, F.lit(True))).select(*dict.fromkeys([*keep, text, flag])))
    edge = min(depth, 3)

    def extract(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        texts, train = table.column(text), np.array(table.column(flag), bool)
        symbols, begins = _symbols(texts, depth)
        codes, at, rank = _pairs(symbols, depth)
        learnt = np.repeat(train, np.diff(begins))[at]
        counts = np.bincount(rank[learnt], minlength=len(codes))
        of = _bucket_of(codes, depth, buckets)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own):
                yield b, blocks.frame(blocks.pack_rising(codes[own]), blocks.pack_planes(counts[own].astype(np.uint32)))
        hashes, ours = [np.zeros(0, _U)], [np.zeros(0, bool)]
        for piece, h, doc in _words(texts):
            hashes.append(h)
            ours.append(train[doc + piece.first])
        hashes.append(np.full(len(train), _END_WORD))
        ours.append(train)
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(place[np.concatenate(ours)], minlength=len(words))
        bounds = blocks.bucket_bounds(words, buckets)
        for b in range(buckets):
            s = slice(bounds[b], bounds[b + 1])
            if s.start < s.stop:
                yield buckets + b, blocks.frame(blocks.pack_rising(words[s]), blocks.pack_planes(counts[s].astype(np.uint32)))

    def gather(lists) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
        """What each block asked, all distinct keys, and their counts."""
        asked, counts = [], []
        for block, payload in lists:
            keys, own = blocks.unframe(payload)
            asked.append((block, blocks.unpack_rising(keys)))
            counts.append(blocks.unpack_planes(own, np.uint32))
        keys, place = np.unique(np.concatenate([k for _, k in asked]), return_inverse=True)
        return asked, keys, np.bincount(place, np.concatenate(counts), len(keys))

    def summarise(key, table):
        lists = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        _, keys, counts = gather(lists)
        if key[0].as_py() >= buckets:
            node, a, b, e = np.array([-1]), np.array([counts.sum()]), np.array([float((counts > 0).sum())]), np.zeros(1)
        else:
            level = leaves(keys[counts > 0], counts[counts > 0])
            for _ in range(depth - edge):
                level = shorter(level)
            # One context shorter than a bucket: sums over the children here.
            up, place = level.parents(_up)
            node, a, b, e = up.astype(np.int64), np.bincount(place, level.a, len(up)), np.bincount(place, level.b, len(up)), np.bincount(place, level.evidence, len(up))
        return pa.table({"node": pa.array(node, pa.int64()), "a": pa.array(a, pa.float64()), "b": pa.array(b, pa.float64()), "e": pa.array(e, pa.float64())})

    def answer(bucket: int, lists: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        asked, keys, counts = gather(lists)
        if bucket >= buckets:
            values = counts.astype(np.float32)
            if counts.max() >= 1 << 24:
                values = counts.astype(np.float64)
        else:
            level = leaves(keys[counts > 0], counts[counts > 0])
            deep = [level]
            for _ in range(depth - edge):
                deep.insert(0, level := shorter(level))
            values = np.rint(-SCALE * log10_probability(keys, [*top.value, *deep], depth)).astype(np.uint32)
        for block, own in asked:
            got = values[np.searchsorted(keys, own)]
            yield block, got.dtype.char.encode() + blocks.pack_planes(got)

    def values_of(payload: bytes) -> np.ndarray:
        return blocks.unpack_planes(payload[1:], payload[:1].decode()).astype(np.float64)

    def prepare(table: pa.Table) -> bytes:
        return blocks.pack_text(table, text)

    def conclude(payload: bytes, answers: list[tuple[int, bytes]], own: pa.Table) -> dict[str, pa.Array]:
        texts, (n_all, v_all) = blocks.unpack_text(payload), totals.value
        symbols, begins = _symbols(texts, depth)
        codes, at, rank = _pairs(symbols, depth)
        order = np.argsort(_bucket_of(codes, depth, buckets), kind="stable")
        got = np.concatenate([np.zeros(0), *(values_of(p) / -SCALE for b, p in answers if b < buckets)])
        known = np.concatenate([np.zeros(0), *(values_of(p) for b, p in answers if b >= buckets)])
        if len(got) != len(codes):
            raise RuntimeError("a block's contexts have no scores; write the source to a table first")
        log_p = np.empty(len(codes))
        log_p[order] = got
        n = len(begins) - 1
        total = np.add.reduceat(log_p[rank], np.searchsorted(at, begins[:-1])) if n else np.zeros(0)
        hashes, docs_ = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for piece, h, doc in _words(texts):
            hashes.append(h)
            docs_.append(doc + piece.first)
        hashes.append(np.full(n, _END_WORD))
        docs_.append(np.arange(n))
        doc = np.concatenate(docs_)
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        c = known[place]
        n_tokens = np.bincount(doc, minlength=n)
        base = np.bincount(doc, np.log10(c + 1), n) - n_tokens * np.log10(n_all + v_all + 1)
        n_bytes = np.diff(begins) - depth - 1
        return {
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(np.bincount(doc, c > 0, n).astype(np.int64), pa.int64()), "train_tokens": pa.array(np.full(n, int(n_all)), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": pa.array(-total / np.log10(2) / np.maximum(n_bytes, 1), pa.float64()),
        }

    asked = blocks.ask(docs, text, [flag], extract)
    asked = blocks.dealt(asked, buckets)
    nodes = asked.groupBy("bucket").applyInArrow(summarise, "node long, a double, b double, e double").groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("e").alias("e"))
    rows = nodes.toPandas().sort_values("node")  # bounded: 257 x 257 contexts, 257 nodes each
    spare = rows[rows.node < 0]
    totals = sc.broadcast((float(spare.a.sum()), float(spare.b.sum())))
    rows = rows[rows.node >= 0]
    level = Level(rows.node.to_numpy().astype(_U), rows.a.to_numpy(), rows.b.to_numpy(), rows.e.to_numpy())
    levels = [level]
    for _ in range(edge - 1):
        levels.insert(0, level := shorter(level))
    top = sc.broadcast(levels)
    return blocks.finish(docs, text, keep, blocks.resolve(asked, answer), prepare, conclude, arrowmap.schema("n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's log probability, learnt from six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce((arrowmap.crc32_text("doc_id") % 7) == 2, F.lit(False))
    return score(docs.withColumn("held_out", held), ~F.col("held_out"), keep=["doc_id", "held_out"])
