"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's words (ASCII-lower-cased bytes, any white space or ASCII punctuation
and digit as one boundary byte) give byte 2-, 3- and 4-grams, hashed into a
fixed number of buckets.  Their embeddings are averaged and a linear softmax
gives the language.  Embeddings and softmax are trained by stochastic
gradient descent in numpy, in small batches, on a bounded sample of labelled
rows: ``sample_rows`` in all, shared out evenly between the languages and
``per_language`` of each at most, in expectation, chosen by a hash of the id;
what is gathered for a row is its bucket counts, so it is bounded by the number
of buckets and not by the text.  Every language that has a label is learnt.
Whole texts are used in training and prediction.

A part of the sample that is not trained on calibrates: a temperature makes
the score a probability, and the rejection threshold is the smallest score
from which on at least ``accept_accuracy`` of the calibration rows are right.

Defined results: ``und`` with score 0 and rejected for a null text or one
without a letter; with no labelled row at all, every text is ``und``;
repeated rows get equal results; ties go to the alphabetically first
language; an empty table gives an empty table; other columns are carried
along, and one called lang_pred, score or rejected is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import arrowmap
from veloria.llm.textbytes import LOWER, Slice, singles, slices

BUCKETS = 1 << 15
LETTER = regex.compile(r"\p{L}")
#: Bytes as they count for grams: letters in lower case, bytes of other scripts, one boundary.
FOLD = LOWER.copy()
FOLD[:128] = [b if 97 <= b < 123 else 32 for b in LOWER[:128]]
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of all byte grams of a slice."""
    b = FOLD[piece.buf].astype(np.uint32)
    doc = np.repeat(np.arange(len(piece)), np.diff(piece.offsets))
    keys, docs = [], []
    rolling = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        rolling = rolling[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        useful = (doc[: len(rolling)] == doc[n - 1 :]) & ~((b[: len(rolling)] == 32) & (b[1 : len(rolling) + 1] == 32))
        h = rolling * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        keys.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(17))[useful].astype(np.int32))
        docs.append(doc[: len(rolling)][useful])
    if not keys:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


def has_letter(piece: Slice) -> np.ndarray:
    """Whether each document of the slice has a letter of any script."""
    ascii_ = np.add.reduceat(np.append(ASCII_LETTER[piece.buf], False).astype(np.int64), piece.offsets[:-1]) > 0 if len(piece.buf) else np.zeros(len(piece), bool)
    ascii_ &= np.diff(piece.offsets) > 0
    for k in np.flatnonzero(~ascii_ & (np.diff(piece.offsets) > 0)).tolist():
        ascii_[k] = LETTER.search(piece.text(k).decode("utf-8", "replace")) is not None
    return ascii_


def bags(column: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """For each text its buckets (uint16) and their counts (float32)."""
    which, counts = [], []
    for piece in singles(column):
        own = np.bincount(grams(piece)[0], minlength=BUCKETS)
        at = np.flatnonzero(own)
        which.append(at.astype(np.uint16).tobytes())
        counts.append(own[at].astype(np.float32).tobytes())
    return which, counts


class Model:
    """``table`` is the embedding times the softmax weights: one row of logits a bucket."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, piece: Slice) -> np.ndarray:
        keys, doc = grams(piece)
        total = np.maximum(np.bincount(doc, minlength=len(piece)), 1)[:, None]
        sums = np.stack([np.bincount(doc, weights=self.table[keys, k], minlength=len(piece)) for k in range(len(self.languages))], axis=1)
        return (sums / total + self.bias) / self.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, bytes, bytes]], *, dim: int = 16, epochs: int = 6, rate: float = 1.0, batch: int = 16, seed: int = 7, accept_accuracy: float = 0.99) -> Model:
    """Stochastic gradient descent over bags of buckets in batches, then calibration."""
    languages = sorted({r[0] for r in rows})
    n, rng = len(languages), np.random.default_rng(seed)
    if n < 2:
        return Model(languages, np.zeros((BUCKETS, n)), np.zeros(n), 1.0, 0.0)
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[r[0]] for r in rows])
    sizes = np.array([len(w) // 2 for _, w, _ in rows])
    ends = np.cumsum(sizes)
    which, share = np.frombuffer(b"".join(w for _, w, _ in rows), np.uint16), np.frombuffer(b"".join(c for _, _, c in rows), np.float32)
    totals = np.maximum(1.0, np.bincount(np.repeat(np.arange(len(rows)), sizes), share, len(rows)))

    def matrix(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of some rows, and the rows' shares of them as a dense matrix."""
        at = np.repeat(ends[own] - np.cumsum(sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        row = np.repeat(np.arange(len(own)), sizes[own])
        slot[which[at]] = 1
        used = np.flatnonzero(slot)
        slot[used] = np.arange(len(used))
        dense = np.zeros((len(own), len(used)), np.float32)
        dense[row, slot[which[at]]] = share[at] / totals[own][row]
        slot[used] = 0
        return used, dense

    slot = np.zeros(BUCKETS, np.int64)
    embed, weight, bias = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, n)).astype(np.float32), np.zeros(n)
    order = rng.permutation(len(rows))
    held, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(learn)
        for first in range(0, len(shuffled), batch):
            own = shuffled[first : first + batch]
            used, x = matrix(own)
            mean = x @ embed[used]
            error = _softmax(mean @ weight + bias)
            error[np.arange(len(own)), y[own]] -= 1
            back = error @ weight.T
            weight -= (step * (mean.T @ error)).astype(np.float32)
            bias -= 0.1 * step * error.sum(axis=0)
            embed[used] -= (10 * step) * (x.T @ back).astype(np.float32)
    table = embed @ weight
    held = held if len(held) else order
    logits = np.concatenate([x @ table[used] + bias for used, x in (matrix(held[k : k + batch]) for k in range(0, len(held), batch))])
    grid = np.geomspace(0.2, 5, 33)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    rank = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= accept_accuracy)
    threshold = float(score[rank[good[-1]]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), bias, temperature, threshold)


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 2000, sample_rows: int = 100_000, **options) -> Model:
    """Trains on a sample of about ``sample_rows`` rows at most, ``per_language`` of each language."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().collect()  # one row a language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("lid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = min(per_language, max(1, sample_rows // len(counts)))
    share = F.create_map(*(F.lit(x) for row in counts for x in (row[0], min(1.0, each / row[1]))))
    chosen = draw < share[F.col(lang)]
    made = arrowmap.schema("_w binary, _c binary")
    sample = arrowmap.append(known.filter(chosen), [text], [lang, key], made, lambda cols: {k: pa.array(v, pa.binary()) for k, v in zip(("_w", "_c"), bags(cols[text]), strict=True)})
    rows = sorted(sample.select(lang, F.col(key).cast("string"), "_w", "_c").toLocalIterator(), key=lambda r: (r[1] or "", r[2]))
    return train([(r[0], bytes(r[2]), bytes(r[3])) for r in rows], **options)


SCHEMA = arrowmap.schema("lang_pred string, score double, rejected boolean")


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x languages

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        m, lang, score = shared.value, [], []
        for piece in slices(cols[text]):
            if not m.languages:
                lang += ["und"] * len(piece)
                score += [0.0] * len(piece)
                continue
            p = _softmax(m.logits(piece))
            best, letter = p.argmax(axis=1), has_letter(piece)
            lang += [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            score += np.where(letter, p.max(axis=1), 0.0).tolist()
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array([x < m.threshold or w == "und" for x, w in zip(score, lang, strict=True)], pa.bool_())}

    return arrowmap.append(docs, [text], [c for c in (keep if keep is not None else docs.columns)], SCHEMA, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the language of every document, learnt without the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = (arrowmap.crc32_text("doc_id") % 4) == 2
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model, keep=["doc_id", "held_out"])
