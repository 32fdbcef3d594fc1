"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

Texts are lower-cased and folded to skeletons: look-alike letters of other
scripts, digits and symbols that stand for letters become those letters, and
i, l and 1 become one.  An Aho-Corasick automaton finds the lexicon's words
(as whole words); a match inside an exception phrase does not count.  The
sum of the matches' weights, and that sum divided by the text's length, give
the score through a logistic curve.

Lexicon, exceptions and curve are learnt from labelled rows: a bounded
sample of ``per_class`` rows of each label in expectation, chosen by a hash
of the id.  Weights are smoothed log odds of a word's document frequency in
distinct texts; ``least_documents`` toxic texts and a log-likelihood ratio of
``least_ratio`` admit a word, and at most ``lexicon_size`` of the strongest
are kept (a model's size, as the number of buckets of an embedding is).

Defined results: a null, empty or wordless text gets the score of a text
without matches; with no labelled row, or labels of one class only, the lexicon
is empty and the score is the same everywhere, below 1e-12 (without toxic rows)
or above 1 - 1e-12 (without clean ones); several labels of one id count as the
largest; repeated rows get equal scores; an empty table gives an empty table;
other columns are carried along, and one called score or predicted is replaced.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import arrowmap
from veloria.llm.blocks import stored

# Look-alikes of Latin letters (Cyrillic, Greek, symbols, digits).
LOOKALIKES = {
    "a": "аαɑ4@áàâäãå", "b": "вβ8", "c": "сϲç", "d": "ԁ", "e": "еεє3éèêë", "g": "ɡ9", "h": "һ", "i": "іιı1l|!íìîï", "j": "ј",
    "k": "кκ", "m": "м", "n": "пηñ", "o": "оοσ0óòôöõ", "p": "рρ", "s": "ѕ5$", "t": "тτ7", "u": "υúùûü", "v": "ѵν", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
FOLD = {ord(x): letter for letter, own in LOOKALIKES.items() for x in own if x not in "@$!|"}
SYMBOL = regex.compile(r"[@$!|](?=\p{L})")
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}
WORD = regex.compile(r"\p{L}+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    return text.translate(FOLD)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)):
        self.weights, self.exceptions, self.curve = dict(weights), sorted(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, text: str):
        """(start, end, word) of whole lexicon words outside exception phrases."""
        if not self.weights:
            return []
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for word in self.weights:
                a.add_word(word, (word, False))
            for phrase in self.exceptions:
                a.add_word(phrase, (phrase, True))
            a.make_automaton()
            self._automaton = a
        found, excepted = [], []
        for last, (word, is_phrase) in self._automaton.iter(text):
            first = last - len(word) + 1
            if (first == 0 or not text[first - 1].isalpha()) and (last + 1 == len(text) or not text[last + 1].isalpha()):
                (excepted if is_phrase else found).append((first, last + 1, word))
        if not excepted:
            return found
        reach, upto = {}, 0  # the furthest end of an exception that begins no later
        for a, b, _ in sorted(excepted):
            reach[a] = upto = max(upto, b)
        begins = sorted(reach)
        return [m for m in found if not (k := bisect.bisect(begins, m[0])) or reach[begins[k - 1]] < m[1]]

    def features(self, text: str) -> tuple[float, float]:
        total = sum(self.weights[w] for _, _, w in self.matches(text))
        length = 1 + text.count(" ") + text.count("\n")
        return math.log1p(max(0.0, total)), math.log1p(max(0.0, 100 * total / length))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _ratio(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of a of n1 against b of n0."""
    def part(k, n):
        p = k / n if n else 0.0
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    p = (a + b) / (n1 + n0)
    joint = ((a + b) * math.log(p) if a + b else 0.0) + ((n1 + n0 - a - b) * math.log(1 - p) if p < 1 else 0.0)
    return 2 * (part(a, n1) + part(b, n0) - joint)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method for a weighted logistic curve."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * weight.sum() * beta * (np.arange(len(beta)) > 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * weight.sum() * np.eye(len(beta))
        move = np.linalg.solve(hess, grad)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 10000, least_documents: int = 4, least_ratio: float = 20.0, lexicon_size: int = 2000, exceptions: Iterable[str] = ()) -> Lexicon:
    """Learns lexicon, exception phrases and curve from docs joined with labels on ``key``."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    sizes = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return Lexicon({}, curve=(-30.0 if not sizes.get(1) else 30.0, 0.0, 0.0))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("tox")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    chosen = known.filter(((F.col("_y") == 1) & (draw < share[1])) | ((F.col("_y") == 0) & (draw < share[0])))
    sample = docs.select(key, text).join(F.broadcast(chosen), key)  # at most about 2 x per_class ids
    sample = stored(sample.filter(F.col(text).isNotNull()).groupBy("_y", text).agg(F.count("*").alias("_n")))  # distinct texts and their copies

    words = _document_counts(sample, text)
    totals = Counter()
    for r in words.filter(F.col("word") == "").collect():
        totals[r._y] += r.n
    n1, n0 = totals[1], totals[0]
    if not n1 or not n0:
        return Lexicon({}, curve=(-30.0, 0.0, 0.0))
    table = words.filter(F.col("word") != "").groupBy("word").agg(F.sum(F.when(F.col("_y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("_y") == 0, F.col("n")).otherwise(0)).alias("b"))
    table = table.filter((F.col("a") >= least_documents) & (F.col("a") / F.lit(float(n1)) > 3 * F.col("b") / F.lit(float(n0))))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    top = table.withColumn("w", odds).orderBy(F.desc(F.col("a") * F.col("w")), "word").limit(4 * lexicon_size).collect()
    strong = sorted(((_ratio(r.a, r.b, n1, n0), r.word, r.w) for r in top), reverse=True)
    lexicon = Lexicon({w: odds for ratio, w, odds in strong[:lexicon_size] if ratio >= least_ratio}, exceptions)

    prior = sizes[1] / (sizes[0] + sizes[1])
    spots, phrases = _features(sample, text, lexicon)
    learnt = {r["phrase"] for r in phrases if r["a"] / n1 * prior < 0.5 * r["b"] / n0 * (1 - prior) * prior}
    lexicon.exceptions = sorted({*lexicon.exceptions, *learnt})
    x = np.array([[1.0, r["f1"], r["f2"]] for r in spots])
    y = np.array([float(r["_y"]) for r in spots])
    weight = np.array([float(r["n"]) / share[int(r["_y"])] for r in spots])
    lexicon.curve = tuple(float(v) for v in logistic(x, y, weight))
    lexicon._automaton = None
    return lexicon


def _document_counts(sample: DataFrame, text: str) -> DataFrame:
    """(word, _y, n): texts of the (distinct) sample of each label that hold the word; "" counts all."""
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((w, y) for w in {*WORD.findall(fold(t)), ""})
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "_y", "n"])

    return sample.select("_y", text).mapInArrow(run, "word string, _y int, n long").groupBy("word", "_y").agg(F.sum("n").alias("n"))


def _features(sample: DataFrame, text: str, lexicon: Lexicon) -> tuple[list, list]:
    """The curve's inputs, summed up over the rows of equal ones, and the phrases around matches.

    A phrase has the numbers of distinct toxic (a) and clean (b) texts that hold it; those of 5 clean ones or more are listed.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            spots, phrases = Counter(), Counter()
            for y, t, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = fold(t)
                f1, f2 = shared.value.features(t)
                spots[(y, "", round(f1, 2), round(f2, 2))] += rows
                near = set()
                for a, b, w in shared.value.matches(t):
                    before = _word_before(t, a - 1) if a and t[a - 1] == " " else ""
                    after = WORD.match(t, b + 1) if t[b : b + 1] == " " else None
                    near |= {f"{before} {w}"} if before else set()
                    near |= {f"{w} {after[0]}"} if after else set()
                phrases.update((y, p, 0.0, 0.0) for p in near)
            keys = [*spots, *phrases]
            counts = [*spots.values(), *phrases.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.float64()), pa.array([k[3] for k in keys], pa.float64()), pa.array(counts, pa.int64())], names=["_y", "phrase", "f1", "f2", "n"])

    found = sample.select("_y", text, "_n").mapInArrow(run, "_y int, phrase string, f1 double, f2 double, n long").groupBy("_y", "phrase", "f1", "f2").agg(F.sum("n").alias("n"))
    spots = found.filter(F.col("phrase") == "").collect()
    of = lambda y: F.sum(F.when(F.col("_y") == y, F.col("n")).otherwise(0))
    phrases = found.filter(F.col("phrase") != "").groupBy("phrase").agg(of(1).alias("a"), of(0).alias("b")).filter(F.col("b") >= 5).collect()
    return spots, phrases


def _word_before(text: str, end: int) -> str:
    """The word that ends at a place, if one does."""
    first = end
    while first and text[first - 1].isalpha():
        first -= 1
    return text[first:end]


SCHEMA = arrowmap.schema("score double, predicted int")


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded: lexicon_size words

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        values = [shared.value.score(fold(t)) for t in cols[text].to_pylist()]
        return {"score": pa.array(values, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in values], pa.int32())}

    return arrowmap.append(docs, [text], [c for c in (keep if keep is not None else docs.columns)], SCHEMA, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: toxicity of every document, learnt without the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = (arrowmap.crc32_text("doc_id") % 5) == 0
    lexicon = fit(docs, labels.filter(~held))
    return score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), lexicon, keep=["doc_id", "held_out"])
