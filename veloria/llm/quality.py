"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Native: every step is a DataFrame or SQL function.

Four measures of a text (share of symbols, of repeated lines, of words in
repeated 5-word windows, and characters a word) are judged against the texts
of the same language and source.  Their quantiles come from sketches that
count values in buckets of a geometric grid (relative error ``ACCURACY``);
sketches merge by adding counts, so they are pre-aggregated before the
shuffle, a hot source costs no more than any other, and the result does not
depend on the order of rows.  A sketch of fewer than ``LEAST_ROWS`` texts
gives way to that of the language, and then to that of all texts.  A limit
lies ``REACH`` quartile distances beyond the outer quartile, on both sides
for characters a word and above only for the shares; a distance counts as ``LEAST_SPREAD`` at least, so that a source whose texts are all
alike does not reject harmless deviation.  Limits are joined back to the
texts and whatever lies beyond one is rejected.

Defined results: null, empty or wordless texts have zero words and fail the
base rule (under 10 words); null lang or source is a group of its own;
repeated rows count and are judged one by one; an empty table gives an empty
table; extra columns are carried along by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloria.llm.blocks import stored

ACCURACY = 0.01
LEAST_ROWS = 50
REACH = 5.0
#: Groups whose limits may be broadcast.
BROADCAST_GROUPS = 20_000
#: Digests of rejected texts that may be broadcast.
BROADCAST_DIGESTS = 1 << 20
#: The least quartile distance of each measure.
LEAST_SPREAD = {"symbols": 0.01, "lines": 0.05, "repeats": 0.04, "length": 0.5}
#: Measures with a lower limit too; few symbols or repeats are never a fault.
TWO_SIDED = {"length"}
_GRID = 1 + 2 * ACCURACY
_SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _removed(text: Column, signs: str) -> Column:
    return F.char_length(F.translate(text, signs, ""))


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of each text, which replace columns of their names.

    Arrays are made in steps so that none is made twice.  Words and windows
    are compared by 64-bit hashes within one text.
    """
    taken = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in (*COUNTS, "n_lines") or c == text}
    names = list(taken.values())
    d = docs.select(*(F.col(c).alias(n) for c, n in taken.items()), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(*names, "_t", F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+"), "").alias("_a"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(*names, "_t", F.transform("_a", lambda w: F.xxhash64(w)).alias("_h"), F.char_length(F.array_join("_a", "")).cast("long").alias("word_chars"), lines.alias("_l"))
    h = F.col("_h")
    windows = F.when(F.size(h) >= 6, F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))
    d = d.select(*names, F.size(h).cast("long").alias("n_words"), "word_chars", (F.char_length("_t") - _removed(F.col("_t"), _SYMBOLS)).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").alias("n_lines"), windows.alias("_w"))
    w = F.col("_w")
    placed = F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    d = d.select(*names, *counts, placed.alias("_p"))
    p, last = F.col("_p"), F.size("_p") - 1
    twice = F.filter(p, lambda x, i: ((i > 0) & (p[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (p[F.least(i + 1, last)]["h"] == x["h"])))
    d = d.select(*names, *counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_s"))
    s, last = F.col("_s"), F.size("_s") - 1
    words = F.aggregate(F.transform(s, lambda x, i: F.when(i < last, F.least(s[F.least(i + 1, last)] - x, F.lit(5))).otherwise(5)), F.lit(0), lambda a, x: a + x)
    return d.select(*(F.col(n).alias(c) for c, n in taken.items()), *counts, F.coalesce(words, F.lit(0)).cast("long").alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "length": share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, bucket, n: counts on the geometric grid; zero has bucket null."""
    bucket = lambda x: F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(_GRID))).cast("int"))
    each = F.array(*(F.struct(F.lit(name).alias("measure"), bucket(x).alias("bucket")) for name, x in measures().items()))
    return counted.select(*by, F.inline(each)).groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, rows, q1, q3 of merged sketches."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by, "measure")
    running = merged.withColumn("upto", F.sum("n").over(own.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("rows", F.sum("n").over(own))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(_GRID), F.col("bucket")) / (1 + _GRID))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
    return running.groupBy(*by, "measure").agg(F.first("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source and the largest value of each measure, and the least of those in TWO_SIDED."""
    sketch = stored(sketches(counted.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"), ["_lang", "_source"]))
    fine, wide, whole = (quartiles(sketch, by) for by in (["_lang", "_source"], ["_lang"], []))
    name = lambda df, p: df.select(*(F.col(c) if c in ("_lang", "_source", "measure") else F.col(c).alias(p + c) for c in df.columns))
    wide = name(wide, "w_").withColumnsRenamed({"_lang": "l", "measure": "m"})
    joined = name(fine, "f_").join(wide, F.col("_lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).drop("l", "m").join(name(whole, "a_"), "measure")
    pick = lambda q: F.when(F.col("f_rows") >= LEAST_ROWS, F.col(f"f_{q}")).when(F.col("w_rows") >= LEAST_ROWS, F.col(f"w_{q}")).otherwise(F.col(f"a_{q}"))
    joined = joined.withColumn("q1", pick("q1")).withColumn("q3", pick("q3"))
    out = []
    for m, spread in LEAST_SPREAD.items():
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        own = lambda x, m=m: F.max(F.when(F.col("measure") == m, x))
        out += [own(F.col("q1") - reach).alias(f"{m}_least")] if m in TWO_SIDED else []
        out += [own(F.col("q3") + reach).alias(f"{m}_most")]
    return joined.groupBy("_lang", "_source").agg(*out)


def judged(counted: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counted with base_failed and kept; the bounds are broadcast if there are few."""
    bounds = stored(bounds)
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    joined = counted.join(bounds, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    good = F.lit(True)
    for m, x in measures().items():
        good = good & (x <= F.col(f"{m}_most"))
        good = good & (x >= F.col(f"{m}_least")) if m in TWO_SIDED else good
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(True))).drop(*bounds.columns)


def _identity(columns: list[str]) -> list[Column]:
    """128 bits that stand for the columns' values, null apart from empty."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return [F.xxhash64(F.lit(k), *parts).alias(f"_h{k}") for k in (1, 2)]


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass, with docs' columns.

    Each text is counted once; the counts are stored without it.  A verdict
    hangs on text, language and source alone, so the texts then meet the
    distinct digests of what is rejected, broadcast if they are few.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]  # no column of docs clashes with a count
    plain = docs.toDF(*names)
    t, own_lang, own_source = (names[docs.columns.index(c)] for c in (text, lang, source))
    own = _identity([t, own_lang, own_source])
    counted = stored(count(plain.select(t, own_lang, own_source, *own), t).drop(t))
    rejected = judged(counted, limits(counted, own_lang, own_source), own_lang, own_source).filter(~F.col("kept"))
    rejected = stored(rejected.select("_h1", "_h2").distinct())
    if rejected.count() <= BROADCAST_DIGESTS:
        rejected = F.broadcast(rejected)
    return plain.select("*", *own).join(rejected, ["_h1", "_h2"], "left_anti").select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    counted = stored(count(docs).drop("text"))
    done = judged(counted, limits(counted))
    return done.select("doc_id", *COUNTS, "base_failed", "kept")
