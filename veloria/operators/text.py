"""Text operators: excerpts, digests, prior context, masking, linkage, HTML, full-text search."""

from __future__ import annotations

import difflib
import re
import unicodedata
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veloria.functions.columns import fold_marks, host, strip_html
from veloria.sources.shared import stored


@pandas_udf(T.StringType())
def plain_ascii(text: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition, marks dropped, lower-case ASCII words."""
    def one(t):
        if t is None:
            return None
        t = t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return " ".join(re.findall(r"[a-z0-9]+", t.lower()))

    return text.map(one)


@pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of sorted distinct words."""
    key = lambda t: " ".join(sorted(set((t or "").lower().split())))
    return pd.Series([difflib.SequenceMatcher(None, key(x), key(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@pandas_udf(T.StringType())
def mask_names(text: pd.Series, names: pd.Series) -> pd.Series:
    """Each name of the row replaced by PERSON1, PERSON2, ...; longer names first, whole words only."""
    def one(t, own):
        if t is None or own is None or len(own) == 0:
            return t
        order = {n.lower(): f"PERSON{k + 1}" for k, n in enumerate(own)}
        pattern = "|".join(re.escape(n) for n in sorted(order, key=lambda n: (-len(n), n)))
        return re.sub(rf"(?<!\w)(?:{pattern})(?!\w)", lambda m: order[m[0].lower()], t, flags=re.I)

    return pd.Series([one(t, n) for t, n in zip(text, names, strict=True)])


def top_items(items: DataFrame, by: list[str], order: list[Column], cap: int, chars: int) -> DataFrame:
    """The first ``cap`` items of each group with an excerpt of the text."""
    r = items.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("idx") <= cap)
    return r.withColumn("excerpt", F.substring("text", 1, chars)).drop("text")


def content_features(items: DataFrame, by: str) -> DataFrame:
    """Counts and rates of content classes by group."""
    has = lambda pattern: F.col("text").rlike(pattern)
    x = items.select(by, "n_chars", has(r"(?i)licen[sc]e").alias("licence"), has(r"[#*$%&]{3}").alias("symbols"), has(r"!!").alias("shouting"), has(r"\d{3}").alias("digits"))
    n = F.count("*")
    return x.groupBy(by).agg(n.alias("items"), F.count_if("licence").alias("licence"), F.count_if("symbols").alias("symbols"), F.count_if("shouting").alias("shouting"), (F.count_if("digits") / n).alias("digit_rate"), F.avg(F.col("n_chars").cast("double")).alias("mean_chars"))


def digest(turns: DataFrame, chars: int) -> DataFrame:
    """Ordered, cut and joined turns of each conversation, hashed."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars)).alias("t"))))
    text = F.array_join(F.transform(parts, lambda x: x["t"]), "\n")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(text, 256).alias("digest"))


def prior_context(turns: DataFrame) -> DataFrame:
    """How much came before each turn of its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.count("*").over(before).alias("n_prior"), F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)).alias("prior_chars"))


def page_title() -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def pages_text(pages: DataFrame) -> DataFrame:
    """Title, host and visible length of each page."""
    return pages.select("page_id", page_title().alias("title"), host(F.col("url")).alias("host"), F.char_length(strip_html(F.col("html"))).cast("long").alias("chars"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s"), F.lit(0))).cast("long").alias("links"))


def tokens(text: Column) -> Column:
    """Words of a text with marks folded."""
    return F.filter(F.split(fold_marks(text), "[^a-z0-9]+"), lambda w: w != "")


def inverted_index(docs: DataFrame) -> DataFrame:
    """(token, kind, doc_id, title_n, body_n): postings with counts in both columns."""
    parts = [docs.select("kind", "doc_id", F.explode(tokens(F.col(c))).alias("token"), F.lit(k).alias("part")) for k, c in enumerate(("title", "body"))]
    return parts[0].unionByName(parts[1]).groupBy("token", "kind", "doc_id").agg(F.count_if(F.col("part") == 0).alias("title_n"), F.count_if(F.col("part") == 1).alias("body_n"))


def search(docs: DataFrame, query: str, *, title_weight: float = 5.0, k1: float = 1.2, b: float = 0.75, limit: int = 50) -> DataFrame:
    """Documents that have a word with each of the query's prefixes, by column-weighted BM25."""
    wanted = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    if not wanted:
        raise ValueError("an empty query")
    index = stored(inverted_index(docs))  # texts are tokenised once, whatever is asked
    sized = index.groupBy("kind", "doc_id").agg(F.sum(F.col("title_n") + F.col("body_n")).alias("size"))
    totals = sized.agg(F.sum("size").alias("tokens")).join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("n", (F.col("tokens") / F.col("n")).alias("mean"))
    hit = [index.filter(F.col("token").startswith(w)).groupBy("kind", "doc_id").agg((title_weight * F.sum("title_n") + F.sum("body_n")).alias("f")).withColumn("q", F.lit(k)) for k, w in enumerate(wanted)]
    every = hit[0]
    for h in hit[1:]:
        every = every.unionByName(h)
    df = every.groupBy("q").agg(F.count("*").alias("df"))
    x = every.join(df, "q").join(sized, ["kind", "doc_id"]).join(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = x.groupBy("kind", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("got")).filter(F.col("got") == len(wanted)).drop("got")
    return scored.orderBy(F.desc(F.round("score", 6)), "kind", "doc_id").limit(limit)


def snippet(text: Column, prefix: str, words: int = 18) -> Column:
    """The first hit with words around it, the hit marked."""
    around = rf"(?i)((?:\S+\s+){{0,{words // 2}}})(\b{re.escape(prefix)}\w*)((?:\s+\S+){{0,{words // 2}}})"
    return F.concat(F.regexp_extract(text, around, 1), F.lit("<mark>"), F.regexp_extract(text, around, 2), F.lit("</mark>"), F.regexp_extract(text, around, 3))


def entity_candidates(people: DataFrame) -> DataFrame:
    """The best partner of each customer by additive evidence; the smaller key wins a tie.

    Blocking: partners are of one nation, and their balances lie in the same
    or in neighbouring bands of 20, so any two that are at most 20 apart meet.
    A pair is scored once and counts for both; who meets nobody has no row.
    """
    x = people.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal", F.floor(F.col("c_acctbal") / 20).alias("band"))
    y = x.select(F.col("c_custkey").alias("other"), F.col("c_name").alias("other_name"), "c_nationkey", F.col("c_mktsegment").alias("other_segment"), F.col("c_acctbal").alias("other_bal"), F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    pairs = x.join(y, ["c_nationkey", "band"]).filter("c_custkey < other")
    score = 0.4 + F.when(F.col("c_mktsegment") == F.col("other_segment"), 0.3).otherwise(0.0) + F.when(name_similarity("c_name", "other_name") >= 0.9, 0.2).otherwise(0.0) + F.when(F.abs(F.col("c_acctbal") - F.col("other_bal")) < 1, 0.1).otherwise(0.0)
    s = pairs.select("c_custkey", "other", F.round(F.least(F.lit(1.0), score), 6).alias("score"))
    s = s.select(F.inline(F.array(F.struct("c_custkey", "other", "score"), F.struct(F.col("other").alias("c_custkey"), F.col("c_custkey").alias("other"), "score"))))
    return s.groupBy("c_custkey").agg(F.max_by(F.struct("other", "score"), F.struct("score", -F.col("other"))).alias("best")).select("c_custkey", "best.other", "best.score")


def json_first(html: Column, attribute: str) -> Column:
    """A JSON document held in an HTML attribute, unescaped."""
    from veloria.functions.columns import unescape

    return unescape(F.regexp_extract(html, rf'{attribute}="([^"]*)"', 1))


def tolerant_json(text: str) -> str | None:
    """The first balanced {...} of a model's answer, without fences and comments."""
    text = re.sub(r"^\s*//[^\n]*$", "", re.sub(r"```(?:json)?", "", text), flags=re.M)
    depth, begin = 0, None
    for k, c in enumerate(text):
        if c == "{":
            begin = k if depth == 0 else begin
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[begin : k + 1]
    return None


def leak_audit(masked: DataFrame, text: str, names: str) -> DataFrame:
    """Masked rows in which one of the row's names still stands as a word."""
    return masked.filter(F.exists(F.col(names), lambda n: F.rlike(F.lower(F.col(text)), F.concat(F.lit(r"(^|\W)"), F.lower(n), F.lit(r"(\W|$)")))))
