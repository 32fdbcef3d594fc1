"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage is a function of (spark, docs, sf_dir).  All but the last return
the columns of documents; n_chars follows a changed text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloria.llm import blocks, bpe, decontaminate, near_dup, quality, substring_dedup


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds.

    Null, empty or wordless texts go; null lang or source is a group of its own;
    equal rows share their verdict; extra columns stay, whatever they are called;
    an empty table gives an empty table.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (5-word shingles, similarity 0.8), the one with the smallest id.

    Rows of one id stay or go together; rows without an id and texts without a
    word are linked with nothing and stay; extra columns stay.
    """
    return near_dup.representatives(docs, shingle=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 13-word windows that a document with a smaller id has; a text of which nothing is left goes.

    A text that is cut has its other words joined by spaces; others, null and
    empty ones too, stay as they are.  A null id counts as the largest.
    """
    others = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"))
    found = substring_dedup.find_repeats(docs.select(others.alias("row"), "doc_id", "text"), n=13, keep=["row", "text"])
    changed = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(changed.select(*((text if c == "text" else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns))), docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages (10-word windows); a text that is nothing else goes.

    Null and empty texts have no words and stay; rows are judged one by one.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.decontaminate(docs, items, n=10), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every row, with token ids and the text that they decode to; a null text is an empty one."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.decode(bpe.encode(docs, ranks, keep=["doc_id", "lang", "source"]), ranks)
    return done.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring deduplication", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", tokenise),
]

#: SQL cannot express the token ids; the whole pipeline is tested against a plain version of it instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again.

    What a stage has read is deleted when its own result is written.
    """
    folder = f"{blocks.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if done is not None:
            blocks.deleted(spark, done)
        done = f"{folder}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
