"""Sinks that readers never see half done: small files, published folders, resumable batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place, synced, and moved there; the old one stays until then."""
    fs, target = _path(spark, path)
    fs.mkdirs(target.getParent())
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    if not fs.rename(staged, target):
        backup = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        if not fs.rename(target, backup) or not fs.rename(staged, target):
            raise OSError(f"could not replace {path}")
        fs.delete(backup, False)


def write_json(spark: SparkSession, path: str, value) -> None:
    """JSON with sorted keys, so that equal values make equal files."""
    write_text(spark, path, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1) + "\n")


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a staged folder in another's place; if that fails, the old one is put back."""
    fs, new = _path(spark, staged)
    old = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not fs.exists(new):
        raise FileNotFoundError(staged)
    backup = spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.{uuid.uuid4().hex}") if fs.exists(old) else None
    fs.mkdirs(old.getParent())
    if backup is not None and not fs.rename(old, backup):
        raise OSError(f"could not move {target} away")
    if not fs.rename(new, old):
        if backup is not None:
            fs.rename(backup, old)
        raise OSError(f"could not publish {target}")
    if backup is not None:
        fs.delete(backup, True)


def in_steps(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], folder: str, steps: int = 10) -> DataFrame:
    """What ``work`` makes of all items, done in hash steps that are kept as they finish.

    A run that is repeated after a failure goes on with the steps that have no
    result yet.  A step's items are found by a hash of the key, so a step is
    the same in every run.
    """
    spark = items.sparkSession
    for k in range(steps):
        fs, done = _path(spark, f"{folder}/step={k}/_SUCCESS")
        if not fs.exists(done):
            work(items.filter(F.pmod(F.xxhash64(key), F.lit(steps)) == k)).write.mode("overwrite").parquet(f"{folder}/step={k}")
    return spark.read.parquet(*(f"{folder}/step={k}" for k in range(steps)))
