"""The registry of queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veloria.plans import audit, detail, evaluation, graph, ingest, lifecycle, panel, profile, semantics, serving, text

_MODULES = [ingest, panel, evaluation, graph, serving, text, profile, audit, detail, semantics, lifecycle]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
