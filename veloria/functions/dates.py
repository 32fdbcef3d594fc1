"""Months as integers: year x 12 + month - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(ts: str | Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def month_date(m: str | Column) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))


def quarter_index(m: str | Column) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.floor(m / 3)


def is_weekend(ts: str | Column) -> Column:
    return F.weekday(ts).isin(5, 6)


def season_date(label: Column) -> Column:
    """``Winter 2023``, ``W23`` and the like as the first day of the batch."""
    season, year = F.lower(F.substring(label, 1, 2)), F.regexp_extract(label, r"(\d{2,4})\s*$", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year).try_cast("int")
    month = F.when(season.startswith("w"), 1).when(season == "sp", 3).when(season.startswith("s"), 6).when(season.startswith("f"), 9)
    return F.when(full.isNotNull() & month.isNotNull(), F.make_date(full, month, F.lit(1)))
