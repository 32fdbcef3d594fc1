"""Scalar expressions over dates, names, maps and encodings; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months' names in order.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def owner_of(repo: Column) -> Column:
    """The owner in ``owner/name``; null without a slash."""
    return F.when(repo.contains("/"), F.split_part(repo, F.lit("/"), F.lit(1)))


def plus_months(day: Column, months: int | Column) -> Column:
    """The same day of a later month, or that month's last day."""
    return F.add_months(day, months)


def months_apart(later: Column, earlier: Column) -> Column:
    """Days between two dates in months of 30.44 days."""
    return F.datediff(later, earlier) / F.lit(30.44)


def iso_timestamp(text: Column) -> Column:
    """An ISO timestamp, without a zone taken as UTC (the session's zone); null for rubbish."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def side_of_cutoff(time: Column, cutoff: Column) -> Column:
    """pre_cutoff before the cutoff's day, else post_cutoff; null where either is missing."""
    return F.when(F.to_date(time) < cutoff, "pre_cutoff").when(time.isNotNull() & cutoff.isNotNull(), "post_cutoff")


def month_in_text(text: Column) -> Column:
    """The first "Month 20xx" of a text as the month's first day."""
    pattern = rf"(?i)\b({'|'.join(MONTH_NAMES)})\s+(20\d{{2}})\b"
    number = F.create_map(*(F.lit(x) for k, name in enumerate(MONTH_NAMES, 1) for x in (name.lower(), k)))
    month = F.lower(F.regexp_extract(text, pattern, 1))
    return F.when(month != "", F.make_date(F.regexp_extract(text, pattern, 2).cast("int"), F.try_element_at(number, month), F.lit(1)))


def humanised(name: Column) -> Column:
    """A feature's name for people: words apart, months spelt out, each word with a capital."""
    words = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\b(\d+)m\b", "last $1 months")
    return F.initcap(words)


def valid_utf8(data: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(data.cast("string"))


def over_wire(text: Column) -> Column:
    """Free text as base64, which no separator or control sign breaks."""
    return F.base64(F.encode(text, "UTF-8"))


def from_wire(text: Column) -> Column:
    return valid_utf8(F.unbase64(text))


def coded(value: Column, codes: dict[str, float], what: str) -> Column:
    """The code of each value; an unknown or missing one fails the query."""
    out = None
    for name, code in codes.items():
        out = F.when(value == name, F.lit(code)) if out is None else out.when(value == name, F.lit(code))
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null"))))
    return out.otherwise(unknown.cast("double" if isinstance(next(iter(codes.values())), float) else "string"))


def value_of(mapping: Column, key: str, otherwise: Column | None = None) -> Column:
    """A map's value, or the default for a missing key."""
    got = F.try_element_at(mapping, F.lit(key))
    return got if otherwise is None else F.coalesce(got, otherwise)
