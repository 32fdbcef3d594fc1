"""Scalar expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accounts that look automated.
BOT_PATTERN = r"(?i)(bot|\[bot\]|-ci|automation)"


def is_bot(login: Column) -> Column:
    return login.rlike(BOT_PATTERN)


def draw(modulus: int, *parts: str | Column) -> Column:
    """A portable hash of the parts: the first 32 bits of md5, modulo."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus).alias("draw")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def host(url: Column) -> Column:
    """The bare host of a URL, without www; null for rubbish."""
    h = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#\s\[\]]+)", 1))
    h = F.regexp_replace(h, r"^www\.", "")
    return F.when(h.contains("."), h)


def handle(text: Column) -> Column:
    """A social handle from a URL or an @name."""
    h = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:https?://)?(?:www\.)?(?:twitter|x)\.com/", ""), r"^@", ""))
    h = F.regexp_extract(h, r"^([a-z0-9_]{1,15})", 1)
    return F.when(h != "", h)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


# HTML entities that the text extractor resolves.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def strip_html(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(body, r"<[^>]+>", " ")), r"\s+", " "))


# Letters with marks and the plain letters they fold to.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def fold_marks(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of schema: missing ones null, others cast without failing."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Counts as long, other numbers as double rounded to ``digits``."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)
