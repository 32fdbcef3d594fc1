"""Names of people, companies and accounts, and lists inside landed JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


# Legal forms at the end of a company's name, signs around it, and how a launch title begins and goes on.
LEGAL_FORM, OUTER = r"(?i)[,.]?\s*(inc|llc|ltd|corp|co)\.?$", " ,."
LAUNCH_BEGIN, LAUNCH_END = r"(?i)^launch hn:?\s+", r"\s*\(yc\s"


def company_core(name: Column) -> Column:
    """A company's name without its legal form and outer punctuation."""
    return F.btrim(F.regexp_replace(F.btrim(name), LEGAL_FORM, ""), F.lit(OUTER))


def _literal(phrase: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text with no letter or digit beside it, in any case."""
    return F.rlike(F.lower(text), F.concat(F.lit("(?<![A-Za-z0-9])"), _literal(F.lower(phrase)), F.lit("(?![A-Za-z0-9])")))


def launch_title(title: Column, phrase: Column) -> Column:
    """Whether a title announces the company by the launch format."""
    return F.rlike(F.btrim(title), F.concat(F.lit(LAUNCH_BEGIN), _literal(phrase), F.lit(LAUNCH_END)))


def username_variants(name: Column) -> Column:
    """Account names that a person's name suggests, sorted; empty for no name."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z ]", ""), " +"), lambda w: w != "")
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    joined = [F.concat(first, F.lit(sign), last) for sign in ("", "_", ".")]
    short = [F.concat(F.left(first, F.lit(1)), last), F.concat(first, F.left(last, F.lit(1))), F.when(F.length(first) >= 5, first)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*joined, *short))))


def author_grade(author: Column, login: Column, name: Column) -> Column:
    """How an author's account points to a person: the first rule that holds, or null."""
    a, own = F.lower(author), F.lower(F.coalesce(login, F.lit("")))
    inside = (own != "") & (F.least(F.length(a), F.length(own)) >= 5) & (F.contains(a, own) | F.contains(own, a))
    return F.when(a == own, "strong_author").when(inside, "author_substring").when(F.array_contains(username_variants(name), a), "author_name_variant")


def is_rare_login(login: Column) -> Column:
    return (F.length(login) >= 10) | ((F.length(login) >= 8) & login.rlike(r"[\p{Nd}_-]"))


def percentile_100(value: Column) -> Column:
    """A share or a percentile as 0 to 100; an error for anything else."""
    wrong = F.isnan(value.cast("double")) | (value < 0) | (value > 100)
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a percentile: "), value.cast("string")))).otherwise(F.when(value <= 1, value * 100.0).otherwise(value.cast("double")))


def first_number(text: Column) -> Column:
    """The first number of a text, thousands commas allowed; null if none."""
    return F.replace(F.nullif(F.regexp_extract(text, r"\d[\d,]*(?:\.\d+)?", 0), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def logins_of(links: Column, site: str, reserved: list[str], most: int = 8) -> Column:
    """Distinct account names in links to a site, in order, without reserved paths."""
    pattern = r"(?i)https?://(?:www\.)?" + site.replace(".", r"\.") + r"/([^/?#]+)"
    found = F.filter(F.transform(links, lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), pattern, 1)), lambda x: (x != "") & ~F.lower(x).isin(reserved or [""]))
    lowered = F.transform(found, lambda x: F.lower(x))
    return F.slice(F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1), 1, most)


def first_list(key: str):
    """A column function: JSON of the first list under the key, depth first, objects only; null if none."""

    def one(text: str | None) -> str | None:
        try:
            waiting = [json.loads(text)] if text else []
        except ValueError:
            return None
        while waiting:
            value = waiting.pop()
            if isinstance(value, dict) and isinstance(value.get(key), list):
                return json.dumps([x for x in value[key] if isinstance(x, dict)], sort_keys=True)
            inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
            waiting += reversed(list(inner))
        return None

    @pandas_udf(T.StringType())
    def found(text: pd.Series) -> pd.Series:
        return text.map(one)

    return found
