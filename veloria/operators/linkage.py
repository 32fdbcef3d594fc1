"""Links between labels, accounts and repositories: snapshots, preferred matches, leaks, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def founder_snapshot(raw: DataFrame, resolved: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """Final labels if there are any, else raw rows with what was resolved for them (key: person)."""
    if final is not None:
        return final
    return raw.join(resolved, "person", "left")


def preferred(rows: DataFrame, labels: DataFrame, key: str, same: list[str], order: list[str]) -> DataFrame:
    """Each row with one label of its key: the first that agrees in ``same``, else the first by ``order``.

    Label columns get the prefix l_.  Rows without a label fall away; ``audit.covered`` lists them.
    """
    own = labels.select(F.col(key).alias("_key"), *(F.col(c).alias(f"l_{c}") for c in labels.columns if c != key))
    agrees = F.lit(True)
    for c in same:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    joined = rows.withColumn("_row", F.monotonically_increasing_id()).join(own, F.col(key) == F.col("_key")).withColumn("_rank", F.row_number().over(Window.partitionBy("_row").orderBy(F.desc(agrees), *(F.col(f"l_{c}") for c in order))))
    return joined.filter("_rank = 1").drop("_key", "_row", "_rank")


def domain_leaks(repos: DataFrame, people: DataFrame) -> DataFrame:
    """The first repository of each actor whose name shows one of the actor's company domains.

    repos: actor, repo, ordinal (equal ones go by name); people: actor, domains (array).  A name shows a
    domain if it holds it, or if one of its parts is the domain or its stem.
    """
    x = repos.join(people.select("actor", F.posexplode("domains").alias("nth", "domain")), "actor")
    name, domain = F.lower(F.coalesce("repo", F.lit(""))), F.lower(F.col("domain"))
    bare = F.regexp_replace(domain, r"^\.+|\.+$", "")
    parts = F.filter(F.split(name, "[/._-]+"), lambda p: p != "")
    tokens = F.when(bare != "", F.array(bare, F.split_part(bare, F.lit("."), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    shown = x.filter(name.contains(domain) | F.arrays_overlap(parts, tokens))
    return shown.groupBy("actor").agg(F.min_by(F.struct("repo", "domain"), F.struct("ordinal", "nth", "repo")).alias("x")).select("actor", "x.repo", "x.domain", F.lit("company_website_domain_in_pre_cutoff_repo_name").alias("reason"))


def graded(rows: DataFrame, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """rows with ``grade``: the name of the first rule that holds."""
    grade = None
    for name, rule in rules:
        held = F.coalesce(rule, F.lit(False))
        grade = F.when(held, name) if grade is None else grade.when(held, name)
    return rows.withColumn("grade", grade.otherwise(otherwise))


def titles_linked(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """(title_id, doc_id, grade): documents that hold the whole title as words.

    Candidates meet by a word: of each title the rarest one in the documents, so
    a common word makes no long lists; the whole title is then confirmed.
    Titles of one word are linked too.  Grade: exact if the document's text is
    the title, start if it begins with it, else inside.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    t = titles.select("title_id", F.array_join(words(F.col("title")), " ").alias("title"), F.array_distinct(words(F.col("title"))).alias("tw")).filter(F.size("tw") > 0)
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    vocabulary = t.select(F.explode("tw").alias("word")).distinct()
    held = d.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(vocabulary, "word")  # only words of titles
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    rarest = t.select("title_id", "title", F.explode("tw").alias("word")).join(often, "word", "left").groupBy("title_id", "title").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    near = rarest.join(held, "word").join(d.select("doc_id", F.array_join("w", " ").alias("body")), "doc_id")
    whole = F.concat(F.lit(" "), F.col("body"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("title"), F.lit(" ")))
    grade = F.when(F.col("body") == F.col("title"), "exact").when(F.concat(F.col("body"), F.lit(" ")).startswith(F.concat(F.col("title"), F.lit(" "))), "start").otherwise("inside")
    return near.filter(whole).select("title_id", "doc_id", grade.alias("grade"))


def strata(people: DataFrame, peaks: DataFrame, pilot: DataFrame) -> DataFrame:
    """People with a peak, and their pilot stratum if they were in it; all three grow with the people and none is broadcast."""
    return people.join(peaks.hint("merge"), "actor").join(pilot.hint("merge"), "actor", "left").withColumn("stratum", F.coalesce("stratum", F.lit("new")))


def companies(payload: Column) -> Column:
    """Rows of a JSON array of companies: names trimmed, teams as whole numbers, industries always a list."""
    parsed = F.from_json(payload, "array<struct<slug:string,name:string,team_size:string,industries:string,industry:string>>")
    listed = lambda x: F.coalesce(F.from_json(x["industries"], "array<string>"), F.when(x["industries"].isNotNull(), F.array(x["industries"])), F.when(x["industry"].isNotNull(), F.array(x["industry"])), F.array().cast("array<string>"))
    return F.transform(parsed, lambda x: F.struct(x["slug"].alias("slug"), F.trim(x["name"]).alias("name"), x["team_size"].try_cast("double").cast("long").alias("team_size"), listed(x).alias("industries")))


def normalise_companies(payloads: DataFrame, column: str) -> DataFrame:
    """One row a slug; of several the first by payload and place counts."""
    x = payloads.select(F.monotonically_increasing_id().alias("_p"), F.posexplode(companies(F.col(column))).alias("_k", "c")).select("_p", "_k", "c.*").filter("slug is not null and slug <> ''")
    return x.groupBy("slug").agg(F.min_by(F.struct("name", "team_size", "industries"), F.struct("_p", "_k")).alias("x")).select("slug", "x.*")
