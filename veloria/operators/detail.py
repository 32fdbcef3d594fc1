"""Finer reads of people, repositories and scores: as-of context, repository flags, budgets, fills, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloria.operators import evaluation as ev
from veloria.operators.panel import LAST, WARM, over, spine
from veloria.operators.ranking import numbered


def as_of_context(events: DataFrame, people: DataFrame, types: dict[str, str], at: list[int], last: int = 5) -> DataFrame:
    """What was known of each person strictly before month b - k, for each k of ``at``.

    events: actor, m, ts, id, line, repo, is_own, kind.  Counts of each kind,
    share of own repositories, repositories, tenure, recency, and the ``last``
    touched repositories, the newest first, padded with -1.  The past begins 62
    months before b.  Everything is first summed up by month, so a busy person is 62 rows like any other.
    """
    new = F.row_number().over(Window.partitionBy("actor", "repo").orderBy("ts", "id", "line")) == 1
    inside = events.join(people.select("actor", "b"), "actor").filter((F.col("m") >= F.col("b") - WARM) & (F.col("m") < F.col("b") - LAST)).drop("b")
    rows = inside.withColumn("new", new)
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "id", "line", "repo")))), 1, last)
    monthly = rows.groupBy("actor", "m").agg(F.count("*").alias("n"), F.count_if("is_own").alias("own"), F.count_if("new").alias("repos"), *(F.count_if(F.col("kind") == t).alias(c) for c, t in types.items()), newest.alias("_newest"))
    grid = spine(people).join(monthly, ["actor", "m"], "left")
    before, sums = over(Window.unboundedPreceding, -1), ["n", "own", "repos", *types]
    total = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}
    seen = F.flatten(F.reverse(F.collect_list(F.transform("_newest", lambda x: x["repo"])).over(Window.partitionBy("actor").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))))
    first, latest = (f(F.when(F.col("n") > 0, F.col("m"))).over(before) for f in (F.min, F.max))
    x = grid.select("actor", "b", "m", *(v.alias(c) for c, v in total.items()), first.alias("_first"), latest.alias("_latest"), F.slice(F.concat(seen, F.array_repeat(F.lit(-1).cast("long"), last)), 1, last).alias("_last"))
    x = x.filter(reduce(Column.__or__, [F.col("m") == F.col("b") - k for k in at]))
    own_share = F.when(F.col("n") > 0, F.col("own") / F.col("n")).otherwise(0.0)
    return x.select("actor", "m", "n", *types, "repos", own_share.alias("own_share"), F.log1p(F.col("n").cast("double")).alias("log_n"), F.coalesce(F.col("m") - F.col("_first"), F.lit(0)).alias("tenure"), F.coalesce(F.col("m") - F.col("_latest"), F.lit(99)).alias("recency"), F.array_join(F.transform("_last", lambda r: r.cast("string")), ",").alias("last_repos"))


def repository_series(events: DataFrame, pushed: Column) -> DataFrame:
    """Events, pushes and exact distinct actors of each repository and month."""
    return events.groupBy("repo", "m").agg(F.count("*").alias("n"), F.count_if(pushed).alias("pushes"), F.count_distinct("actor").alias("actors"))


def repository_flags(series: DataFrame, end: int, hot: int = 10) -> DataFrame:
    """Whether any three months in a row held ``hot`` events, the tail without events, months active of the last six, the longest silence within."""
    s = series.withColumn("n3", F.sum("n").over(Window.partitionBy("repo").orderBy("m").rangeBetween(-2, 0))).withColumn("gap", F.col("m") - F.lag("m").over(Window.partitionBy("repo").orderBy("m")) - 1)
    return s.groupBy("repo").agg((F.max("n3") >= hot).alias("hot"), (F.lit(end) - F.max("m")).alias("tail"), F.count_if(F.col("m") > end - 6).alias("active6"), F.coalesce(F.max("gap"), F.lit(0)).alias("silence"))


def trends(scored: DataFrame, steady: float = 0.003) -> DataFrame:
    """Least-squares slope of each person's whole trajectory, by its place."""
    x = scored.withColumn("x", F.row_number().over(Window.partitionBy("actor").orderBy("m")) - 1)
    s = x.groupBy("actor").agg(F.regr_slope("score", "x").alias("slope"), F.count("*").alias("months"))
    return s.withColumn("trend", F.when(F.col("slope") > steady, "improving").when(F.col("slope") < -steady, "declining").otherwise("stable"))


def content_ratios(items: DataFrame, by: str, classes: dict[str, str]) -> DataFrame:
    """Items of each class of content, and each class against the others' sum, at least one in the denominator."""
    hits = {c: F.count_if(F.col("text").rlike(p)) for c, p in classes.items()}
    g = items.groupBy(by).agg(F.count("*").alias("items"), *(v.alias(c) for c, v in hits.items()), F.sum(F.char_length("text")).alias("chars"))
    ratios = [(F.col(c) / F.greatest(sum((F.col(o) for o in classes if o != c), F.lit(0)), F.lit(1))).alias(f"{c}_ratio") for c in classes]
    return g.select("*", *ratios, (F.col("chars") / F.greatest(F.col("items"), F.lit(1))).alias("mean_chars"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Rows in each half-open band [edge, next edge); missing values apart."""
    bands = F.when(F.col(value).isNull(), "missing").when(F.col(value) < edges[0], f"below {edges[0]}")
    for a, b in zip(edges, edges[1:], strict=False):
        bands = bands.when(F.col(value) < b, f"{a} to {b}")
    return rows.groupBy(bands.otherwise(f"{edges[-1]} and above").alias("band")).agg(F.count("*").alias("n"))


def accounted(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each rule is the first to drop, and how many pass them all."""
    reason = None
    for name, keeps in rules:
        lost = ~F.coalesce(keeps, F.lit(False))
        reason = F.when(lost, name) if reason is None else reason.when(lost, name)
    return rows.groupBy(reason.otherwise("selected").alias("outcome")).agg(F.count("*").alias("n"))


def budget_metrics(summary: DataFrame, recall_share: float = 0.1, lift_share: float = 0.01) -> DataFrame:
    """Recall within the first tenth of the ranking, and lift in its first hundredth."""
    r = numbered(summary, "peak", [F.asc("actor")])
    k1, k2 = F.ceil(F.col("_all") * recall_share), F.ceil(F.col("_all") * lift_share)
    y = F.col("positive").cast("double")
    return r.agg((F.sum(F.when(F.col("rank") <= k1, y).otherwise(0.0)) / F.sum(y)).alias("recall"), (F.avg(F.when(F.col("rank") <= k2, y)) / F.avg(y)).alias("lift"), F.count("*").alias("people"))


def tie_diagnostics(summary: DataFrame, ks: list[int]) -> DataFrame:
    """For each cut k: people who share their score, ties of both classes, and how many tie across the cut."""
    c = ev.running(summary.groupBy("peak").agg(F.count("*").alias("n"), F.count_if("positive").alias("p")), "peak", ["n"], [])
    mixed = (F.col("n") > 1) & (F.col("p") > 0) & (F.col("p") < F.col("n"))
    each = c.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    across = (F.col("c_n") > F.col("k")) & (F.col("c_n") - F.col("n") < F.col("k")) & (F.col("n") > 1)
    return each.groupBy("k").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied"), F.count_if(mixed).alias("mixed_ties"), F.sum(F.when(across, F.col("n")).otherwise(0)).alias("at_cut"))


def alpha_grid(rows: DataFrame, alphas: list[float]) -> DataFrame:
    """Within-month precision of the blend for each alpha, and which is the best (the smaller of equal ones).

    rows: m, y, score, second.
    """
    logit = lambda c: F.log(c / (1 - c))
    x = rows.select("m", "y", "score", "second", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    x = x.withColumn("blend", F.round(F.col("alpha") * logit(F.col("score")) + (1 - F.col("alpha")) * logit(F.col("second")), 9))
    m = ev.average_precision(x, ["alpha", "m"], "blend").filter("ap is not null")
    g = m.groupBy("alpha").agg((F.sum(F.col("ap") * F.col("positives")) / F.sum("positives")).alias("ap"))
    best = g.agg(F.max_by("alpha", F.struct(F.round("ap", 9), -F.col("alpha"))).alias("best"))
    return g.join(F.broadcast(best)).select("alpha", "ap", (F.col("alpha") == F.col("best")).alias("chosen"))


def frozen_ranks(events: DataFrame, people: DataFrame, vintage: int, near: int, far: int) -> DataFrame:
    """Median rank percentile, at a vintage, of positives that begin soon after it and later."""
    before = events.filter((F.col("m") >= vintage - 12) & (F.col("m") < vintage)).groupBy("actor").agg(F.count("*").alias("n"))
    r = numbered(before, "n", [F.asc("actor")]).join(people.filter("positive").select("actor", "b"), "actor")
    lead = F.col("b") - F.lit(vintage)
    group = F.when((lead > 0) & (lead <= near), "near").when((lead > near) & (lead <= far), "far")
    return r.withColumn("horizon", group).filter("horizon is not null").groupBy("horizon").agg(F.count("*").alias("people"), F.percentile(F.col("rank") / F.col("_all"), F.lit(0.5)).alias("median_percentile"))


def text_budget(items: DataFrame, by: str, order: list[Column], budget: int, most: int) -> DataFrame:
    """Excerpts of the newest ``most`` items of each group; the budget is shared evenly among those there are."""
    own = Window.partitionBy(by)
    x = items.withColumn("place", F.row_number().over(own.orderBy(*order))).filter(F.col("place") <= most)
    share = F.floor(F.lit(budget) / F.count("*").over(own)).cast("int")
    return x.withColumn("excerpt", F.substring(F.col("text"), F.lit(1), share)).drop("text")


def filled_sample(rows: DataFrame, by: list[str], stratum: str, order: list[Column], most: int) -> DataFrame:
    """``most`` rows of each group, evenly from its strata; what strata lack is filled up from the others in order."""
    own = Window.partitionBy(*by)
    strata = rows.groupBy(*by).agg(F.count_distinct(stratum).alias("_strata"))
    x = rows.join(strata, by) if by else rows.join(F.broadcast(strata))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by, stratum).orderBy(*order))).filter(F.col("_r") <= most)
    x = x.withColumn("_extra", (F.col("_r") > F.floor(F.lit(most) / F.col("_strata"))).cast("int"))
    return x.withColumn("pick", F.row_number().over(own.orderBy("_extra", *order)).cast("long")).filter(F.col("pick") <= most).drop("_strata", "_r", "_extra")


def universe(touched: DataFrame, created: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct valid repositories that were touched or created, and whether the cohort owns them."""
    every = touched.select("name").union(created.select("name")).distinct().filter(F.col("name").rlike("^[^/]+/[^/]+$"))
    mine = owners.select(F.lower("owner").alias("_o")).distinct()
    return every.withColumn("owner", F.lower(F.split_part("name", F.lit("/"), F.lit(1)))).join(mine, F.col("owner") == F.col("_o"), "left").select("name", F.col("_o").isNotNull().alias("owned"))


def split_rooms(universe_: DataFrame, counts: DataFrame, small: int) -> DataFrame:
    """Repositories with their actors (none counted: 0): regular if small, capped if owned and larger; others fall away."""
    x = universe_.join(counts, "name", "left").withColumn("actors", F.coalesce("actors", F.lit(0)))
    return x.filter(F.col("owned") | (F.col("actors") <= small)).withColumn("room", F.when(F.col("actors") <= small, "regular").otherwise("capped"))


def column_checks(df: DataFrame, not_null: list[str] = [], non_negative: list[str] = [], positive: list[str] = []) -> DataFrame:  # noqa: B006
    """Violations of each column's rule, all counted in one pass."""
    rules = [(c, "not null", F.col(c).isNull()) for c in not_null] + [(c, "not negative", F.col(c) < 0) for c in non_negative] + [(c, "positive", ~(F.col(c) > 0) | F.col(c).isNull()) for c in positive]
    counts = df.agg(*(F.count_if(broken).alias(f"v{k}") for k, (_, _, broken) in enumerate(rules)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"v{k}").alias("violations")) for k, (c, rule, _) in enumerate(rules)))))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with missing values of the columns as zero; an infinite or undefined one fails the query."""
    ok = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a feature is not finite")).cast("double")).otherwise(F.coalesce(c, F.lit(0.0)))
    return df.withColumns({c: ok(F.col(c).cast("double")) for c in columns})


def joined_once(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", both: bool = False) -> DataFrame:
    """A join that must not multiply rows: the right side's keys are unique, with ``both`` the left's too, or it fails."""
    for side, name in ((right, "right"), *(((left, "left"),) if both else ())):
        if repeated := side.groupBy(*on).count().filter("count > 1").limit(1).collect():  # one row
            raise ValueError(f"the {name} side has {tuple(repeated[0])} more than once")
    return left.join(right, on, how)


def account_score(same_handle: Column, same_domain: Column, same_company: Column, similarity: Column, only: Column, bot: Column) -> Column:
    """Additive evidence that an account is a person's, from 0 to 1."""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    raw = part(same_handle, 0.5) + part(same_domain, 0.4) + part(same_company, 0.3) + part(similarity >= 0.9, 0.2) + part(only, 0.1) - part(bot, 0.3)
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 6)


def best_account(candidates: DataFrame, person: str, account: str, score: str) -> DataFrame:
    """Each person's best account, the first by name of equal ones; below nothing it has none."""
    g = candidates.groupBy(person).agg(F.min_by(F.struct(account, score), F.struct(-F.col(score), account)).alias("x"))
    return g.select(person, F.when(F.col(f"x.{score}") > 0, F.col(f"x.{account}")).alias(account), F.col(f"x.{score}").alias(score))


def stable_json(mapping: Column) -> Column:
    """A map as JSON with its keys in order, so that equal maps make equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (file, sha256, length) that differ from a manifest, are missing, or are not in it."""
    x = found.select("file", F.col("sha256").alias("_s")).join(expected.select("file", "sha256"), "file", "full_outer")
    kind = F.when(F.col("_s").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_s") != F.col("sha256"), "changed")
    return x.withColumn("problem", kind).filter("problem is not null").select("file", "problem")
