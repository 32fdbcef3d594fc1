"""Temporal evaluation: ranking metrics, matched groups, lead time, calibration, re-scoring.

Metrics never sort a whole table in one task: rows are first counted by
distinct score (partial aggregation), and running sums over those counts are
made in ranges (``ranking``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloria.functions.columns import draw, ratio
from veloria.operators.ranking import numbered, running
from veloria.sources.shared import stored

#: Groups whose values may be broadcast.
BROADCAST_GROUPS = 1 << 20


def by_score(rows: DataFrame, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Per distinct score: rows, positives, and both summed up from the highest score down."""
    g = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("tp"))
    c = running(g, "s", ["tp", "n"], by)
    return c.select(*by, "s", "n", "tp", F.col("c_tp").alias("ctp"), F.col("c_n").alias("cn"), F.col("t_tp").alias("p"), F.col("t_n").alias("all"))


def average_precision(rows: DataFrame, by: list[str] = [], score: str = "score", label: str = "y") -> DataFrame:  # noqa: B006
    """Step-wise average precision, ties taken together; null where a class is missing."""
    c = by_score(rows, by, score, label)
    ap = F.sum(F.when((F.col("p") > 0) & (F.col("p") < F.col("all")), F.col("tp") / F.col("p") * F.col("ctp") / F.col("cn")))
    return c.groupBy(*by).agg(ap.alias("ap"), F.sum("n").alias("rows"), F.sum("tp").alias("positives"))


def pr_curve(rows: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    return by_score(rows, [], score, label).select(F.col("s").alias("threshold"), (F.col("ctp") / F.col("cn")).alias("precision"), (F.col("ctp") / F.col("p")).alias("recall"))


def roc_auc(rows: DataFrame, by: list[str] = [], score: str = "score", label: str = "y") -> DataFrame:  # noqa: B006
    """Mann-Whitney area with ties as halves."""
    c = by_score(rows, by, score, label)
    negatives, above = F.col("n") - F.col("tp"), F.col("cn") - F.col("ctp")
    wins = F.col("tp") * (F.col("all") - F.col("p") - above + negatives / 2)
    return c.groupBy(*by).agg((F.sum(wins) / F.nullif(F.max(F.col("p") * (F.col("all") - F.col("p"))), F.lit(0))).alias("auc"))


def within_month(rows: DataFrame, least: int = 5) -> DataFrame:
    """Average precision by month: weighted by positives, plainly averaged, and the base rate."""
    m = average_precision(rows, ["m"]).filter(F.col("ap").isNotNull())
    w = F.col("positives")
    return m.agg((F.sum(F.col("ap") * w) / F.sum(w)).alias("weighted_ap"), F.avg(F.when(F.col("rows") >= least, F.col("ap"))).alias("mean_ap"), (F.sum(w / F.col("rows") * w) / F.sum(w)).alias("base_rate"), F.count("*").alias("months"))


def quintiles(rows: DataFrame, value: str, by: str = "m") -> DataFrame:
    """rows with ``q``: how many of the group's quintile boundaries lie below the value."""
    edges = rows.groupBy(by).agg(F.percentile(value, F.array(*(F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    e = F.col("e")
    return rows.join(edges, by).withColumn("q", sum(((e[k] < F.col(value)).cast("long") for k in range(4)), F.lit(0).cast("long"))).drop("e")


def tenure_cells(rows: DataFrame) -> DataFrame:
    cells = average_precision(quintiles(rows, "tenure"), ["m", "q"])
    some = F.col("ap").isNotNull()
    return cells.groupBy("q").agg(F.sum("rows").alias("rows"), F.count_if(some).alias("cells"), (F.sum(F.when(some, F.col("ap") * F.col("positives"))) / F.sum(F.when(some, F.col("positives")))).alias("ap"))


def person_summary(scored: DataFrame) -> DataFrame:
    """First, current and best score of each person, and the last three months' slope."""
    before = F.max(F.when(F.col("m") == F.col("b") - 14, F.col("score")))
    s = scored.groupBy("actor").agg(F.first("grp").alias("grp"), F.bool_or("positive").alias("positive"), F.max("score").alias("peak"), F.max_by("score", "m").alias("current"), F.min_by("score", "m").alias("first_score"), before.alias("_before"))
    return s.withColumn("momentum", (F.col("current") - F.col("_before")) / 2).drop("_before")


def matched_ranks(summary: DataFrame) -> DataFrame:
    """Expected rank of each group's positive under ties, in closed form."""
    pos = summary.filter("positive").select("grp", F.col("peak").alias("p"))
    j = summary.join(pos, "grp").groupBy("grp").agg(F.count_if(F.col("peak") > F.col("p")).alias("h"), F.count_if(F.col("peak") == F.col("p")).alias("t"), F.count("*").alias("n")).filter("n > 1")
    half = F.ceil(F.col("n") / 2)
    first = F.when(F.col("h") == 0, 1 / F.col("t")).otherwise(F.lit(0.0))
    top = F.least(F.greatest(half - F.col("h"), F.lit(0)), F.col("t")) / F.col("t")
    return j.agg(F.count("*").alias("groups"), F.avg(first).alias("rank1"), F.avg(1 / F.col("n")).alias("chance"), F.avg(top).alias("top_half"), F.avg((F.col("h") + (F.col("t") - 1) / 2) / (F.col("n") - 1)).alias("norm_rank"))


def pairwise(summary: DataFrame, value: str = "peak") -> DataFrame:
    """Positives against their own group's controls."""
    pos = summary.filter("positive").select("grp", F.col(value).alias("p"))
    j = summary.filter("not positive").join(pos, "grp")
    return j.agg(F.count_if(F.col("p") > F.col(value)).alias("wins"), F.count_if(F.col("p") == F.col(value)).alias("ties"), F.count_if(F.col("p") < F.col(value)).alias("losses"), F.avg(F.when(F.col("p") > F.col(value), 1.0).when(F.col("p") == F.col(value), 0.5).otherwise(0.0)).alias("auc"))


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of an order, without sorting the rest."""
    return rows.orderBy(*order).limit(k)


def precision_at(summary: DataFrame, ks: list[int]) -> DataFrame:
    order = [F.desc("peak"), F.asc("actor")]
    base = summary.agg(F.count("*").alias("all"), F.count_if("positive").alias("p"))
    best = top_k(summary, max(ks), order).select("positive", F.row_number().over(Window.orderBy(*order)).alias("r"))  # at most max(ks) rows
    each = best.select("positive", F.explode(F.array(*(F.when(F.col("r") <= k, k) for k in ks))).alias("k")).filter("k is not null").groupBy("k").agg(F.count_if("positive").alias("hit"), F.count("*").alias("n"))
    return each.join(F.broadcast(base)).select(F.col("k").cast("long").alias("k"), (F.col("hit") / F.col("n")).alias("precision"), (F.col("hit") / F.col("p")).alias("recall"), (F.col("hit") / F.col("n") / (F.col("p") / F.col("all"))).alias("lift"))


def score_percentiles(summary: DataFrame) -> DataFrame:
    r = numbered(summary, "peak", [F.asc("actor")])
    return r.select("actor", F.col("rank").cast("long").alias("rank"), ((F.col("_all") - F.col("rank") + 1) / F.col("_all")).alias("percentile"))


def detections(scored: DataFrame, q: float = 0.99) -> DataFrame:
    """First month in which a positive reaches its month's control quantile, and the lead."""
    bar = scored.filter("not positive").groupBy("m").agg(F.percentile("score", F.lit(q)).alias("bar"))
    hits = scored.filter("positive").join(bar, "m", "left").groupBy("actor", "b").agg(F.min(F.when(F.col("score") >= F.col("bar"), F.col("m"))).alias("detected"))
    return hits.select("actor", "detected", (F.col("b") - F.col("detected")).alias("lead"))


def lead_summary(found: DataFrame, boundary: int = 48) -> DataFrame:
    q = F.percentile("lead", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return found.agg((F.count("detected") / F.count("*")).alias("rate"), F.count_if(F.col("lead") == boundary).alias("censored"), F.count_if(F.col("lead") < boundary).alias("rising"), q.alias("_q")).select("rate", "censored", "rising", *(F.col("_q")[k].alias(n) for k, n in enumerate(("q25", "q50", "q75"))))


def odds_corrected(p: Column, sample: Column, population: float) -> Column:
    """Case-control correction of a probability for the population's base rate."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = p / (1 - p) * (F.lit(population) / (1 - F.lit(population))) / (sample / (1 - sample))
    return odds / (1 + odds)


def calibration(scored: DataFrame, population: float = 0.01) -> DataFrame:
    """Reliability in ten equal bins under population weights, with the overall Brier score."""
    rate = scored.agg(F.avg("y").alias("rate"))
    x = scored.join(F.broadcast(rate)).withColumn("p", odds_corrected(F.col("score"), F.col("rate"), population))
    w = F.when(F.col("y") == 1, F.lit(population) / F.col("rate")).otherwise((1 - F.lit(population)) / (1 - F.col("rate")))
    x = x.withColumn("w", w).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long"))
    weighted = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    brier = x.agg(weighted((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    return x.groupBy("bin").agg(F.count("*").alias("rows"), weighted(F.col("p")).alias("predicted"), weighted(F.col("y")).alias("observed")).join(F.broadcast(brier))


def mid_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): average rank of each distinct value."""
    c = running(rows.groupBy(value).agg(F.count("*").alias("n")), value, ["n"], [], falling=False)
    return c.select(F.col(value), (F.col("c_n") - (F.col("n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.join(mid_ranks(rows, a, "_ra"), a).join(mid_ranks(rows, b, "_rb"), b).agg(F.corr("_ra", "_rb").alias("rho"))


def resolution(summary: DataFrame) -> DataFrame:
    c = summary.groupBy("peak").agg(F.count("*").alias("n"), F.count_if("positive").alias("p"))
    return c.agg(F.count("*").alias("distinct_scores"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("tied_share"), F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("mixed_ties"), (F.sum(F.when(F.round(F.col("peak") * 10000).cast("long") % 500 == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("round_share"))


def second_score(rows: DataFrame) -> DataFrame:
    """rows with ``second``, a deterministic score of another model's kind."""
    return rows.withColumn("second", (draw(997, "actor", "m") + 1) / F.lit(999.0))


def tie_break(rows: DataFrame) -> DataFrame:
    """Score plus less than half the month's least gap, by the second score."""
    steps = rows.select("m", "score").distinct().withColumn("gap", F.col("score") - F.lag("score").over(Window.partitionBy("m").orderBy("score")))
    gap = steps.groupBy("m").agg(F.coalesce(F.min("gap"), F.lit(0.0)).alias("gap"))
    return rows.join(gap, "m").select("actor", "m", (F.col("score") + F.col("gap") * F.lit(0.49) * F.col("second")).alias("score"))


def logit_blend(rows: DataFrame, alpha: float) -> DataFrame:
    logit = lambda c: F.log(c / (1 - c))
    z = F.lit(alpha) * logit(F.col("score")) + F.lit(1 - alpha) * logit(F.col("second"))
    return rows.select("actor", "m", (1 / (1 + F.exp(-z))).alias("score"))


def top_permuted(rows: DataFrame, k: int) -> DataFrame:
    """Within each month's top k the scores are dealt anew by the second score; the multiset stays."""
    first = Window.partitionBy("m").orderBy(F.desc("score"), "actor")
    r = rows.withColumn("r", F.row_number().over(first))
    top = r.filter(F.col("r") <= k).withColumn("r2", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("second"), "actor")))
    dealt = top.select("actor", "m", "r2").join(top.select("m", F.col("r").alias("r2"), "score"), ["m", "r2"]).select("actor", "m", "score")
    return dealt.unionByName(r.filter(F.col("r") > k).select("actor", "m", "score"))


def shuffled_labels(panel: DataFrame, keep_split: str = "test", seed: str = "18") -> DataFrame:
    """Labels permuted within month by a hash order; the held-out split keeps its own.

    Both sides hold the whole panel, whatever Spark takes an exploded spine for, so they meet by a merge and not by broadcast.
    """
    free = panel.filter(F.col("split") != keep_split)
    natural = free.select("m", "y", F.row_number().over(Window.partitionBy("m").orderBy("actor")).alias("r"))
    hashed = free.select("actor", "m", "split", F.row_number().over(Window.partitionBy("m").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "actor", "m")), "actor")).alias("r"))
    return hashed.join(natural.hint("merge"), ["m", "r"]).select("actor", "m", "split", "y").unionByName(panel.filter(F.col("split") == keep_split).select("actor", "m", "split", "y"))


def bootstrap(groups: DataFrame, value: str, draws: int, seed: str = "7") -> DataFrame:
    """Percentile interval of the mean over groups drawn with replacement by a hash.

    groups has a gap-free ``i`` from 0.  Up to ``BROADCAST_GROUPS`` groups the
    values are broadcast and only sums of each draw are shuffled.
    """
    groups = stored(groups.select("i", value))
    count = groups.count()
    values = F.broadcast(groups) if count <= BROADCAST_GROUPS else groups
    n = groups.agg(F.count("*").alias("n"))
    slots = groups.select("i").join(F.broadcast(n)).select("n", "i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "i")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = slots.select("draw", pick.alias("i")).join(values, "i").groupBy("draw").agg(F.avg(value).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.avg("v").alias("mean"), q.alias("_q")).select("mean", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def binomial_ci(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson limits by bisection of the binomial tail."""
    import math

    def tail(p: float, least: int) -> float:  # P(X >= least)
        if p <= 0:
            return 0.0 if least > 0 else 1.0
        if p >= 1:
            return 1.0
        terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(least, n + 1))
        return min(1.0, math.fsum(map(math.exp, terms)))

    def solve(least: int, want: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tail(mid, least) < want else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if k == 0 else solve(k, alpha / 2), 1.0 if k == n else solve(k + 1, 1 - alpha / 2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables no likelier than this one."""
    import math

    def log_p(x: int) -> float:
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        return choose(a + b, x) + choose(c + d, a + c - x) - choose(a + b + c + d, a + c)

    here = log_p(a)
    low, high = max(0, a + c - (c + d)), min(a + b, a + c)
    return min(1.0, math.fsum(math.exp(v) for x in range(low, high + 1) if (v := log_p(x)) <= here + 1e-7))


def frozen_clock(events: DataFrame, people: DataFrame, vintage: int, horizon: int, ks: list[int]) -> DataFrame:
    """Actors ranked by the year before a vintage; how many positives begin in the horizon after it."""
    before = events.filter((F.col("m") >= vintage - 12) & (F.col("m") < vintage)).groupBy("actor").agg(F.count("*").alias("n"))
    pool = before.join(people, "actor").select("actor", "n", (F.col("positive") & (F.col("b") > vintage) & (F.col("b") <= vintage + horizon)).alias("hit"))
    base = pool.agg(F.count("*").alias("all"), F.count_if("hit").alias("p"))
    order = [F.desc("n"), F.asc("actor")]
    best = top_k(pool, max(ks), order).select("hit", F.row_number().over(Window.orderBy(*order)).alias("r"))
    rows = reduce(DataFrame.unionByName, [best.filter(F.col("r") <= k).agg(F.count_if("hit").alias("hit"), F.count("*").alias("n")).select(F.lit(k).alias("k"), "hit", "n") for k in ks])
    return rows.join(F.broadcast(base)).select("k", (F.col("p") / F.col("all")).alias("base_rate"), (F.col("hit") / F.col("n")).alias("precision"), ratio(F.col("hit") / F.col("n"), F.col("p") / F.col("all")).alias("lift"))


def variants(scored: DataFrame, excluded: dict[str, Column]) -> DataFrame:
    """AUC with each exclusion applied, all in one pass; null for a variant without rows."""
    kept = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in excluded.items())))
    found = roc_auc(scored.select(F.explode(kept).alias("variant"), "score", "y"), ["variant"])
    names = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, excluded))).alias("variant"))
    return names.join(found, "variant", "left")


def crossing_changes(scored: DataFrame, found: DataFrame, features: list[str], top: int = 3) -> DataFrame:
    """At each detection, the contributions that changed most since the month before."""
    w = Window.partitionBy("actor").orderBy("m")
    now = scored.select("actor", "m", *(( F.col(f) - F.coalesce(F.lag(f).over(w), F.lit(0))).alias(f) for f in features))
    at = now.join(found.filter("detected is not null").select("actor", F.col("detected").alias("m")), ["actor", "m"])
    each = at.select("actor", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("delta")) for f in features))))
    r = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc(F.abs("delta")), "feature"))
    return each.select("actor", "feature", "delta", r.cast("long").alias("rank")).filter(F.col("rank") <= top)


def components_of(changes: DataFrame, top: int = 2) -> DataFrame:
    """The largest contributions by size, the rest in one remainder row."""
    key = F.when(F.col("rank") <= top, F.col("feature")).otherwise(F.lit("other"))
    return changes.groupBy("actor", key.alias("key")).agg(F.sum(F.abs("delta")).alias("contribution"))
