"""The person-month panel: one dense spine and the window features over it.

Windows are calendar windows over a spine that is dense from 62 months before
the batch month, so a range frame over the integer month gives trailing sums
with missing months as zero, and all frames share one sort.  A block is a list
of columns over such a spine, so that several blocks make one frame together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veloria.functions.columns import ratio
from veloria.functions.dates import is_weekend

FIRST, WARM, LAST = 48, 62, 12
#: "Never" among months since an event.
NEVER = 49


def over(first: int, last: int) -> WindowSpec:
    """The frame from ``first`` to ``last`` months relative to the row's month."""
    return Window.partitionBy("actor").orderBy("m").rangeBetween(first, last)


def ever() -> WindowSpec:
    """The frame of all months up to the row's own."""
    return over(Window.unboundedPreceding, 0)


def spine(people: DataFrame) -> DataFrame:
    """Every person's months from B-62 to B-12."""
    return people.select("actor", "grp", "positive", "b", F.explode(F.sequence(F.col("b") - WARM, F.col("b") - LAST)).alias("m"))


def trimmed(frame: DataFrame) -> DataFrame:
    return frame.filter(F.col("m") >= F.col("b") - FIRST)


def label_columns() -> list[Column]:
    y = (F.col("positive") & F.col("m").between(F.col("b") - 15, F.col("b") - 12)).cast("long")
    split = F.when(F.col("b") < 2000 * 12, "train").when(F.col("b") < 2001 * 12, "valid").otherwise("test")
    return [y.alias("y"), split.alias("split")]


def labelled(frame: DataFrame) -> DataFrame:
    """Target and temporal fold of each panel row."""
    return trimmed(frame).select("actor", "grp", "positive", "b", "m", *label_columns())


def bounded(facts: DataFrame, people: DataFrame) -> DataFrame:
    """Facts in each person's history window."""
    return facts.join(people.select("actor", "b"), "actor").filter((F.col("m") >= F.col("b") - 60) & (F.col("m") < F.col("b") - 12)).drop("b")


def on_spine(people: DataFrame, monthly: DataFrame) -> DataFrame:
    """The spine with monthly values, absent ones zero."""
    values = [c for c in monthly.columns if c not in ("actor", "m")]
    return spine(people).join(monthly, ["actor", "m"], "left").fillna(0, values)


def histories(people: DataFrame, monthly: DataFrame, value: str) -> DataFrame:
    """Every person with ``history``, the value of each month from B-62 to B-12 (absent ones zero), and ``copies``, how often the person is listed.

    Spark takes an exploded spine for as small as people and may broadcast it;
    here only people and their months are joined, and the spine is made of the
    result, which is dealt by person already.  The number of tasks is given,
    since adaptive execution would fit it to the rows before the explode.
    """
    tasks = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    months = monthly.filter("m is not null").groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("m", value))).alias("_months"))
    rows = people.select("actor", "grp", "positive", "b").repartition(tasks, "actor").join(months, "actor", "left")
    each = F.transform(F.sequence(F.col("b") - WARM, F.col("b") - LAST), lambda m: F.coalesce(F.try_element_at("_months", m), F.lit(0).cast("long")))
    return rows.select("actor", "grp", "positive", "b", each.alias("history"), F.count("*").over(Window.partitionBy("actor")).alias("copies"))


def history_sum(months: int) -> Column:
    """The trailing sum at month ``m`` of a row that has ``history`` and ``copies``; as a window over the copies' rows gives it."""
    return F.col("copies") * sum((F.coalesce(F.get("history", (F.col("m") - F.col("b") + WARM - k).cast("int")), F.lit(0)) for k in range(1, months)), F.get("history", (F.col("m") - F.col("b") + WARM).cast("int")))


def trailing(c: str, months: int) -> Column:
    return F.sum(c).over(over(-(months - 1), 0))


def recent_mean(c: str) -> Column:
    return F.sum(c).over(over(-2, 0)) / F.lit(3.0)


def prior_mean(c: str) -> Column:
    return F.sum(c).over(over(-14, -3)) / F.lit(12.0)


def burst(c: str) -> Column:
    """Recent mean against the prior year's mean, in its population deviations; 0 if that year is even."""
    year = over(-14, -3)
    even = F.max(c).over(year) == F.min(c).over(year)
    mean = prior_mean(c)
    variance = F.sum(F.col(c) * F.col(c)).over(year) / F.lit(12.0) - mean * mean
    return F.when(even | F.max(c).over(year).isNull(), F.lit(0.0)).otherwise((recent_mean(c) - mean) / F.sqrt(variance))


def share(num: str, den: str, first: int, last: int) -> Column:
    return ratio(F.sum(num).over(over(first, last)).cast("double"), F.sum(den).over(over(first, last)).cast("double"))


def mandatory_rate(n: Column, total: Column) -> Column:
    """n per million of a baseline; a missing or non-positive baseline fails the query."""
    return F.when(total > 0, n * F.lit(1e6) / total).otherwise(F.raise_error(F.lit("a month has no baseline")).cast("double"))


def per_million(events: DataFrame, people: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Monthly activity of each class per million of all events of that month and class."""
    base = events.groupBy("m", "event_type").agg(F.count("*").alias("total"))
    mine = bounded(events, people).groupBy("actor", "m", "event_type").agg(F.count("*").alias("n"))
    rate = mine.join(F.broadcast(base), ["m", "event_type"], "left").withColumn("v", mandatory_rate(F.col("n"), F.col("total")))  # months x types
    return rate.groupBy("actor", "m").agg(*(F.sum(F.when(F.col("event_type") == t, F.col("v")).otherwise(0.0)).alias(c) for c, t in classes.items()))


def block(dense: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns of one block for the months of the panel."""
    return trimmed(dense.select("actor", "b", "m", *columns)).drop("b")


def with_change(c: str, name: str, months: tuple[int, ...]) -> list[Column]:
    """Trailing sums, and the last quarter against the year before it as ratio and difference."""
    recent, prior = recent_mean(c), F.coalesce(prior_mean(c), F.lit(0.0))
    return [*(trailing(c, k).alias(f"{name}_{k}m") for k in months), ((recent + 1) / (prior + 1)).alias(f"{name}_ratio"), (recent - prior).alias(f"{name}_delta")]


def activity(classes: list[str], prefix: str = "") -> list[Column]:
    return [x for c in classes for x in with_change(f"{prefix}{c}", c, (1, 3, 6, 12))]


def traction(kinds: list[str]) -> list[Column]:
    """The spine has received_<kind>: events of others on what the person owns."""
    return [x for c in kinds for x in with_change(f"received_{c}", f"traction_{c}", (3, 12))]


def bursts(columns: list[str]) -> list[Column]:
    return [burst(c).alias(f"{c}_z") for c in columns]


def repositories() -> list[Column]:
    """The spine has ``new_repos``, the repositories first touched in the month."""
    last = F.max(F.when(F.col("new_repos") > 0, F.col("m"))).over(ever())
    return [*(trailing("new_repos", k).alias(f"new_{k}m") for k in (3, 6, 12)), F.coalesce(F.col("m") - last, F.lit(NEVER)).alias("months_since"), F.sum("new_repos").over(ever()).alias("cumulative")]


def weekend_and_tenure() -> list[Column]:
    """The spine has ``n`` and ``weekend``."""
    recent, prior = share("weekend", "n", -2, 0), share("weekend", "n", -14, -3)
    begun = F.min(F.when(F.col("n") > 0, F.col("m"))).over(ever())
    return [recent.alias("weekend_3m"), prior.alias("weekend_prior"), (recent - prior).alias("weekend_delta"), F.coalesce(F.col("m") - begun + 1, F.lit(0)).alias("tenure"), begun.isNull().cast("long").alias("no_activity")]


def history() -> Column:
    """Sorted monthly totals from the first active month on; a person has at most 51 months."""
    return F.sort_array(F.collect_list(F.when(F.col("m") >= F.col("begun"), F.col("n"))).over(ever()))


def with_begun(dense: DataFrame) -> DataFrame:
    """dense with ``begun``, the person's first active month so far."""
    return dense.withColumn("begun", F.min(F.when(F.col("n") > 0, F.col("m"))).over(ever()))


def gini(h: Column) -> Column:
    """Expanding Gini of monthly totals, zeros included."""
    size = F.size(h)
    total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    ranked = F.aggregate(F.transform(h, lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, 2.0 * ranked / (size * total) - (size + 1) / size).otherwise(F.lit(0.0)).alias("gini")


def ownership() -> list[Column]:
    """The spine has ``own``, ``total`` and ``collab``."""
    recent, prior = share("own", "total", -2, 0), share("own", "total", -14, -3)
    return [recent.alias("own_3m"), (recent - prior).alias("own_delta"), trailing("collab", 3).alias("collab_3m"), (recent_mean("collab") - F.coalesce(prior_mean("collab"), F.lit(0.0))).alias("collab_delta"), burst("collab").alias("collab_z")]


def compositions(types: list[str]) -> list[Column]:
    """Sums of each type in the last six months and in everything before."""
    prior = over(Window.unboundedPreceding, -6)
    return [*(F.sum(t).over(over(-5, 0)).cast("double").alias(f"r_{t}") for t in types), *(F.sum(t).over(prior).cast("double").alias(f"p_{t}") for t in types)]


def divergence(types: list[str]) -> Column:
    """1 - cosine of both compositions; null without six prior active-span months or a zero norm."""
    dot = sum((F.col(f"r_{t}") * F.col(f"p_{t}") for t in types), F.lit(0.0))
    r2, p2 = (sum((F.col(f"{k}_{t}") * F.col(f"{k}_{t}") for t in types), F.lit(0.0)) for k in "rp")
    before = F.col("m") - 6 - F.col("begun") + 1
    return F.when((before >= 6) & (r2 > 0) & (p2 > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot / F.sqrt(r2 * p2)))).alias("divergence")


def together(people: DataFrame, facts: list[DataFrame]) -> DataFrame:
    """The spine with the monthly values of all facts (actor, m, values), absent ones zero.

    Spine and facts are united and added up by person and month behind one
    exchange by person, which the windows over the result use as well.
    """
    values = [c for f in facts for c in f.columns if c not in ("actor", "m")]
    rows = spine(people).withColumn("_spine", F.lit(True))
    for f in facts:
        rows = rows.unionByName(f, allowMissingColumns=True)
    own = [F.max(c).alias(c) for c in ("grp", "positive", "b", "_spine")]
    dense = rows.repartition("actor").groupBy("actor", "m").agg(*own, *(F.sum(c).alias(c) for c in values))
    return dense.filter("_spine").drop("_spine").fillna(0, values)


def monthly_counts(events: DataFrame, people: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """n, weekend and a count of each type, by person and month of the history window."""
    kinds = [F.count_if(F.col("event_type") == t).alias(c) for c, t in (types or {}).items()]
    return bounded(events, people).groupBy("actor", "m").agg(F.count("*").alias("n"), F.count_if(is_weekend("ts")).alias("weekend"), *kinds)
