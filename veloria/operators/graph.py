"""Co-activity graphs: rooms, edges, neighbour pairs, onsets and ego context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rooms(contrib: DataFrame, small: int) -> DataFrame:
    """Repositories with their distinct actors and whether the cohort owns them; small or owned ones stay."""
    r = contrib.groupBy("repo").agg(F.count_distinct("actor").alias("actors"), F.bool_or("is_own").alias("owned"))
    return r.filter(F.col("owned") | (F.col("actors") <= small))


def edges(contrib: DataFrame, kept: DataFrame, cap: int) -> DataFrame:
    """Directed co-activity in a repository and month; of the neighbours only the ``cap`` busiest."""
    monthly = contrib.join(kept.select("repo"), "repo", "left_semi").groupBy("repo", "m", "actor").agg(F.count("*").alias("n"))
    busy = Window.partitionBy("repo", "m").orderBy(F.desc("n"), "actor")
    top = monthly.withColumn("r", F.row_number().over(busy)).filter(F.col("r") <= cap)
    others = top.select("repo", "m", F.col("actor").alias("neighbour"), F.col("n").alias("neighbour_events"))
    return monthly.withColumnRenamed("n", "events").join(others, ["repo", "m"]).filter("actor != neighbour").select("actor", "neighbour", "repo", "m", "events", "neighbour_events")


def pairs(links: DataFrame, people: DataFrame) -> DataFrame:
    """Pair summary, with the neighbour's flag as far as it was known when the pair first met."""
    p = links.groupBy("actor", "neighbour").agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"), F.count_distinct("m").alias("months"), F.count_distinct("repo").alias("repos"), F.sum("events").alias("events"), F.sum("neighbour_events").alias("neighbour_events"))
    flags = people.filter("positive").select(F.col("actor").alias("neighbour"), F.col("b").alias("nb"))
    return p.join(flags, "neighbour", "left").select("actor", "neighbour", "first_m", "last_m", "months", "repos", "events", "neighbour_events", F.coalesce(F.col("nb") <= F.col("first_m"), F.lit(False)).alias("known_before"))


def degrees(neighbours: DataFrame) -> DataFrame:
    """Quantiles of the number of neighbours."""
    d = neighbours.groupBy("actor").agg(F.count("*").alias("degree"))
    q = [0.25, 0.5, 0.75, 0.9, 0.99]
    return d.agg(F.count("*").alias("actors"), F.min("degree").alias("least"), F.percentile("degree", F.array(*map(F.lit, q))).alias("_q"), F.max("degree").alias("most"), F.avg("degree").alias("mean")).select("actors", "least", *(F.col("_q")[k].alias(f"p{int(x * 100)}") for k, x in enumerate(q)), "most", "mean")


def onsets(contrib: DataFrame, people: DataFrame, small: int) -> DataFrame:
    """When two cohort members of one group of batches first shared a repository, and how long before the batch.

    Only repositories that ``rooms`` keeps make pairs; members meet by repository and batch.
    """
    kept = contrib.join(rooms(contrib, small).select("repo"), "repo", "left_semi")
    first = kept.groupBy("actor", "repo").agg(F.min("m").alias("f")).join(people.select("actor", "b"), "actor")
    other = first.select(F.col("actor").alias("other"), "repo", F.col("f").alias("g"), "b")
    both = first.join(other, ["repo", "b"]).filter(F.col("actor") < F.col("other"))
    met = both.groupBy("actor", "other", "b").agg(F.min(F.greatest("f", "g")).alias("onset"), F.count("*").alias("shared")).filter("onset < b")
    tier = F.when(F.col("shared") >= 2, "strong").when(F.col("b") - F.col("onset") >= 12, "early").otherwise("late")
    return met.select("actor", "other", "onset", (F.col("b") - F.col("onset")).alias("lead"), "shared", tier.alias("tier"))


def ego(contrib: DataFrame, people: DataFrame, last: int = 5) -> DataFrame:
    """Each person's context right before the batch: mix, tenure, recency and the last touched repositories."""
    rows = contrib.join(people.select("actor", "b"), "actor").filter(F.col("m") < F.col("b") - 12)
    seen = Window.partitionBy("actor", "repo").orderBy("ts", "id", "line")
    recent = Window.partitionBy("actor").orderBy(F.desc("ts"), F.desc("id"), F.desc("line"), F.desc("repo"))
    rows = rows.withColumn("new", F.row_number().over(seen) == 1).withColumn("r", F.row_number().over(recent))
    newest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= last, F.struct("r", "repo")))), lambda x: x["repo"].cast("string")), ",")
    return rows.groupBy("actor", "b").agg(F.count("*").alias("events"), F.avg(F.col("is_own").cast("double")).alias("own_share"), F.count_if("new").alias("repos"), (F.col("b") - 12 - F.min("m")).alias("tenure"), (F.col("b") - 12 - F.max("m")).alias("recency"), F.log1p(F.count("*").cast("double")).alias("log_events"), newest.alias("last_repos")).drop("b")


def dark(contrib: DataFrame, hot: int, silent: int) -> DataFrame:
    """Repositories with a busy quarter that fell silent before the end of the log."""
    monthly = contrib.groupBy("repo", "m").agg(F.count("*").alias("n"))
    sums = monthly.withColumn("n3", F.sum("n").over(Window.partitionBy("repo").orderBy("m").rangeBetween(-2, 0)))
    end = contrib.agg(F.max("m").alias("end"))
    r = sums.groupBy("repo").agg(F.max("n3").alias("peak"), F.max("m").alias("last_m"))
    return r.join(F.broadcast(end)).select("repo", (F.col("peak") >= hot).alias("hot"), (F.col("end") - F.col("last_m")).alias("silence"), ((F.col("peak") >= hot) & (F.col("end") - F.col("last_m") >= silent)).alias("dark"))


def quarter_changes(events: DataFrame, codes: dict[str, int]) -> DataFrame:
    """Quarterly level of each actor, one-hot counts, and the change from exactly the quarter before."""
    q = events.withColumn("q", F.floor(F.col("m") / 3))
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.col("event_type")]
    level = q.groupBy("actor", "q").agg(F.count("*").alias("n"), F.sum(code).alias("level"), *(F.count_if(F.col("event_type") == t).alias(f"is_{c}") for t, c in codes.items()))
    before = level.select("actor", (F.col("q") + 1).alias("q"), F.col("level").alias("_before"))
    return level.join(before, ["actor", "q"], "left").withColumn("delta", F.col("level") - F.col("_before")).drop("_before")


def pseudonyms(contrib: DataFrame) -> DataFrame:
    """Owners numbered by first appearance for each actor: OWN for the actor's own, P1, P2, ... for others."""
    first = contrib.groupBy("actor", "owner").agg(F.min(F.struct("ts", "id", "line")).alias("f"), F.bool_or("is_own").alias("own"))
    k = F.row_number().over(Window.partitionBy("actor", "own").orderBy("f", "owner"))
    return first.select("actor", "owner", F.concat(F.when(F.col("own"), "OWN").otherwise("P"), k.cast("string")).alias("pseudonym"))


def cosine_to_centroid(vectors: DataFrame) -> DataFrame:
    """Cosine of each vector and its label's mean vector; centroids are pre-aggregated by place."""
    each = vectors.select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    mean = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("c"))
    j = each.join(mean, ["label", "k"]).withColumn("x", F.col("x").cast("double"))
    s = j.groupBy("vec_id").agg(F.sum(F.col("x") * F.col("c")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("c") * F.col("c")).alias("b"))
    return s.select("vec_id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).alias("cosine"))
