"""Event ingestion: cohort-bounded monthly aggregates, controls, and checks on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloria.functions.columns import draw, is_bot
from veloria.functions.dates import is_weekend, month_date
from veloria.sources.shared import stored

#: Months of history before an actor's cutoff, and the cutoff's distance from the batch month.
HISTORY, LEAD = 48, 12
#: How far a positive's free candidates are rotated before the first are taken.
MATCH_OFFSET = 17
#: Tasks that share the positives of one cutoff, and positives of one band that are written side by side.
BAND_SLOTS, BAND_GROUP = 4, 256
SENTINEL = "__NO_ACTIVITY__"


def in_window(events: DataFrame, people: DataFrame) -> DataFrame:
    """Events of cohort members in [cutoff - 48 months, cutoff), each with its own cutoff."""
    return events.join(people.select("actor", "b", "positive"), "actor").filter((F.col("m") >= F.col("b") - LEAD - HISTORY) & (F.col("m") < F.col("b") - LEAD))


def monthly_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(F.trunc("ts", "month").alias("month"), "event_type").agg(F.count("*").alias("event_count"))


def monthly_activity(events: DataFrame, people: DataFrame) -> DataFrame:
    rows = in_window(events, people)
    return rows.groupBy("actor", F.trunc("ts", "month").alias("month"), "event_type", is_weekend("ts").alias("is_weekend"), month_date(F.col("b") - LEAD).alias("t_cutoff")).agg(F.count("*").alias("event_count"))


def no_activity_sentinels(events: DataFrame, people: DataFrame) -> DataFrame:
    """A zero row for each cohort member without an event in the window."""
    idle = people.join(in_window(events, people).select("actor").distinct(), "actor", "left_anti")
    return idle.select("actor", month_date(F.col("b") - LEAD).alias("month"), F.lit(SENTINEL).alias("event_type"), F.lit(0).cast("long").alias("event_count"))


def received(contrib: DataFrame, predicate: Column) -> DataFrame:
    """Events of others on an owner's repositories, by month."""
    return contrib.filter((F.col("actor") != F.col("owner")) & predicate).groupBy("owner", F.trunc("ts", "month").alias("month")).agg(F.count("*").alias("event_count"))


def ownership_split(contrib: DataFrame, people: DataFrame) -> DataFrame:
    """Own and other events of each actor, and distinct strangers on what they own, in one pass."""
    roles = contrib.select("*", F.explode(F.array_distinct(F.array("actor", "owner"))).alias("person"))
    mine, theirs = F.col("person") == F.col("actor"), (F.col("person") == F.col("owner")) & (F.col("actor") != F.col("owner"))
    rows = roles.join(people.select(F.col("actor").alias("person"), "name"), "person")
    return rows.groupBy("person", F.trunc("ts", "month").alias("month")).agg(
        F.count_if(mine & F.col("is_own")).alias("own"), F.count_if(mine & ~F.col("is_own")).alias("other"),
        F.count_distinct(F.when(theirs & ~is_bot(F.concat(F.lit("user"), F.col("actor").cast("string"))), F.col("actor"))).alias("distinct_collab"),
    )


def unpivot_ownership(split: DataFrame) -> DataFrame:
    return split.select("person", "month", F.inline(F.array(F.struct(F.lit(True).alias("is_own"), F.col("own").alias("event_count")), F.struct(F.lit(False).alias("is_own"), F.col("other").alias("event_count"))))).filter("event_count > 0")


def first_creations(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("actor", "repo").agg(F.min("ts").alias("first_ts"))


def actor_stats(events: DataFrame, people: DataFrame) -> DataFrame:
    """Events in the window and the first year seen at all; zero for absent members."""
    inside = (F.col("m") >= F.col("b") - LEAD - HISTORY) & (F.col("m") < F.col("b") - LEAD)
    rows = events.join(people.select("actor", "b"), "actor").groupBy("actor").agg(F.count_if(inside).alias("total_events"), F.min(F.year("ts")).cast("long").alias("first_seen_year"))
    return people.select("actor").join(rows, "actor", "left").select("actor", F.coalesce("total_events", F.lit(0)).alias("total_events"), F.coalesce("first_seen_year", F.lit(0)).cast("long").alias("first_seen_year"))


def hash_candidates(events: DataFrame, people: DataFrame, excluded: DataFrame, modulus: int = 40, least: int = 3) -> DataFrame:
    """Sampled actors outside the cohort's positives, with their totals before each cutoff."""
    cutoffs = people.select((F.col("b") - LEAD).alias("cutoff")).distinct()  # as many as there are months
    sampled = events.withColumn("bucket", draw(modulus, "actor")).filter("bucket < 3").join(excluded.select("actor"), "actor", "left_anti")
    seen = sampled.groupBy("actor").agg(F.min(F.year("ts")).cast("long").alias("first_seen_year"))
    monthly = sampled.groupBy("actor", "bucket", "m").agg(F.count("*").alias("n"))
    rows = monthly.join(F.broadcast(cutoffs), (F.col("m") < F.col("cutoff")) & (F.col("m") >= F.col("cutoff") - HISTORY)).groupBy("actor", "cutoff", "bucket").agg(F.sum("n").alias("total_events")).filter(F.col("total_events") >= least)
    return rows.join(seen, "actor").select("actor", "cutoff", "total_events", "first_seen_year", "bucket")


def band_pairs(positives: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates in a positive's band: same cutoff, half to twice the total, first year within one.

    Pairs are many times both sides, so they are neither shuffled nor sorted: a
    cutoff's candidates are one array in the order of their hashes, which is
    counted through once for all positives of the same band (``BAND_GROUP`` at a
    time).  Each candidate comes with its positives one after the other, so a
    column store keeps candidate, cutoff and rank as runs.  Candidates are sent
    ``BAND_SLOTS`` times.
    A positive listed twice has each candidate once for each listing, numbered on.
    """
    tasks = int(positives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ("actor", "total_events", "first_seen_year")
    ordered = F.sort_array(F.collect_list(F.struct(F.md5(F.col("actor").cast("string")).alias("hash"), *fields)))
    listed = candidates.groupBy("cutoff").agg(ordered.alias("listed")).select("cutoff", F.transform("listed", lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("listed"))
    listed = listed.select("cutoff", "listed", F.explode(F.sequence(F.lit(0), F.lit(BAND_SLOTS - 1))).alias("_slot")).repartition(tasks, "cutoff", "_slot")
    bands = F.sort_array(F.collect_list(F.struct((0.5 * F.col("total_events")).alias("least"), (2 * F.col("total_events")).alias("most"), F.col("first_seen_year").alias("year"))))
    x = positives.groupBy(F.col("actor").alias("positive"), "cutoff").agg(bands.alias("bands")).groupBy("cutoff", "bands").agg(F.sort_array(F.collect_list(F.struct("positive"))).alias("positives"))
    groups = F.transform(F.sequence(F.lit(1), F.size("positives"), F.lit(BAND_GROUP)), lambda k: F.transform(F.slice("positives", k, BAND_GROUP), lambda p: p["positive"]))
    x = x.select("cutoff", "bands", F.posexplode(groups).alias("_group", "positives")).withColumn("_slot", F.pmod(F.hash("bands", "_group"), F.lit(BAND_SLOTS)))
    x = x.select("*", F.inline(F.slice("bands", 1, 1))).repartition(tasks, "cutoff", "_slot")
    within = lambda c, least, most, year: (c["total_events"] >= least) & (c["total_events"] <= most) & (F.abs(c["first_seen_year"] - year) <= 1)
    one = F.transform(F.filter("listed", lambda c: within(c, F.col("least"), F.col("most"), F.col("year"))), lambda c: c["actor"])
    several = F.flatten(F.transform("listed", lambda c: F.array_repeat(c["actor"], F.size(F.filter("bands", lambda p: within(c, p["least"], p["most"], p["year"]))))))
    found = x.join(listed.hint("merge"), ["cutoff", "_slot"])
    ranked = found.select("positives", "cutoff", F.posexplode(F.when(F.size("bands") == 1, one).otherwise(several)).alias("_place", "candidate"))
    rows = ranked.select("candidate", "cutoff", (F.col("_place") + 1).cast("long").alias("order_rank"), F.explode("positives").alias("positive"))
    return rows.select("positive", "candidate", "cutoff", "order_rank")


def match_components(pairs: DataFrame) -> DataFrame:
    """(positive, component): positives linked by shared candidates have their least positive as component.

    Minima run over candidates and back, and then on to the label's own label, so rounds grow slowly with the length of a chain.
    """
    links = stored(pairs.select("positive", "candidate").distinct())
    labels = stored(links.select("positive", F.col("positive").alias("component")).distinct())
    while True:
        least = links.join(labels, "positive").groupBy("candidate").agg(F.min("component").alias("c"))
        near = links.join(least, "candidate").groupBy("positive").agg(F.min("c").alias("c"))
        beyond = labels.select(F.col("positive").alias("c"), F.col("component").alias("d"))
        moved = stored(labels.join(near, "positive").join(beyond, "c").select("positive", F.least("component", "c", "d").alias("new"), "component"))
        labels = moved.select("positive", F.col("new").alias("component"))
        if moved.filter("new <> component").isEmpty():
            return labels


def greedy_match(pairs: DataFrame, k: int = 5, offset: int = 0) -> DataFrame:
    """First k unused candidates of each positive, positives in order, without replacement.

    A candidate serves once, whatever its cutoffs: each connected component of
    positives and candidates is matched in one pass with one set of used
    candidates.  What is free to a positive is rotated by ``offset`` first.
    A pass holds the pairs of one component.
    """
    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (positive, cutoff), own in pdf.sort_values(["positive", "cutoff", "order_rank"]).groupby(["positive", "cutoff"], sort=True):
            free = [c for c in own.candidate.tolist() if c not in used]
            turn = offset % len(free) if free else 0
            free = (free[turn:] + free[:turn])[:k]
            used.update(free)
            out += [(c, positive, cutoff, r + 1) for r, c in enumerate(free)]
        return pd.DataFrame(out, columns=["control", "positive", "cutoff", "match_rank"])

    pairs = stored(pairs)
    linked = pairs.join(match_components(pairs), "positive")
    return linked.groupBy("component").applyInPandas(match, "control long, positive long, cutoff long, match_rank long")


def collapse(rows: DataFrame, key: str, cutoff: str, tag: str, eligible: Column) -> DataFrame:
    """One row a key: least cutoff and the sorted distinct tags of its eligible rows."""
    return rows.filter(eligible).groupBy(key).agg(F.min(cutoff).alias("t_cutoff"), F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"))


def leakage(frame: DataFrame, time: str, cutoff: str) -> DataFrame:
    """Rows whose time is missing or not before their cutoff."""
    return frame.filter(F.col(time).isNull() | F.col(cutoff).isNull() | (F.col(time) >= F.col(cutoff)))


def check(name: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def require_unique(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once (a join declared one-to-one must have none)."""
    return frame.groupBy(*keys).count().filter("count > 1")


def require_columns(frame: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def in_batches(actors: DataFrame, size: int) -> Iterator[DataFrame]:
    """Actors in hash batches of about ``size``, for sources that limit a request."""
    parts = max(1, -(-actors.count() // size))
    for p in range(parts):
        yield actors.filter(F.pmod(F.xxhash64(*actors.columns), F.lit(parts)) == p)
