"""Serving reads: evidence, claims, candidate pages, re-ranking, timelines, guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloria.functions.columns import ratio
from veloria.operators.ranking import numbered
from veloria.sources.shared import stored


def evidence_rollup(events: DataFrame) -> DataFrame:
    """One evidence row an actor and month, under an id hashed from its parts."""
    r = events.groupBy("actor", "m").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    month = F.concat(F.floor(F.col("m") / 12).cast("string"), F.lit("-"), F.lpad((F.col("m") % 12 + 1).cast("string"), 2, "0"))
    return r.select(F.sha2(F.concat_ws("\x1f", F.lit("activity"), F.col("actor").cast("string"), month), 256).alias("evidence_id"), "actor", "ts", F.concat(F.col("n").cast("string"), F.lit(" events in "), month).alias("detail"))


def resolve_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim's references, resolved to evidence, to a URL, or dangling."""
    refs = claims.select("claim", F.explode("refs").alias("ref"))
    j = refs.join(evidence.select(F.col("ref").alias("_e")), refs["ref"] == F.col("_e"), "left")
    kind = F.when(F.col("_e").isNotNull(), "evidence").when(F.col("ref").rlike("^https?://"), "url").otherwise("dangling")
    return j.select("claim", "ref", kind.alias("resolved"))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, where: Column | None = None) -> DataFrame:
    """One page of the matching rows, with their total."""
    found = rows if where is None else rows.filter(where)
    return found.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(found.agg(F.count("*").alias("total"))))


def evidence(rows: DataFrame, *, actor: int | None = None, kind: str | None = None, after: str | None = None, before: str | None = None, limit: int = 100) -> DataFrame:
    """Newest rows under optional filters; dates are inclusive."""
    if actor is not None:
        rows = rows.filter(F.col("user_id") == actor)
    if kind is not None:
        rows = rows.filter(F.col("event_type") == kind)
    if after is not None:
        rows = rows.filter(F.to_date("ts") >= F.lit(after).cast("date"))
    if before is not None:
        rows = rows.filter(F.to_date("ts") <= F.lit(before).cast("date"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def rerank(rows: DataFrame, fit: Column, weights: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """Score, momentum and fit mixed; the rank before, after, and the difference.

    Each ranking reads its rows several times, and the second reads the first: they are computed once and stored.
    """
    adjusted = F.col("peak") * weights[0] + F.greatest(F.lit(0.0), 4 * F.coalesce("momentum", F.lit(0.0))) * weights[1] + fit.cast("double") * weights[2]
    x = stored(rows.select("actor", "peak", F.round(adjusted, 6).alias("adjusted")))
    both = numbered(numbered(x, "peak", [F.asc("actor")], "old").drop("_all"), "adjusted", [F.asc("actor")], "new")
    return both.select("actor", "adjusted", F.col("old").cast("long").alias("rank_before"), F.col("new").cast("long").alias("rank"), (F.col("old") - F.col("new")).cast("long").alias("rank_delta"))


def axes(rows: DataFrame) -> DataFrame:
    """Three axes of 1 to 10 and the trend of a summary."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1.0)), F.lit(10.0))
    trend = F.when(F.col("momentum") > 0.003, "improving").when(F.col("momentum") < -0.003, "declining").otherwise("stable")
    return rows.select("actor", clip(1 + 9 * (0.78 * F.col("peak") + 0.22 * F.least(F.col("current") / 0.4, F.lit(1.0)))).alias("founder"), clip(1 + 9 * F.col("current")).alias("market"), clip(1 + 9 * ratio(F.col("first_score"), F.col("peak"))).alias("idea"), trend.alias("trend"))


def timeline(stream: DataFrame) -> DataFrame:
    """Events by day, with the commonest type (ties by name)."""
    c = stream.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "event_type"))
    r = c.withColumn("r", first)
    day = r.groupBy("day").agg(F.sum("n").alias("events"), F.count("*").alias("types"), F.max(F.when(F.col("r") == 1, F.col("event_type"))).alias("dominant"))
    return day.withColumn("so_far", F.sum("events").over(Window.orderBy("day")))  # one row a day


def recognition(rows: DataFrame) -> DataFrame:
    """The most confident label of each actor; ties by month, then label."""
    return rows.groupBy("actor").agg(F.max_by(F.struct("month", "label"), F.struct("confidence", "month", "label")).alias("x")).select("actor", "x.month", "x.label")


def health(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


#: Nodes of a parsed plan that only read; anything else (commands, inserts, scripts) is refused.
_READS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Intersect", "Except", "Distinct", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "ResolvedInlineTable",
    "OneRowRelation", "Generate", "Window", "WithWindowDefinition", "Pivot", "Unpivot", "Tail", "LocalRelation", "LateralJoin", "CTERelationDef", "UnresolvedTableValuedFunction", "Sample", "AsOfJoin", "ExplainCommand",
}
#: Functions that leave the engine.
_OUTSIDE = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.I)


def _nodes(plan) -> list:
    """A parsed plan's nodes, those in subqueries and common tables too."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        for part in (p.children(), p.innerChildren(), p.subqueries()):
            todo += [part.apply(k) for k in range(part.size())]
        if p.getClass().getSimpleName() == "ExplainCommand":
            todo.append(p.logicalPlan())
    return out


def guarded_sql(spark: SparkSession, text: str, most: int = 1000, size: int = 256 * 1024, tables: set[str] | None = None) -> DataFrame:
    """One read-only statement, at most ``most`` rows of it; anything else raises ValueError.

    The parsed plan is judged, not the text, so that a column may be called what
    it likes.  Relations are names of one part, among ``tables`` if given; files
    (parquet.`/path`) are refused.
    """
    if len(text.encode()) > size:
        raise ValueError("the statement is too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))
    except Exception as e:  # the parser's own class is the JVM's
        raise ValueError("only one read-only SELECT or WITH statement is allowed") from e
    nodes = _nodes(plan)
    kinds = {p.getClass().getSimpleName().rstrip("$") for p in nodes}
    if unknown := kinds - _READS:
        raise ValueError(f"only reads are allowed, not {', '.join(sorted(unknown))}")
    known = {t.lower() for t in tables or ()}
    for p in nodes:
        if p.getClass().getSimpleName() == "UnresolvedWith":  # common tables are relations too
            known |= {p.cteRelations().apply(k)._1().lower() for k in range(p.cteRelations().size())}
    for p in nodes:
        if p.getClass().getSimpleName() == "UnresolvedRelation":
            parts = [p.multipartIdentifier().apply(k) for k in range(p.multipartIdentifier().size())]
            if len(parts) != 1 or (tables is not None and parts[0].lower() not in known):
                raise ValueError(f"relation {'.'.join(parts)} is not served")
    if _OUTSIDE.search(re.sub(r"'(?:[^']|'')*'", "''", text)):
        raise ValueError("functions outside of the engine are not served")
    return spark.sql(text.strip().rstrip(";")).limit(most)
