"""What must not grow with the tables on the driver."""

import pytest
from pyspark.sql import functions as F

from veloria import catalog
from veloria.operators import evaluation, ingest
from veloria.plans.evaluation import scored
from veloria.plans.text import _panel

SF = "/root/testdata/sf0.001"
SCORED = "scored_panel exclusion_variants alpha_grid matched_group_rank calibration null_shuffle".split()


def _below(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        return [node.initialPlan()]
    return [node.children().apply(k) for k in range(node.children().size())]


def _explodes(node):
    """Whether exploded rows leave a node without having been aggregated."""
    name = node.nodeName()
    return name == "Generate" or "Aggregate" not in name and any(map(_explodes, _below(node)))


def _broadcast_spines(node):
    return (node.nodeName() == "BroadcastExchange" and _explodes(node)) + sum(map(_broadcast_spines, _below(node)))


def broadcast_spines(df):
    return _broadcast_spines(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", SCORED)
def test_no_spine_is_broadcast(spark, name):
    assert broadcast_spines(catalog.queries()[name](spark, SF)) == 0


def test_no_spine_is_broadcast_to_a_model(spark):
    assert broadcast_spines(scored(spark, SF).select("actor", "m", "y", "split", "n3", "n12", "tenure")) == 0


def test_scored_meets_each_listing_of_a_person(spark, tmp_path):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    again = customers.filter("c_custkey % 2 = 0").unionByName(customers.limit(3).withColumn("c_custkey", F.lit(None).cast("long")))
    customers.unionByName(again).write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    one = {(r.actor, r.m): r for r in scored(spark, SF).collect()}
    got = scored(spark, str(tmp_path)).collect()
    assert len(got) == sum(4 if a % 2 == 0 else 1 for a, _ in one)
    for r in got:
        times, want = (4 if r.actor % 2 == 0 else 1), one[r.actor, r.m]
        assert (r.n3, r.n12, r.tenure, r.y) == (times * want.n3, times * want.n12, want.tenure, want.y)


def test_variants_read_the_panel_once(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.4, 0), (3, 0.6, 0), (4, 0.5, 1)], "actor long, score double, y long")
    out = evaluation.variants(rows, {"all": F.lit(False), "odd": F.col("actor") % 2 == 0, "none": F.lit(True), "unknown": F.lit(None).cast("boolean")})
    assert {r.variant: r.auc for r in out.collect()} == {"all": 0.75, "odd": 1.0, "none": None, "unknown": None}
    plan = lambda name: catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [c_custkey")
    assert plan("exclusion_variants") <= plan("within_month_ap")


def _scans(node):
    """Whether rows of a table leave a node without having been aggregated."""
    name = node.nodeName()
    return name.startswith("Scan") or "Aggregate" not in name and any(map(_scans, _below(node)))


def _broadcast_tables(node):
    return (node.nodeName() == "BroadcastExchange" and _scans(node)) + sum(map(_broadcast_tables, _below(node)))


@pytest.mark.parametrize("name", "scored_panel logistic_rows matched_group_rank scrubbed_momentum pilot_strata score_percentiles thesis_rerank trajectory_trend hybrid_score".split())
def test_no_people_are_broadcast(spark, name):
    df = _panel(spark, SF) if name == "logistic_rows" else catalog.queries()[name](spark, SF)
    assert _broadcast_tables(df._jdf.queryExecution().executedPlan()) == 0


def test_band_pairs_are_not_shuffled(spark):
    """Pairs are made last: no exchange, sort or window lies above the rows that are exploded into them."""
    from hashlib import md5

    def above(node):
        name = node.nodeName()
        return [] if name in ("Generate", "SortMergeJoin") else [name, *(x for n in _below(node) for x in above(n))]

    plan = catalog.queries()["band_match_eligible"](spark, SF)._jdf.queryExecution().executedPlan()
    assert not {"Exchange", "Sort", "Window"} & set(above(plan))

    positives = [(1, 100, 10, 1995), (2, 100, 3, 1996), (3, 101, 10, 1995), (4, 100, 10, 1995), (4, 100, 10, 1995), (5, 100, 4, 1995), (5, 100, 40, 1996), (6, 100, 0, 0), (7, 100, None, 1995)]
    candidates = [(k, 100 + k % 2, k % 23 + 3, 1993 + k % 5) for k in range(10, 90)]
    got = ingest.band_pairs(spark.createDataFrame(positives, "actor long, cutoff long, total_events long, first_seen_year long"), spark.createDataFrame(candidates, "actor long, cutoff long, total_events long, first_seen_year long"))
    want = []
    for p, cutoff in sorted({r[:2] for r in positives}):
        mine = [a for a, c, n, y in candidates for q, d, t, z in positives if (q, d) == (p, cutoff) and c == d and t is not None and 0.5 * t <= n <= 2 * t and abs(y - z) <= 1]
        want += [(p, a, cutoff, k) for k, a in enumerate(sorted(mine, key=lambda a: (md5(str(a).encode()).hexdigest(), a)), 1)]
    assert {r[0] for r in want} == {1, 2, 3, 4, 5} and sorted(map(tuple, got.collect())) == sorted(want)


def test_band_pairs_come_in_runs(spark, monkeypatch):
    """Positives of one band come side by side under each candidate, so that a file of all pairs stays small."""
    names = "actor long, cutoff long, total_events long, first_seen_year long"
    positives = spark.createDataFrame([(k, 100, 10 + 20 * (k % 2), 1995) for k in range(600)], names)
    candidates = spark.createDataFrame([(1000 + k, 100, 15, 1994 + k % 3) for k in range(400)], names)

    def pairs():
        return [tuple(r) for r in ingest.band_pairs(positives, candidates).collect()]

    rows = pairs()
    assert sum(a[1:] != b[1:] for a, b in zip(rows, rows[1:])) < len(rows) / 30
    assert len(rows) == len({r[:2] for r in rows}) == len({(r[0], r[3]) for r in rows}) == 600 * 400 and {r[3] for r in rows} == set(range(1, 401))
    assert len({r[1:] for r in rows}) == 400

    monkeypatch.setattr(ingest, "BAND_GROUP", 7)  # the last of 43 groups of a band has 6 positives
    assert sorted(pairs()) == sorted(rows)


#: Queries over scored() whose whole plan, the answer's joins included, is looked at.
WHOLE = "gbt_scores logistic_scores matched_group_rank scrubbed_momentum axis_screen within_month_ap budget_metrics candidate_page tie_diagnostics hybrid_score pairwise_auc precision_at_k score_percentiles thesis_rerank pilot_strata trajectory_trend tenure_cells_ap model_metrics".split()


@pytest.mark.parametrize("name", WHOLE)
def test_only_aggregates_are_broadcast(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert broadcast_spines(df) == 0 and _broadcast_tables(df._jdf.queryExecution().executedPlan()) == 0
