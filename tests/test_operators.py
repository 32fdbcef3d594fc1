"""Hand-computed cases and invariants of operators that SQL cannot check."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from veloria.functions.columns import conform, handle, host, slug, strip_html
from veloria.functions import names
from veloria.functions.dates import season_date
from veloria.operators import evaluation as ev
from veloria.operators import graph, ingest, models, panel, serving, text
from veloria.plans.panel import CLASSES
from veloria.sources import tables


def _people(spark, rows):
    return spark.createDataFrame(rows, "actor long, grp long, positive boolean, b long")


def test_trailing_windows_by_hand(spark):
    p = _people(spark, [(1, 0, True, 24000)])
    monthly = spark.createDataFrame([(1, 23985, 4), (1, 23986, 6), (1, 23987, 8)], "actor long, m long, n long")
    dense = panel.on_spine(p, monthly)
    got = {r.m: r for r in panel.trimmed(dense.select("actor", "b", "m", panel.trailing("n", 3).alias("n3"), panel.burst("n").alias("z"))).collect()}
    assert len(got) == 37 and got[23987].n3 == 18 and got[23986].n3 == 10 and got[23980].n3 == 0 and got[23987].z == 0.0


def test_greedy_match_never_reuses(spark):
    pairs = spark.createDataFrame([(1, 10, 5, 1), (1, 11, 5, 2), (2, 10, 5, 1), (2, 12, 5, 2)], "positive long, candidate long, cutoff long, order_rank long")
    got = {(r.positive, r.control) for r in ingest.greedy_match(pairs, 1).collect()}
    assert got == {(1, 10), (2, 12)}


def test_greedy_match_uses_a_control_once_over_all_cutoffs(spark):
    rows = [(1, 10, 5, 1), (1, 11, 5, 2), (2, 10, 6, 1), (2, 12, 6, 2), (3, 12, 7, 1), (4, 13, 5, 1), (4, 14, 5, 2), (4, 15, 5, 3)]
    pairs = spark.createDataFrame(rows, "positive long, candidate long, cutoff long, order_rank long")
    got = {(r.positive, r.control, r.match_rank) for r in ingest.greedy_match(pairs, 1).collect()}
    assert got == {(1, 10, 1), (2, 12, 1), (4, 13, 1)}
    got = {(r.positive, r.control, r.match_rank) for r in ingest.greedy_match(pairs, 2, offset=17).collect()}
    assert got == {(1, 11, 1), (1, 10, 2), (2, 12, 1), (4, 15, 1), (4, 13, 2)}
    chain = spark.createDataFrame([(k, c, k, 1) for k in range(40) for c in (100 + k, 101 + k)] + [(90, 900, 1, 1)], "positive long, candidate long, cutoff long, order_rank long")
    assert {(r.positive, r.component) for r in ingest.match_components(chain).collect()} == {*((k, 0) for k in range(40)), (90, 90)}


def test_best_partners_by_brute_force(spark):
    balances = [19.99, 20.01, 39.9, 40.0, 40.5, -0.2, 0.3, -20.0, 75.0, 500.0, 501.5, 19.2, 60.0, 79.99, 99.0]
    people = [(k, f"Customer#{k % 4 * 1111}", k % 2, ("A", "B", "C")[k % 3], balances[k % 15] + k // 15 / 4) for k in range(45)] + [(99, "x", 9, "A", 1.0)]
    similar = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()
    best = {}
    for a, b in itertools.combinations(people, 2):
        if a[2] == b[2] and abs(a[4] // 20 - b[4] // 20) <= 1:
            score = min(1.0, 0.4 + 0.3 * (a[3] == b[3]) + 0.2 * (similar(a[1], b[1]) >= 0.9) + 0.1 * (abs(a[4] - b[4]) < 1))
            for one, other in ((a[0], b[0]), (b[0], a[0])):
                best[one] = max(best.get(one, (0, 0)), (round(score, 6), -other))
    got = text.entity_candidates(spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"))
    assert {r.c_custkey: (round(r.score, 6), -r.other) for r in got.collect()} == best and 99 not in best


def test_matched_ranks_under_ties(spark):
    s = spark.createDataFrame([(1, 0, True, 0.5), (2, 0, False, 0.5), (3, 0, False, 0.1)], "actor long, grp long, positive boolean, peak double")
    r = ev.matched_ranks(s).head()
    assert (r.rank1, r.top_half, r.norm_rank) == (0.5, 1.0, 0.25)


def test_average_precision_and_auc(spark):
    d = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, y long")
    assert ev.average_precision(d).head().ap == pytest.approx((1 + 2 / 3) / 2)
    assert ev.roc_auc(d).head().auc == pytest.approx(0.75)


def test_exact_intervals():
    lo, hi = ev.binomial_ci(8, 10)
    assert (lo, hi) == (pytest.approx(0.4439, abs=1e-4), pytest.approx(0.9748, abs=1e-4))
    assert ev.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03497, abs=1e-5)


def test_topk_keeps_the_multiset(spark):
    d = ev.second_score(spark.range(50).select(F.col("id").alias("actor"), F.lit(1).alias("m"), (F.col("id") / 100).alias("score")))
    before, after = sorted(r.score for r in d.collect()), sorted(r.score for r in ev.top_permuted(d, 10).collect())
    assert before == after


def test_guarded_sql(spark):
    assert serving.guarded_sql(spark, "SELECT 'drop table x' AS t").head().t == "drop table x"
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", ""):
        with pytest.raises(ValueError):
            serving.guarded_sql(spark, bad)


def test_text_helpers(spark):
    row = spark.createDataFrame([("https://www.Example.org/x", "@Some_One!", "<p>a &amp; <b>b</b></p><script>x</script>", "Hello, World", "Winter 2023")], "u string, h string, t string, s string, w string")
    r = row.select(host(F.col("u")).alias("u"), handle(F.col("h")).alias("h"), strip_html(F.col("t")).alias("t"), slug(F.col("s")).alias("s"), season_date(F.col("w")).cast("string").alias("w"), text.plain_ascii(F.lit("Éa b")).alias("p"), text.name_similarity(F.lit("a b"), F.lit("b a")).alias("sim")).head()
    assert tuple(r) == ("example.org", "some_one", "a & b", "hello-world", "2023-01-01", "ea b", 1.0)
    assert text.tolerant_json('```json\n{"a": {"b": 1}}\n``` rest') == '{"a": {"b": 1}}'


def test_masking_leaves_no_name(spark):
    d = spark.createDataFrame([("Ann met Annabel and ann", ["Ann", "Annabel"]), (None, ["x"])], "text string, names array<string>")
    got = d.select(text.mask_names("text", "names").alias("masked"), "names")
    assert [r.masked for r in got.collect()] == ["PERSON1 met PERSON2 and PERSON1", None]
    assert text.leak_audit(got.filter("masked is not null"), "masked", "names").count() == 0


def test_edges_drop_self_and_cap(spark):
    c = spark.createDataFrame([(1, 7, 3, False), (2, 7, 3, False), (2, 7, 3, False), (3, 7, 3, False)], "actor long, repo long, m long, is_own boolean")
    e = graph.edges(c, graph.rooms(c, 10), 1).collect()
    assert {(r.actor, r.neighbour) for r in e} == {(1, 2), (3, 2)}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n1\t\\N\n2\tz\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "x.tsv"), "a int, b string").collect()] == [(1, None), (2, "z")]
    tables.write(spark.range(3), str(tmp_path / "p"))
    tables.write(spark.range(2).withColumn("k", F.lit(1)), str(tmp_path / "q"))
    assert tables.read_collection(spark, str(tmp_path / "p"), str(tmp_path / "q")).filter("k is null").count() == 3
    assert tables.query_cached(spark, "SELECT 1 AS one", str(tmp_path / "c")).count() == tables.query_cached(spark, "SELECT 1 AS one", str(tmp_path / "c")).count() == 1
    assert tables.manifest(spark, str(tmp_path / "x.tsv")).head().length == 13


def test_conform_and_leakage(spark):
    d = conform(spark.createDataFrame([("1",), ("x",)], "a string"), {"a": "int", "b": "string"})
    assert [tuple(r) for r in d.collect()] == [(1, None), (None, None)]
    f = spark.createDataFrame([(1, 2), (2, 2), (None, 2)], "t long, c long")
    assert ingest.leakage(f, "t", "c").count() == 2


def test_logistic_contributions_add_up(spark):
    rows = models.matrix(spark.range(200).select(F.col("id").alias("actor"), F.lit(1).alias("m"), (F.col("id") % 3 == 0).cast("long").alias("y"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 7).cast("double").alias("x")), ["x"])
    model = models.fit(models.logistic(["x"]), rows)
    assert models.contributions(model, rows, ["x"]).filter("x is null").count() == 0 and len(CLASSES) == 5


def test_names_and_landed_lists(spark):
    row = spark.createDataFrame([("Acme, Inc.", "Launch HN: Acme (YC W21)", "Ada B. Lovelace", '{"x": [{"y": 1}, {"people": [{"b": 1}, 2]}], "people": 3}', "up 1,234.5 since")], "c string, t string, n string, j string, d string")
    links = F.array(F.lit("https://github.com/Ann/x"), F.lit("see https://www.github.com/ann?q"), F.lit("https://github.com/features"), F.lit(None))
    r = row.select(
        names.company_core(F.col("c")), names.whole_word(F.col("t"), F.lit("ACME")), names.whole_word(F.col("t"), F.lit("cme")), names.launch_title(F.col("t"), F.lit("Acme")), names.username_variants(F.col("n")),
        names.author_grade(F.lit("alovelace"), F.lit(None).cast("string"), F.col("n")), names.is_rare_login(F.lit("abcdefg1")), names.percentile_100(F.lit(0.5)), names.first_number(F.col("d")),
        names.logins_of(links, "github.com", ["features"]), names.first_list("people")("j"), names.username_variants(F.lit("")),
    ).head()
    assert tuple(r) == ("Acme", True, False, True, ["ada.lovelace", "ada_lovelace", "adal", "adalovelace", "alovelace"], "author_name_variant", True, 50.0, 1234.5, ["Ann"], '[{"b": 1}]', [])
