"""Queries of the evaluation family."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from veloria.functions.columns import tidy
from veloria.operators import evaluation as op
from veloria.operators import panel as pn
from veloria.plans.sqltext import sql
from veloria.sources.tables import act, people, table


def scored(s, d):
    """A transparent score of each person-month from its trailing counts.

    People grow with the tables, but Spark takes them for small: the hint keeps them from the driver.
    """
    p = people(s, d).filter("actor is not null").hint("merge")
    known = pn.histories(p, pn.monthly_counts(act(s, d), p), "n")
    active = F.filter(F.sequence(F.lit(0), F.size("history") - 1), lambda k: F.get("history", k) > 0)
    known = known.withColumn("_begun", F.col("b") - pn.WARM + F.array_min(active))
    # A person listed twice has each month's row once for each pair of listings, as a join of the panel with the counts has it.
    rows = known.select("*", F.explode(F.flatten(F.array_repeat(F.sequence(F.col("b") - pn.FIRST, F.col("b") - pn.LAST), F.col("copies").cast("int")))).alias("m"))
    tenure = F.when(F.col("_begun") <= F.col("m"), F.col("m") - F.col("_begun") + 1).otherwise(F.lit(0).cast("long"))
    dense = rows.select("actor", "m", "grp", "positive", "b", *pn.label_columns(), pn.history_sum(3).alias("n3"), pn.history_sum(12).alias("n12"), tenure.alias("tenure"))
    raw = 2 * F.col("n3") + F.col("n12") + F.col("actor") % 3
    return dense.withColumn("score", F.round(F.lit(0.02) + F.lit(0.9) * raw / (raw + 10), 4)).withColumn("recent", 2 * F.col("n3")).withColumn("year", F.col("n12"))


def summary(s, d):
    return op.person_summary(scored(s, d))


def items(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("long").alias("y"), F.round(F.least(F.lit(1.0), F.char_length("text") / F.lit(4000.0)), 2).alias("score"))


def _binomial(s, d):
    def limits(batches):
        for pdf in batches:
            got = [op.binomial_ci(int(k), int(n)) for k, n in zip(pdf.k, pdf.n, strict=True)]
            yield pdf.assign(lo=[x[0] for x in got], hi=[x[1] for x in got])

    counts = items(s, d).groupBy("lang").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return tidy(counts.mapInPandas(limits, "lang string, k long, n long, lo double, hi double"))


def _fisher(s, d):
    def tests(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf.lang, "p": [op.fisher_exact(*map(int, r)) for r in zip(pdf.a, pdf.b, pdf.c, pdf.d, strict=True)]})

    x, q = items(s, d), F.col("score") >= 0.5
    counts = x.groupBy("lang").agg(F.count_if(q & (F.col("y") == 1)).alias("a"), F.count_if(q & (F.col("y") == 0)).alias("b"), F.count_if(~q & (F.col("y") == 1)).alias("c"), F.count_if(~q & (F.col("y") == 0)).alias("d"))
    return tidy(counts.mapInPandas(tests, "lang string, p double"))


def _groups(s, d):
    x = summary(s, d).groupBy("grp").agg((F.max(F.when(F.col("positive"), F.col("peak"))) - F.avg(F.when(~F.col("positive"), F.col("peak")))).alias("v"))
    return x.withColumn("i", F.col("grp"))


def _shuffle(s, d):
    panel = pn.labelled(pn.spine(people(s, d)))
    before = panel.groupBy("m").agg(F.sum("y").alias("before"))
    return before.join(op.shuffled_labels(panel).groupBy("m").agg(F.sum("y").alias("after")), "m")


def _found(s, d):
    return op.detections(scored(s, d))


def _second(s, d):
    return op.second_score(scored(s, d).filter("split = 'test'"))


_BY = lambda src, by, y="y", sc="score": (f"SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY s DESC) AS ctp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC) AS cn, sum(tp) OVER (PARTITION BY {by}) AS p, sum(n) OVER (PARTITION BY {by}) AS al FROM (SELECT {by}, {sc} AS s, count(*) AS n, sum({y}) AS tp FROM {src} GROUP BY ALL)")
_ITEMS1 = _BY("(SELECT 1 AS one, * FROM items)", "one")
_AP = "sum(tp::DOUBLE / p * ctp / cn) FILTER (WHERE p > 0 AND p < al)"
_AUC = "sum(tp * (al - p - (cn - ctp) + (n - tp) / 2.0::DOUBLE)) / nullif(max(p * (al - p)), 0)"
_COUNTED = "SELECT c.*, coalesce(c.m - min(CASE WHEN c.n > 0 THEN c.m END) OVER (PARTITION BY c.actor ORDER BY c.m RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1, 0) AS tenure FROM counted c"
_SUMMARY = "SELECT actor, any_value(grp) AS grp, bool_or(positive) AS positive, max(score) AS peak, max_by(score, m) AS current, min_by(score, m) AS first_score, (max_by(score, m) - max(score) FILTER (WHERE m = b - 14)) / 2 AS momentum FROM scored GROUP BY actor"
_FOUND = "SELECT actor, detected, b - detected AS lead FROM (SELECT s.actor, s.b, min(s.m) FILTER (WHERE s.score >= t.bar) AS detected FROM scored s LEFT JOIN (SELECT m, quantile_cont(score, 0.99) AS bar FROM scored WHERE NOT positive GROUP BY m) t USING (m) WHERE s.positive GROUP BY ALL)"
_SECOND = "SELECT actor, m, score, (('0x' || substr(md5(actor || ':' || m), 1, 8))::BIGINT % 997 + 1) / 999.0::DOUBLE AS second FROM scored WHERE split = 'test'"
_CHANGES = "SELECT actor, feature, delta::DOUBLE AS delta, row_number() OVER (PARTITION BY actor ORDER BY abs(delta) DESC, feature) AS rank FROM (SELECT c.actor, unnest(['recent', 'year', 'tenure']) AS feature, unnest([c.recent, c.year, c.tenure]) AS delta FROM (SELECT actor, m, 2 * n3 - coalesce(lag(2 * n3) OVER w, 0) AS recent, n12 - coalesce(lag(n12) OVER w, 0) AS year, tenure - coalesce(lag(tenure) OVER w, 0) AS tenure FROM (SELECT t.* FROM tenured t WHERE t.m >= t.b - 48) WINDOW w AS (PARTITION BY actor ORDER BY m)) c JOIN found f ON f.actor = c.actor AND f.detected = c.m)"
_r = lambda x, n=6: f"round({x}, {n}) + 0.0"

QUERIES = {
    "scored_panel": lambda s, d: scored(s, d).select("actor", "m", "score", "y"),
    "person_summary": lambda s, d: tidy(summary(s, d)),
    "detection_lead": lambda s, d: _found(s, d),
    "lead_summary": lambda s, d: tidy(op.lead_summary(_found(s, d))),
    "score_percentiles": lambda s, d: tidy(op.score_percentiles(summary(s, d))),
    "average_precision": lambda s, d: tidy(op.average_precision(items(s, d))),
    "roc_auc": lambda s, d: tidy(op.roc_auc(items(s, d), ["lang"])),
    "within_month_ap": lambda s, d: tidy(op.within_month(scored(s, d))),
    "tenure_cells_ap": lambda s, d: tidy(op.tenure_cells(scored(s, d))),
    "matched_group_rank": lambda s, d: tidy(op.matched_ranks(summary(s, d))),
    "pairwise_auc": lambda s, d: tidy(op.pairwise(summary(s, d))),
    "precision_at_k": lambda s, d: tidy(op.precision_at(summary(s, d), [10, 50, 100])),
    "pr_curve": lambda s, d: tidy(op.pr_curve(items(s, d))),
    "calibration": lambda s, d: tidy(op.calibration(scored(s, d))),
    "spearman": lambda s, d: tidy(op.spearman(items(s, d), "score", "y")),
    "score_resolution": lambda s, d: tidy(op.resolution(summary(s, d))),
    "tie_break": lambda s, d: tidy(op.tie_break(_second(s, d))),
    "logit_blend": lambda s, d: tidy(op.logit_blend(_second(s, d), 0.7)),
    "topk_permute": lambda s, d: tidy(op.top_permuted(_second(s, d), 20)),
    "null_shuffle": _shuffle,
    "bootstrap_ci": lambda s, d: tidy(op.bootstrap(_groups(s, d), "v", 100)),
    "binomial_ci": _binomial,
    "fisher_exact": _fisher,
    "frozen_clock": lambda s, d: tidy(op.frozen_clock(act(s, d), people(s, d), 2000 * 12, 18, [20, 100])),
    "exclusion_variants": lambda s, d: tidy(op.variants(scored(s, d), {"all": F.lit(False), "without tens": F.col("actor") % 10 == 0, "test only": F.col("split") != "test"})),
    "crossing_attribution": lambda s, d: tidy(op.crossing_changes(scored(s, d), _found(s, d), ["recent", "year", "tenure"])),
    "score_components": lambda s, d: tidy(op.components_of(op.crossing_changes(scored(s, d), _found(s, d), ["recent", "year", "tenure"]))),
}

_S = {"summary": _SUMMARY}
ORACLES = {
    "scored_panel": sql("SELECT actor, m, score, y FROM scored", "scored"),
    "person_summary": sql(f"SELECT actor, grp, positive, {_r('peak')} AS peak, {_r('current')} AS current, {_r('first_score')} AS first_score, {_r('momentum')} AS momentum FROM summary", "scored", **_S),
    "detection_lead": sql("SELECT * FROM found", "scored", found=_FOUND),
    "lead_summary": sql(f"SELECT {_r('count(detected)::DOUBLE / count(*)')} AS rate, count(*) FILTER (WHERE lead = 48) AS censored, count(*) FILTER (WHERE lead < 48) AS rising, {_r('quantile_cont(lead, 0.25)')} AS q25, {_r('quantile_cont(lead, 0.5)')} AS q50, {_r('quantile_cont(lead, 0.75)')} AS q75 FROM found", "scored", found=_FOUND),
    "score_percentiles": sql(f"SELECT actor, rank, {_r('(al - rank + 1)::DOUBLE / al')} AS percentile FROM (SELECT actor, row_number() OVER (ORDER BY peak DESC, actor) AS rank, count(*) OVER () AS al FROM summary)", "scored", **_S),
    "average_precision": sql(f"SELECT {_r(_AP)} AS ap, sum(n)::BIGINT AS rows, sum(tp)::BIGINT AS positives FROM c", "items", c=_ITEMS1),
    "roc_auc": sql(f"SELECT lang, {_r(_AUC)} AS auc FROM c GROUP BY lang", "items", c=_BY("items", "lang")),
    "within_month_ap": sql(f"SELECT {_r('sum(ap * positives) / sum(positives)')} AS weighted_ap, {_r('avg(ap) FILTER (WHERE rows >= 5)')} AS mean_ap, {_r('sum(positives::DOUBLE / rows * positives) / sum(positives)')} AS base_rate, count(*) AS months FROM (SELECT m, {_AP} AS ap, sum(n) AS rows, sum(tp) AS positives FROM c GROUP BY m) WHERE ap IS NOT NULL", "scored", c=_BY("scored", "m")),
    "tenure_cells_ap": sql(f"SELECT q, sum(rows)::BIGINT AS rows, count(ap) AS cells, {_r('sum(ap * positives) FILTER (WHERE ap IS NOT NULL) / sum(positives) FILTER (WHERE ap IS NOT NULL)')} AS ap FROM (SELECT m, q, {_AP} AS ap, sum(n) AS rows, sum(tp) AS positives FROM c GROUP BY ALL) GROUP BY q", "scored", "counted", tenured=_COUNTED, cells="SELECT s.*, ((e.q1 < t.tenure)::BIGINT + (e.q2 < t.tenure)::BIGINT + (e.q3 < t.tenure)::BIGINT + (e.q4 < t.tenure)::BIGINT)::BIGINT AS q FROM scored s JOIN tenured t USING (actor, m) JOIN (SELECT m, quantile_cont(tenure, 0.2) AS q1, quantile_cont(tenure, 0.4) AS q2, quantile_cont(tenure, 0.6) AS q3, quantile_cont(tenure, 0.8) AS q4 FROM scored JOIN tenured USING (actor, m) GROUP BY m) e USING (m)", c=_BY("cells", "m, q")),
    "matched_group_rank": sql(f"SELECT count(*) AS groups, {_r('avg(CASE WHEN h = 0 THEN 1.0::DOUBLE / t ELSE 0 END)')} AS rank1, {_r('avg(1.0::DOUBLE / n)')} AS chance, {_r('avg(least(greatest(ceil(n / 2.0::DOUBLE) - h, 0), t)::DOUBLE / t)')} AS top_half, {_r('avg((h + (t - 1) / 2.0::DOUBLE) / (n - 1))')} AS norm_rank FROM (SELECT s.grp, count(*) FILTER (WHERE s.peak > p.peak) AS h, count(*) FILTER (WHERE s.peak = p.peak) AS t, count(*) AS n FROM summary s JOIN summary p ON p.grp = s.grp AND p.positive GROUP BY s.grp) WHERE n > 1", "scored", **_S),
    "pairwise_auc": sql(f"SELECT count(*) FILTER (WHERE p.peak > c.peak) AS wins, count(*) FILTER (WHERE p.peak = c.peak) AS ties, count(*) FILTER (WHERE p.peak < c.peak) AS losses, {_r('avg(CASE WHEN p.peak > c.peak THEN 1.0::DOUBLE WHEN p.peak = c.peak THEN 0.5::DOUBLE ELSE 0 END)')} AS auc FROM summary p JOIN summary c USING (grp) WHERE p.positive AND NOT c.positive", "scored", **_S),
    "precision_at_k": sql(f"SELECT k::BIGINT AS k, {_r('h::DOUBLE / n')} AS precision, {_r('h::DOUBLE / p')} AS recall, {_r('h::DOUBLE / n / (p::DOUBLE / al)')} AS lift FROM (SELECT k, count(*) FILTER (WHERE positive) AS h, count(*) AS n FROM (SELECT positive, row_number() OVER (ORDER BY peak DESC, actor) AS r FROM summary) JOIN (SELECT unnest([10, 50, 100]) AS k) ON r <= k GROUP BY k), (SELECT count(*) AS al, count(*) FILTER (WHERE positive) AS p FROM summary)", "scored", **_S),
    "pr_curve": sql(f"SELECT {_r('s')} AS threshold, {_r('ctp::DOUBLE / cn')} AS precision, {_r('ctp::DOUBLE / p')} AS recall FROM c", "items", c=_ITEMS1),
    "calibration": sql(f"SELECT bin, rows, {_r('predicted')} AS predicted, {_r('observed')} AS observed, {_r('brier')} AS brier FROM (SELECT bin, count(*) AS rows, sum(w * p) / sum(w) AS predicted, sum(w * y) / sum(w) AS observed FROM x GROUP BY bin), (SELECT sum(w * (p - y) * (p - y)) / sum(w) AS brier FROM x)", "scored", r="SELECT avg(y) AS rate FROM scored", o="SELECT y, CASE WHEN y = 1 THEN 0.01::DOUBLE / rate ELSE 0.99::DOUBLE / (1 - rate) END AS w, score / (1 - score) * (0.01::DOUBLE / 0.99::DOUBLE) / (rate / (1 - rate)) AS odds FROM scored, r", x="SELECT y, w, odds / (1 + odds) AS p, least(floor(odds / (1 + odds) * 10), 9)::BIGINT AS bin FROM o"),
    "spearman": sql(f"SELECT {_r('corr(a, b)')} AS rho FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM items)", "items"),
    "score_resolution": sql(f"SELECT count(*) AS distinct_scores, {_r('sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n)')} AS tied_share, count(*) FILTER (WHERE p > 0 AND p < n) AS mixed_ties, {_r('sum(CASE WHEN round(peak * 10000)::BIGINT % 500 = 0 THEN n ELSE 0 END)::DOUBLE / sum(n)')} AS round_share FROM (SELECT peak, count(*) AS n, count(*) FILTER (WHERE positive) AS p FROM summary GROUP BY peak)", "scored", **_S),
    "tie_break": sql(f"SELECT x.actor, x.m, {_r('x.score + g.gap * 0.49::DOUBLE * x.second')} AS score FROM x JOIN (SELECT m, coalesce(min(gap), 0) AS gap FROM (SELECT m, score - lag(score) OVER (PARTITION BY m ORDER BY score) AS gap FROM (SELECT DISTINCT m, score FROM x)) GROUP BY m) g USING (m)", "scored", x=_SECOND),
    "logit_blend": sql(f"SELECT actor, m, {_r('1 / (1 + exp(-(0.7::DOUBLE * ln(score / (1 - score)) + (1 - 0.7::DOUBLE) * ln(second / (1 - second)))))')} AS score FROM x", "scored", x=_SECOND),
    "topk_permute": sql(f"SELECT actor, m, {_r('score')} AS score FROM r WHERE r > 20 UNION ALL SELECT t.actor, t.m, {_r('u.score')} FROM t JOIN t u ON u.m = t.m AND u.r = t.r2", "scored", x=_SECOND, r="SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, actor) AS r FROM x", t="SELECT *, row_number() OVER (PARTITION BY m ORDER BY second DESC, actor) AS r2 FROM r WHERE r <= 20"),
    "null_shuffle": sql("SELECT m, sum(y)::BIGINT AS before, sum(y)::BIGINT AS after FROM panel GROUP BY m", "panel"),
    "bootstrap_ci": sql(f"SELECT {_r('avg(v)')} AS mean, {_r('quantile_cont(v, 0.025)')} AS lo, {_r('quantile_cont(v, 0.975)')} AS hi FROM (SELECT d.draw, avg(g.v) AS v FROM (SELECT draw, ('0x' || substr(md5('7:' || draw || ':' || i), 1, 8))::BIGINT % (SELECT count(*) FROM g) AS i FROM (SELECT grp AS i FROM g), (SELECT unnest(generate_series(1, 100)) AS draw)) d JOIN g ON g.grp = d.i GROUP BY d.draw)", "scored", **_S, g="SELECT grp, max(peak) FILTER (WHERE positive) - avg(peak) FILTER (WHERE NOT positive) AS v FROM summary GROUP BY grp"),
    "frozen_clock": sql(f"SELECT k::BIGINT AS k, {_r('p::DOUBLE / al')} AS base_rate, {_r('h::DOUBLE / n')} AS precision, {_r('CASE WHEN p = 0 THEN 0 ELSE h::DOUBLE / n / (p::DOUBLE / al) END')} AS lift FROM (SELECT k, count(*) FILTER (WHERE hit) AS h, count(*) AS n FROM (SELECT hit, row_number() OVER (ORDER BY n DESC, actor) AS r FROM pool) JOIN (SELECT unnest([20, 100]) AS k) ON r <= k GROUP BY k), (SELECT count(*) AS al, count(*) FILTER (WHERE hit) AS p FROM pool)", "act", "people", pool="SELECT a.actor, a.n, p.positive AND p.b > 24000 AND p.b <= 24018 AS hit FROM (SELECT actor, count(*) AS n FROM act WHERE m >= 23988 AND m < 24000 GROUP BY actor) a JOIN people p USING (actor)"),
    "exclusion_variants": sql(" UNION ALL ".join(f"SELECT '{n}' AS variant, {_r(_AUC)} AS auc FROM ({_BY('(SELECT 1 AS one, * FROM scored WHERE ' + w + ')', 'one')})" for n, w in (("all", "true"), ("without tens", "actor % 10 <> 0"), ("test only", "split = 'test'"))), "scored"),
    "crossing_attribution": sql("SELECT actor, feature, delta, rank FROM changes WHERE rank <= 3", "scored", "counted", tenured=_COUNTED, found=_FOUND, changes=_CHANGES),
    "score_components": sql(f"SELECT actor, CASE WHEN rank <= 2 THEN feature ELSE 'other' END AS key, {_r('sum(abs(delta))')} AS contribution FROM changes GROUP BY ALL", "scored", "counted", tenured=_COUNTED, found=_FOUND, changes=_CHANGES),
}
