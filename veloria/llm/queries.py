"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veloria.llm import bpe, decontaminate, language_id, license_scan, lm_score, near_dup, quality, sharding, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.query,
        "op2_lm_score": lm_score.query,
        "op3_toxicity": toxicity.query,
        "op4_near_dup": near_dup.query,
        "op5_sharding": sharding.query,
        "op6_quality": quality.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_decontamination": decontaminate.query,
        "op9_language_id": language_id.query,
        "op10_license_scan": license_scan.query,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "list_filter(string_split_regex({}, '{}'), lambda x: x <> '')"
_BLANKS, _NO_WORD = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SUBSTRING = f"""WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')", _BLANKS)} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT w.doc_id, w.i FROM win w JOIN first USING (k) WHERE f < w.doc_id), (SELECT unnest(generate_series(0, 12)) AS j)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS t, count(g.p) AS n FROM words w LEFT JOIN gone g USING (doc_id, p) GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""

_DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_SPLIT.format(_LOWER, _NO_WORD)} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT.format(_LOWER, _NO_WORD)} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM item))),
found AS (SELECT w.doc_id, w.i, w.n, t.item_id FROM win w JOIN item t ON t.n = w.n AND t.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS t FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.t, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER, _BLANKS)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(l.v, doc_id)) AS component_id, coalesce(l.v, doc_id) >= doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON l.u = doc_id"""

_SHARE = "CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0::DOUBLE END"
_MEASURES = {"symbols": _SHARE.format(a="n_symbols", b="word_chars"), "lines": _SHARE.format(a="n_dup_lines", b="n_lines"), "repeats": _SHARE.format(a="n_repeat_words", b="n_words"), "length": _SHARE.format(a="word_chars", b="n_words")}


def _quality() -> str:
    """op6 in SQL: the counts by lists and joins, the sketches as counts on the same grid."""
    grid, rows = f"{quality._GRID}::DOUBLE", quality.LEAST_ROWS
    quarter = lambda by: f"SELECT {by}measure, max(rows) AS rows, min(CASE WHEN upto >= 0.25 * rows THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * rows THEN value END) AS q3 FROM (SELECT {by}measure, CASE WHEN bucket IS NULL THEN 0.0::DOUBLE ELSE 2 * pow({grid}, bucket) / (1 + {grid}) END AS value, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS rows FROM (SELECT {by}measure, bucket, count(*) AS n FROM bucketed GROUP BY ALL)) GROUP BY ALL"
    pick = lambda q: f"CASE WHEN f.rows >= {rows} THEN f.{q} WHEN w.rows >= {rows} THEN w.{q} ELSE a.{q} END"
    spread = "CASE f.measure " + " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in quality.LEAST_SPREAD.items()) + " END"
    two = ", ".join(f"'{m}'" for m in sorted(quality.TWO_SIDED))
    blanks = "translate({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')"
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')", _BLANKS)} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {blanks.format("x")} <> '') AS l FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM win WHERE c > 1) GROUP BY doc_id),
counted AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length({blanks.format("t")})::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
measured AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {x} AS x FROM counted" for m, x in _MEASURES.items())}),
bucketed AS (SELECT *, CASE WHEN x > 0 THEN ceil(ln(x) / ln({grid}))::INT END AS bucket FROM measured),
fine AS ({quarter("lang, source, ")}), wide AS ({quarter("lang, ")}), every AS ({quarter("")}),
bound AS (SELECT lang, source, measure, q1 - {quality.REACH} * greatest(q3 - q1, spread) AS least, q3 + {quality.REACH} * greatest(q3 - q1, spread) AS most FROM (SELECT f.lang, f.source, f.measure, {pick("q1")} AS q1, {pick("q3")} AS q3, {spread} AS spread FROM fine f JOIN wide w ON w.lang IS NOT DISTINCT FROM f.lang AND w.measure = f.measure JOIN every a ON a.measure = f.measure)),
good AS (SELECT doc_id, bool_and(x <= most AND (m.measure NOT IN ({two}) OR x >= least)) AS ok FROM measured m JOIN bound b ON b.lang IS NOT DISTINCT FROM m.lang AND b.source IS NOT DISTINCT FROM m.source AND b.measure = m.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ok AS kept FROM counted JOIN good USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose whole result SQL can express; tests cover the others by brute force."""
    return {"op4_near_dup": _NEAR, "op6_quality": _quality(), "op7_substring_dedup": _SUBSTRING, "op8_decontamination": _DECONTAMINATION}
