"""Queries of the text, search, streaming and model families."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veloria.functions.columns import ENTITIES, host, strip_html, tidy
from veloria.operators import evaluation as ev
from veloria.operators import linkage as ln
from veloria.operators import models as ml
from veloria.operators import search as se
from veloria.operators import text as op
from veloria.plans.evaluation import scored
from veloria.sources.shared import shared_folder
from veloria.sources.tables import table
from veloria.streaming import counts as st


def _searchable(s, d):
    docs = table(s, d, "documents").select(F.lit("document").alias("kind"), "doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    bench = table(s, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("doc_id"), F.lit("item").alias("title"), F.col("text").alias("body"))
    page = table(s, d, "pages")
    pages = page.select(F.lit("page").alias("kind"), F.col("page_id").alias("doc_id"), F.coalesce(op.page_title(), F.lit("")).alias("title"), F.concat_ws(" ", host(F.col("url")), strip_html(F.col("html"))).alias("body"))
    return docs.unionByName(bench).unionByName(pages)


def _titles(s, d):
    """Whole benchmark texts as titles."""
    return ln.titles_linked(table(s, d, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title")), table(s, d, "documents"))


def _typed(s, d):
    empty = F.lit("").alias
    docs = table(s, d, "documents").select("doc_id", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("ref"), F.col("source").alias("title"), F.col("lang").alias("about"), F.col("text").alias("body"), empty("tags"))
    bench = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("kind"), empty("ref"), F.lit("the item").alias("title"), empty("about"), F.col("text").alias("body"), empty("tags"))
    who = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("person").alias("kind"), F.col("c_name").alias("ref"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("about"), empty("body"), F.lit("the rest").alias("tags"))
    folder = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    se.build(docs.unionByName(bench).unionByName(who), folder)
    return tidy(se.find(s, folder, "the rest", kinds=["document", "benchmark"]))


def _masked(s, d):
    t = table(s, d, "conversations")
    names = F.filter(F.array_distinct(F.slice(F.split("text", r"\W+"), 1, 2)), lambda w: F.length(w) > 1)
    rows = t.select("conv_id", "turn", "text", names.alias("names"))
    return rows.select("conv_id", "turn", "names", op.mask_names("text", "names").alias("masked"))


def _panel(s, d):
    return ml.matrix(scored(s, d).select("actor", "m", "y", "split", "n3", "n12", "tenure"), ["n3", "n12", "tenure"])


def _model(kind):
    def run(s, d):
        rows = _panel(s, d)
        pipeline = ml.logistic(["n3", "n12", "tenure"]) if kind == "logistic" else ml.boosted(["n3", "n12", "tenure"])
        return tidy(ml.probabilities(ml.fit(pipeline, rows), rows.filter("split = 'test'")).drop("split"), 4)

    return run


def _stream(window):
    def run(s, d):
        out = st.drained(s, d, window)
        return tidy(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)

    return run


_r = lambda x, n=6: f"round({x}, {n}) + 0.0"
_LINE = r"array_to_string(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), ' ')"
_FOLD = "translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"
_TOKENS = "list_filter(string_split_regex(" + _FOLD + ", '[^a-z0-9]+'), lambda w: w <> '')"
_SEARCH = f"""WITH docs AS (SELECT 'document' AS kind, doc_id, source AS title, text AS body FROM documents UNION ALL SELECT 'benchmark', item_id, 'item', text FROM benchmark UNION ALL SELECT 'page', page_id, {{title}}, {{host}} FROM pages),
tok AS (SELECT kind, doc_id, {_TOKENS.format('title')} AS t, {_TOKENS.format('body')} AS b FROM docs),
sized AS (SELECT kind, doc_id, len(t) + len(b) AS size FROM tok), tot AS (SELECT count(*) AS n, avg(size) AS mean FROM sized),
hits AS (SELECT q, kind, doc_id, 5.0::DOUBLE * sum(ti) + sum(1 - ti) AS f FROM (SELECT kind, doc_id, unnest(t) AS w, 1 AS ti FROM tok UNION ALL SELECT kind, doc_id, unnest(b), 0 FROM tok) JOIN (SELECT unnest(['the', 'rest']) AS q) ON starts_with(w, q) GROUP BY ALL),
df AS (SELECT q, count(*) AS df FROM hits GROUP BY q)
SELECT kind, doc_id, {_r('score')} AS score FROM (SELECT kind, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM hits JOIN df USING (q) JOIN sized USING (kind, doc_id), tot GROUP BY ALL HAVING count(*) = 2) ORDER BY round(score, 6) DESC, kind, doc_id LIMIT 50"""
_WORTH = " + ".join(f"{w}::DOUBLE * count(*) FILTER (WHERE c = '{c}')" for c, w in se.WEIGHTS.items())
_TYPED = f"""WITH docs AS (SELECT 'document' AS kind, doc_id, doc_id::VARCHAR AS ref, source AS title, lang AS about, text AS body, '' AS tags FROM documents UNION ALL SELECT 'benchmark', item_id, '', 'the item', '', text, '' FROM benchmark UNION ALL SELECT 'person', c_custkey, c_name, c_name, c_mktsegment, '', 'the rest' FROM customer),
tok AS ({" UNION ALL ".join(f"SELECT kind, doc_id, '{c}' AS c, unnest({_TOKENS.format(f'coalesce({c}, {chr(39) * 2})')}) AS w FROM docs" for c in se.WEIGHTS)}),
sized AS (SELECT kind, doc_id, count(*) AS size FROM tok GROUP BY ALL), tot AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM docs) AS mean),
hits AS (SELECT q, kind, doc_id, {_WORTH} AS f FROM tok JOIN (SELECT unnest(['the', 'rest']) AS q) ON starts_with(w, q) GROUP BY ALL),
df AS (SELECT q, count(*) AS df FROM hits GROUP BY q)
SELECT kind, doc_id, {_r('score')} AS score FROM (SELECT kind, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM hits JOIN df USING (q) JOIN sized USING (kind, doc_id), tot WHERE kind <> 'person' GROUP BY ALL HAVING count(*) = 2) ORDER BY round(score, 6) DESC, kind, doc_id LIMIT 50"""
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
_HOST = r"CASE WHEN contains(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#\s\[\]]+)', 1)), '^www\.', ''), '.') THEN regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#\s\[\]]+)', 1)), '^www\.', '') END"
_VISIBLE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _sign in ENTITIES:
    _VISIBLE = f"replace({_VISIBLE}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_VISIBLE = f"trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'))"

QUERIES = {
    "text_topn_quarter": lambda s, d: op.top_items(table(s, d, "documents").select("source", "doc_id", "text"), ["source"], [F.desc("doc_id")], 40, 100),
    "content_features": lambda s, d: tidy(op.content_features(table(s, d, "documents"), "source")),
    "digest": lambda s, d: op.digest(table(s, d, "conversations"), 200),
    "prior_context": lambda s, d: tidy(op.prior_context(table(s, d, "conversations"))),
    "mask_text": lambda s, d: op.leak_audit(_masked(s, d), "masked", "names").agg(F.count("*").alias("leaks")),
    "entity_resolution": lambda s, d: tidy(op.entity_candidates(table(s, d, "customer"))),
    "title_linkage": _titles,
    "html_extract": lambda s, d: op.pages_text(table(s, d, "pages")).select("page_id", "title", "host", "links", "chars"),
    "search_bm25": lambda s, d: tidy(op.search(_searchable(s, d), "the rest")),
    "search_typed": _typed,
    "logistic_scores": _model("logistic"),
    "gbt_scores": _model("boosted"),
    "model_metrics": lambda s, d: tidy(ev.roc_auc(ml.probabilities(ml.fit(ml.logistic(["n3", "n12", "tenure"]), _panel(s, d)), _panel(s, d)), ["split"], "prob"), 2),
    "tumbling_counts_stream": _stream(st.tumbling),
    "session_counts_stream": _stream(st.sessions),
}

ORACLES = {
    "text_topn_quarter": "SELECT source, doc_id, idx, excerpt FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS idx, substr(text, 1, 100) AS excerpt FROM documents) WHERE idx <= 40",
    "content_features": f"SELECT source, count(*) AS items, count(*) FILTER (WHERE regexp_matches(text, '(?i)licen[sc]e')) AS licence, count(*) FILTER (WHERE regexp_matches(text, '[#*$%&]{{3}}')) AS symbols, count(*) FILTER (WHERE regexp_matches(text, '!!')) AS shouting, {_r(chr(40) + 'count(*) FILTER (WHERE regexp_matches(text, ' + chr(39) + r'\d{3}' + chr(39) + '))::DOUBLE / count(*))')} AS digit_rate, {_r('avg(n_chars)')} AS mean_chars FROM documents GROUP BY source",
    "digest": "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn, role || ': ' || substr(text, 1, 200))) AS digest FROM conversations GROUP BY conv_id",
    "prior_context": "SELECT conv_id, turn, count(*) OVER w AS n_prior, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS prior_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "title_linkage": f"WITH t AS (SELECT item_id AS title_id, {_LINE.format('text')} AS title FROM benchmark), d AS (SELECT doc_id, {_LINE.format('text')} AS body FROM documents) SELECT title_id, doc_id, CASE WHEN body = title THEN 'exact' WHEN starts_with(body || ' ', title || ' ') THEN 'start' ELSE 'inside' END AS grade FROM t JOIN d ON contains(' ' || body || ' ', ' ' || title || ' ') WHERE title <> ''",
    "html_extract": f"SELECT page_id, {_TITLE} AS title, {_HOST} AS host, len(regexp_extract_all(html, '(?i)<a\\s'))::BIGINT AS links, length({_VISIBLE})::BIGINT AS chars FROM pages",
    "search_bm25": _SEARCH.replace("{title}", f"coalesce({_TITLE}, '')").replace("{host}", f"coalesce({_HOST} || ' ', '') || {_VISIBLE}"),
    "search_typed": _TYPED,
    "tumbling_counts_stream": f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, {_r('sum(value)', 4)} AS total FROM events GROUP BY ALL",
    "session_counts_stream": "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM y GROUP BY user_id, s",
}
