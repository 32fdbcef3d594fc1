"""The language-model operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloria.llm import bpe, components, decontaminate, language_id, license_scan, lm_score, near_dup, quality, sharding, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, and rows with nulls, empty and long texts, repeats and odd signs."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    passage = " ".join(f"w{k}" for k in range(60))
    odd = [(1001, None, "en", None), (1002, "", None, "s"), (1003, " \t\n\x0b\x0c\r ", "en", "s"), (1004, "one", "en", "s"), (1005, "ONE two", "en", "s"), (1006, passage, "en", "s"), (1007, "Before " + passage + " after", "en", "s"), (1007, "Before " + passage + " after", "en", "s"),
           (1008, "it's 'we''ll  x　y z 1½!? 中文\U0001f600 é", "en", "s"), (1009, "a b c d e f g " * 4000, "en", "s"), (1010, "the The\nThe the\n\n \nThe the", "en", "s"), (1011, "u\rv\x0bw\x0cx\ty z\x85a", "en", "s"), (None, "no id here", "en", "s")]
    return real + odd


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("_t", F.lit("x")).withColumn("n_words", F.lit(-1))


def _tally(rows):
    return collections.Counter(rows)


def test_bpe_round_trip_and_library(spark, frame, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(frame, ranks), ranks).select("doc_id", "ids", "decoded", "n_tokens", "_t").collect()
    want = _tally((i, np.array(encoder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _, _ in docs)
    assert _tally((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) and r._t == "x" for r in got)


def test_pretokens_follow_the_pattern():
    import public_tokenizers
    import pyarrow as pa
    import regex

    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", " ", "a", "é", "1", "²", "!", "\U0001f600", "́", "中", "\t"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(5000)]
    found = []
    for piece in bpe.slices(pa.array(texts)):
        begins, per = bpe.pretokens(piece)
        ends, raw, at = np.append(begins[1:], len(piece.buf)), piece.buf.tobytes(), 0
        for n in per:
            found.append([raw[a:b].decode() for a, b in zip(begins[at : at + n], ends[at : at + n], strict=True)])
            at += n
    assert found == [[m[0] for m in pattern.finditer(t)] for t in texts]


def test_lm_base_and_normalisation(spark, frame, docs):
    held = F.col("doc_id") % 3 == 0
    got = lm_score.score(frame, ~held, depth=3, keep=["doc_id", "text"]).collect()
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, _, _ in docs]
    count = collections.Counter(w for i, ws in tokens if i is None or i % 3 for w in ws)
    n, v = sum(count.values()), len(count)
    want = {}
    for (i, ws), (_, t, _, _) in zip(tokens, docs, strict=True):
        want[(i, t)] = (len(ws), sum(count[w] > 0 for w in ws), sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    assert len(got) == len(docs)
    for r in got:
        a = want[(r.doc_id, r.text)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a[0], a[1], n) and r.base_score == pytest.approx(a[2]) and r.score < 0


def test_ctw_probabilities_sum_to_one_and_match_sequences():
    rng = np.random.default_rng(2)
    contexts, symbols = rng.integers(97, 100, 400), np.append(rng.integers(97, 100, 399), lm_score.END)
    codes, counts = np.unique((contexts << 9) | symbols, return_counts=True)
    deep = lm_score.leaves(codes.astype(np.uint64), counts)
    levels = [lm_score.shorter(deep), deep]
    for context in (97, 98, 120):
        every = np.array([(context << 9) | s for s in range(257)], np.uint64)
        assert (10 ** lm_score.log10_probability(every, levels, 1)).sum() == pytest.approx(1)
    kt = lambda a, b: np.prod([(k + 0.5) for k in range(a)]) * np.prod([(k + 0.5) for k in range(b)]) / np.prod([k + 1.0 for k in range(a + b)])
    assert np.exp(lm_score.log_kt(np.array([3.0]), np.array([2.0])))[0] == pytest.approx(kt(3, 2))


def test_toxicity_finds_disguised_words(spark):
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 3.0, toxicity.fold("clown"): 3.0}, [toxicity.fold("class clown")], (-3.0, 2.0, 1.0))
    for bad in ("you idiot", "you 1d10t", "an іdiot!", "C1OWN"):
        assert lexicon.score(toxicity.fold(bad)) > 0.5, bad
    for good in ("idiotic", "the class clown", "", None):
        assert lexicon.score(toxicity.fold(good)) < 0.5, good


def test_toxicity_exceptions_count_distinct_texts(spark):
    own = lambda k: "w" + "".join("abcdefgh"[int(d)] for d in f"{k:03o}")
    toxic = [f"you grumbo {('head', 'nose', own(k))[(k > 15) + (k > 19)]} {own(k)}" for k in range(30)]
    clean = ["a grumbo head was seen"] * 1000 + [f"the grumbo nose {own(k)}" for k in range(5)] + [f"grumbo cake {own(k)}" for k in range(10)] + [f"the rest {own(k)}" for k in range(400)]
    rows = [(k, t, int(k < 30)) for k, t in enumerate(toxic + clean)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    lexicon = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    # 16 toxic texts against one clean one with copies; 4 of 30 against 5 of 416; none against 10
    assert "grumbo" in lexicon.weights and "grumbo cake" in lexicon.exceptions
    assert not {"grumbo head", "grumbo nose"} & {*lexicon.exceptions}


def test_toxicity_held_out(spark):
    table = toxicity.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    right = table.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).head()[0]
    assert right > 0.9


def _components(sets, num):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, docs, shingle, threshold):
    rng, family = random.Random(5), []
    base = [f"x{k}" for k in range(120)]
    for k in range(60):  # a family of which some are linked and some are not
        words = base.copy()
        for _ in range(k % 6):
            words[rng.randrange(120)] = f"y{rng.random()}"
        family.append((2000 + k, " ".join(words), "en", "s"))
    rows = [r for r in docs + family]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sets = {}
    for i, t, _, _ in rows:
        if i is not None:
            w = WORD.findall((t or "").translate(LOWER))
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    want = _components(sets, round(threshold * 100))
    got = near_dup.find_groups(frame, shingle=shingle, threshold=threshold, keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (100, 101)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 101: 100}
    assert components.components(edges.filter("u < 0")).count() == 0


def test_sharding_law(spark, frame):
    got = sharding.assign(frame, shards=5).join(frame.select("doc_id", "text"), "doc_id").collect()
    slots = collections.defaultdict(set)
    for r in sharding.assign(frame, shards=5).collect():
        slots[r.shard].add(r.slot)
    assert all(s == set(range(len(s))) for s in slots.values())
    home = collections.defaultdict(set)
    for r in got:
        home[r.text or ""].add(r.shard)
        assert r.size == len((r.text or "").encode()) + 16
    assert all(len(s) == 1 for s in home.values())
    assert sharding.longest_first([(5, 0), (4, 1), (3, 2), (3, 3)], 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_quality_counts(spark, frame, docs):
    got = quality.count(frame.drop("n_words").withColumn("k", F.monotonically_increasing_id()))
    for r in got.collect():
        t = r.text or ""
        w, seen, dup = WORD.findall(t), set(), 0
        often = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = [any(often[tuple(w[j : j + 5])] > 1 for j in range(max(0, k - 4), min(k, len(w) - 5) + 1)) for k in range(len(w))] if len(w) < 3000 else [True] * len(w)
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(cover))
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and 0 < kept.count() < len(docs)


def test_quality_keeps_clean_texts_among_junk_copies(spark):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40))
    junk = " ".join(f"{a}{b}c##" for a in "abcdef" for b in "abcdef")  # 0.4 symbols
    lines = "\n".join([prose()] + [" ".join(f"{a}{b}cde" for b in "xyz") for a in "kl" for _ in range(4)])
    assert "##" in junk and lines.count("\n") == 8
    rows = [(k, junk, "en", "symbols") for k in range(90)] + [(100 + k, prose(), "en", "symbols") for k in range(10)]
    rows += [(200 + k, lines, "en", "lines") for k in range(90)] + [(300 + k, prose(), "en", "lines") for k in range(10)]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept >= {*range(100, 110), *range(300, 310)}


def test_substring_dedup(spark, frame, docs):
    words = [(i, WORD.findall(t or "")) for i, t, _, _ in docs]
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, float("inf")), rank(i))
    want = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < rank(i):
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.find_repeats(frame, n=13, keep=["doc_id", "_t"]).collect()
    assert _tally((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == _tally(want)
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed for r in got)


def test_factors_are_a_greedy_parse(spark):
    """With one reference block and long passages the factors are those of a plain greedy parse."""
    rng = random.Random(8)
    own = lambda n: [f"u{rng.random():.12f}" for _ in range(n)]
    base = {k: own(80) for k in range(4)}
    rows = [(k, " ".join(base[k])) for k in base]
    for k in range(10, 30):
        parts = [base[rng.randrange(4)][a : a + rng.randint(5, 40)] for a in (rng.randrange(60) for _ in range(4))]
        rows.append((k, " ".join(w for p in parts for w in (*p, *own(rng.randrange(3))))))
    want = {}
    for k, text in rows:
        words, at, out = text.split(), 0, []
        while at + 13 <= len(words):
            places = [(i, j) for i, t in rows if i < k for j in [next((j for j in range(len(t.split()) - 12) if t.split()[j : j + 13] == words[at : at + 13]), None)] if j is not None]
            if not places:
                at += 1
                continue
            i, j = min(places)
            ref, n = dict(rows)[i].split(), 13
            while at + n < len(words) and j + n < len(ref) and words[at + n] == ref[j + n]:
                n += 1
            out.append((at, n, i))
            at += n
        want[k] = out
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for blocks_, most in ((1, 1000), (7, 1000), (7, 3)):
        got = substring_dedup.find_repeats(frame.coalesce(1), reference_blocks=blocks_, passage_windows=most).collect()
        for r in got:
            f = [tuple(r.factors[i : i + 3]) for i in range(0, len(r.factors), 3)]
            assert all(n >= 13 and ref < r.doc_id for _, n, ref in f)
            words, texts = r.text.split(), dict(rows)
            assert all(" ".join(words[a : a + n]) in texts[ref] for a, n, ref in f)
            if (blocks_, most) == (1, 1000):
                assert set(want[r.doc_id]) <= set(f) and all(n == 13 for a, n, ref in set(f) - set(want[r.doc_id]))


def test_decontamination(spark, frame, docs):
    items = [(1, " ".join(f"w{k}" for k in range(5, 30))), (2, "One TWO"), (3, None), (4, "..."), (5, "absent words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t, _, _ in docs:
        w, hit, found = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    for limit in (1 << 20, 60):  # one pass, several passes
        got = decontaminate.find_hits(frame, bench, n=10, keep=["doc_id", "n_words"], pass_bytes=limit).collect()
        assert _tally((r.doc_id, r._words, r._n_hit, tuple(r._items)) for r in got) == _tally(want)
    cut = decontaminate.decontaminate(frame, bench, n=10)
    assert cut.columns == frame.columns and cut.filter("doc_id = 1005").count() == 0
    assert decontaminate.find_hits(frame, bench.limit(0)).filter("_n_hit > 0").count() == 0


def test_language_id(spark):
    got = language_id.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0] > 0.97


def test_language_id_edges(spark, frame):
    model = language_id.fit(frame)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).filter("doc_id > 1000").collect()}
    assert got[1001] == ("und", 0.0) and got[1002] == ("und", 0.0) and got[1003] == ("und", 0.0) and got[1004][0] != "und"
    empty = language_id.predict(frame, language_id.fit(frame.limit(0)))
    assert empty.filter("lang_pred <> 'und'").count() == 0


def test_short_neighbours_keep_their_own_slice(spark):
    import pyarrow as pa

    for texts in (["", "", "the nine."], ["", "x", "", "the nine.", "", None, "y"], [None, None], []):
        which, counts = language_id.bags(pa.array(texts, pa.string()))
        assert len(which) == len(counts) == len(texts)
    assert language_id.bags(pa.array(["", "", "the nine."]))[0][2] == language_id.bags(pa.array(["the nine."]))[0][0]
    labelled = spark.createDataFrame([(k, t, "en" if k % 2 else "de") for k, t in enumerate(["", "", "a", "", "some words", "und so weiter"])], "doc_id long, text string, lang string").coalesce(1)
    assert language_id.predict(labelled, language_id.fit(labelled)).count() == 6
    bench = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "x"), (5, "one two"), (6, None), (7, ""), (8, "three four")], "item_id long, text string")
    frame = spark.createDataFrame([(1, "so one two"), (2, "three four"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r._n_hit, list(r._items)) for r in decontaminate.find_hits(frame, bench, n=10).collect()}
    assert got == {1: (2, ["5"]), 2: (2, ["8"]), 3: (1, ["4"])}


def test_license_scan(spark):
    rows = [(1, "Released under the MIT License. mit license"), (2, None), (3, "cc\nBY, x"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 3, 5, "mit", "mit,mit-text")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[3].base_labels == "cc-by" and got[4].labels == "gpl,gpl-3.0" and got[5].labels == "isc" and got[5].base_labels == ""


def _plain_matches(templates, query, least):
    """(end, length, template, places) of all matches that are maximal in their template, by trying everything."""
    longest = lambda t, at: max((n for n in range(1, at + 2) if any(t[k : k + n] == query[at - n + 1 : at + 1] for k in range(len(t) - n + 1))), default=0)
    out = set()
    for k, t in enumerate(templates):
        sizes = [longest(t, at) for at in range(len(query))] + [0]
        for at, n in enumerate(sizes[:-1]):
            if n >= least and sizes[at + 1] <= n:
                out.add((at, n, k, tuple(e for e in range(n - 1, len(t)) if t[e - n + 1 : e + 1] == query[at - n + 1 : at + 1])))
    return out


def test_matches_of_each_template():
    rng = random.Random(3)
    for letters in (2, 3, 6):
        texts = [[rng.randrange(letters) for _ in range(rng.randint(3, 25))] for _ in range(4)]
        texts.append(texts[0][1:])  # one inside another
        query = [rng.randrange(letters) for _ in range(80)] + texts[0] + [0]
        automaton = license_scan.SuffixAutomaton(texts)
        query = [t for t in query if t in automaton.next[0]]
        got = {(a, n, k, tuple(places)) for a, n, k, places in automaton.matches(query, 3)}
        assert got == _plain_matches(texts, query, 3)


def test_license_labels_nest(spark):
    rows = [(1, "x a b c d"), (2, "a b c d"), (3, "a b q c d a b c d"), (4, "q a b c")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates={"A": ["x a b c d"], "B": ["a b c d"]}).collect()}
    assert got[1].labels == "A,B" and got[1].score == 1.0 and got[2].labels == "B" and got[3].spans == ["B:5-8"] and got[4].labels == "B" and got[4].score == 0.75
    header = license_scan.TEMPLATES["apache-2.0"][1]
    rows = [(1, header[: header.index("You may obtain")]), (2, "Header:\n" + header + " and more"), (3, license_scan.TEMPLATES["mit-text"][2].upper().replace("COPYRIGHT", "patent")), (4, license_scan.TEMPLATES["bsd"][1])]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "apache,apache-2.0" and got[2].score == 1.0 and got[3].labels == "mit-text" and got[4].labels == "bsd"


def test_license_base_by_brute_force(spark, frame, docs):
    extra = [(3001, "MIT License, cc by; CC-BY. gnu general public license gnu General public LICENSE", "en", "s"), (3002, "the apache license apache license mit", "en", "s")]
    rows = docs + extra
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string, lang string, source string").withColumn("score", F.lit("mine")).withColumn("_n", F.lit(1))
    got = {r.k: r for r in license_scan.scan(table).collect()}
    for k, (_, text, _, _) in enumerate(rows):
        words, places, labels = ALNUM.findall((text or "").translate(LOWER)), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and labels <= set(r.labels.split(",")) | {""} and r._n == 1


def _thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_cancel_in_plain_polynomials_stay_apart(spark):
    import public_tokenizers

    a, b = _thue_morse(1024)
    fill = " ".join(f"f{k}" for k in range(12))
    rows = [(1, f"{a} {fill}"), (2, f"{b} {fill}"), (3, a), (4, b)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(bpe.encode(table, ranks), ranks).collect()} == set(rows)
    assert all(r.n_removed == 0 for r in substring_dedup.find_repeats(table).collect())
    found = {r.doc_id: r.component_id for r in near_dup.find_groups(table, shingle=3, threshold=0.85).collect()}
    assert found[3] == 3 and found[4] == 4
    got = lm_score.score(table.filter("doc_id > 2"), F.col("doc_id") == 3, keep=["doc_id"]).collect()
    assert {r.doc_id: r.n_known for r in got} == {3: 2, 4: 1}
    assert license_scan.scan(table, phrases={a: "A"}, templates={}).filter("n_base > 0").count() == 2


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    import pyarrow as pa

    from veloria.llm import textbytes

    monkeypatch.setattr(textbytes, "hash_spans", lambda buf, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 20))) for _ in range(300)] * 2
    piece = next(textbytes.slices(pa.array([" ".join(words)])))
    starts, ends, _ = piece.words(textbytes.SPACE)
    keys, first, place = textbytes.distinct_spans(piece.buf, starts, ends)
    assert len(keys) == len(set(words)) and [words[first[p]] for p in place] == words


def _grid_quartiles(values):
    at = sorted(((math.ceil(math.log(x) / math.log(quality._GRID)) if x > 0 else None) for x in values), key=lambda b: -math.inf if b is None else b)
    value = lambda b: 0.0 if b is None else 2 * quality._GRID**b / (1 + quality._GRID)
    return [value(at[max(0, math.ceil(q * len(at)) - 1)]) for q in (0.25, 0.75)]


def _plain_quality(rows):
    """The verdict of each row (id, text, lang, source)."""
    shares = []
    for _, t, _, _ in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        often = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = set()
        for i in range(len(w) - 4):
            if often[tuple(w[i : i + 5])] > 1:
                cover.update(range(i, i + 5))
        chars, part = sum(map(len, w)), lambda a, b: a / b if b else 0.0
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        shares.append((failed, {"symbols": part(len(re.findall(r"[#*$%&|<>]", t)), chars), "lines": part(len(lines) - len(set(lines)), len(lines)), "repeats": part(len(cover), len(w)), "length": part(chars, len(w))}))
    limits = {}

    def limit(m, lang, source):
        if (m, lang, source) not in limits:
            for same in (lambda r: r[2:4] == (lang, source), lambda r: r[2] == lang, lambda r: True):
                group = [x[1][m] for x, r in zip(shares, rows, strict=True) if same(r)]
                if len(group) >= quality.LEAST_ROWS:
                    break
            q1, q3 = _grid_quartiles(group)
            reach = quality.REACH * max(q3 - q1, quality.LEAST_SPREAD[m])
            limits[(m, lang, source)] = (q1 - reach if m in quality.TWO_SIDED else -1.0, q3 + reach)
        return limits[(m, lang, source)]

    return [not failed and all(limit(m, *r[2:4])[0] <= own[m] <= limit(m, *r[2:4])[1] for m in own) for (failed, own), r in zip(shares, rows, strict=True)]


def test_quality_verdict_by_brute_force(spark, frame, docs):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    more = [(5000 + k, prose(30) + " #" * rng.choice([0, 0, 0, 1, 9]) + rng.choice(["", "\nx\nx\nx", " abcdefghijklmnopqrstuvwxyz" * 3]), rng.choice(["en", None]), rng.choice(["s", "hot"])) for k in range(240)]
    rows = docs + more
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string, lang string, source string")
    want = {k for k, ok in enumerate(_plain_quality(rows)) if ok}
    assert 0 < len(want) < len(rows)
    assert {r.k for r in quality.keep_good(table).collect()} == want


def _plain_pipeline(rows, items, encoder):
    """What the corpus pipeline leaves of rows (id, text, lang, source), by trying everything."""
    rows = [r for r, ok in zip(rows, _plain_quality(rows), strict=True) if ok]
    sets = {}
    for i, t, _, _ in rows:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = _components({i: s for i, s in sets.items() if i is not None}, 80)
    rows = [r for r in rows if r[0] is None or group[r[0]] == r[0]]
    rank = lambda i: float("inf") if i is None else i
    first, out = {}, []
    for i, t, _, _ in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, float("inf")), rank(i))
    for i, t, *rest in rows:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < rank(i) for j in range(k, k + 13)}
        if len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, *rest))
    windows = set()
    for _, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    rows, out = out, []
    for i, t, *rest in rows:
        places = [m.span() for m in ALNUM.finditer(t.translate(LOWER))]
        w, hit = [t.translate(LOWER)[a:b] for a, b in places], set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        if not hit or len(hit) < len(w):
            cut = set()
            for k in hit:
                cut.update(range(places[k][0], places[k + 1][0] if k + 1 in hit else places[k][1]))
            text = "".join(c for j, c in enumerate(t) if j not in cut)
            ids = encoder.encode_ordinary(text)
            out.append((i, text, *rest, len(ids), np.array(ids, "<u4").tobytes()))
    return out


def test_pipeline_by_brute_force(spark, docs, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    rng = random.Random(12)
    prose = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(3000)}" for _ in range(n)]
    rows = [r for r in docs]
    shared, leak = prose(60), prose(30)
    for k in range(60):
        base = prose(80)
        rows.append((6000 + 10 * k, " ".join(base), "en", "s"))
        near = list(base)
        near[rng.randrange(80)] = "changed"
        rows += [(6001 + 10 * k, " ".join(near), "en", "s")] if k % 3 == 0 else []
        rows += [(6002 + 10 * k, " ".join(base[:20] + shared + prose(25)), "en", "s")] if k % 3 == 1 else []
        rows += [(6003 + 10 * k, " ".join(prose(20) + leak[5:25] + prose(25)) + ".", "en", "s")] if k % 3 == 2 else []
    rows += [(8000, " ".join(leak), "en", "s"), (8001, " ".join(shared), "en", "s"), (8002, " ".join(shared), "en", "s")]
    items = [(1, " ".join(leak)), (2, None), (3, "only three words")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = _plain_pipeline(rows, items, encoder)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 60 < len(want) < len(rows)
    assert _tally((r.doc_id, r.text, r.lang, r.source, r.n_tokens, bytes(r.ids)) for r in got) == _tally(want)


def _plain_ctw(train, depth):
    """log10 probability of a text under a context tree of recursive definition."""
    counts = collections.defaultdict(lambda: [0, 0])

    def places(text):
        symbols = [*(text or "").translate(LOWER).encode(), lm_score.END]
        for i, symbol in enumerate(symbols):
            context = tuple(symbols[i - d - 1] if i > d else lm_score.PAD for d in range(depth))
            for j in range(lm_score.STEPS):
                if j == 0 or symbol != lm_score.END:
                    yield context, (1 << j) | (symbol >> (lm_score.STEPS - j)), (symbol >> (lm_score.STEPS - 1 - j)) & 1

    for text in train:
        for context, node, bit in places(text):
            for d in range(depth + 1):
                counts[(context[:d], node)][bit] += 1
    children = collections.defaultdict(list)
    for context, node in counts:
        if context:
            children[(context[:-1], node)].append((context, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def evidence(key):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            return own, 1.0
        below = sum(evidence(c)[0] for c in children[key])
        return np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own)))

    def score(text):
        total = 0.0
        for context, node, bit in places(text):
            p, below = 0.5, False
            for d in range(depth, -1, -1):
                key = (context[:d], node)
                if key in counts:
                    own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                    weight = evidence(key)[1]
                    p, below = (weight * own + (1 - weight) * p if below else own), True
            total += math.log10(p)
        return total

    return score


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_lm_mixture_by_brute_force(spark, depth):
    rng = random.Random(depth)
    texts = ["".join(rng.choices("abA é", k=rng.randint(0, 25))) for _ in range(12)] + [None, "", "abab" * 8]
    rows = [(k, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("mine", F.lit(3)).repartition(3)
    score = _plain_ctw([t for k, t in rows if k % 3], depth)
    got = lm_score.score(table, F.col("doc_id") % 3 != 0, depth=depth).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(score(r.text), rel=1e-5, abs=1e-5) and r.mine == 3


def test_lexicon_matches_by_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        words = {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(4)}
        phrases = {f"{rng.choice(sorted(words))} {''.join(rng.choices('ab', k=2))}" for _ in range(2)}
        text = "".join(rng.choices("ab  .", k=rng.randint(0, 60)))
        lexicon = toxicity.Lexicon({w: 1.0 for w in words}, phrases)
        whole = lambda x: [m.span(1) for m in re.finditer(rf"(?<![a-z])(?=({re.escape(x)})(?![a-z]))", text)]
        excepted = [x for p in phrases for x in whole(p)]
        want = {(a, b, w) for w in words for a, b in whole(w) if not any(x <= a and b <= y for x, y in excepted)}
        assert set(lexicon.matches(text)) == want


def test_toxicity_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "grumbo " * 50000, "x"), (4, "ok " + "v" * 100, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("predicted", F.lit("mine"))
    one = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, one)).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and all(r.score < 1e-12 and r.predicted == 0 for r in got)
    assert all(r.score > 1 - 1e-12 for r in toxicity.score(docs, toxicity.fit(docs, one.withColumn("toxic", F.lit(1)))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, one.limit(0))).count() == 0
    long = "z" * 100  # long words are learnt too
    texts = [(k, f"you {long} {'abcdefgh'[k % 8]}{k}x") for k in range(30)] + [(100 + k, f"fine day {'abcdefgh'[k % 8]}") for k in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    lexicon = toxicity.fit(table, table.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic")))
    assert long in lexicon.weights


def test_language_forward_pass_by_brute_force(spark):
    texts = ["Hello, World 12!", "", None, "héé à", "...", "ab", "x", "中文 字", "a" * 5000]
    rng = np.random.default_rng(3)
    model = language_id.Model(["aa", "bb", "cc"], rng.normal(0, 3, (language_id.BUCKETS, 3)).astype(np.float32), np.array([0.1, 0.0, -0.1]), 0.7, 0.6)
    got = language_id.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("mine")), model).collect()
    for r in got:
        b = [x if 97 <= x < 123 or x >= 128 else x + 32 if 65 <= x < 91 else 32 for x in (r.text or "").encode()]
        keys = []
        for n in (2, 3, 4):
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                if g[0] == 32 and g[1] == 32:
                    continue
                h = 0
                for x in g:
                    h = (h * 257 + x) % 2**32
                h = (h * 0x9E3779B1 + n) % 2**32
                h ^= h >> 15
                keys.append((h * 0x85EBCA77 % 2**32) >> 17)
        z = (model.table[keys].astype(float).sum(axis=0) / max(1, len(keys)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), rel=1e-4) and r.rejected == (r.score < 0.6)
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


def test_every_language_is_learnt(spark):
    rows = [(k * 10 + j, f"{a}{b}{a} {b}{a}{b} {a}{a}", f"l{a}{b}") for k, (a, b) in enumerate(itertools.product("abcdefghijklmnopqrstuvw", repeat=2)) for j in range(2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), epochs=1)
    assert len(model.languages) == 23 * 23 > 400


def test_sharding_digests_and_balance(spark):
    rows = [(k, f"text {k % 400} " * (1 + k % 37)) for k in range(3000)] + [(None, "hot")] * 500 + [(7, None), (8, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("mine")).repartition(5)
    got = sharding.assign(table, shards=8).collect()
    crc = collections.Counter((r.doc_id, r.text_crc32, r["size"]) for r in got)
    assert crc == collections.Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    loads, groups = collections.Counter(), collections.Counter()
    for r in got:
        loads[r.shard] += r["size"]
        groups[(r.text_crc32, r["size"])] += r["size"]
    assert len(loads) == 8 and max(loads.values()) <= sum(loads.values()) / 8 + max(groups.values())


def test_equal_rows_and_clashing_columns(spark):
    """Repeated rows stay, made columns replace their namesakes, all other columns come through."""
    import public_tokenizers

    rows = [(1, "the mit license here", "a"), (1, "the mit license here", "a"), (2, None, None), (3, "", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    for name in ("n_tokens", "ids", "n_words", "n_base", "labels", "score", "spans", "_words", "_hits", "_items", "lang_pred", "n_removed", "kept_text", "factors", "kept", "component_id", "_train", "_n", "_t", "_text", "u", "v"):
        table = table.withColumn(name, F.lit("mine"))
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = {
        "bpe": (bpe.encode(table, ranks), {"n_tokens", "ids"}),
        "lm": (lm_score.score(table, F.lit(True), depth=2), {"n_tokens", "score", "n_known", "train_tokens", "base_score", "n_bytes", "bits_per_byte"}),
        "near": (near_dup.find_groups(table), {"n_shingles", "component_id", "kept"}),
        "repeats": (substring_dedup.find_repeats(table), {"n_words", "n_removed", "spans", "factors", "kept_text"}),
        "hits": (decontaminate.find_hits(table, spark.createDataFrame([(1, "mit license")], "item_id long, text string")), {"_words", "_n_hit", "_hits", "_items"}),
        "lang": (language_id.predict(table, language_id.fit(table.withColumn("lang", F.lit("en")))), {"lang_pred", "score", "rejected"}),
        "licence": (license_scan.scan(table), set(license_scan.SCHEMA.names)),
        "quality": (quality.count(table), {*quality.COUNTS, "n_lines"}),
    }
    for name, (df, replaced) in made.items():
        got = df.collect()
        assert len(got) == 4, name
        assert set(table.columns) - replaced <= set(df.columns), name
        for r in got:
            assert all(r[c] == "mine" for c in table.columns if c not in replaced and c not in ("doc_id", "text", "_id")), name
        assert _tally((r.doc_id, r.text, r._id) for r in got) == _tally(rows), name
    assert near_dup.representatives(table).columns == table.columns and near_dup.representatives(table).count() == 4
    assert quality.keep_good(table.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))).count() == 0


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns: every stage keeps its input's columns; the last one's result decodes."""
    import corpus_pipeline

    good = " ".join(f"word{k} and{k % 7}" for k in range(40))
    rows = [(1, good, "en", "s", 0), (1, good, "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (None, good.replace("word", "Word"), "en", "s", 0), (4, good + " more", "en", None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine")).withColumn("_id", F.lit("mine"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (table, table.limit(0)):
            done = stage(spark, docs, SF)
            if k < 4:
                assert done.columns == docs.columns
            else:
                assert {r.text for r in done.collect()} <= {r[1] or "" for r in rows}
            assert done.count() <= docs.count()


@pytest.mark.parametrize("name", ["op4_near_dup", "op6_quality", "op7_substring_dedup", "op8_decontamination"])
def test_sql_twins(spark, name):
    import duckdb

    from veloria.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    order = [[c[0] for c in result.description].index(c) for c in columns]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert _tally(tuple(r[c] for c in columns) for r in df.collect()) == _tally(tuple(r[i] for i in order) for r in result.fetchall())


def test_empty_tables(spark, frame):
    none = frame.limit(0)
    assert substring_dedup.find_repeats(none).count() == 0
    assert near_dup.find_groups(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert quality.keep_good(none).count() == 0
    assert bpe.encode(none, {b"a": 0}).count() == 0
    assert lm_score.score(none, F.lit(True)).count() == 0
    assert license_scan.scan(none).count() == 0
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontaminate.find_hits(none, bench).count() == 0 and decontaminate.decontaminate(none, bench.limit(0)).count() == 0
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    assert near_dup.representatives(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        assert 0 < docs.count() <= before.count()
    joined = docs.join(before.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert joined.filter("text <> was").count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
