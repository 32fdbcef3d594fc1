"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is the text of all documents with a smaller id.
It is cut into reference blocks by content, and a document is parsed against
those blocks only that can hold something of it:

1. Each block of documents lists its anchors, the smallest 5-gram hash of
   every n-word window.  A window that two documents share has the same
   anchor in both, so a window whose anchor occurs in one document only
   cannot be repeated, and is settled here (this is exact).
2. The windows left make passages: runs of consecutive windows whose anchors
   fall into one reference block.  Each distinct passage of a block of
   documents goes, as text, to its reference block once, with the places where
   it occurs.
3. A reference block joins its passages into the reference text and indexes
   every window's occurrence in the smallest document.  Each passage is then
   parsed greedily: from the first word that begins an indexed window of a
   smaller document, the factor runs on for as long as passage and reference
   text have the same words; the next factor is sought behind it.  Windows
   that straddle the end of a factor are checked one by one, since greedy
   parsing skips them.  Words and windows are compared as bytes, not as
   hashes.  A passage that a smaller document of the same block has is one
   factor.
4. A document meets its factors, each of n words at least (place, length and
   the reference's document), and the words that they cover go.

Every word inside an n-word window that also starts in a document with a
smaller id is thus covered, and no other word.  Windows are judged on the
input texts.

Defined results: null and empty texts have no words; texts under n words
are kept whole; repeated rows with the same id do not remove each other (an
id is not smaller than itself), equal texts with different ids do; a null id
counts as larger than all others; an empty table gives an empty table; ids
are whole numbers; other columns are carried along, but one called n_words,
n_removed, spans, factors or kept_text is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloria.llm import arrowmap, blocks
from veloria.llm.textbytes import SPACE, Slice, covered, distinct_spans, hash_spans, mix, ngram_hashes, slices

#: Words of an anchor.
ANCHOR_WORDS = 5
#: Windows of a passage, at most; a longer run makes several.
PASSAGE_WINDOWS = 64
_LAST = np.iinfo(np.int64).max
#: Bits of an anchor's hash that are compared; equal ones only cost a closer look.
_ANCHOR_SHIFT = np.uint64(20)


def _words(piece: Slice):
    starts, ends, doc = piece.words(SPACE)
    return starts, ends, doc, hash_spans(piece.buf, starts, ends)


def _anchors(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each n-word window, and the windows' first words."""
    k = min(ANCHOR_WORDS, n)
    grams = ngram_hashes(words, k)
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = grams[:m].copy()
    for j in range(1, n - k + 1):
        np.minimum(low, grams[j : j + m], out=low)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return (mix(low[at]) >> _ANCHOR_SHIFT) << _ANCHOR_SHIFT, at


def _ids(table: pa.Table, key: str) -> np.ndarray:
    return np.array(pc.fill_null(table.column(key).cast(pa.int64()), _LAST), np.int64)


def _block_anchors(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block, sorted, and whether two of its documents have each."""
    codes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in slices(texts):
        _, _, doc, words = _words(piece)
        code, at = _anchors(words, doc, n)
        if len(at):
            own = doc[at]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])])
            codes.append(code[new])
            docs.append(own[new] + piece.first)
    code, doc = np.concatenate(codes), np.concatenate(docs)
    order = np.lexsort((doc, code))
    code, doc = code[order], doc[order]
    first = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
    other = np.concatenate([[False], (code[1:] == code[:-1]) & (doc[1:] != doc[:-1])])[: len(code)]
    starts = np.flatnonzero(first)
    return code[starts], (np.add.reduceat(other.astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool))


def _passages(code: np.ndarray, at: np.ndarray, doc: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the passages that the windows ``at`` make, and their numbers of windows."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(place % most == 0)
    return first, np.diff(np.append(first, len(at)))


class Reference:
    """The joined text of passages, each of a document ``low``, indexed by its n-word windows."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, low: np.ndarray, n: int):
        starts, ends, self.owner = Slice(0, buf, offsets).words(SPACE)
        self.n, self.low = n, low
        self.word = distinct_spans(buf, starts, ends)[2].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        self.stop = np.cumsum(np.bincount(self.owner, minlength=len(low)))  # past-the-end word of each passage
        m = max(0, len(self.word) - n + 1)
        self.at = np.flatnonzero(self.owner[:m] == self.owner[len(self.word) - m :]) if m else np.zeros(0, np.int64)
        self.first = self._index()

    def _index(self) -> np.ndarray:
        """For each word that begins a window, the window's first place in the document with the smallest id; else -1."""
        h, low = ngram_hashes(mix(self.word.astype(np.uint64) + np.uint64(1)), self.n)[self.at], self.low[self.owner[self.at]]
        rank = np.empty(len(self.low), np.int64)
        rank[np.argsort(self.low, kind="stable")] = np.arange(len(self.low))
        rank = rank[self.owner[self.at]]
        first = np.full(len(self.word), -1, np.int64)
        while len(h):
            order = np.lexsort((self.at, rank, h))
            begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            least = np.repeat(self.at[order[begin]], np.diff(np.append(begin, len(order))))
            first[self.at[order]] = least
            differ = np.zeros(len(order), bool)
            for j in range(self.n):
                differ |= self.word[self.at[order] + j] != self.word[least + j]
            if not differ.any():
                break
            h[order[differ]] = mix(h[order[differ]] + np.uint64(0x9E3779B97F4A7C15))  # another window with the same hash
        return first

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passage, first word, number of words and reference document of each factor, against documents smaller than the passage's own."""
        n, total = self.n, len(self.word)
        usable = np.zeros(total + 1, bool)
        usable[self.at] = self.low[self.owner[self.first[self.at]]] < self.low[self.owner[self.at]]
        following = np.where(usable, np.arange(total + 1), total)
        following = np.minimum.accumulate(following[::-1])[::-1]
        passage = np.arange(len(self.low))
        at = self.stop - np.bincount(self.owner, minlength=len(self.low))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(passage):
            at = following[np.minimum(at, total)]
            inside = at < self.stop[passage]
            passage, at = passage[inside], at[inside]
            if not len(passage):
                break
            length, ref = np.full(len(at), n), self.first[at]
            going = np.arange(len(at))
            room = np.minimum(self.stop[passage] - at, self.stop[self.owner[ref]] - ref)
            while len(going):  # a factor runs on word by word
                going = going[length[going] < room[going]]
                going = going[self.word[at[going] + length[going]] == self.word[ref[going] + length[going]]]
                length[going] += 1
            out.append((passage, at, length))
            for back in range(1, n):  # windows that straddle the factor's end
                over = at + length - back
                fits = (over > at) & usable[np.minimum(over, total)]
                fits &= over < self.stop[passage]
                out.append((passage[fits], over[fits], np.full(int(fits.sum()), n)))
            at = at + length
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        passage, at, length = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(at, kind="stable")
        return passage[order], at[order], length[order], self.low[self.owner[self.first[at[order]]]]


def find_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 13, keep: list[str] | None = None, reference_blocks: int | None = None, passage_windows: int = PASSAGE_WINDOWS) -> DataFrame:
    """docs with n_words, n_removed, spans (first and past-the-end words, in turn), factors (first word, words and reference id, in turn) and kept_text (the other words, joined by spaces)."""
    keep = keep if keep is not None else docs.columns
    docs = blocks.steady(docs.select(*dict.fromkeys([*keep, key, text])))
    buckets = reference_blocks or blocks.bucket_count(docs)

    def ask_anchors(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        code, twice = _block_anchors(table.column(text), n)
        bounds = blocks.bucket_bounds(code, buckets)
        for b in range(buckets):
            own = slice(bounds[b], bounds[b + 1])
            if own.start < own.stop:
                yield b, blocks.frame(blocks.pack_rising(code[own] >> _ANCHOR_SHIFT), np.packbits(twice[own]).tobytes())

    def answer_anchors(bucket: int, lists: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        seen: list[tuple[int, np.ndarray]] = []
        every, shared = [], [np.zeros(0, np.uint64)]
        for block, payload in lists:
            code, twice = blocks.unframe(payload)
            code = blocks.unpack_rising(code)
            seen.append((block, code))
            every.append(code)
            shared.append(code[np.unpackbits(np.frombuffer(twice, np.uint8), count=len(code)).astype(bool)])
        whole = np.sort(np.concatenate(every))
        shared.append(whole[1:][whole[1:] == whole[:-1]])
        known = np.unique(np.concatenate(shared))
        for block, code in seen:
            yield block, np.packbits(np.isin(code, known, assume_unique=True)).tobytes()

    def prepare(table: pa.Table) -> bytes:
        return blocks.pack_text(table, text)

    def list_passages(block: int, own: pa.Table, payload: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
        texts, ids = blocks.unpack_text(payload), _ids(own, key)
        code, _ = _block_anchors(texts, n)
        bounds = blocks.bucket_bounds(code, buckets)
        flags = [np.unpackbits(np.frombuffer(p, np.uint8), count=int(bounds[b + 1] - bounds[b])) for b, p in answers]
        shared = code[np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)]
        rows: list[tuple[int, int, bytes]] = []
        if len(shared):
            bufs, spans, done, placed = [], [], 0, 0
            edges = blocks.bucket_bounds(shared, buckets)[1:-1]
            for piece in slices(texts):
                starts, ends, doc, words = _words(piece)
                anchor, at = _anchors(words, doc, n)
                if len(at):
                    slot = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
                    known = shared[slot] == anchor
                    at, slot = at[known], slot[known]
                if len(at):
                    bucket = np.searchsorted(edges, slot, "right")
                    first, count = _passages(anchor, at, doc[at], bucket, passage_windows)
                    begin = at[first]
                    spans.append(np.stack([starts[begin] + placed, ends[begin + count + n - 2] + placed, begin + done, count + n - 1, bucket[first], ids[doc[begin] + piece.first]]))
                bufs.append(piece.buf)
                placed += len(piece.buf)
                done += len(words)
            if spans:
                a, b, word, size, bucket, owner = np.concatenate(spans, axis=1)
                buf = np.concatenate(bufs)
                _, first, place = distinct_spans(buf, a, b)
                order = np.lexsort((word, owner, place))  # by passage, its smallest document first
                begin = np.searchsorted(place[order], np.arange(len(first)))
                count, low = np.diff(np.append(begin, len(order))), owner[order[begin]]
                by = np.lexsort((first, bucket[first]))  # passages by reference block, then in the order of the texts
                bounds = np.searchsorted(bucket[first][by], np.arange(buckets + 1))
                raw = buf.tobytes()
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = by[bounds[k] : bounds[k + 1]]
                    at = order[np.repeat(begin[mine] - np.cumsum(count[mine]) + count[mine], count[mine]) + np.arange(count[mine].sum())]
                    texts_ = [raw[x:y] for x, y in zip(a[first[mine]].tolist(), b[first[mine]].tolist(), strict=True)]
                    later = owner[at] > np.repeat(low[mine], count[mine])
                    rows.append((block, k, blocks.frame(blocks.pack(np.array([len(t) for t in texts_], np.uint32)), blocks.pack(b"".join(texts_), 3), blocks.pack_planes(low[mine]), blocks.pack_planes(count[mine].astype(np.uint32)), blocks.pack_planes(word[at].astype(np.uint32)), blocks.pack_planes(size[first[mine]].astype(np.uint32)), np.packbits(later).tobytes())))
        return pa.Table.from_batches([blocks._rows(rows)])

    def answer_passages(bucket: int, lists: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [(block, blocks.unframe(payload)) for block, payload in lists]
        lengths = [blocks.unpack(p[0], np.uint32).astype(np.int64) for _, p in parts]
        low = np.concatenate([blocks.unpack_planes(p[2], np.int64) for _, p in parts])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        reference = Reference(np.concatenate([blocks.unpack(p[1]) for _, p in parts]), offsets, low, n)
        passage, at, length, source = reference.parse()
        at = at - (reference.stop - np.bincount(reference.owner, minlength=len(low)))[passage]
        order = np.argsort(passage, kind="stable")
        passage, at, length, source = passage[order], at[order], length[order], source[order]
        del reference
        done = 0
        for (block, p), sizes in zip(parts, lengths, strict=True):
            count, word = blocks.unpack_planes(p[3], np.uint32).astype(np.int64), blocks.unpack_planes(p[4], np.uint32).astype(np.int64)
            size, later = blocks.unpack_planes(p[5], np.uint32).astype(np.int64), np.unpackbits(np.frombuffer(p[6], np.uint8), count=len(word)).astype(bool)
            which = np.repeat(np.arange(len(sizes)), count)  # each occurrence's passage
            a, b = np.searchsorted(passage, [done, done + len(sizes)])
            per = np.bincount(passage[a:b] - done, minlength=len(sizes))
            begin = a + np.cumsum(per) - per
            plain = np.flatnonzero(~later & (per[which] > 0))  # occurrences in the passage's smallest document
            many = per[which[plain]]
            pick = np.repeat(begin[which[plain]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            starts = np.concatenate([np.repeat(word[plain], many) + at[pick], word[later]])
            if len(starts):
                yield block, blocks.frame(blocks.pack_planes(starts.astype(np.uint32)), blocks.pack_planes(np.concatenate([length[pick], size[which[later]]]).astype(np.uint32)), blocks.pack_planes(np.concatenate([source[pick], low[done : done + len(sizes)][which[later]]])))
            done += len(sizes)

    def conclude(payload: bytes, answers: list[tuple[int, bytes]], own: pa.Table) -> dict[str, pa.Array]:
        texts = blocks.unpack_text(payload)
        parts = [blocks.unframe(p) for p in blocks.joined(answers)]
        first, length, source = (np.concatenate([np.zeros(0, np.int64), *(blocks.unpack_planes(p[k], kind).astype(np.int64) for p in parts)]) for k, kind in enumerate((np.uint32, np.uint32, np.int64)))
        order = np.lexsort((length, first))
        first, length, source = first[order], length[order], source[order]
        n_words, n_removed, spans, factors, kept, done = [], [], [], [], [], 0
        for piece in slices(texts):
            starts, ends, doc = piece.words(SPACE)
            a, b = np.searchsorted(first, [done, done + len(starts)])
            at = first[a:b] - done
            gone = covered(at, length[a:b], len(starts))
            per = np.bincount(doc, minlength=len(piece))
            stop = np.cumsum(per)
            removed = np.bincount(doc[gone], minlength=len(piece))
            n_words.append(per)
            n_removed.append(removed)
            raw = piece.buf.tobytes()
            for k in range(len(piece)):
                x, y = stop[k] - per[k], stop[k]
                mine = gone[x:y]
                spans.append(np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist() if removed[k] else [])
                i, j = np.searchsorted(at, [x, y]) if removed[k] else (0, 0)
                factors.append(np.stack([at[i:j] - x, length[a + i : a + j], source[a + i : a + j]], axis=1).reshape(-1).tolist())
                left = np.flatnonzero(~mine) + x
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]).decode("utf-8"))
            done += len(starts)
        whole = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
        again = {text: blocks.original_text(payload)} if text in keep else {}
        return again | {"n_words": whole(n_words), "n_removed": whole(n_removed), "spans": pa.array(spans, pa.list_(pa.int64())), "factors": pa.array(factors, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.string())}

    anchors = blocks.resolve(blocks.ask(docs, text, [], ask_anchors), answer_anchors)
    passages = blocks.meet(docs, text, [key], anchors, prepare, list_passages, blocks._ASKED)
    found = blocks.resolve(passages, answer_passages)
    made = arrowmap.schema("n_words long, n_removed long, spans array<long>, factors array<long>, kept_text string")
    names = [c for c in keep if c not in made.names]
    if text in names:  # it comes back from what the parse has read, and is not sent twice
        made = T.StructType([T.StructField(text, T.StringType()), *made])
    done = blocks.finish(docs, text, keep, found, prepare, conclude, made)
    return done.select(*names, *(c for c in done.columns if c not in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: repeated words of every document, in 13-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_repeats(docs, n=13, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
