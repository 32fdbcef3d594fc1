"""Byte-level BPE encoding and decoding through a global distinct-word table.

Texts are split into pre-tokens; each block of documents lists its distinct
pre-tokens, which are shuffled by hash; each distinct pre-token is encoded
once for the whole corpus; the ids come back to the blocks, where they are
put together by the pre-tokens' positions.  Decoding joins each id with the
table of token bytes, which is as large as the vocabulary and no larger.

The pre-token pattern is the one of the public byte-level vocabularies
(contractions; letters, digits or other signs, each with one space before;
white space).  It is evaluated on whole arrays of code points.

Defined results: a null text is encoded as an empty one (no ids); repeated
rows are encoded one by one; ids are a binary column of little-endian
unsigned 32-bit integers; other columns are carried along, and a column
called n_tokens, ids or decoded is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloria.llm import arrowmap, blocks
from veloria.llm.textbytes import Slice, distinct_spans, slices

# Code points with the White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Code points that are classed at once.
CODES = 1 << 12


@cache
def classes() -> np.ndarray:
    """The class of each code point, made a part at a time: a worker's memory stays near that of the table."""
    table = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, "L"), (DIGIT, "N")):
        pattern = regex.compile(rf"\p{{{name}}}+")
        for low in range(0, len(table), CODES):
            part = np.arange(low, low + CODES, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for m in pattern.finditer(part):
                table[low + m.start() : low + m.end()] = kind
    table[WHITE_SPACE] = SPACE
    return table


def pretokens(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of a slice, and the number of them in each document."""
    n_docs = len(piece)
    if not len(piece.buf):
        return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    at = np.flatnonzero((piece.buf & 0xC0) != 0x80)
    code = np.frombuffer(piece.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    n = len(code)
    first = np.zeros(n + 1, bool)  # of a document, in code points
    first[np.searchsorted(at, piece.offsets)] = True
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    ends = np.empty(n, bool)  # last code point of its run
    ends[:-1], ends[-1] = run[1:], True
    blank = kind == SPACE
    start = run.copy()
    # A word takes one plain space before it; other last spaces stand alone.
    last_blank = np.flatnonzero(blank & ends & ~first[1:])
    start[last_blank] = True
    plain = last_blank[code[last_blank] == 0x20]
    start[plain + 1] = False
    # Contractions: a lone apostrophe that begins a pre-token, then certain letters.
    quote = np.flatnonzero((code == 0x27) & run & ends & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one, two = code[quote + 1], np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < n]] = True
    begins = at[start]
    return begins, np.diff(np.searchsorted(begins, piece.offsets))


def _block_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, the bounds of its pre-tokens, and the number of them in each document."""
    bufs, begins, counts, done = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for piece in slices(column):
        own, per = pretokens(piece)
        bufs.append(piece.buf)
        begins.append(own + done)
        counts.append(per)
        done += len(piece.buf)
    starts = np.concatenate(begins)
    return np.concatenate(bufs), starts, np.append(starts[1:], done)[: len(starts)], np.concatenate(counts)


_encoders: dict[int, tuple[dict, object]] = {}


def _encoder(ranks: dict[bytes, int]):
    """The library's encoder of single pre-tokens; a worker keeps the one that it used last."""
    import public_tokenizers
    import tiktoken

    if id(ranks) not in _encoders:
        _encoders.clear()
        _encoders[id(ranks)] = ranks, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return _encoders[id(ranks)][1]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file; read where the query is planned, then sent along."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def encode(docs: DataFrame, ranks: dict[bytes, int], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens and ids."""
    keep = keep if keep is not None else docs.columns
    docs = blocks.steady(docs.select(*dict.fromkeys([*keep, text])))
    sc, buckets = docs.sparkSession.sparkContext, blocks.bucket_count(docs)
    shared = sc.broadcast(ranks)  # bounded: one vocabulary

    def extract(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        buf, starts, ends, _ = _block_words(table.column(text))
        distinct, first, place = distinct_spans(buf, starts, ends)
        del place
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        bounds = blocks.bucket_bounds(distinct, buckets)
        for bucket in range(buckets):
            if own := words[bounds[bucket] : bounds[bucket + 1]]:
                yield bucket, blocks.frame(blocks.pack(np.array([len(w) for w in own], np.uint32)), blocks.pack(b"".join(own)))

    def answer(bucket: int, lists: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        encoder = _encoder(shared.value)
        known: dict[bytes, list[int]] = {}
        for block, payload in lists:
            lengths, data = blocks.unframe(payload)
            ends = np.cumsum(blocks.unpack(lengths, np.uint32), dtype=np.int64)
            data, a, own = blocks.unpack(data).tobytes(), 0, []
            for b in ends.tolist():
                word = data[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encoder.encode_single_piece(word)
                own.append(ids)
                a = b
            yield block, blocks.frame(blocks.pack_planes(np.array([len(i) for i in own], np.uint32)), blocks.pack_planes(np.array([x for i in own for x in i], np.uint32)))

    def prepare(table: pa.Table) -> bytes:
        buf, starts, ends, counts = _block_words(table.column(text))
        place = distinct_spans(buf, starts, ends)[2]
        return blocks.frame(counts.astype(np.int64).tobytes(), blocks.pack_planes(place.astype(np.uint32)))

    def conclude(payload: bytes, answers: list[tuple[int, bytes]], own: pa.Table) -> dict[str, pa.Array]:
        counts, places = blocks.unframe(payload)
        counts, places = np.frombuffer(counts, np.int64), blocks.unpack_planes(places, np.uint32)
        parts = [blocks.unframe(p) for p in blocks.joined(answers)]
        length = np.concatenate([np.zeros(0, np.int64), *(blocks.unpack_planes(p[0], np.uint32) for p in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(blocks.unpack_planes(p[1], np.uint32) for p in parts)])
        if len(places) and places.max() >= len(length):
            raise RuntimeError("a block's words have no ids; write the source to a table first")
        begin = np.cumsum(length) - length
        ids, n_tokens, done = [], [], 0
        for size in counts.tolist():
            own = places[done : done + size]
            done += size
            long = length[own]
            stop = np.cumsum(long)
            total = int(stop[-1]) if size else 0
            index = np.repeat(begin[own] - (stop - long), long) + np.arange(total)
            ids.append(flat[index].astype("<u4").tobytes())
            n_tokens.append(total)
        return {"n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids, pa.binary())}

    answers = blocks.resolve(blocks.ask(docs, text, [], extract), answer)
    return blocks.finish(docs, text, keep, answers, prepare, conclude, arrowmap.schema("n_tokens long, ids binary"))


def decode(docs: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """docs with the bytes that their ids stand for, as ``decoded``."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded: one vocabulary

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        token = shared.value.__getitem__
        return {"decoded": pa.array([b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in cols[ids]], pa.binary())}

    return arrowmap.append(docs, [ids], [c for c in (keep if keep is not None else docs.columns)], arrowmap.schema("decoded binary"), make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, ranks, keep=["doc_id"]), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
