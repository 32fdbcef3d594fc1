"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 buffers of an Arrow string column, a bounded
slice of documents at a time, so that no Python string is made for a word.
A null text has no bytes.  Words of two neighbouring documents never touch,
because a document's first byte always opens a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64


def separator_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table that is True for bytes that separate words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = separator_table([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NON_ALNUM = separator_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection with good avalanche."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Masks of the lowest 0 to 8 bytes of a 64-bit word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Spans that are worked on at once.
_SPANS = 1 << 17
_PLACE = _U(0x9E3779B97F4A7C15)
_SEED = _U(0xA3D1F6B87C2E945B)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def _further(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of more than 8 bytes, and the owner, number and place of each of their eights but the first."""
    long = np.flatnonzero(ends - starts > 8)
    count = (ends[long] - starts[long] - 1) // 8
    owner = np.repeat(np.arange(len(long)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1
    return long, owner, number, starts[long][owner] + 8 * number


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span.

    Eight bytes at a time go through a bijection that differs from place to
    place, so that no two fixed strings cancel whatever surrounds them.
    Equal hashes are not taken for equal bytes where a result depends on it:
    see ``distinct_spans``.
    """
    if len(starts) > _SPANS:
        return np.concatenate([hash_spans(buf, starts[k : k + _SPANS], ends[k : k + _SPANS]) for k in range(0, len(starts), _SPANS)])
    if not len(starts):
        return np.zeros(0, _U)
    eights, size = _eights(buf), ends - starts
    total = mix((eights[starts] & _MASK[np.minimum(size, 8)]) ^ _SEED)
    long, owner, number, at = _further(starts, ends)
    if len(long):
        parts = eights[at] & _MASK[np.minimum(ends[long][owner] - at, 8)]
        total[long] += np.add.reduceat(mix(parts ^ mix(number.astype(_U) * _PLACE + _SEED)), np.flatnonzero(number == 1))
    return mix(total + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span numbered ``other``."""
    eights, same = _eights(buf), np.zeros(len(starts), bool)
    for k in range(0, len(starts), _SPANS):
        a, b, o = starts[k : k + _SPANS], ends[k : k + _SPANS], other[k : k + _SPANS]
        size, begin = b - a, starts[o]
        mask = _MASK[np.minimum(size, 8)]
        own = (size == ends[o] - begin) & (eights[a] & mask == eights[begin] & mask)
        check = np.flatnonzero(own & (size > 8) & (begin != a))
        if len(check):
            _, owner, number, at = _further(a[check], b[check])
            mask = _MASK[np.minimum(b[check][owner] - at, 8)]
            differ = (eights[at] & mask) != (eights[begin[check][owner] + 8 * number] & mask)
            own[check[owner[differ]]] = False
        same[k : k + _SPANS] = own
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct byte strings, each one's first span, and each span's key.

    Spans share a key if and only if their bytes are equal: keys are hashes,
    and spans that differ from the first of their hash get another.  Many
    spans are first reduced to the distinct ones of each ``_SPANS``, so that
    what is sorted at once does not grow with the block.
    """
    if len(starts) > _SPANS:
        firsts, places, done = [], [], 0
        for k in range(0, len(starts), _SPANS):
            a, b = starts[k : k + _SPANS], ends[k : k + _SPANS]
            low = a.min()
            _, first, place = _distinct(buf[low : b.max()], a - low, b - low)
            firsts.append(first + k)
            places.append((place + done).astype(np.uint32))
            done += len(first)
        reps = np.concatenate(firsts)
        keys, first, place = _distinct(buf, starts[reps], ends[reps])
        out = np.empty(len(starts), np.intp)
        for k, own in enumerate(places):
            out[k * _SPANS : (k + 1) * _SPANS] = place[own]
        return keys, reps[first], out
    return _distinct(buf, starts, ends)


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = hash_spans(buf, starts, ends)
    while True:
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        differ = np.flatnonzero(~same_bytes(buf, starts, ends, first[place])) if len(place) else first
        if not len(differ):
            return keys, first, place
        hashes[differ] = mix(hashes[differ] + _PLACE)


class Slice:
    """Some consecutive documents: ``buf`` holds their bytes, ``offsets`` their bounds."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents (within the slice) of all words."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        inside = ~separators[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, self.documents(starts)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        """The document of each (rising) byte position."""
        per = np.diff(np.searchsorted(positions, self.offsets))
        return np.repeat(np.arange(len(self)), per)

    def text(self, k: int) -> bytes:
        return self.buf[self.offsets[k] : self.offsets[k + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about ``most`` bytes, without copying."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    done = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        if not pa.types.is_large_string(chunk.type):
            chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        k = 0
        while k < len(chunk):
            upto = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
            yield Slice(done + k, buf[at[k] : at[upto]], at[k : upto + 1] - at[k])
            k = upto
        done += len(chunk)


def singles(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """A slice of its own for each text, null and empty ones too, in order."""
    for piece in slices(column):
        for k in range(len(piece)):
            a, b = piece.offsets[k], piece.offsets[k + 1]
            yield Slice(piece.first + k, piece.buf[a:b], np.array([0, b - a]))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, from the words' hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for j in range(n):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += words[j : j + m]
    return mix(out + _U(n))


def counts_of(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """True for each of n places that lies in one of the runs (start, length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0
