"""Distinct spans of large blocks: the same answer in bounded memory."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from veloria.llm import textbytes


def _spans(n, vocabulary):
    rng = np.random.default_rng(5)
    words = [b"w%d" % k + b"x" * (k % 23) for k in range(vocabulary)]
    own = [words[k] for k in (rng.zipf(1.4, n) % vocabulary).tolist()]
    ends = np.cumsum([len(w) for w in own])
    return own, np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], ends[:-1]]), ends


@pytest.mark.parametrize("collide", [False, True])
def test_distinct_spans_of_many_chunks(monkeypatch, collide):
    own, buf, starts, ends = _spans(4000, 300)
    monkeypatch.setattr(textbytes, "_SPANS", 256)
    if collide:
        real = textbytes.hash_spans
        monkeypatch.setattr(textbytes, "hash_spans", lambda *a: real(*a) % np.uint64(7))
    keys, first, place = textbytes.distinct_spans(buf, starts, ends)
    seen = {}
    for k, w in enumerate(own):
        seen.setdefault(w, k)
    assert len(keys) == len(seen) and (np.diff(keys.astype(object)) > 0).all()
    assert sorted(first.tolist()) == sorted(seen.values())
    assert [first[p] for p in place] == [seen[w] for w in own]


def test_distinct_spans_sort_a_part_at_a_time():
    own, buf, starts, ends = _spans(1_000_000, 50_000)
    tracemalloc.start()
    textbytes.distinct_spans(buf, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(own)


def test_classes_of_code_points_need_little_memory():
    script = "import resource; from veloria.llm import bpe; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = peak(); t = bpe.classes(); print(peak() - a, *t[[0x41, 0x39, 0x2167, 0xD800, 0x10FFFF, 0x20000, 0x2003]])"
    found = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(found[0]) < 40_000  # KB
    assert found[1:] == ["1", "2", "2", "0", "0", "1", "3"]
