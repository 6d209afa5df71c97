"""Tokenisation and hashing against regular expressions."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common
from tessera.llm.common import ALNUM, NON_SPACE, Words, ragged, slices, utf8

PATTERNS = {"space": (NON_SPACE, r"[^\x20\x09-\x0D]+"), "alnum": (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def texts(seed, n=200):
    r = random.Random(seed)
    alphabet = "abAB09 _-.\n\té日🎉 "
    return [None if r.random() < 0.05 else "".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("kind", PATTERNS)
def test_words(kind):
    table, pattern = PATTERNS[kind]
    rows = texts(1)
    data, offsets = utf8(pa.array(rows, pa.string()))
    w = Words(data, offsets, table)
    want = [re.findall(pattern, lower(x or "")) for x in rows]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [lower(data[a:b].tobytes().decode()) for a, b in zip(w.starts, w.ends, strict=True)] == flat
    seen = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    at, hashes = w.shingles(3)
    grams = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
    assert len(at) == len(grams) and len(set(zip(grams, hashes.tolist(), strict=True))) == len(set(grams)) == len(set(hashes.tolist()))


def test_slices_keep_texts_whole():
    batch = pa.record_batch({"text": pa.array(["a" * 50, None, "b" * 500, "", "c"])})
    got = [rows.column(0).to_pylist() for rows, _, _ in slices(batch, size=60)]
    assert [x for rows in got for x in rows] == batch.column(0).to_pylist() and len(got) > 1


def test_ragged():
    assert ragged(np.array([5, 9]), np.array([2, 0])).tolist() == [5, 6]


def test_released_gives_back_what_a_worker_has_freed():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20

    pins = []

    def run(batches):
        for _ in batches:
            many = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces that malloc takes from its heap
            pins.append(many[-1])  # above the others: without a trim none goes back
            yield len(many)

    before = resident()
    assert list(common.released(run)([1])) == [4000]
    assert resident() - before < 128
