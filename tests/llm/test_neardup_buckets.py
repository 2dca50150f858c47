"""Operator 4: what comparing the rows of a bucket costs and finds."""

from __future__ import annotations

import time

import numpy as np
import pytest
from quarrylight.llm import neardup
from quarrylight.llm.textkernel import popcount


def roots(n, a, b):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def flipped(r, sig, most):
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    for row in bits:
        row[r.choice(256, r.integers(1, most), replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


@pytest.mark.parametrize("cap", [8, 256, 10_000])
def test_links_connect_what_brute_force_connects(cap):
    r = np.random.default_rng(4)
    sizes = [1, 2, 9, 24, 25, 70, 300, 900]
    parts = []
    for n in sizes:  # a third of a bucket near one row, a third in pairs, the rest alone
        base = r.integers(0, 2**64, (n, 4), dtype=np.uint64)
        base[: n // 3] = flipped(r, np.repeat(base[:1], n // 3, axis=0), 50)
        base[n // 3 : 2 * (n // 3)] = flipped(r, base[n - n // 3 :], 56) if n > 2 else base[n // 3 : 2 * (n // 3)]
        parts.append(r.permutation(base))
    sig, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    near = np.array([popcount(sig ^ row).sum(axis=1) <= neardup.RADIUS for row in sig]) & (bucket == bucket[:, None])
    want = np.nonzero(np.triu(near, 1))
    a, b = neardup._links(at, sig, neardup.RADIUS, cap)
    assert near[a, b].all() and (a != b).all()
    assert roots(len(sig), a, b) == roots(len(sig), *want)
    if cap == 10_000:
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))


def test_comparing_a_pair_costs_a_few_words():
    """Buckets of about 500 rows, as many as the plan makes at most: not more than 30 times what one word
    of each pair costs."""
    r = np.random.default_rng(2)
    sig, at = r.integers(0, 2**64, (20_000, 4), dtype=np.uint64), np.arange(0, 20_001, 500)
    word = r.integers(0, 2**64, 1 << 15, dtype=np.uint64)
    pairs = 40 * 500 * 499 // 2

    def seconds(f):
        best = 1e9
        for _ in range(3):
            t = time.process_time()
            f()
            best = min(best, time.process_time() - t)
        return best

    one = seconds(lambda: [popcount(word ^ word[0]) for _ in range(pairs >> 15)])
    assert seconds(lambda: neardup._links(at, sig, neardup.RADIUS, neardup.CAP)) < 30 * one
