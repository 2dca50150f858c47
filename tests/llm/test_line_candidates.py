"""Operator 10: what comparing lines costs, what it finds, and how many pairs are verified."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quarrylight.llm import linededup
from quarrylight.llm.textkernel import popcount

BITS, BLOCKS = 13, [11] * 17


def bucketed(r, n, words, buckets):
    """Rows as the search gets them, sorted: random signatures, a third of them near another one; sizes
    go with the words."""
    sig = r.integers(0, 2**64, (n, 4), dtype=np.uint64)
    some = r.permutation(n)[: n // 3 * 2].reshape(2, -1)
    sig[some[0]] = sig[some[1]] ^ np.uint64(1 << 40) ^ (np.uint64(1) << r.integers(0, 64, (len(some[0]), 4)).astype(np.uint64))
    words = words[r.integers(0, len(words), n)]
    size = 6 * words + r.integers(0, 3, n)
    key = (r.integers(0, buckets, n) << linededup._LOW) | (size << 4) | np.minimum(words, 15)
    order = np.argsort(key, kind="stable")
    cols = [key[order], np.arange(n)[order] + 1, *[sig[order, i].view(np.int64) for i in range(4)]]
    return pa.record_batch([pa.array(c) for c in cols], names=["k", "h1", "s1", "s2", "s3", "s4"]), words[order], size[order]


def candidates(batch):
    out = linededup._candidates(BITS, BLOCKS, 0.92)(iter([batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)]))
    return [(x["a"], x["b"], x["apart"]) for part in out for x in part.to_pylist()]


def test_candidates_are_those_of_brute_force():
    r = np.random.default_rng(6)
    for words in (np.array([4, 5, 6, 7]), np.array([9, 10, 30]), np.array([5, 7, 8, 9, 40])):
        batch, w, size = bucketed(r, 3000, words, 9)
        k, h = (batch.column(i).to_numpy() for i in range(2))
        s1, s2, s3, s4 = (batch.column(i).to_numpy().view(np.uint64) for i in range(2, 6))
        first, second = linededup.screens()
        want = []
        for i in range(len(k)):
            j = np.arange(i + 1, len(k))
            j = j[(k[j] >> linededup._LOW == k[i] >> linededup._LOW) & (size[j] <= np.floor(size[i] / 0.92 + 1e-9))]
            fewer = np.minimum(np.minimum(w[i], w[j]), 15)
            far = popcount(s1[i] ^ s1[j]) + popcount(s2[i] ^ s2[j])
            j = j[(far <= first[fewer]) & (popcount(s3[i] ^ s3[j]) + popcount(s4[i] ^ s4[j]) <= second[fewer])]
            want += [(min(h[i], h[x]), max(h[i], h[x]), int(popcount(s1[i] ^ s1[x]) + popcount(s2[i] ^ s2[x]))) for x in j]
        assert want and sorted(candidates(batch)) == sorted(want)


def test_comparing_two_lines_costs_a_few_words():
    """Full buckets of lines of one length: not more than 12 times what one word of each pair costs."""
    r = np.random.default_rng(3)
    batch, _, _ = bucketed(r, 24_000, np.array([20]), 8)
    word = r.integers(0, 2**64, 1 << 15, dtype=np.uint64)

    def seconds(f):
        best = 1e9
        for _ in range(3):
            t = time.process_time()
            f()
            best = min(best, time.process_time() - t)
        return best

    one = seconds(lambda: [popcount(word ^ word[0]) for _ in range(8 * 3000 * 3000 // 2 >> 15)])
    run = linededup._candidates(BITS, BLOCKS, 0.92)
    assert seconds(lambda: list(run(iter([batch])))) < 12 * one


def test_two_groups_meet_once(spark, monkeypatch):
    """Two groups of variants with a similar pair between them: most of their pairs are never verified,
    and all lines still become one group."""
    base = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i] = w[i] + "q"
        if i >= 20:
            w[59], w[58] = "other", "last"
        rows.append((i, " ".join(w)))
    seen = []
    similar = linededup._similar

    def counted(pairs, texts, similarity):
        seen.append(pairs.select("a", "b").collect())
        return similar(pairs, texts, similarity)

    monkeypatch.setattr(linededup, "_similar", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = linededup.line_groups(docs, linededup.signed_lines(docs))
    assert groups.agg(F.countDistinct("__group")).first()[0] == 1
    tried = [tuple(sorted(p)) for part in seen for p in part]
    assert len(tried) == len(set(tried)) and len(seen) == 3
