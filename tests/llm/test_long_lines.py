"""Operator 10 on lines of more than 8,000 characters: edit similarity decides, not word counts."""

from __future__ import annotations

import random
import time

import numpy as np
from quarrylight.llm import linededup
from quarrylight.llm.editdistance import within


def test_reordered_long_lines_stay_and_edited_ones_leave(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(2, 8))) for _ in range(1500)]
    words = [r.choice(vocabulary) for _ in range(3000)]
    parts = [words[i : i + 60] for i in range(0, 3000, 60)]
    r.shuffle(parts)
    edited = list(words)
    for i in range(0, 3000, 300):
        edited[i] = edited[i][:-1] + "q"
    rows = [(1, " ".join(words)), (2, " ".join(w for p in parts for w in p)), (3, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in linededup.dedup_lines(df).collect()) == [1, 2]


def test_long_distances_are_exact():
    r = random.Random(6)
    a = "".join(r.choice("abcdefgh ") for _ in range(12_000))
    for edits in (0, 1, 40, 300):
        b = list(a)
        for p in r.sample(range(12_000), edits):
            b[p] = "z"  # occurs nowhere else: the distance is the number of edits
        assert within([a, a], ["".join(b)] * 2, np.array([edits, edits - 1])).tolist() == [True, False] if edits else within([a], [a], np.array([0]))[0]
    assert within([a, a], [a[5:], "x" + a], np.array([5, 1])).all() and not within([a], [a[::-1]], np.array([960]))[0]


def test_few_edits_of_a_long_text_cost_little():
    """The work follows the number of edits, not the length times the room for edits."""
    r = random.Random(7)
    a = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    b = list(a)
    for p in range(0, 400_000, 20_000):
        b[p] = "z"
    began = time.process_time()
    assert within([a] * 2, ["".join(b)] * 2, np.array([32_000, 19])).tolist() == [True, False]
    assert time.process_time() - began < 8
