"""Operator 4: recall of the tables at the operator's own radius."""

from __future__ import annotations

import numpy as np
import pytest
from quarrylight.llm import neardup


def test_tables_are_planned_for_the_radius():
    for nodes in (2, 200, 10_000, 100_000, 1_000_000, 30_000_000):
        bits, tables = neardup.table_plan(nodes)
        assert 1 - (1 - (1 - neardup.RADIUS / neardup.BITS) ** bits) ** tables >= 0.9


@pytest.mark.parametrize("cap", [neardup.CAP, 8])
def test_pairs_at_the_radius_among_many_nodes(spark, cap):
    """With cap = 8 nearly every bucket is oversized: its pairs must not get lost."""
    r = np.random.default_rng(1)
    sig = r.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    other = np.unpackbits(sig[:500].view(np.uint8), axis=1)
    for row in other:
        row[r.choice(256, neardup.RADIUS, replace=False)] ^= 1
    other = np.packbits(other, axis=1)
    raw = [x.tobytes() for x in sig] + [x.tobytes() for x in other]
    nodes = spark.createDataFrame([(bytearray(x),) for x in raw], "__sig binary")
    got = {frozenset((bytes(p["a"]), bytes(p["b"]))) for p in neardup.near_pairs(nodes, len(raw), cap=cap).collect()}
    assert sum(frozenset((raw[i], raw[20_000 + i])) in got for i in range(500)) >= 450
