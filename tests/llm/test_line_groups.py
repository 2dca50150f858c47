"""Operator 10: lines of a block travel in groups and arrive sorted, each once in each of its blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from quarrylight.llm import linededup


def test_lines_travel_in_groups_and_arrive_sorted(monkeypatch):
    r = np.random.default_rng(8)
    n = 3000
    sig = r.integers(-(2**63), 2**63, (n, 4))
    sig[: n // 2, 0] = sig[0, 0]  # large buckets
    size, words = r.integers(8, 1 << 21, n).astype(np.int32), r.integers(4, 40, n).astype(np.int32)
    nodes = pa.record_batch([pa.array(c) for c in (np.arange(n) + 1, *sig.T, size, words)], names=["h1", "s1", "s2", "s3", "s4", "size", "words"])
    for bits, blocks, groups, held in ((13, [26] * 5 + [18, 16, 11], 7, 1 << 17), (13, [12], 1, 500), (17, [16], 70_000, 1000)):
        monkeypatch.setattr(linededup, "_HELD", held)
        parts = list(linededup._spread(bits, blocks, groups)(iter([nodes.slice(i, 700) for i in range(0, n, 700)])))
        own = np.array(blocks)[np.minimum(words, len(blocks) - 1)]
        if groups < 10:
            assert sum(p.num_rows for p in parts) * 10 < own.sum()
        table = pa.Table.from_batches(parts).sort_by("g").combine_chunks()
        got = list(linededup._sorted(bits, groups)(iter(table.to_batches(max_chunksize=13))))
        assert held == 1 << 17 or groups == 1 or len(got) > 1
        k, h = (np.concatenate([p.column(c).to_numpy() for p in got]) for c in ("k", "h1"))
        bucket = k >> linededup._LOW
        for p in got:  # sorted, and no bucket goes on in the next part
            assert (np.diff(p.column("k").to_numpy()) >= 0).all()
        assert len({(i, b) for i, p in enumerate(got) for b in (p.column("k").to_numpy() >> linededup._LOW).tolist()}) == len(np.unique(bucket))
        t = bucket >> bits
        assert sorted(zip(h.tolist(), t.tolist(), strict=True)) == [(i + 1, b) for i in range(n) for b in range(own[i])]
        at = h - 1
        assert ((k >> 4 & (1 << 20) - 1) == np.minimum(size, (1 << 20) - 1)[at]).all() and ((k & 15) == np.minimum(words, 15)[at]).all()
        for i, c in enumerate(("s1", "s2", "s3", "s4")):
            assert (np.concatenate([p.column(c).to_numpy() for p in got]) == sig[at, i]).all()
        # the same bucket means the same bits at the places of the block
        places = linededup.block_places(bits, max(blocks))
        bit = np.unpackbits(np.ascontiguousarray(sig[:, :2]).view(np.uint8), axis=1, bitorder="little")
        for b in range(max(blocks)):
            some = np.flatnonzero(t == b)
            whole = {bytes(x) for x in bit[at[some]][:, places[b]]}
            assert len(whole) == len(np.unique(bucket[some])) == len({(bytes(x), y) for x, y in zip(bit[at[some]][:, places[b]], bucket[some].tolist(), strict=True)})
