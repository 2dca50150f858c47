"""Operator 7 row by row: recall where density differs between rows."""

from __future__ import annotations

import numpy as np
from quarrylight.llm import ann


def test_lone_rows_find_their_neighbours_beside_tight_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(38, 64))
    x = np.concatenate([*[c + 0.05 * r.normal(size=(50, 64)) for c in centres], r.normal(size=(80, 64))])
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block_rows in (8192, 700):
        got: dict[int, set[int]] = {i: set() for i in range(len(x))}
        for a in ann.neighbours(df, block_rows=block_rows, query_step=1).collect():
            got[a["vec_id"]].add(a["neighbour_id"])
        recall = np.array([len(got[i] & set(want[i].tolist())) / 10 for i in got])
        assert all(len(g) == 10 for g in got.values())
        assert recall[1900:].mean() >= 0.9 and recall[:1900].mean() >= 0.9
        assert (recall < 0.9).mean() <= 0.02


def test_the_query_set_against_all_rows(spark):
    """The registered query: every id divisible by 100, in full against brute force."""
    from quarrylight.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    u = np.array([r[1] for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = queries.op7_multi_index_neighbours(spark, sf).collect()
    asked = [i for i in ids if i % 100 == 0]
    assert {r["vec_id"] for r in got} == set(asked) and len(got) == 10 * len(asked)
    hits = 0
    for i in asked:
        s = u @ u[np.flatnonzero(ids == i)[0]]
        s[ids == i] = -9
        mine = sorted((r["rank"], r["neighbour_id"], r["cosine"]) for r in got if r["vec_id"] == i)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s[np.flatnonzero(ids == n)[0]] - c) < 2e-6 for _, n, c in mine)
        hits += len({n for _, n, _ in mine} & set(ids[np.argsort(-s)[:10]].tolist()))
    assert hits >= 0.9 * len(got)


def test_ties_and_wide_vectors(spark):
    same = [(i, [1.0, 2.0] * 200) for i in range(0, 500, 100)] + [(7, [2.0, 1.0] * 200), (7, [2.0, 1.0] * 200)]
    got = ann.neighbours(spark.createDataFrame(same, "vec_id long, embedding array<float>"), k=3).collect()
    by = {i: [r["neighbour_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["vec_id"] == i] for i in range(0, 500, 100)}
    assert by == {0: [100, 200, 300], 100: [0, 200, 300], 200: [0, 100, 300], 300: [0, 100, 200], 400: [0, 100, 200]}  # of equal cosines the smaller ids
