"""Steps along calls read the edges from a table that was written once, and depths are the least ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from quarrylight.operators import graph
from quarrylight.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(edges, seeds, most):
    out = set()
    for s in seeds:
        seen, front = {s}, {s}
        for depth in range(1, most + 1):
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            out |= {(s, n, depth) for n in front}
    return out


def test_reach_is_the_least_depth(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), (None, "n3"), ("n3", None)]
    seeds = [f"n{i}" for i in range(20)] + ["alone"]
    df = spark.createDataFrame(pairs, "target string, dependent string")
    for most in (1, 2, 3):
        got = [tuple(r) for r in graph.reach(df, spark.createDataFrame([(s,) for s in seeds * 2], "seed string"), most).select("seed", "node", "depth").collect()]
        assert len(got) == len(set(got)) and set(got) == brute([p for p in pairs if None not in p], seeds, most)


def scans(df, table: str = "lineitem") -> int:
    return df._jdf.queryExecution().analyzed().toString().count("l_partkey#") and sum("l_partkey#" in x and "Relation" in x for x in df._jdf.queryExecution().analyzed().toString().splitlines())


@pytest.mark.parametrize("name", ["blast_radius", "blast_summary", "blast_radius_paths", "pr_draft", "pr_markdown"])
def test_calls_are_derived_once(spark, monkeypatch, name):
    """Every table that is written, and the result, together read the line items once."""
    read = []

    def counting(df):
        read.append(scans(df))
        return cut(df)

    cut = graph.cut
    monkeypatch.setattr(graph, "cut", counting)
    read.append(scans(catalog.QUERIES[name](spark, SF)))
    assert sum(read) == 1


def test_summary_of_distances(spark):
    f, c = catalog._fn(spark, SF), catalog._calls(spark, SF)
    seeds = catalog._names(f)
    full = graph.blast_radius(f, c, seeds).select("seed", "name", "depth")
    near = graph.blast_distances(f, c, seeds)
    assert near.exceptAll(full).isEmpty() and full.exceptAll(near).isEmpty()
    want = {r["seed"]: r["functions"] for r in graph.blast_summary(graph.blast_radius(f, c, seeds), seeds).collect()}
    assert want == {r["seed"]: r["functions"] for r in catalog.blast_summary(spark, SF).select("seed", F.col("functions")).collect()}
