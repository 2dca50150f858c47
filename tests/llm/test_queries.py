"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from quarrylight.llm import neardup, queries, spm

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    rel = db.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})")
    assert got == Counter(repr(tuple(plain(v) for v in r)) for r in rel.fetchall())


def test_all_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in seen.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after and after <= before
        if name == "quality rules":
            # near copies by the texts before line dedup takes what they share from them
            copies = {r["doc_id"] for r in neardup.find(out).filter("not keep").collect()}
        if name == "SimHash near-dedup":
            left = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert len(copies) > 5 and len(left & copies) <= 0.1 * len(copies)
        seen = out
    ids = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert ids == {r["doc_id"]: r["ids"] for r in seen.collect()}
    assert spm.decode(seen).count() == seen.count()


def test_pipeline_stages_on_odd_input(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "just a few plain words in this one", "en", "s", 34), (2, "just a few plain words in this one", "en", "s", 34), (3, "x" * 100_000, "en", None, 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        df = spark.createDataFrame([(*r, 1, "h") for r in data], schema + ", __rid int, host string")
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= 2 * len(data)
            if "ids" not in out.columns:
                assert out.columns == df.columns


def test_stages_keep_values_of_clashing_columns(spark):
    shared = "this line of eight plain words is shared"
    rows = [(900_001, f"{shared}\nand this one is of the first document only", "en", "s", 80, 7, {"a": 1}), (900_002, f"{shared}\nwhile that one is found in the second alone", "en", "s", 80, 8, {"b": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __host int, __rid map<string,int>")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert {(r["doc_id"], r["__host"], tuple(r["__rid"].items())) for r in out.collect()} == {(900_001, 7, (("a", 1),)), (900_002, 8, (("b", 2),))}, name
