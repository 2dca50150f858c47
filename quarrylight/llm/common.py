"""Shared helpers: tables, lineage cuts in the shared folder, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, shared_dir, ship_package

__all__ = ["BROADCAST_LIMIT", "bytes_of", "cut", "discard", "row_id", "row_order", "shared_dir", "sized", "table"]

#: A side is broadcast only when its estimated in-memory size is below this.
BROADCAST_LIMIT = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(df: DataFrame) -> int:
    """Estimated bytes of a table made by ``cut``: its files, times four for decompression."""
    path = getattr(df, "_ql_path", None)
    if path is None:
        raise ValueError("only a table made by cut() has a known size")
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return 4 * fs.getContentSummary(p).getLength()


def sized(small: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast of a ``cut`` table that is small enough; otherwise force the
    shuffled join, which Spark spills and splits on skew."""
    return F.broadcast(small) if bytes_of(small) <= limit else small.hint("merge")


def row_id(doc_id: Column, text: Column) -> Column:
    """64-bit identity of a row by its id and text; defined for nulls."""
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def row_order(columns: list[str]) -> Column:
    """An order of rows by all their columns, of any type (maps cannot be sorted themselves): rows
    that tie are equal."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
