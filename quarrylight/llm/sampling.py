"""Bounded samples of labelled rows for training, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, sized


def by_label(rows: DataFrame, id_col: str, label: str, per_label: int) -> DataFrame:
    """(id, label) of about ``per_label`` rows of each label at most, a written table.

    Two aggregations' worth of work: counts per label, then a filter on the hash that leaves
    about twice the wanted rows, of which the least hashes are taken. No label is sorted whole.
    """
    slim = rows.select(F.col(id_col).alias("__id"), F.col(label).alias("__label")).filter("__id is not null and __label is not null")
    counts = cut(slim.groupBy("__label").agg(F.count(F.lit(1)).alias("__n")))
    u = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    few = slim.withColumn("__u", u).join(sized(counts), "__label").filter(F.col("__u") * F.col("__n") <= 2.0 * per_label + 50)
    pick = Window.partitionBy("__label").orderBy("__u", "__id")
    return cut(few.distinct().withColumn("__k", F.row_number().over(pick)).filter(F.col("__k") <= per_label).select("__id", "__label"))
