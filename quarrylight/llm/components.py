"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``(a, b); root is the least node of its component.

    Nodes may be of any type that can be ordered. Rounds repeat until the edges stay the
    same: every node then points at its root (stars). Each round costs two shuffles of the
    edges and the number of rounds grows with the logarithm of the component size. Loops,
    repeated edges and edges with a null end are allowed and ignored.
    """
    e = cut(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    seen = _digest(e)
    by = Window.partitionBy("u")
    while seen[0]:
        # large-star: every neighbour above u is joined to u's least neighbour (or u)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = (
            both.withColumn("m", F.least(F.min("v").over(by), F.col("u")))
            .filter("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
        )
        # small-star: u and its neighbours below are joined to the least of them
        down = large.distinct().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.withColumn("m", F.min("v").over(by)).select(
            F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x")
        )
        nxt = cut(small.select("x.a", "x.b").filter("a <> b").distinct())
        now = _digest(nxt)
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
