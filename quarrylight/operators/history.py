"""Ownership, bus factor and churn from commit touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules


def ownership(touches: DataFrame) -> DataFrame:
    """(file_path, email, name, commits, percentage, rank): names are the first seen for an
    address in a file; equal counts are ranked by first appearance."""
    g = touches.groupBy("file_path", F.col("author_email").alias("email")).agg(
        F.count(F.lit(1)).alias("commits"), F.min_by("author_name", "ord").alias("name"), F.min("ord").alias("first")
    )
    rank = Window.partitionBy("file_path").orderBy(F.desc("commits"), "first")
    share = F.col("commits") / F.sum("commits").over(Window.partitionBy("file_path")) * 100
    return g.select(
        "file_path", "email", "name", "commits", rules.round_half_up(share).cast("int").alias("percentage"), F.row_number().over(rank).alias("rank"), "first"
    )


def primary_owner(touches: DataFrame) -> DataFrame:
    return ownership(touches).filter("rank = 1").select("file_path", "email", "name", "commits", "percentage")


def top_contributors(touches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Authors by number of files they mainly own, until half of the files are covered."""
    owner = ownership(touches).filter("rank = 1")
    g = owner.groupBy("email").agg(F.count(F.lit(1)).alias("files"), F.min_by("name", F.struct("first", "file_path")).alias("name"), F.min("first").alias("first"))
    # one row per author
    order = Window.orderBy(F.desc("files"), "first", "email").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("run", F.sum("files").over(order)).withColumn("total", F.sum("files").over(Window.partitionBy()))
    share = rules.round_half_up(F.col("files") / F.col("total") * 100).cast("int")
    return g.filter(F.col("run") - F.col("files") < F.col("total") * threshold).select("email", "name", "files", share.alias("percentage"))


def bus_factor(touches: DataFrame) -> DataFrame:
    n = top_contributors(touches).agg(F.count(F.lit(1)).cast("int").alias("bus_factor"))
    risk = F.when(F.col("bus_factor") == 0, "low").otherwise(rules.bus_factor_risk(F.col("bus_factor")))
    return n.withColumn("risk", risk)


def high_churn(touches: DataFrame, k: int = 10) -> DataFrame:
    g = touches.groupBy("file_path").agg(
        F.count_distinct("commit_hash").alias("commits"), F.count_distinct("author_email").alias("authors"), F.max("date").alias("last_modified"),
        F.min("ord").alias("first"),
    )
    return g.orderBy(F.desc("commits"), "first").limit(k).drop("first")


def window_of(touches: DataFrame) -> DataFrame:
    return touches.agg(F.count_distinct("commit_hash").alias("commits"), F.min("date").alias("oldest"), F.max("date").alias("newest"))


def parse_log(raw: DataFrame, marker: str = "__COMMIT__") -> DataFrame:
    """Touches from log text, one row per log in ``raw``(log_id, text): header lines carry
    marker|hash|name|email|date, the paths below belong to the last header."""
    lines = raw.select("log_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    parts = F.split(F.substring("line", len(marker) + 1, 1 << 20), r"\|")
    head = F.when(F.col("line").startswith(marker), F.struct(F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("email"), F.get(parts, F.lit(3)).alias("date")))
    so_far = Window.partitionBy("log_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.filter("line <> ''").withColumn("head", head).withColumn("h", F.last("head", ignorenulls=True).over(so_far))
    x = x.filter("head is null and h is not null and h.hash <> '' and h.date is not null and h.date <> ''")
    return x.select(
        F.col("h.hash").alias("commit_hash"), F.coalesce("h.name", F.lit("")).alias("author_name"), F.coalesce("h.email", F.lit("")).alias("author_email"),
        F.col("h.date").alias("date"), F.col("line").alias("file_path"), F.col("pos").cast("long").alias("ord"),
    )
