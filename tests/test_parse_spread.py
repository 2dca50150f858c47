"""Parsing uses all cores, however few tasks read the files."""

from __future__ import annotations

from pyspark.sql import functions as F
from quarrylight.parse import registry
from quarrylight.sources import programs


def test_one_small_table_is_parsed_by_many_tasks(spark, tmp_path):
    spark.range(4000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = programs.programs(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 1
    parsed = registry.parse_files(files)
    per = parsed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) >= 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in per) == 4000
    assert max(r["count"] for r in per) < 1000
