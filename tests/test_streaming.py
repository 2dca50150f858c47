"""The stream of touches gives what a batch over the same rows gives."""

from __future__ import annotations

from pyspark.sql import functions as F
from quarrylight.streaming.churn import churn


def test_churn_of_a_stream_equals_a_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", f"f{i % 4}.py") for i in range(40)]
    batch = spark.createDataFrame(rows, "ts string, file_path string").withColumn("ts", F.to_timestamp("ts"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = churn(stream).writeStream.format("memory").queryName("churned").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("churned").collect()) == sorted(churn(batch).collect()) and spark.table("churned").count() == 12
