"""A stream and the same table give the same windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming.windows import windowed_levels


def test_stream_matches_table(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7200).alias("time"), F.col("id").alias("score"))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    table = windowed_levels(rows, "time", F.col("score"), "5 days")
    stream = windowed_levels(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "time", F.col("score"), "5 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("levels").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    plain = lambda d: sorted((r.start, r.n, round(r["mean"], 9)) for r in d.collect())
    assert plain(spark.table("levels")) == plain(table)
