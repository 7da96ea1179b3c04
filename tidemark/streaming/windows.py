"""Levels of scores over a stream of rows, by windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_levels(rows: DataFrame, time: str, score: Column, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """start, n and the mean of log1p scores of each window. Rows later than `late` behind the newest are left out; a stream's state holds open windows only. Tables give the same rows."""
    dealt = rows.withWatermark(time, late) if rows.isStreaming else rows
    return dealt.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p(score)).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
