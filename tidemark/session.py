"""Session settings and the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def session(app: str = "tidemark", master: str | None = None) -> SparkSession:
    """A session in UTC; adaptive execution and ANSI mode stay at their defaults (on)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 in UTC. Zoneless timestamps are UTC; numbers are seconds."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))
