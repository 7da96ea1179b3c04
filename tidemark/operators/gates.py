"""Distribution, drift and settling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.filters import seeded

#: Bands of age in hours; what lies between 168 and 336 is in none.
BANDS = ((0, 12), (12, 24), (24, 48), (48, 72), (72, 168), (336, 100_000))


def yearly_stats(df: DataFrame, time: str, score: Column) -> DataFrame:
    y = F.log1p(score)
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    return out.select("year", "n", F.col("q")[1].alias("median"), "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.round(F.expm1(F.col("q")[1]), 1).alias("median_score"))


def drift_ratio(yearly: DataFrame, statistic: str, least: int = 10_000) -> DataFrame:
    """Last over first of the years with enough rows."""
    return yearly.where(F.col("n") >= least).agg(F.try_divide(F.max_by(statistic, "year"), F.min_by(statistic, "year")).alias("ratio"))


def monthly_means(df: DataFrame, time: str, score: Column) -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.avg(F.log1p(score)).alias("mean"), F.count(F.lit(1)).alias("n"))


def mean_levels(monthly: DataFrame, low: float = 1.10, high: float = 1.26, least: int = 1000) -> DataFrame:
    m = F.col("mean")
    return monthly.where(F.col("n") >= least).agg(F.count_if(m < low).alias("low"), F.count_if(m > high).alias("high"), F.count_if((m > low) & (m < high)).alias("between"))


def quantile_pivot(df: DataFrame, time: str, score: Column, points: dict[str, float]) -> DataFrame:
    q = F.percentile(score, F.array(*[F.lit(p) for p in points.values()]))
    return df.groupBy(F.year(time).alias("year")).agg(q.alias("q")).select("year", *[F.col("q")[i].alias(n) for i, n in enumerate(points)])


def correlation(df: DataFrame, x: str, y: str, name: str = "r") -> DataFrame:
    """Pearson; 0 for a constant."""
    varied = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    cov = F.covar_pop(x, y)
    return df.agg(F.when(varied, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0).alias(name))


def floor_share(df: DataFrame, score: Column, top: int = 5) -> DataFrame:
    """Scores 1 to top: rows, share of all rows, log1p, running share. Scores without rows stay."""
    counts = df.groupBy(score.cast("long").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.range(1, top + 1).withColumnRenamed("id", "score")
    out = wanted.join(F.broadcast(counts.where(F.col("score").between(1, top))), "score", "left").join(F.broadcast(total), F.lit(True)).select("score", F.coalesce("n", F.lit(0)).alias("n"), "total")
    share = F.try_divide("n", "total")
    return out.select("score", "n", share.alias("share"), F.log1p("score").alias("log_score"), F.sum(share).over(W.orderBy("score")).alias("cumulative"))


def age_bucket(hours: Column, step: int = 6, fine: int = 72) -> Column:
    """The left edge of an age's bucket: steps up to fine hours, then one bucket to 96 and whole days."""
    day = F.floor(hours / 24) * 24
    return F.when(hours < fine, F.floor(hours / step) * step).when(hours < 96, F.lit(fine)).otherwise(day).cast("long")


def settling_curve(df: DataFrame, hours: str, score: Column, step: int = 6, least: int = 1, tolerance: float = 0.05, statistic: str = "mean_log", settled_hours: int = 336) -> DataFrame:
    """Statistics by age, the plateau (median from two weeks on, else the last bucket), and from which bucket all are within the tolerance of it."""
    buckets = df.withColumn("age", age_bucket(F.col(hours), step)).groupBy("age").agg(F.count(F.lit(1)).alias("n"), F.percentile(score, F.lit(0.5)).alias("median"), F.avg(score).alias("mean"), F.percentile(score, F.lit(0.75)).alias("p75"), F.percentile(score, F.lit(0.9)).alias("p90"), F.avg(F.log1p(score)).alias("mean_log")).where(F.col("n") >= least)
    plateau = buckets.agg(F.coalesce(F.percentile(F.when(F.col("age") >= settled_hours, F.col(statistic)), F.lit(0.5)), F.max_by(statistic, "age")).alias("plateau"))
    out = buckets.join(F.broadcast(plateau), F.lit(True)).withColumn("within", F.abs(F.col(statistic) - F.col("plateau")) <= tolerance * F.abs("plateau"))
    return out.withColumn("settled", F.min("within").over(W.orderBy("age").rowsBetween(0, W.unboundedFollowing)))


def band(hours: Column) -> Column:
    out = None
    for i, (low, high) in enumerate(BANDS):
        inside = (hours >= low) & (hours < high)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def balanced_bands(df: DataFrame, hours: str, hour_of_day: Column, value: Column) -> DataFrame:
    """For each band the equal-weight mean of the means by hour of day."""
    cells = df.withColumns({"band": band(F.col(hours)), "hod": hour_of_day}).where("band IS NOT NULL").groupBy("band", "hod").agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("k"))
    return cells.groupBy("band").agg(F.avg("m").alias("balanced"), F.sum("k").alias("n"), F.count("hod").alias("hours"))


def leading_run(df: DataFrame, order: str, flag: Column) -> DataFrame:
    """Adds leading: whether the flag holds for this row and all before it."""
    return df.withColumn("leading", F.min(flag).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def bootstrap_bands(df: DataFrame, hours: str, hour_of_day: Column, value: Column, id_: str, replicates: int = 400, seed: int = 0) -> DataFrame:
    """95 % intervals of the balanced means. Each row weighs, in each replicate, as often as a Poisson(1) draw from its id says: no row is copied or shipped twice, and partial sums meet by band, hour and replicate."""
    u = lambda r: F.pmod(F.xxhash64(F.col(id_), r, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    edges = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = lambda r: sum(((u(r) >= e).cast("int") for e in edges), F.lit(0))
    rows = df.withColumns({"band": band(F.col(hours)), "hod": hour_of_day, "_v": value}).where("band IS NOT NULL")
    draws = rows.select("band", "hod", "_v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.struct(r.alias("r"), weight(r).alias("w")))).alias("x")).select("band", "hod", "_v", "x.r", "x.w").where("w > 0")
    cells = draws.groupBy("band", "r", "hod").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("m"))
    means = cells.groupBy("band", "r").agg(F.avg("m").alias("m"))
    return means.groupBy("band").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("band", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last includes its right edge."""
    width = (high - low) / bins
    at = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    return df.where((value >= low) & (value <= high)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def jaccard_micro(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pooled Jaccard and the share of equal sets."""
    return df.agg(F.try_divide(F.sum(F.size(F.array_intersect(a, b))), F.sum(F.size(F.array_union(a, b)))).alias("jaccard"), F.avg((F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) == 0).cast("double")).alias("exact"))


def commit_lag(df: DataFrame, month: str, committed: str) -> DataFrame:
    """How many months were committed within two days of their end, and on its date."""
    end = F.date_add(F.last_day(F.to_date(F.concat(month, F.lit("-01")))), 1)
    seconds = F.unix_timestamp(committed) - F.unix_timestamp(end.cast("timestamp"))
    return df.agg(F.count_if(seconds <= 2 * 86400).alias("within_two_days"), F.count_if(F.to_date(committed) == end).alias("same_date"))


def live_ages(stories: DataFrame, live: DataFrame, observed, time: str = "time") -> DataFrame:
    """Stories with a live score, their month, and their age in hours at one instant (above 0)."""
    age = (F.unix_micros(F.lit(observed).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 3.6e9
    return stories.join(live, "id").withColumns({"month": F.date_format(time, "yyyy-MM"), "age_hours": age}).where("age_hours > 0")
