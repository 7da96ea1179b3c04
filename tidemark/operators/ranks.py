"""Errors, tie-aware rank correlation and precision at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import before


def errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    d = F.col(predicted) - F.col(actual)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n"))


def _ranked(counts: DataFrame, value: str, rank: str) -> DataFrame:
    """value and its average rank, from rows (value, _k) of values and how often each occurs."""
    return before(counts, [value], F.col("_k"), "_b", value).select(value, (F.col("_b") + (F.col("_k") + 1) / 2).alias(rank))


def average_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """Adds the mean rank of equal values; null for null. Equal values are counted first; running totals are taken in two levels, so no task sorts all of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    return df.join(_ranked(counts, value, rank), value, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """0 for a constant or fewer than two rows; rows with a null in either do not count.

    Rows are counted by (x, y) once, and all else is done on the counts: ranks of distinct values, and a weighted covariance.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).persist()
    sides = [_ranked(pairs.groupBy(c).agg(F.sum("_n").alias("_k")), c, f"{c}r") for c in ("_x", "_y")]
    n = F.sum("_n")
    # The mean of all ranks is (n + 1) / 2 on either side.
    mean = pairs.agg(((n + 1) / 2).alias("_m"))
    each = pairs.join(sides[0], "_x").join(sides[1], "_y").join(F.broadcast(mean), F.lit(True))
    a, b = F.col("_xr") - F.col("_m"), F.col("_yr") - F.col("_m")
    xx, yy, xy = (F.sum(F.col("_n") * p) for p in (a * a, b * b, a * b))
    row = each.agg(F.coalesce(F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)), F.lit(0.0)).alias("spearman")).first()
    pairs.unpersist()
    return df.sparkSession.createDataFrame([(row[0],)], "spearman double")


def precision_at_k(df: DataFrame, predicted: str, actual: str, id_: str, k: int) -> DataFrame:
    """Of the k best predictions (ties by id) the share whose actual reaches the k-th largest actual."""
    if k <= 0:
        raise ValueError("k must be above 0")
    if df.limit(k).count() < k:
        raise ValueError("fewer rows than k")
    least = df.orderBy(F.desc(actual)).limit(k).agg(F.min(actual).alias("_least"))
    best = df.orderBy(F.desc(predicted), id_).limit(k).select(actual)
    return best.join(F.broadcast(least), F.lit(True)).agg((F.count_if(F.col(actual) >= F.col("_least")) / F.lit(float(k))).alias("precision"))


def report(df: DataFrame, predicted: str, actual: str, id_: str, k: int = 100) -> dict:
    a, b, c = errors(df, predicted, actual).first(), spearman(df, predicted, actual).first(), precision_at_k(df, predicted, actual, id_, k).first()
    return {"rmse": a[0], "mae": a[1], "n": a[2], "spearman": b[0], f"precision_at_{k}": c[0]}


def reports(df: DataFrame, group: str, predicted: str, actual: str, id_: str, k: int = 100) -> DataFrame:
    """report() for each value of a text column, in the passes of one: group, rmse, mae, n, spearman, precision."""
    if k <= 0:
        raise ValueError("k must be above 0")
    d = F.col(predicted) - F.col(actual)
    errs = df.groupBy(group).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n"))
    pairs = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(group, F.col(predicted).alias("_x"), F.col(actual).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).persist()
    each = pairs.join(F.broadcast(pairs.groupBy(group).agg(((F.sum("_n") + 1) / 2).alias("_m"))), group)
    for c in ("_x", "_y"):
        ranked = before(pairs.groupBy(group, c).agg(F.sum("_n").alias("_k")), [c], F.col("_k"), "_b", c, [group])
        each = each.join(ranked.select(group, c, (F.col("_b") + (F.col("_k") + 1) / 2).alias(f"{c}r")), [group, c])
    a, b = F.col("_xr") - F.col("_m"), F.col("_yr") - F.col("_m")
    xx, yy, xy = (F.sum(F.col("_n") * p) for p in (a * a, b * b, a * b))
    rank = each.groupBy(group).agg(F.coalesce(F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)), F.lit(0.0)).alias("spearman")).collect()
    top = lambda *order: df.withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_at") <= k)
    least = top(F.desc(actual)).groupBy(group).agg(F.min(actual).alias("_least"))
    best = top(F.desc(predicted), F.col(id_)).select(group, actual).join(F.broadcast(least), group)
    share = best.groupBy(group).agg((F.count_if(F.col(actual) >= F.col("_least")) / F.lit(float(k))).alias("precision")).collect()
    rank, share = dict(map(tuple, rank)), dict(map(tuple, share))
    rows = [(*r, rank.get(r[0], 0.0), share[r[0]]) for r in errs.collect()]
    pairs.unpersist()
    if any(r[3] < k for r in rows):
        raise ValueError("fewer rows than k")
    return df.sparkSession.createDataFrame(rows, f"{group} string, rmse double, mae double, n long, spearman double, precision double")
