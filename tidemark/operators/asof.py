"""As-of statistics: for a row at time t they read rows strictly before t - lag, and from t - lag - window on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import part_of
from tidemark.session import DAY_US, HOUR_US, micros

LAG_US = 24 * HOUR_US
IQR_TO_STD = 0.7413


@dataclass(frozen=True)
class Prior:
    """Settings of a prior mean. window_us None: all of the past."""

    lag_us: int = LAG_US
    window_us: int | None = None
    min_rows: int = 1

    def __post_init__(self) -> None:
        if self.lag_us < 0 or self.min_rows < 1 or self.window_us is not None and self.window_us <= 0:
            raise ValueError("lag must be at least 0, window above 0, min_rows at least 1")

    def frame(self, spec):
        low = W.unboundedPreceding if self.window_us is None else -(self.lag_us + self.window_us)
        return spec.rangeBetween(low, -self.lag_us - 1)


def text_key(key: Column | str) -> Column:
    """Null and the empty string are one key."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def prior_mean(rows: DataFrame, key: Column | str, time: str, value: Column | str, config: Prior = Prior(), name: str = "prior") -> DataFrame:
    """Adds <name>_mean (null below min_rows) and <name>_count over earlier rows with the same key."""
    value = F.col(value) if isinstance(value, str) else value
    over = config.frame(W.partitionBy(text_key(key)).orderBy(micros(time)))
    n = F.count(value).over(over)
    return rows.withColumns({f"{name}_mean": F.when(n >= config.min_rows, F.avg(value).over(over)), f"{name}_count": n})


def prior_from(query: DataFrame, history: DataFrame, key: str, time: str, value: str, config: Prior = Prior(), name: str = "prior") -> DataFrame:
    """The same for rows that are not their own history: both are dealt out by key once, and no pair is formed."""
    both = query.withColumns({"_value": F.lit(None).cast("double"), "_query": F.lit(True)}).unionByName(history.select(key, time, F.col(value).cast("double").alias("_value"), F.lit(False).alias("_query")), allowMissingColumns=True)
    return prior_mean(both, key, time, "_value", config, name).where("_query").drop("_value", "_query")


def global_priors(rows: DataFrame, id_: str, time: str, value: Column | str, configs: dict[str, Prior]) -> DataFrame:
    """Keyless priors without a one-partition window: id and, for each config, <name>_mean and <name>_count. Ids are those of rows; equal rows count as one query.

    All cutoffs are merged with the history into ranges of time, in one pass: running sums within the ranges, and the ranges' totals before them. A
    cutoff sorts before history of the same instant. The table of ranges is small and the only thing that one task orders.
    """
    value = F.col(value) if isinstance(value, str) else value
    base = rows.select(F.col(id_).alias("_id"), micros(time).alias("_us"), value.cast("double").alias("_y"))
    none = F.lit(None).cast(base.schema["_id"].dataType)
    merged = base.where("_y IS NOT NULL").select(none.alias("_id"), "_us", "_y", F.lit(1).alias("_n"), F.lit(1).alias("_late"), F.lit(None).cast("int").alias("_config"), F.lit(0).alias("_sign"))
    ends = []
    for i, c in enumerate(configs.values()):
        ends.append(F.struct((F.col("_us") - c.lag_us).alias("_us"), F.lit(i).alias("_config"), F.lit(1).alias("_sign")))
        if c.window_us is not None:
            ends.append(F.struct((F.col("_us") - c.lag_us - c.window_us).alias("_us"), F.lit(i).alias("_config"), F.lit(-1).alias("_sign")))
    asked = base.select("_id", "_us").distinct().select("_id", F.explode(F.array(*ends)).alias("e"))
    merged = merged.unionByName(asked.select("_id", "e._us", F.lit(0.0).alias("_y"), F.lit(0).alias("_n"), F.lit(0).alias("_late"), "e._config", "e._sign"))
    merged = merged.withColumn("_part", part_of(base, "_us"))
    totals = merged.groupBy("_part").agg(F.sum("_y").alias("y"), F.sum("_n").alias("n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("y").over(earlier), F.lit(0.0)).alias("_y0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("_part").orderBy("_us", "_late").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = merged.withColumns({"_ys": F.sum("_y").over(inside), "_ns": F.sum("_n").over(inside)}).where("_late = 0").join(F.broadcast(totals), "_part")
    sums = []
    for i in range(len(configs)):
        mine = F.when(F.col("_config") == i, F.col("_sign"))
        sums += [F.sum(mine * (F.col("_ys") + F.col("_y0"))).alias(f"s{i}"), F.sum(mine * (F.col("_ns") + F.col("_n0"))).alias(f"n{i}")]
    found = run.groupBy("_id").agg(*sums)
    out = [F.col("_id").alias(id_)]
    for i, (name, c) in enumerate(configs.items()):
        out += [F.when(F.col(f"n{i}") >= c.min_rows, F.try_divide(f"s{i}", f"n{i}")).alias(f"{name}_mean"), F.col(f"n{i}").alias(f"{name}_count")]
    return found.select(*out)


def global_prior(rows: DataFrame, id_: str, time: str, value: Column | str, config: Prior = Prior(), name: str = "prior") -> DataFrame:
    return global_priors(rows, id_, time, value, {name: config})


def with_history(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both intervals as one history. Each row still reads only what its own bound allows, so the test rows' own future stays out."""
    return train.unionByName(test)


@dataclass(frozen=True)
class Baseline:
    """Settings of a trailing baseline."""

    window_us: int = 30 * DAY_US
    lag_us: int = LAG_US
    centre: str = "zero"
    spread: str = "std"
    scale: bool = False
    min_periods: int = 30
    fallback_centre: float = 0.0
    fallback_spread: float = 1.0

    def __post_init__(self) -> None:
        if self.window_us <= 0 or self.lag_us < 0 or self.min_periods < 1 or self.fallback_spread <= 0:
            raise ValueError("window and fallback_spread must be above 0, lag at least 0, min_periods at least 1")
        if self.centre not in ("mean", "median", "zero") or self.spread not in ("std", "iqr"):
            raise ValueError("centre is mean, median or zero; spread is std or iqr")


def trailing_baseline(rows: DataFrame, time: str, value: Column, config: Baseline, key: str | None = None) -> DataFrame:
    """Adds centre, spread and n_prior of log1p scores in the trailing window. Order: statistics, too few rows, degenerate spread, zero centre, no scaling."""
    over = Prior(config.lag_us, config.window_us).frame(W.partitionBy(text_key(key) if key else F.lit(0)).orderBy(micros(time)))
    n = F.count(value).over(over)
    quantile = lambda p: F.percentile(value, F.lit(p)).over(over)
    centre = quantile(0.5) if config.centre == "median" else F.avg(value).over(over)
    spread = (quantile(0.75) - quantile(0.25)) * IQR_TO_STD if config.spread == "iqr" else F.stddev_pop(value).over(over)
    enough = n >= config.min_periods
    centre = F.lit(0.0) if config.centre == "zero" else F.when(enough, centre).otherwise(config.fallback_centre)
    spread = F.when(enough & (spread > 0), spread).otherwise(config.fallback_spread) if config.scale else F.lit(1.0)
    return rows.withColumns({"n_prior": n, "centre": centre, "spread": spread})


def forward(score: Column, centre: Column, spread: Column) -> Column:
    """An error where the spread is not above 0."""
    spread = F.when(spread > 0, spread).otherwise(F.raise_error(F.lit("the spread must be above 0")).cast("double"))
    return (F.log1p(score) - centre) / spread


def inverse(target: Column, centre: Column, spread: Column) -> Column:
    return F.expm1(target * spread + centre)


def trailing_rung(rows: DataFrame, id_: str, time: str, value: Column, min_rows: int = 30) -> DataFrame:
    """Rung 1: the mean of 30 days, else of all the past, else 0. Gives id and rung1."""
    both = global_priors(rows, id_, time, value, {"near": Prior(window_us=30 * DAY_US, min_rows=min_rows), "all": Prior()})
    return both.select(id_, F.coalesce("near_mean", "all_mean", F.lit(0.0)).alias("rung1"))


def keyed_rung(rows: DataFrame, id_: str, key: Column | str, time: str, value: Column, min_rows: int = 1) -> DataFrame:
    """Rungs 2 and 3: the key's own past, else rung 1. Adds prior_mean, prior_count, rung1 and prediction."""
    first = trailing_rung(rows, id_, time, value)
    return prior_mean(rows, key, time, value, Prior(min_rows=min_rows)).join(first, id_).withColumn("prediction", F.coalesce("prior_mean", "rung1"))


def fallbacks(predicted: DataFrame) -> DataFrame:
    """Rows, how many fell back, and their share."""
    n, miss = F.count(F.lit(1)), F.count_if(F.col("prior_mean").isNull())
    return predicted.agg(n.alias("total"), miss.alias("fallbacks"), F.try_divide(miss, n).alias("fraction"))


#: The lag of expanding statistics of authors and domains.
EXPANDING = Prior(lag_us=48 * HOUR_US)


def expanding_stats(rows: DataFrame, key: str, time: str, value: Column, least: int, name: str, config: Prior = EXPANDING) -> DataFrame:
    """<name>_prior_count, _mean and _std (population) of a key's past; null below the least number of posts."""
    over = config.frame(W.partitionBy(text_key(key)).orderBy(micros(time)))
    n = F.count(value).over(over)
    return rows.withColumns({f"{name}_prior_count": n, f"{name}_prior_mean": F.when(n >= least, F.avg(value).over(over)), f"{name}_prior_std": F.when(n >= least, F.stddev_pop(value).over(over))})
