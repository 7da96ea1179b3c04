"""Ridge regression, boosted trees with prefixes and patience."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge_dense(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> dict[str, float]:
    """The closed form with an unpenalised intercept: one aggregation gives the moments, and the driver solves as many equations as features."""
    names, d = [*features, label], len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d + 1)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not row["n"]:
        raise ValueError("no rows to fit")
    gram, right = np.zeros((d, d)), np.zeros(d)
    for i, j in pairs:
        value = row[f"c{i}_{j}"] * row["n"]
        if j == d:
            right[i] = value
        else:
            gram[i, j] = gram[j, i] = value
    w = np.linalg.solve(gram + alpha * np.eye(d), right)
    out = dict(zip(features, w.tolist(), strict=True))
    return out | {"intercept": float(row[f"m{d}"] - sum(row[f"m{i}"] * w[i] for i in range(d)))}


def ridge(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0, solver: str = "l-bfgs", steps: int = 100):
    """Ridge over vectors: of any width by l-bfgs, a pass for each step, or by the normal equations in one pass (solver "normal", 4096 features at most).

    The solvers divide their penalty by the label's deviation, which the parameter makes up for.
    """
    n, deviation = df.agg(F.count(label), (F.stddev_pop if solver == "normal" else F.stddev_samp)(label)).first()
    if not n:
        raise ValueError("no rows to fit")
    return LinearRegression(featuresCol=features, labelCol=label, regParam=alpha * (deviation or 1.0) / n, elasticNetParam=0.0, standardization=False, solver=solver, maxIter=steps, tol=1e-5).fit(df)


class Fitted(Protocol):
    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted."""


class Estimator(Protocol):
    """What a rung is: fit learns from rows with a label, predict adds a column without looking at one."""

    def fit(self, train: DataFrame, label: str) -> Fitted: ...


def boosted(df: DataFrame, label: str, features: str = "features", trees: int = 500, depth: int = 6, rate: float = 0.1, bins: int = 64, seed: int = 0) -> GBTRegressionModel:
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed, checkpointInterval=10).fit(df)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first n trees."""
    if not 0 < n <= model.getNumTrees:
        raise ValueError(f"the model has {model.getNumTrees} trees")
    gateway = model._java_obj.trees()
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        kept[i], weights[i] = gateway[i], float(model.treeWeights[i])
    made = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{n}", kept, weights)
    made.setFeaturesCol(model.getFeaturesCol())
    return GBTRegressionModel(made)


def tree_ladder(model: GBTRegressionModel, df: DataFrame, label: str, counts: Sequence[int]) -> list[tuple[int, float]]:
    """(trees, root mean squared error) of prefixes; counts above what was built are dropped."""
    losses = model.evaluateEachIteration(df, "squared")
    return [(n, math.sqrt(losses[n - 1])) for n in counts if 0 < n <= len(losses)]


def best_round(losses: Sequence[float], patience: int = 50) -> int:
    """The number of rounds with the least loss, where the search ends once patience rounds bring no better one."""
    best, at = math.inf, 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at


@dataclass
class Boosted:
    """Least-squares boosting round by round: the label's mean, and trees that each fit what the earlier ones leave."""

    base: float
    rate: float
    trees: list[DecisionTreeRegressionModel]
    losses: list[float]
    best: int

    def predict(self, df: DataFrame, trees: int | None = None) -> DataFrame:
        """Adds predicted, by the best number of trees or a stated one, up to those built."""
        out = df.withColumn("predicted", F.lit(self.base))
        for tree in self.trees[: self.best if trees is None else trees]:
            out = tree.transform(out).withColumn("predicted", F.col("predicted") + self.rate * F.col("prediction")).drop("prediction")
        return out


def boosted_early(fit: DataFrame, validation: DataFrame, label: str, features: str = "features", patience: int = 50, trees: int = 5000, depth: int = 6, rate: float = 0.1, bins: int = 64, every: int = 20) -> Boosted:
    """Boosting that ends once `patience` rounds bring no better validation error. A round continues from the last one, nothing is fitted again.

    Residuals are written each `every` rounds to the folder in spark.checkpoint.dir, which cuts their lineage.
    """
    spark = fit.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    base = fit.agg(F.avg(label)).first()[0]
    if base is None:
        raise ValueError("no rows to fit")
    rows = [df.select(features, F.col(label).cast("double").alias("_y"), F.lit(float(base)).alias("_p")) for df in (fit, validation)]
    out = Boosted(float(base), rate, [], [], 0)
    grower = DecisionTreeRegressor(featuresCol=features, labelCol="_r", maxDepth=depth, maxBins=bins, predictionCol="_t")
    best = math.inf
    for n in range(1, trees + 1):
        tree = grower.fit(rows[0].withColumn("_r", F.col("_y") - F.col("_p")))
        rows = [tree.transform(df).withColumn("_p", F.col("_p") + rate * F.col("_t")).drop("_t") for df in rows]
        if n % every == 0:
            rows = [df.checkpoint() for df in rows]
        loss = rows[1].agg(F.sqrt(F.avg((F.col("_y") - F.col("_p")) ** 2))).first()[0]
        out.trees.append(tree.setPredictionCol("prediction"))
        out.losses.append(loss)
        if loss < best:
            best, out.best = loss, n
        elif n - out.best >= patience:
            break
    return out
