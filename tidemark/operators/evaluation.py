"""Analogies, word similarity, synonyms, loss curves and the rules that decide on them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.operators.vectors import cosine, matches, unit


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four words (a, b, c, d); section lines and others go. qid is unique."""
    parts = F.split(F.trim(F.lower("value")), r"\s+")
    lines = spark.read.text(path).where("NOT startswith(value, ':')").select(parts.alias("w")).where("size(w) = 4")
    return lines.select(F.monotonically_increasing_id().alias("qid"), *[F.col("w")[i].alias(n) for i, n in enumerate("abcd")])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """left, right, rating from lines parted by commas or tabs; lines whose rating is no number go."""
    parts = F.split(F.regexp_replace("value", "\t", ","), ",")
    rows = spark.read.text(path).select(parts.alias("w")).where("size(w) >= 3")
    return rows.select(F.lower(F.trim(F.col("w")[0])).alias("left"), F.lower(F.trim(F.col("w")[1])).alias("right"), F.trim(F.col("w")[2]).try_cast("double").alias("rating")).where("rating IS NOT NULL")


def analogies(space: DataFrame, questions: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """accuracy and covered of "a is to b as c is to what": the word nearest to b - a + c that is none of them.

    Questions with an unknown word do not count; of equally near words the least is the answer. The questions' vectors
    go out in blocks of a bounded size.
    """
    units = space.select(F.col(word).alias("_word"), unit(F.col(vector)).alias("_unit"))
    asked = questions
    for name in "abcd":
        asked = asked.join(units.select(F.col("_word").alias(name), F.col("_unit").alias(f"_{name}")), name)
    query = F.zip_with(F.zip_with("_b", "_a", lambda x, y: x - y), "_c", lambda x, y: x + y)
    met = matches(space, asked.select(F.col("qid").alias("query"), F.array("a", "b", "c").alias("others"), query.alias("vector")), 1, word, vector)
    best = met.groupBy("query").agg(F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("found")).join(questions.select(F.col("qid").alias("query"), "d"), "query")
    covered = F.count(F.lit(1))
    return best.agg(F.coalesce(F.avg((F.col("found") == F.col("d")).cast("double")), F.lit(0.0)).alias("accuracy"), covered.alias("covered"))


def rated_pairs(space: DataFrame, pairs: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """rating and cosine of pairs whose words are both known."""
    side = lambda name: space.select(F.col(word).alias(name), F.col(vector).alias(f"_{name}"))
    return pairs.join(side("left"), "left").join(side("right"), "right").select("left", "right", "rating", cosine(F.col("_left"), F.col("_right")).alias("similarity"))


def word_similarity(space: DataFrame, pairs: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """spearman (0 for fewer than two pairs) and covered."""
    found = rated_pairs(space, pairs, word, vector)
    return ranks.spearman(found, "similarity", "rating").join(found.agg(F.count(F.lit(1)).alias("covered")), F.lit(True))


def synonym_recall(neighbours: DataFrame, pairs: DataFrame) -> DataFrame:
    """The share of pairs (query, id) whose second word is the nearest to the first; a missing word is a miss."""
    nearest = neighbours.where("rank = 1").select("query", F.col("id").alias("_found"))
    return pairs.join(nearest, "query", "left").agg(F.avg(F.coalesce((F.col("_found") == F.col("id")).cast("double"), F.lit(0.0))).alias("recall"))


def curve_report(points: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """A row for each run: points, diverged, upticks, largest_uptick, fall.

    A run diverges where a loss is not finite or the last is above the first; its upticks are then all its points and
    the other figures null.
    """
    x = points.select(F.col(run).alias("run"), F.col(step).alias("step"), F.col(loss).cast("double").alias("loss"))
    x = x.withColumn("rise", F.col("loss") - F.lag("loss").over(W.partitionBy("run").orderBy("step")))
    finite = F.coalesce(F.abs("loss") < math.inf, F.lit(False))
    g = x.groupBy("run").agg(
        F.count(F.lit(1)).alias("points"),
        (~F.bool_and(finite) | (F.max_by("loss", "step") > F.min_by("loss", "step"))).alias("diverged"),
        F.count_if(F.col("rise") > 0).alias("_up"),
        F.max("rise").alias("_most"),
        (F.min_by("loss", "step") - F.max_by("loss", "step")).alias("_fall"),
    )
    sound = ~F.col("diverged") & (F.col("points") >= 2)
    return g.select("run", "points", "diverged", F.when(F.col("diverged"), F.col("points")).otherwise(F.col("_up")).alias("upticks"), F.when(sound, F.col("_most")).alias("largest_uptick"), F.when(sound, F.col("_fall")).alias("fall"))


def seed_summary(runs: DataFrame, key: str, value: Column, alive: Column) -> DataFrame:
    """For each key over its seeds: runs, survivors, and the survivors' mean, spread (largest less smallest) and largest."""
    v = F.when(alive, value)
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.count_if(alive).alias("survivors"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("spread"), F.max(v).alias("worst"))


@dataclass(frozen=True)
class Gate:
    passed: bool
    reasons: tuple[str, ...]


def gate(ours: Mapping[str, float], reference: Mapping[str, float], overlap: float, shortfall: float = 0.20, least_overlap: float = 0.15) -> Gate:
    """Passes where every task both have is at most the shortfall below the reference and neighbours overlap enough; no task at all fails."""
    tasks = sorted(ours.keys() & reference.keys())
    reasons = [] if tasks else ["no task to compare"]
    for t in tasks:
        short = (reference[t] - ours[t]) / reference[t] if reference[t] > 0 else 0.0
        if short > shortfall:
            reasons.append(f"{t} is {short:.1%} short")
    if overlap < least_overlap:
        reasons.append(f"overlap {overlap:.3f} is below {least_overlap}")
    return Gate(not reasons, tuple(reasons))


def runtime_estimates(spark: SparkSession, stages: Iterable[tuple[str, str, int, int]], rate: float) -> DataFrame:
    """objective, stage, tokens, epochs, hours at a rate of tokens a second."""
    rows = [(o, s, t, e) for o, s, t, e in stages]
    if rate <= 0 or any(t < 0 or e < 0 for _, _, t, e in rows):
        raise ValueError("rates must be above 0, tokens and epochs not below")
    return spark.createDataFrame(rows, "objective string, stage string, tokens long, epochs long").withColumn("hours", F.col("tokens") * F.col("epochs") / F.lit(rate * 3600.0))
