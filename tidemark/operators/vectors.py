"""Cosine neighbours, purity, overlap, pooling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """1 for a zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


#: Bytes of queries that are sent to all tasks at once; more of them go in turns, each a pass over the space.
QUERY_BYTES = 64_000_000
#: Bytes of similarities that a task holds at once, whatever the number of queries.
SIMILARITY_BYTES = 32_000_000


def _turns(queries: DataFrame) -> Iterator[list]:
    """Rows whose vectors take at most QUERY_BYTES together."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        held.append(row)
        size += 8 * len(row["vector"])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(space: DataFrame, queries: DataFrame, k: int, id_: str, vector: str) -> DataFrame:
    """query, id, similarity: candidates among which are each query's k most similar ids by cosine.

    queries: query, others (an array of ids that don't count for it) and vector. They go out in blocks of at most QUERY_BYTES. A task
    multiplies each batch of its rows with a slice of the block and keeps the k best for each query and what ties with them.
    """
    spark = space.sparkSession
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, id {space.schema[id_].dataType.simpleString()}, similarity double"
    asked = queries.select("query", "others", F.col("vector").cast("array<double>").alias("vector"))

    def block(rows: list) -> DataFrame:
        known = spark.sparkContext.broadcast(([x["query"] for x in rows], [x["others"] for x in rows], _units([x["vector"] for x in rows])))

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, others, q = known.value
            asked = np.array(asked, dtype=object)
            for frame in frames:
                if not len(frame):
                    continue
                names, where, units = frame[id_].to_numpy(dtype=object), frame.groupby(id_).indices, _units(frame[vector].tolist()).T
                step, kept = max(1, SIMILARITY_BYTES // (8 * len(frame))), min(k, len(frame))
                for low in range(0, len(q), step):
                    sims = q[low : low + step] @ units
                    for i, own in enumerate(others[low : low + step]):
                        for x in own:
                            sims[i, where.get(x, [])] = -np.inf
                    least = np.partition(sims, -kept, axis=1)[:, -kept]
                    i, j = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                    yield pd.DataFrame({"query": asked[low + i], "id": names[j], "similarity": sims[i, j]})

        return space.select(id_, vector).mapInPandas(best, kinds)

    return reduce(DataFrame.unionAll, map(block, _turns(asked)), spark.createDataFrame([], kinds))


def neighbours(space: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For a stated set of queries the k nearest others: query, id, similarity, rank; ties by id."""
    found = matches(space, queries.select(F.col(id_).alias("query"), F.array(id_).alias("others"), F.col(vector).alias("vector")), k, id_, vector)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _units(rows: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def purity(found: DataFrame, labels: DataFrame, id_: str = "vec_id", label: str = "label") -> DataFrame:
    """The mean over queries of the share of neighbours with the query's label."""
    own = labels.select(F.col(id_).alias("query"), F.col(label).alias("_a"))
    other = labels.select(F.col(id_).alias("id"), F.col(label).alias("_b"))
    each = found.join(own, "query").join(other, "id").groupBy("query").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("p"))
    return each.agg(F.avg("p").alias("purity"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The mean share of neighbours that two spaces have in common."""
    sets = lambda d, n: d.groupBy("query").agg(F.collect_set("id").alias(n))
    return sets(a, "_a").join(sets(b, "_b"), "query").agg((F.avg(F.size(F.array_intersect("_a", "_b"))) / k).alias("overlap"))


def mean_pool(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """The (weighted) mean vector of each key: one partial sum per component, so no vector list is gathered."""
    parts = rows.select(key, (F.lit(1.0) if weight is None else weight).alias("_w"), F.posexplode(vector).alias("dim", "x"))
    return parts.groupBy(key, "dim").agg(F.try_divide(F.sum(F.col("_w") * F.col("x")), F.sum("_w")).alias("mean"))


def sif_weights(vocab: DataFrame, a: float = 1e-3) -> DataFrame:
    total = vocab.agg(F.sum("count").alias("_t"))
    return vocab.join(F.broadcast(total), F.lit(True)).select("word", (F.lit(a) / (F.lit(a) + F.col("count") / F.col("_t"))).alias("weight"))
