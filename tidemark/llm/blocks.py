"""Self-joins within buckets, in blocks: no bucket is one task's work and no pair is a row.

A bucket of more than `block` rows is dealt over its blocks, and every two blocks of it (and each with itself)
make a cell. A row goes to each cell of its block, so a cell holds 2 * block rows at most, and any two rows of a
bucket meet in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

BLOCK, PAIRS = 1024, 200_000


def cells(rows: DataFrame, bucket: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """Rows with the columns of bucket and node. Buckets of one row go; the others get columns cell and side.

    Bucket sizes are counted before the shuffle. In a cell of two blocks side (0 or 1) tells them apart; in a cell of one block it is 0.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = rows.join(sizes, bucket).withColumn("_blocks", F.ceil(F.col("_n") / block))
    met = met.withColumn("_own", F.pmod(F.xxhash64(node, F.lit(7)), "_blocks"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return met.withColumn("cell", low * F.col("_blocks") + high).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_n", "_blocks", "_own", "_other")


def in_groups(df: DataFrame, keys: list[str], body: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """body(frame, starts) over frames of whole groups; starts: the first row of each. Many small groups share a frame."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            if len(frame):
                frame = pd.concat([*rest, frame], ignore_index=True)
                k = frame[keys].to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
                last = starts[-1]
                rest = [frame.iloc[last:].reset_index(drop=True)]
                if last:
                    yield from body(frame.iloc[:last], starts[:-1])
        if rest:
            yield from body(rest[0], np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def pairs(starts: np.ndarray, side: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within groups, some at a time; in groups of two sides only across."""
    ends = np.append(starts[1:], len(side))
    size = np.repeat(ends - starts, ends - starts)
    at = np.arange(len(side))
    after = np.repeat(ends, ends - starts) - at - 1  # rows of the group after this one
    two = np.repeat(np.add.reduceat(side, starts) > 0, ends - starts) & (size > 0)
    done = np.cumsum(after)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + most, "right")))
        n = after[low:high]
        a = np.repeat(at[low:high], n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        use = ~two[a] | (side[a] != side[b])
        yield a[use], b[use]
        low = high


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the least number that links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
