"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class from the start; only classes are hashed. Each table takes BITS signs, so a class is in as many
buckets as there are tables. Within a bucket, pairs are screened by a longer sign code; rows without any
partner there drop out before the vectors are attached. A pair counts in the first table in which it meets; the rest is compared exactly, in blocks, and give counts and a spanning forest of links: never a
row for each pair.

Projections are sums of integers below 2**53 and so do not depend on the order of addition: codes are the
same wherever and however often they are computed.

Found share: a pair of cosine c agrees on a sign with probability p = 1 - arccos(c) / pi, so it meets with
probability 1 - (1 - p**bits)**tables; tables is the least number that makes this RECALL at the threshold
itself, and pairs above it are found more often. bits is the base-2 logarithm of the rows, between 10 and 30, so that
unrelated vectors share buckets of a few rows at any size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths neither; equal rows link with each other; rows with an equal vec_id are vectors of
their own, in links and in components too; vectors are scaled by their largest component first, so tiny and huge ones keep double precision; rows without vec_id link with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cells, in_groups, least_joined, pairs
from .common import components, giving_back, written

THRESHOLD, RECALL = 0.9, 0.99
SCREEN_BITS, SCREEN_SIGMAS, SEED = 128, 5.0, 11


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(30, max(10, math.ceil(math.log2(max(rows, 2)))))
    p = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def most_apart(threshold: float) -> int:
    """Signs of the screen in which a pair at the threshold differs, and five standard deviations more."""
    q = math.acos(threshold) / math.pi
    return math.ceil(SCREEN_BITS * q + SCREEN_SIGMAS * math.sqrt(SCREEN_BITS * q * (1 - q)))


class Signs:
    def __init__(self, bits: int, tables: int, seed: int = SEED):
        self.bits, self.tables, self.seed, self.planes = bits, tables, seed, {}

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        n = vectors.shape[1]
        if n not in self.planes:
            self.planes[n] = np.rint(np.random.default_rng([self.seed, n]).normal(size=(n, self.bits * self.tables + SCREEN_BITS)) * 256)
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return np.rint(unit * 2**24) @ self.planes[n] > 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One number for each table."""
        s = self.signs(vectors)[:, : self.bits * self.tables].reshape(len(vectors), self.tables, self.bits)
        return s @ (1 << np.arange(self.bits, dtype=np.int64))

    def screen(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits(self.signs(vectors)[:, self.bits * self.tables :], axis=1)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in series]) if len(series) else np.zeros((0, 1))


def _hash(signs: Signs):
    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(frame["vector"].map(len)):
                v = _matrix(part["vector"])
                screen = [x.tobytes() for x in signs.screen(v)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "width": v.shape[1], "codes": list(signs.codes(v)), "screen": screen})

    return run


def _screen(apart: int):
    """Rows of a cell that have a partner within reach of the screen."""

    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        code = np.frombuffer(b"".join(frame["screen"]), np.uint64).reshape(len(frame), -1)
        use = np.zeros(len(frame), bool)
        for a, b in pairs(starts, frame["side"].to_numpy()):
            near = np.bitwise_count(code[a] ^ code[b]).sum(axis=1) <= apart
            use[a[near]] = use[b[near]] = True
        yield frame.loc[use, ["width", "table", "code", "cell", "side", "node"]]

    return run


def _verify(signs: Signs, threshold: float):
    """Exact cosines: for each node of a cell the rows it links to, and a spanning forest of the links.

    A pair counts in the first table in which it meets.
    """

    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        size, node, table = (frame[x].to_numpy() for x in ("size", "node", "table"))
        links, ends = np.zeros(len(frame), np.int64), []
        for width in np.unique(frame["width"]):
            own = np.flatnonzero(frame["width"].to_numpy() == width)  # rows are sorted by width, so groups stay together
            v = _matrix(frame["vector"].iloc[own])
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            codes = signs.codes(v)
            for a, b in pairs(starts[np.isin(starts, own)] - own[0], frame["side"].to_numpy()[own]):
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[near], b[near]
                first = (codes[a] == codes[b]).argmax(axis=1) == table[own[a]]
                a, b = own[a[first]], own[b[first]]
                np.add.at(links, a, size[b])
                np.add.at(links, b, size[a])
                ends.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, int),) * 2
        label = least_joined(len(frame), a, b)
        use = links > 0
        yield pd.DataFrame({"node": node[use], "to": node[label[use]], "links": links[use]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    odd = F.coalesce(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    fit = ~odd & F.exists("vector", lambda x: x != 0)
    # Classes of equal vectors; the digest is of the bytes of all components, with -0.0 as 0.0.
    digest = F.when(fit & F.col("vec_id").isNotNull(), F.unhex(F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("array<string>"), " "), F.lit("utf-8")), 256)))
    rows = written(rows.withColumn("digest", digest))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.any_value("vector").alias("vector"))
    # Nodes are numbered: ids may repeat with unlike vectors. The numbers are written, so they stay.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    bits, tables = plan(classes.count(), threshold, recall)
    signs = Signs(bits, tables)
    hashed = written(classes.select("node", "vector").mapInPandas(_hash(signs), "node long, width int, codes array<long>, screen binary"))
    spread = hashed.select("node", "width", "screen", F.posexplode("codes").alias("table", "code"))
    met = cells(spread, ["width", "table", "code"], "node")
    spot = ["width", "table", "code", "cell"]
    partners = written(in_groups(met, spot, _screen(most_apart(threshold)), "width int, table int, code long, cell long, side int, node long"))
    found = written(in_groups(partners.join(classes.select("node", "vector", "size"), "node"), spot, _verify(signs, threshold), "node long, to long, links long"))
    label = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    label = written(label.unionAll(label.select("component", "component").distinct()))  # the least node has no row of its own
    least = written(label.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("joined")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "node", "least", "size").join(links, "node", "left").join(label.join(least, "component").select("node", "joined"), "node", "left")
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.coalesce("joined", "least", "vec_id")
    return out.select("vec_id", (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
