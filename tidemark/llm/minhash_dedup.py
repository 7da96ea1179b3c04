"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join, links confirmed on full sets.

A signature has SYMBOLS symbols of BITS bits; two sets of similarity J differ in a symbol with probability
(1 - J)(1 - 2**-BITS). The join finds every pair of signatures that differ in at most `apart` symbols: the signature is split into
chunks, so many that by pigeonhole some chunk holds at most ERRORS of the differences, and each chunk is
indexed once for each choice of the ERRORS symbols that may be wrong. `apart` is the least distance that a
pair at the threshold exceeds with probability below MISS.

Documents with equal sets are one class, and only classes are joined. Links are confirmed in two rounds:

1. In each bucket of the index, everyone with the bucket's center, the node that shares most keys with others (the
   original of a group of edited copies, say). These pairs are as many as the index rows
   at most, whatever the size of the bucket. Components are built from the links found.
2. Buckets whose rows are not in one component yet: all pairs across components, in blocks (no pair is a row).

So no link between components is lost, and a group of many near copies costs rows in proportion to its size.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text of fewer
words than a shingle is one shingle; texts of any length are read whole; rows with an equal doc_id are
each given a result by their own text, in links and in components too (in the pipeline's stage one row of a component stays, and of rows without
words all); rows without doc_id link with nothing and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cells, in_groups, pairs
from .common import components, free, giving_back, written
from .runs import mixed
from .spans import grams, odd, words_of

SHINGLE, SYMBOLS, BITS, ERRORS, MISS, SEED = 5, 32, 16, 1, 2e-5, 23
BLOCK = 512


def apart(percent: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    q = (1 - percent / 100) * (1 - 2.0**-BITS)
    mass = [math.comb(symbols, i) * q**i * (1 - q) ** (symbols - i) for i in range(symbols + 1)]
    return next(t for t in range(symbols + 1) if sum(mass[t + 1 :]) <= miss)


@lru_cache
def index_parts(distance: int, symbols: int = SYMBOLS, errors: int = ERRORS) -> tuple[tuple[int, ...], ...]:
    """The symbols of each index key: for every chunk, all but `errors` of its symbols, in every way."""
    chunks = distance // (errors + 1) + 1
    cuts = [symbols * i // chunks for i in range(chunks + 1)]
    return tuple(part for a, b in itertools.pairwise(cuts) for part in itertools.combinations(range(a, b), max(1, b - a - errors)))


def shingles(texts: list[str | None], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for h in words_of(texts, lower=True):
        if 0 < len(h) < n:
            yield mixed((h * odd(99, n)[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
        else:
            yield np.unique(grams(h, n, 6))


def signature(s: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each hash function the low bits of the least value's mix."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(s), 8192):
        least = np.minimum(least, (s[part : part + 8192, None] * factors + offsets).min(axis=0))
    return (mixed(least) & np.uint64(2**BITS - 1)).astype(np.uint16)


def _sign(n: int):
    factors, offsets = odd(SEED, SYMBOLS), odd(SEED + 1, SYMBOLS)

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s in shingles(frame["text"].tolist(), n):
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s, factors, offsets).tobytes()) if len(s) else (0, None, None))
            rest = pd.DataFrame(out, columns=["n_shingles", "digest", "sig"])
            yield pd.concat([frame[["doc_id", "t"]].reset_index(drop=True), rest], axis=1)

    return run


def _keys(parts: tuple[tuple[int, ...], ...]):
    """A key for each part of the index: a hash of the part's number and symbols."""
    factor = odd(SEED + 2, SYMBOLS)

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), -1).astype(np.uint64) + np.uint64(1)
            keys = [mixed((sig[:, p] * factor[list(p)]).sum(axis=1, dtype=np.uint64) + np.array([i], np.uint64) * factor[:1]) for i, p in enumerate(parts)]
            yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), len(parts)), "key": np.stack(keys, axis=1).ravel().view(np.int64), "part": np.tile(np.arange(len(parts), dtype=np.int32), len(frame))})

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _distance(x: pd.Series, y: pd.Series) -> np.ndarray:
    one, two = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (x, y))
    return (one != two).sum(axis=1)


def _near(distance: int):
    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_distance(x, y) <= distance)

    return near


def _confirm(n: int, percent: int):
    """Pairs (a, b, text_a, text_b), in order of a, that are similar."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for frame in frames:
            use = []
            for a, x, y in zip(frame["a"], frame["text_a"], frame["text_b"], strict=True):
                if a != last:
                    last, own = a, next(shingles([x], n))
                use.append(similar(own, next(shingles([y], n)), percent))
            yield frame.loc[use, ["a", "b"]]

    return run


def _meet(sig: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs have near signatures and meet in this part of the index first; a pair counts there only."""
    same = sig[a] == sig[b]
    near = np.flatnonzero(sig.shape[1] - same.sum(axis=1) <= distance)
    alike = np.stack([same[near][:, list(p)].all(axis=1) for p in index_parts(distance)])
    out = np.zeros(len(a), bool)
    out[near] = alike.argmax(axis=0) == part[a[near]]
    return out


def _reach(distance: int):
    """Rows of a cell with a near signature in another component; the others need no text."""

    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), -1)
        label, part, use = frame["label"].to_numpy(), frame["part"].to_numpy(), np.zeros(len(frame), bool)
        for a, b in pairs(starts, frame["side"].to_numpy()):
            apart_ = label[a] != label[b]
            a, b = a[apart_], b[apart_]
            near = _meet(sig, part, a, b, distance)
            use[a[near]] = use[b[near]] = True
        yield frame.loc[use, ["key", "part", "cell", "side", "node", "label", "sig"]]

    return run


def _across(n: int, percent: int, distance: int):
    """Links between rows of a cell that are in different components, as a spanning forest."""

    def run(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), -1)
        node, sets, found = frame["node"].to_numpy(), {}, []
        label, part = frame["label"].to_numpy().copy(), frame["part"].to_numpy()
        for a, b in pairs(starts, frame["side"].to_numpy()):
            apart_ = label[a] != label[b]
            a, b = a[apart_], b[apart_]
            near = _meet(sig, part, a, b, distance)
            for i, j in zip(a[near], b[near], strict=True):
                if label[i] == label[j]:
                    continue
                for x in (i, j):
                    if node[x] not in sets:
                        sets[node[x]] = next(shingles([frame["text"].iloc[x]], n))
                if similar(sets[node[i]], sets[node[j]], percent):
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _components(documents: DataFrame, percent: int, n: int) -> DataFrame:
    """For every row doc_id, t (which tells rows apart that share a doc_id), n_shingles, and source: the least (doc_id, t) of its component, null without one."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    signed = written(docs.mapInPandas(_sign(n), "doc_id long, t long, n_shingles long, digest binary, sig binary"))
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("source"), F.any_value("sig").alias("sig"))
    # Nodes are numbered: ids may repeat with unlike texts. The numbers are written, so they stay.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    label = components(find_links(docs, classes.select("node", "sig", "source"), percent, n))
    label = written(label.unionAll(label.select("component", "component").distinct()))  # the least node has no row of its own
    least = label.join(classes, "node").groupBy("component").agg(F.min("source").alias("source"))
    joined = label.join(written(least), "component").select("node", F.col("source").alias("joined"))
    found = classes.join(joined, "node", "left").select("digest", F.coalesce("joined", "source").alias("source"))
    return signed.select("doc_id", "t", "n_shingles", "digest").join(written(found), "digest", "left").drop("digest")


def near_documents(documents: DataFrame, percent: int = 85, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: links of at least percent similarity."""
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("source.doc_id", "doc_id"))
    return _components(documents, percent, n).select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def find_links(docs: DataFrame, nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) between nodes (node, sig, and the source (doc_id, t) of a text) that join all that are linked."""
    distance = apart(percent)
    keys = nodes.mapInPandas(_keys(index_parts(distance)), "node long, key long, part int")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = written(keys.join(shared, "key"))
    degree = index.groupBy("node").agg(F.sum("n").alias("degree"))
    center = index.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("c")).select("key", (-F.col("c.minus")).alias("center"))
    star = index.join(center, "key").where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    star = written(star.where(_near(distance)("sig_a", "sig_b")).select("a", "b"))
    # Of the texts only those that a round may compare; they are written once, and read by both rounds.
    met = nodes.join(index.select("node").distinct(), "node", "left_semi").select("node", "source.doc_id", "source.t")
    texts = written(docs.join(met, ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"]))
    nodes = nodes.drop("source")
    sided = star.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    first = written(sided.sortWithinPartitions("a").mapInPandas(_confirm(n, percent), "a long, b long"))
    label = written(components(first))
    labelled = index.select("key", "part", "node").join(label, "node", "left").select("key", "part", "node", F.coalesce("component", "node").alias("label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("key")
    rest = cells(labelled.join(open_, "key"), ["key"], "node", BLOCK).join(nodes, "node")
    rest = written(in_groups(rest, ["key", "cell"], _reach(distance), "key long, part int, cell long, side int, node long, label long, sig binary"))
    across = in_groups(rest.join(texts, "node"), ["key", "cell"], _across(n, percent, distance), "a long, b long")
    return written(first.unionAll(across))


def drop_near_documents(documents: DataFrame, percent: int = 80, n: int = SHINGLE) -> DataFrame:
    """The documents, all columns, of each component the row with the least doc_id."""
    found = written(_components(documents, percent, n).withColumn("first", F.coalesce(F.struct("doc_id", "t") == F.col("source"), F.lit(True))))
    doc, t = free(documents, "_doc", "_t")
    text = F.xxhash64(documents["text"].cast("string"))
    gone = found.where("doc_id IS NOT NULL AND NOT first").select(F.col("doc_id").alias(doc), F.col("t").alias(t)).distinct()
    left = documents.join(gone, (documents["doc_id"].cast("long") == F.col(doc)) & (text == F.col(t)), "left_anti")
    # Rows alike in id and text are one component; where there are such, one of them stays.
    alike = found.where("doc_id IS NOT NULL AND first AND source IS NOT NULL").groupBy("doc_id", "t").count().where("count > 1")
    if not alike.limit(1).count():
        return left
    alike = written(alike.select(F.col("doc_id").alias(doc), F.col("t").alias(t)))
    same = (documents["doc_id"].cast("long") == F.col(doc)) & (text == F.col(t))
    once = left.join(alike, same, "left_semi").withColumn(t, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", t]).drop(t)
    return left.join(alike, same, "left_anti").unionByName(once)
