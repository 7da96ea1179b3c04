"""Removal of long repeated spans of words, by a de Bruijn graph of word k-mers that is compacted with Spark joins.

A span is removed when the same window of `window` consecutive words also starts in a document with a smaller
doc_id. A row for each word would be the corpus over again, so the graph is built where something repeats only:

1. Regions. In each window the k-mer of words with the least hash is its anchor. Equal windows have equal anchors, so a window
   whose anchor is in one document only is not repeated; the others make up regions of their documents.
2. Edges. In the regions k-mers are sampled densely (the least of every SAMPLE in a row). A sampled k-mer is a node, and the words from it to
   the next sampled one, k-mer by k-mer, are an edge, named by their hash.
3. Compaction. A join of the nodes with their neighbours shows where a node always continues by one edge, and arrives by one edge: such
   edges are nonbranching, and the components that they form, found by further joins, are the compacted paths. Every document that has one node of a path has all of
   it, so the least document of the path is that of each window inside.
4. Coordinates. Each occurrence of a path gives its coordinates (document, place, length) and a 128-bit hash of its words there. A path counts if all its
   coordinates agree; then it goes from all documents but the least.
5. Windows that no such path holds (near an edit, or the first and last few words of a passage) are looked up one by one, by a 128-bit
   hash, with their coordinates.

Copies of a whole document are settled beforehand by the digest of their words. 64-bit hashes of words and k-mers steer; what is
removed rests on 128 bits made from 64-bit hashes of the words.

Defined results: a null text has no words; texts shorter than the window lose
nothing; of equal documents the one with the least doc_id counts as the source; rows with an equal doc_id are
one document to each other (neither removes from the other); rows without doc_id are neither source nor cut;
empty tables give no rows; other columns are ignored. In remove_repeats() what stays of a text keeps its line breaks, a text that loses nothing
stays as it is, and a column n_chars follows the text where that changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free, giving_back, written
from .runs import Buffer, batches, mixed

WINDOW, K, SAMPLE = 50, 10, 8
#: Of the running sums; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of the hashes: which k-mer is least, names of anchors, nodes and edges, and the two halves of a window's and of a path's 128 bits.
LEAST, ANCHOR, NODE, HALVES = 1, 3, 7, (4, 5)
JUDGED = "place length doc_id t a b path first held"


def words_of(texts: list[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words."""
    for some in batches(texts):
        text = Buffer(some)
        if lower:
            text.lower()
        start, end = text.words()
        yield from np.split(text.hashes(start, end, both=False)[0], np.cumsum(text.per_text(start))[:-1])


@lru_cache(256)
def odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The hash of each run of n words, from the word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i, c in enumerate(odd(seed, n)):
        out += h[i : len(h) - n + 1 + i] * c
    return mixed(out)


def least_of(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each run of n k-mers the place of the least."""
    m = grams(h, k, LEAST)
    if len(m) < n:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(m, n)
    return np.argmin(views, axis=1) + np.arange(len(views))


class Sums:
    """Hashes of any run of words, as differences of running sums."""

    def __init__(self, h: np.ndarray):
        self.h = h
        powers, back = np.full(len(h) + 1, BASE, np.uint64), np.full(len(h) + 1, pow(int(BASE), -1, 2**64), np.uint64)
        powers[0] = back[0] = 1
        self.powers, self.back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def runs(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """The hash of the words from each start to its end. Seeds give independent hashes."""
        h = mixed(self.h ^ odd(seed, 1)[0]) if seed else self.h
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.powers[:-1], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digests(window: int, k: int):
    """n_words, sha256 of the words, and the names of the document's anchors, each once."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            texts = frame["text"].tolist()
            for text, h in zip(texts, words_of(texts), strict=True):
                at = np.unique(least_of(h, window - k + 1, k))
                names = np.unique(grams(h, k, ANCHOR)[at]) if len(at) else np.zeros(0, np.uint64)
                out.append((len(h), hashlib.sha256(b" ".join(text.encode().split()) if text else b"").hexdigest(), _signed(names)))
            yield pd.concat([frame[["doc_id", "t"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "sha", "anchors"])], axis=1)

    return run


def _regions(window: int, k: int):
    """From a text and its repeated anchors: the regions of windows with such an anchor, as first words, numbers of words, and the words' hashes."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, h in zip(frame.itertuples(index=False), words_of(frame["text"].tolist()), strict=True):
                own = np.isin(grams(h, k, ANCHOR)[least_of(h, window - k + 1, k)], np.asarray(row.anchors, np.int64).view(np.uint64))
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, np.flatnonzero(own), 1)
                np.add.at(cover, np.flatnonzero(own) + window, -1)
                used = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
                start, end = np.flatnonzero(used[1:] & ~used[:-1]), np.flatnonzero(~used[1:] & used[:-1])
                out.append((row.doc_id, row.t, start.astype(np.int32), (end - start).astype(np.int32), _signed(h[used[1:-1]])))
            yield pd.DataFrame(out, columns=["doc_id", "t", "starts", "sizes", "words"])

    return run


def _each(row) -> Iterator[tuple[int, np.ndarray]]:
    """The regions of a document: place of the first word, hashes of the words."""
    h = np.asarray(row.words, np.int64).view(np.uint64)
    ends = np.cumsum(row.sizes)
    return zip(np.asarray(row.starts).tolist(), np.split(h, ends[:-1]), strict=True)


def _table(names: str, parts: list[tuple]) -> Iterator[pd.DataFrame]:
    """One frame from parts, each a tuple of equally long arrays (or a value for all of the part's rows), the first an array."""
    if parts:
        whole = [[x if isinstance(x, np.ndarray) else np.full(len(row[0]), x) for x in row] for row in parts]
        yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(names.split(), zip(*whole, strict=True), strict=True)})


def _nodes(k: int, sample: int):
    """The sampled k-mers of the regions: place, name, the edges before and after (0: none), and the next node."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for first, h in _each(row):
                    at = np.unique(least_of(h, sample, k))
                    names = _signed(grams(h, k, NODE)[at])
                    edges = np.concatenate([[0], _signed(Sums(h).runs(at[:-1], at[1:] + k)), [0]])
                    out.append(((at + first).astype(np.int32), row.doc_id, row.t, names, edges[:-1], edges[1:], np.append(names[1:], 0)))
            yield from _table("place doc_id t node before after next", out)

    return run


def _judge(window: int, k: int, sample: int):
    """From a document's regions and its repeated nodes: occurrences of paths (held) that hold a window, and the windows to look up.

    A window is asked for if all sampled k-mers that it determines by itself are repeated.
    """
    short = sample + k - 1

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                order = np.argsort(row.place)
                place, path, source, onward, inward = (np.asarray(x)[order] for x in (row.place, row.path, row.first, row.onward, row.inward))
                for first, h in _each(row):
                    of = least_of(h, sample, k)
                    at = np.unique(of)
                    i = np.searchsorted(place, at + first)
                    known = i < len(place)
                    known[known] = place[i[known]] == at[known] + first
                    i = np.where(known, i, 0)
                    joined = known[1:] & known[:-1] & onward[i[:-1]] & inward[i[1:]]  # the edge after each node is nonbranching
                    run_of = np.concatenate([[0], np.cumsum(~joined)])
                    low, high = np.searchsorted(run_of, run_of, "left"), np.searchsorted(run_of, run_of, "right") - 1
                    start, end = at[low], at[high] + k
                    sums = Sums(h)
                    use = np.flatnonzero((low == np.arange(len(at))) & known & (end - start >= window))
                    if len(use):
                        a, b = (sums.runs(start[use], end[use], seed) for seed in HALVES)
                        out.append(_row(row, start[use] + first, end[use] - start[use], a, b, path[i[use]], source[i[use]]))
                    p = np.arange(len(h) - window + 1)
                    node = np.searchsorted(at, of[p])
                    inside = known[node] & (start[node] <= p) & (p + window <= end[node])
                    lost = np.concatenate([[0], np.cumsum(~known[np.searchsorted(at, of)])])
                    ask = p[~inside & (lost[p + window - short + 1] == lost[p])]
                    if len(ask):
                        a, b = (sums.runs(ask, ask + window, seed) for seed in HALVES)
                        out.append(_row(row, ask + first, np.full(len(ask), window), a, b))
            yield from _table(JUDGED, out)

    return run


def _row(row, place: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, path=0, first=0) -> tuple:
    return place.astype(np.int32), length.astype(np.int32), row.doc_id, row.t, _signed(a), _signed(b), path, first, isinstance(path, np.ndarray)


def _windows(window: int):
    """All windows of some spans (m: place and length) of a document, to be looked up."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                held = {first: h for first, h in _each(row)}
                for span in row.m:
                    first = max(x for x in held if x <= span["place"])
                    ask = np.arange(span["place"] - first, span["place"] - first + span["length"] - window + 1)
                    a, b = (Sums(held[first]).runs(ask, ask + window, seed) for seed in HALVES)
                    out.append(_row(row, ask + first, np.full(len(ask), window), a, b))
            yield from _table(JUDGED, out)

    return run


def _left(n: int, gone) -> np.ndarray:
    """Which of n words stay."""
    hit = np.zeros(n + 1, np.int64)
    place, length = (np.fromiter((x[k] for x in gone), np.int64, len(gone)) for k in ("place", "length"))
    np.add.at(hit, place, 1)
    np.add.at(hit, place + length, -1)
    return np.cumsum(hit[:-1]) == 0


@F.pandas_udf(T.StructType().add("n_removed", T.LongType()).add("sha", T.StringType()))
def _report(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out = []
    for text, spans in zip(texts, gone, strict=True):
        ws = text.encode().split()
        left = _left(len(ws), spans)
        out.append((int((~left).sum()), hashlib.sha256(b" ".join(w for w, x in zip(ws, left, strict=True) if x)).hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "sha"])


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the words of the spans and the blanks after each of them."""
    out = []
    for text, spans in zip(texts, gone, strict=True):
        if text is None or spans is None or not len(spans):
            out.append(text)
            continue
        own = Buffer([text])
        start, end = own.words()
        left = _left(len(start), spans)
        begins = np.append(start, own.size)
        if not left[-1]:
            begins[-1] = own.size
        keep, last = [own.raw[: start[0]]], len(start)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            # Up to the next word, or, where nothing after it stays, to the end of the last word that does.
            keep.append(own.raw[start[a] : begins[b] if b == last or left[b:].any() else end[b - 1]])
        out.append(b"".join(keep).decode() if left.any() else "")
    return pd.Series(out, dtype=object)


def _named(documents: DataFrame) -> DataFrame:
    """t tells rows apart that share a doc_id."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that several documents have, with the least of those, whether a node always continues and arrives by one edge, and its path."""
    least, most = (lambda c, f=f: f(c) for f in (F.min, F.max))
    nodes = rows.groupBy("node").agg(least("doc_id").alias("first"), most("doc_id").alias("last"), (least("after") == most("after")).alias("onward"), (least("before") == most("before")).alias("inward"), least("next").alias("next"))
    nodes = written(nodes.where("first < last").drop("last"))
    to = nodes.where("inward").select(F.col("node").alias("next"))
    edges = nodes.where("onward AND next <> 0").select("node", "next").join(to, "next")
    label = components(edges.select(F.col("node").alias("a"), F.col("next").alias("b")))
    found = nodes.join(label, "node", "left").select("node", "first", "onward", "inward", F.coalesce("component", "node").alias("path"))
    return found, edges


def repeated_spans(documents: DataFrame, window: int = WINDOW, k: int = K, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """A row for each document with doc_id, t, n_words, sha and first (the least doc_id with equal words); and what to remove, arrays gone of (place, length) by (doc_id, t), from documents that are first of their copies."""
    docs = _named(documents)
    seen = written(docs.mapInPandas(_digests(window, k), "doc_id long, t long, n_words long, sha string, anchors array<long>"))
    firsts = written(seen.groupBy("sha").agg(F.min("doc_id").alias("first")))  # written, so that the join may split a hot digest
    digests = written(seen.select("doc_id", "t", "n_words", "sha").join(firsts, "sha"))
    own = digests.where(f"doc_id = first AND n_words >= {window}").select("doc_id", "t").distinct()
    each = seen.join(own, ["doc_id", "t"], "left_semi").select("doc_id", "t", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    marks = each.join(written(twice), "anchor").groupBy("doc_id", "t").agg(F.collect_set("anchor").alias("anchors"))
    regions = written(docs.join(marks, ["doc_id", "t"]).mapInPandas(_regions(window, k), "doc_id long, t long, starts array<int>, sizes array<int>, words array<long>").dropDuplicates(["doc_id", "t"]))
    rows = written(regions.mapInPandas(_nodes(k, sample), "doc_id long, t long, place int, node long, before long, after long, next long"))
    nodes, _ = paths(rows)
    marks = rows.select("doc_id", "t", "place", "node").join(written(nodes), "node").groupBy("doc_id", "t").agg(F.collect_list(F.struct("place", "path", "first", "onward", "inward")).alias("m"))
    judged = regions.join(marks, ["doc_id", "t"]).select("doc_id", "t", "starts", "sizes", "words", "m.place", "m.path", "m.first", "m.onward", "m.inward")
    kinds = "place int, length int, doc_id long, t long, a long, b long, path long, first long, held boolean"
    judged = written(judged.mapInPandas(_judge(window, k, sample), kinds))
    held = judged.where("held")
    odd_ = written(held.groupBy("path").agg(F.min("length").alias("l1"), F.max("length").alias("l2"), F.min("a").alias("a1"), F.max("a").alias("a2"), F.min("b").alias("b1"), F.max("b").alias("b2")).where("l1 <> l2 OR a1 <> a2 OR b1 <> b2").select("path"))
    again = held.join(odd_, "path").groupBy("doc_id", "t").agg(F.collect_set(F.struct("place", "length")).alias("m"))
    again = regions.join(again, ["doc_id", "t"]).mapInPandas(_windows(window), kinds)
    ask = written(judged.where("NOT held").unionAll(again).select("doc_id", "t", "place", "length", "a", "b"))
    least = written(ask.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    found = ask.join(least, ["a", "b"]).where("doc_id > first").select("doc_id", "t", "place", "length")
    sure = held.join(odd_, "path", "left_anti").where("doc_id > first").select("doc_id", "t", "place", "length")
    gone = sure.unionAll(found).groupBy("doc_id", "t").agg(F.collect_set(F.struct("place", "length")).alias("gone"))
    return digests, written(gone)


def span_report(documents: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the digest of the words that stay."""
    digests, gone = repeated_spans(documents, window, k)
    cut = _named(documents).join(gone, ["doc_id", "t"]).select("doc_id", "t", _report("text", "gone").alias("c"))
    cut = cut.select("doc_id", "t", "c.n_removed", F.col("c.sha").alias("left")).dropDuplicates(["doc_id", "t"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= window)
    return digests.join(cut, ["doc_id", "t"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents, all columns, with the repeated spans cut from text. A copy loses all."""
    digests, gone = repeated_spans(documents, window, k)
    copies = digests.where(f"doc_id > first AND n_words >= {window}").select("doc_id", "t", F.lit(True).alias("copy")).distinct()
    doc, t, cut, copy = free(documents, "_doc", "_t", "_gone", "_copy")
    change = gone.join(copies, ["doc_id", "t"], "full").select(F.col("doc_id").alias(doc), F.col("t").alias(t), F.col("gone").alias(cut), F.coalesce("copy", F.lit(False)).alias(copy))
    known = documents.join(change, (documents["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(documents["text"].cast("string")) == F.col(t)), "left")
    text = F.when(F.col(copy), "").otherwise(_cut("text", cut))
    out = known.withColumn("text", text)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(doc).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*documents.columns)
