"""Minimax contiguous partition of ordered atomic groups into shards.

The groups keep their order; a shard is a run of groups. The smallest feasible capacity is found by
binary search with a greedy check, and the cuts are the greedy ones at that capacity.

Only a summary of the ordered groups is ever on the driver: at most RANGES key ranges at a time, each with
its sum, largest group and count. The greedy check runs on that summary twice, once with ranges as
indivisible (then a capacity that fits is feasible) and once with ranges as divisible at will (then one
that does not fit is infeasible). Ranges in which a cut may still fall are split again, by one
aggregation each time, until no cut lies in a range of several groups. The number of passes grows with
the logarithm of the key space, not with the rows.

Defined results: a null text counts as an empty one; rows without doc_id form one group, which comes
first; rows with an equal doc_id stay together; an empty table gives no rows; with fewer groups than
shards the last shards stay empty; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, written

#: Key ranges that a pass makes at most, and that it splits at most.
RANGES, SPLIT = 8192, 128


@dataclass
class Span:
    """Groups with keys from low to high: their total size and that of the largest. Groups of one key are one."""

    low: int
    high: int
    total: int
    largest: int

    def __post_init__(self) -> None:
        if self.low == self.high:
            self.largest = self.total


def walk(spans: list[Span], capacity: int, divisible: bool) -> Iterator[int]:
    """The index of the span in which each greedy shard ends (the first that it doesn't hold whole)."""
    at, left = 0, 0  # left: what of spans[at] earlier shards have taken
    while at < len(spans):
        room = capacity
        while at < len(spans) and spans[at].total - left <= room:
            room -= spans[at].total - left
            at, left = at + 1, 0
        if at < len(spans) and divisible and spans[at].low < spans[at].high:
            left += room
        yield at


def shards_needed(spans: list[Span], capacity: int, divisible: bool, most: int) -> int:
    n, last = 0, -1
    for at in walk(spans, capacity, divisible):
        n += 1
        if n > most or not divisible and at == last and at < len(spans):
            return most + 1  # a range that does not fit as a whole stops the indivisible walk
        last = at
    return n


def least_capacity(spans: list[Span], most: int, divisible: bool) -> int:
    """Binary search with the greedy check."""
    total, largest = sum(s.total for s in spans), max(s.largest for s in spans)
    low, high = max(largest, -(-total // most)), total
    while low < high:
        mid = (low + high) // 2
        if shards_needed(spans, mid, divisible, most) <= most:
            high = mid
        else:
            low = mid + 1
    return low


def unsettled(spans: list[Span], low: int, high: int, most: int) -> list[int]:
    """The first spans in which a greedy cut may fall for a capacity from low to high, and that can be split."""
    first = []
    for at in walk(spans, low, False):
        first.append(at)
        if len(first) > 1 and at == first[-2] or len(first) == most:
            break  # a range that does not fit as a whole: what lies after it waits until it is split
    last = [at for at, _ in zip(walk(spans, high, True), range(len(first)), strict=False)]
    last += [len(spans)] * (len(first) - len(last))
    stuck = len(first) > 1 and first[-1] == first[-2]
    if stuck:
        last[-1] = first[-1]
    if first and first[0] == 0 and spans[0].total > low:
        first, last = [0], [0]
    marked = sorted({i for a, b in zip(first, last, strict=True) for i in range(a, min(b, len(spans) - 1) + 1) if spans[i].low < spans[i].high})
    return marked[:SPLIT]


def minimax_cuts(units: DataFrame, shards: int) -> tuple[int, list[int]]:
    """units: key (long), size; units of one key stay together. Gives the least capacity and the first key of each shard but the first."""
    total = units.agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size")).first()
    if total[0] is None:
        return 0, []
    spans = [Span(*total)]
    while True:
        low, high = least_capacity(spans, shards, True), least_capacity(spans, shards, False)
        marked = unsettled(spans, low, high, shards)
        if not marked:
            break
        parts, branch = RANGES // len(marked), None
        for i in marked:
            width = -(-(spans[i].high - spans[i].low + 1) // parts)
            part = F.floor((F.col("key").cast("decimal(20,0)") - F.lit(str(spans[i].low)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)"))
            place = F.struct(F.lit(i).alias("span"), part.cast("long").alias("part"))
            inside = F.col("key").between(spans[i].low, spans[i].high)
            branch = F.when(inside, place) if branch is None else branch.when(inside, place)
        found = units.select(branch.alias("at"), "key", "size").where("at IS NOT NULL").groupBy("at").agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size")).coalesce(1).collect()
        finer: dict[int, list[Span]] = {}
        for row in found:
            finer.setdefault(row[0][0], []).append(Span(*row[1:]))
        for i in reversed(marked):
            spans[i : i + 1] = sorted(finer[i], key=lambda s: s.low)
    return high, [spans[at].low for at in walk(spans, high, True) if at < len(spans)]


def shard(documents: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Puts every row into one of the shards, equal texts together, with the largest shard as small as can be.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, shard and slot (gapless from 0, in the order of
    groups and then of ids). Groups are in the order of their least doc_id. The texts themselves are read
    once and never shuffled; a text's digest stands for it.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = written(documents.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("_digest")))
    groups = rows.groupBy("_digest").agg(F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("_key"), F.sum("size").alias("_size"))
    groups = written(groups)
    _, cuts = minimax_cuts(groups.select(F.col("_key").alias("key"), F.col("_size").alias("size")), shards)
    number = reduce(add, ((F.col("_key") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = rows.join(groups.select("_digest", "_key"), "_digest").withColumn("shard", number)
    ranked = in_order(placed, "_key", "doc_id", "_digest")
    starts = ranked.groupBy("shard").agg(F.min("_rank").alias("_start")).coalesce(1)  # as many rows as shards
    return ranked.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_start")).alias("slot"))
