"""Packing of documents into sequences by non-negative least squares over length combinations.

A task packs the documents it reads, some millions of ids at a time. What is longer than a sequence is cut; the
remainders are counted in a histogram of GRID-wide bins. Every combination of at most DEPTH bins that fills a
sequence is a strategy, and non-negative least squares finds how often to use each so that the histogram is
matched. The counts are rounded down and carried out while documents last. Residual documents fill, cut where
needed, the few ids that binning leaves free in those sequences, then sequences of their own; the end is cut into
powers of two, which need no padding.

No row is shuffled and the memory of a task is bounded by WINDOW ids and the longest document.

Defined results: a null text is empty and holds the end id only; rows with an equal doc_id are packed each for
itself; an empty table gives no rows; other columns are ignored. Which documents share a sequence depends on how the
input is split into tasks; every id is in exactly one piece in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back
from .tokens import crc32, encoder

SEQUENCE, GRID, DEPTH, WINDOW = 4096, 64, 3, 8_000_000


def strategies(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write bins as a sum of at most depth positive numbers, largest first."""

    def parts(total: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if total == 0:
            yield ()
        elif left:
            for first in range(min(total, most), 0, -1):
                for rest in parts(total - first, first, left - 1):
                    yield (first, *rest)

    return list(parts(bins, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance * scale:
            break
        passive[best] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (z <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x += step * (z - x)
            passive &= x > tolerance
            x[~passive] = 0
        x = z
    return x


class Packer:
    """Turns document lengths into pieces (document, start, length, sequence, offset)."""

    def __init__(self, sequence: int = SEQUENCE, grid: int = GRID, depth: int = DEPTH):
        self.sequence, self.grid, self.next = sequence, grid, 0
        self.bins = sequence // grid
        self.ways = strategies(self.bins, depth)
        self.matrix = np.zeros((self.bins, len(self.ways)))
        for j, way in enumerate(self.ways):
            for b in way:
                self.matrix[b - 1, j] += 1

    def pack(self, lengths: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        full: list[tuple[int, int, int, int, int]] = []
        stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(self.bins + 1)]
        for d, n in enumerate(lengths.tolist()):
            for start in range(0, n - self.sequence + 1, self.sequence):
                full.append((d, start, self.sequence, self._new(), 0))
            if rest := n % self.sequence:
                stacks[-(-rest // self.grid)].append((d, n - rest, rest))
        counts = np.array([len(s) for s in stacks[1:]], float)
        planned: list[list[tuple[int, int, int]]] = []
        for j in np.argsort(-(solved := np.floor(nnls(self.matrix, counts) + 1e-6)), kind="stable"):
            way = self.ways[j]
            for _ in range(int(solved[j])):
                if any(len(stacks[b]) < way.count(b) for b in set(way)):
                    break
                planned.append([stacks[b].pop() for b in way])
        # The longest residual documents are at the end, and so come first.
        residual = [piece for s in stacks for piece in s]
        pieces, i, last = full, 0, len(planned)
        while i < last:
            room = self.sequence - sum(n for _, _, n in planned[i])
            while room and (residual or last - 1 > i):
                if not residual:  # a planned sequence is given up for the others' free places
                    last -= 1
                    residual += planned[last]
                d, start, n = residual.pop()
                planned[i].append((d, start, min(n, room)))
                if n > room:
                    residual.append((d, start + room, n - room))
                room -= min(n, room)
            if room:
                break
            pieces += self._placed(planned[i])
            i += 1
        residual += [piece for row in planned[i:last] for piece in row]
        left = sum(n for _, _, n in residual)
        sizes = [self.sequence] * (left // self.sequence) + [1 << k for k in range(self.sequence.bit_length() - 1, -1, -1) if left % self.sequence >> k & 1]
        for size in sizes:
            row = []
            while size:
                d, start, n = residual.pop()
                row.append((d, start, min(n, size)))
                if n > size:
                    residual.append((d, start + size, n - size))
                size -= min(n, size)
            pieces += self._placed(row)
        return pieces

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _placed(self, row: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        number, at = self._new(), 0
        for d, start, n in row:
            yield d, start, n, number, at
            at += n


def _pack(path: str, blanks: bool, sequence: int, with_ids: bool):
    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, packer, held, size, base = encoder(path, blanks), Packer(sequence), [], 0, None

        def out() -> pd.DataFrame:
            pieces = packer.pack(np.array([len(x[1]) for x in held], np.int64))
            rows = []
            for d, start, n, number, at in pieces:
                doc, ids = held[d]
                part = ids[start : start + n]
                rows.append((doc, start, n, crc32(part), len(ids), base + number, at, *([part.astype(np.int32)] if with_ids else [])))
            made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])
            made["doc_id"] = made["doc_id"].astype("Int64")
            return made

        try:
            for frame in frames:
                for doc, serial, ids in zip(frame["doc_id"], frame["serial"], own.documents(frame["text"].tolist()), strict=True):
                    base = serial if base is None else base
                    held.append((doc, ids))
                    size += len(ids)
                    if size >= WINDOW:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()
        finally:
            own.clear()

    return run


def pack(documents: DataFrame, tokenizer: str, blanks: bool = False, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row for each piece; sequence_id is unique in the result. with_ids adds the piece's ids.

    A task numbers its sequences from its first row's serial number, which no other task's rows share; it has
    fewer than 2**33 rows and sequences.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("serial"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return docs.mapInPandas(_pack(tokenizer, blanks, sequence, with_ids), schema)
