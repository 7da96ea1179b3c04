"""N-best segmentation with an existing piece vocabulary, and decoding.

A text gets one blank in front, blanks become the vocabulary's mark, and characters that are no piece are spelled in bytes. No piece
holds a mark after another character, nor a line break, so the lattice of a text falls into independent
stretches; the best segmentation of the text is the best of each, and the next best ones deviate in the stretches with the
smallest loss. Those are searched by A-star, backwards from the end, with forward Viterbi scores as exact heuristics,
and combined, best first.

A task keeps the best segmentation of stretches it has met, up to KNOWN of them; nothing is shuffled.

Defined results: a null text is empty (one blank); the best segmentation is the forward pass's, and ties after it go to the one that A-star finds first; rows with an equal doc_id are
segmented each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back
from .lattice import MARK, Pieces, astar, pieces, viterbi
from .runs import Buffer, Met, Rows, batches

N_BEST, KNOWN, OPTIONS, LONG = 4, 400_000, 20_000, 1000


class Segmenter:
    def __init__(self, vocabulary: Pieces, n_best: int = N_BEST):
        if vocabulary.crosses:
            raise ValueError("a piece of this vocabulary crosses a mark or a line break")
        self.p, self.n_best = vocabulary, n_best
        self.raw = Rows(np.uint8)
        self.raw.add(np.frombuffer(b"".join(vocabulary.raw), np.uint8), np.fromiter(map(len, vocabulary.raw), np.int64))
        self.clear()

    def clear(self) -> None:
        """Forgets the stretches."""
        self.met, self.ids = Met(KNOWN), Rows(np.int32)
        self.score, self.loss, self.again = np.zeros(2 * KNOWN), np.zeros(2 * KNOWN), np.zeros(2 * KNOWN, bool)
        self.more: dict[bytes, list[tuple[float, np.ndarray]]] = {}

    def _thin(self) -> None:
        """Keeps the stretches that were met again after the texts that brought them."""
        keep = np.flatnonzero(self.again[: self.met.count])
        keep = keep if len(keep) < KNOWN // 2 else keep[:0]
        (one, two), flat, sizes, score, loss = self.met.keys(), self.ids.gather(keep), self.ids.size[keep], self.score[keep], self.loss[keep]
        self.clear()
        self.met.add(one[keep], two[keep])
        self._keep(0, flat, sizes, score, loss)

    def _keep(self, first: int, flat: np.ndarray, sizes: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        last = first + len(sizes)
        if last > len(self.score):
            self.score, self.loss, self.again = (np.concatenate([x, np.zeros(last, x.dtype)]) for x in (self.score, self.loss, self.again))
        self.score[first:last], self.loss[first:last] = score, loss
        self.ids.add(flat, sizes)

    def _learn(self, first: int, new: list[str]) -> None:
        """The best segmentations of new stretches, which are numbered from first on: the usual ones together, very long ones by A-star alone."""
        found, order, score, loss = Rows(np.int32), [], np.zeros(len(new)), np.zeros(len(new))
        usual = [i for i, w in enumerate(new) if len(w) <= LONG]
        for at, best, lost, ids, sizes in viterbi(self.p, [new[i] for i in usual], self.p.scores):
            at = [usual[i] for i in at]
            score[at], loss[at] = best, lost
            found.add(ids, sizes)
            order += at
        for i in sorted(set(range(len(new))) - set(usual)):
            two = astar(self.p, new[i], self.p.scores, max(2, self.n_best))
            score[i], loss[i] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
            found.add(np.array(two[0][1], np.int32), np.array([len(two[0][1])]))
            order.append(i)
        back = np.argsort(order, kind="stable")
        self._keep(first, found.gather(back), found.size[back], score, loss)

    @staticmethod
    def _cut(text: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches: blanks and what follows them, line breaks apart."""
        b = text.bytes[: text.size]
        before = np.concatenate([[0], b[:-1]]) if len(b) else b
        start = np.flatnonzero(text.first() | (b == 10) | (before == 10) | ((b == 32) & (before != 32)))
        return start, np.append(start[1:], text.size)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, float, list[tuple[float, np.ndarray]], bool]]:
        """For each text: the best ids, their score, all of the n best, and whether each of them decodes to the text."""
        for some in batches(texts):
            # The mark and a blank are one in this vocabulary.
            text = Buffer([" " + (t or "").replace(MARK, " ") for t in some])
            start, end = self._cut(text)
            if self.met.count > KNOWN:
                self._thin()
            known = self.met.count
            at, new = self.met.look_up(*text.hashes(start, end))
            if len(new):
                self._learn(known, [self._string(text.raw[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.again[at[at < known]] = True
            low = before = 0
            for n, stop in zip(text.per_text(start).tolist(), text.ends.tolist(), strict=True):
                own = at[low : low + n]
                ids, score, found = self._text(own, start[low : low + n], end[low : low + n], text.raw)
                whole = text.raw[before:stop]
                decodes = all(self.raw.gather(x).tobytes() == whole for _, x in found)
                low, before = low + n, stop
                yield ids, score, found, decodes

    @staticmethod
    def _string(raw: bytes) -> str:
        return raw.decode("utf-8", "surrogatepass").replace(" ", MARK)

    def _text(self, at: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, float, list[tuple[float, np.ndarray]]]:
        ids, total = self.ids.gather(at), float(self.score[at].sum())
        few = min(self.n_best - 1, len(at))
        near = np.sort(np.argpartition(self.loss[at], few - 1)[:few]) if few else np.zeros(0, int)
        options = [self._options(raw[start[i] : end[i]], self.ids.gather(at[i : i + 1])) for i in near]
        size = self.ids.size[at].astype(np.int64)
        ends, out = np.cumsum(size), []
        for lost, choice in combine([[o[0][0] - s for s, _ in o] for o in options], self.n_best):
            made, last = [], 0
            for i, option, c in zip(near, options, choice, strict=True):
                if c:
                    made += [ids[last : ends[i] - size[i]], option[c][1]]
                    last = ends[i]
            out.append((total - lost, np.concatenate([*made, ids[last:]])))
        return ids, total, out

    def _options(self, stretch: bytes, best: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The n best of a stretch, of which the first is the forward pass's; among ties A-star may have put another there."""
        if stretch not in self.more:
            if len(self.more) > OPTIONS:
                self.more.clear()
            found = astar(self.p, self._string(stretch), self.p.scores, self.n_best)
            first = tuple(best.tolist())
            found = [(found[0][0], first), *[x for x in found if x[1] != first]][: self.n_best]
            self.more[stretch] = [(s, np.array(x, np.int32)) for s, x in found]
        return self.more[stretch]


def combine(losses: list[list[float]], n: int) -> Iterator[tuple[float, tuple[int, ...]]]:
    """The n choices, one from each rising list, with the least sums, in order."""
    first = (0,) * len(losses)
    agenda, seen = [(0.0, first)], {first}
    while agenda and n:
        lost, choice = heapq.heappop(agenda)
        yield lost, choice
        n -= 1
        for i, c in enumerate(choice):
            if c + 1 < len(losses[i]):
                new = (*choice[:i], c + 1, *choice[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(agenda, (lost - losses[i][c] + losses[i][c + 1], new))


def segment(documents: DataFrame, model: str, n_best: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """A row for each document: the best segmentation's length, score and checksum, the scores of the n best, a checksum of all of them, and whether every one decodes to the text."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Segmenter(pieces(model), n_best)
        for frame in frames:
            rows = []
            for doc, (ids, score, found, decodes) in zip(frame["doc_id"], own.documents(frame["text"].tolist()), strict=True):
                crc = 0
                for _, x in found:
                    crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score, [s for s, _ in found], crc, decodes, *([ids] if with_ids else [])))
            made = pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_crc32", "score", "scores", "nbest_crc32", "decodes", *(["ids"] if with_ids else [])])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, score double, scores array<double>, nbest_crc32 long, decodes boolean" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The texts of ids that segment() gave: doc_id and text."""

    @giving_back
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [p.decode(np.asarray(x)) for x in frame["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
