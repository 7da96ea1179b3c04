"""The lattice of a word's segmentations into the pieces of an existing vocabulary.

Words of one length are handled together: for each place and each piece length, a hash of the characters is looked up in
the table of pieces. A character that is no piece itself is spelled in byte pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MARK = "▁"
_STEP, _SPICE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters of words that are handled together.
CHARS = 1 << 18
#: Leading bits of a hash that say at once of most strings that they are no piece.
SIEVE = 18


class Pieces:
    """A vocabulary file of the sentencepiece library. Ids are the file's; byte pieces spell what is no piece."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.size, self.plain = n, plain
        self.longest = max(len(self.text[i]) for i in plain)
        self.crosses = any(MARK in self.text[i].lstrip(MARK) or "\n" in self.text[i] for i in plain)
        self.table: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(1, self.longest + 1):
            ids = np.array([i for i in plain if len(self.text[i]) == length], np.int64)
            h = self._hash(self._chars([self.text[i] for i in ids], length)) if len(ids) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            maybe = np.zeros(1 << SIEVE, bool)
            maybe[h >> np.uint64(64 - SIEVE)] = True
            self.table.append((h[order], ids[order], maybe))
        self.scores = self._file_scores()
        self.index = {self.text[i]: i for i in plain}

    def _file_scores(self) -> np.ndarray:
        """The file ranks its pieces (a rank's negative is its score); their probabilities fall as one over the rank."""
        out = np.full(self.size, -np.inf)
        rank = np.zeros(self.size)
        rank[self.plain] = np.arange(2, len(self.plain) + 2)
        rank[self.byte] = len(self.plain) + 2
        use = rank > 0
        weight = 1 / rank[use]
        out[use] = np.log(weight / weight.sum())
        return out

    @staticmethod
    def _chars(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for i in range(chars.shape[1]):
            h = (h ^ (chars[:, i].astype(np.uint64) * _SPICE)) * _STEP
            h ^= h >> np.uint64(31)
        return h

    def edges(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length n: for each piece length l from 1 the id of the piece at each start (words, n - l + 1), or -1; -2 - i spells a character in bytes, which is self.spelled(i)."""
        n = len(words[0])
        chars = self._chars(words, n)
        h, out = np.zeros(chars.shape, np.uint64), []
        for length in range(1, min(n, self.longest) + 1):
            h = (h[:, : n - length + 1] ^ (chars[:, length - 1 :].astype(np.uint64) * _SPICE)) * _STEP
            h ^= h >> np.uint64(31)
            keys, ids, maybe = self.table[length - 1]
            found = np.full(h.shape, -1)
            if not len(keys):
                out.append(found)
                continue
            some = maybe[h >> np.uint64(64 - SIEVE)]
            asked = h[some]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            found[some] = np.where(keys[at] == asked, ids[at], -1)
            if length == 1:
                found = np.where(found < 0, -2 - chars.astype(np.int64), found)
            out.append(found)
        return out

    def spell(self, char: int) -> np.ndarray:
        """Byte pieces of a character."""
        return self.byte[np.frombuffer(chr(char).encode("utf-8", "surrogatepass"), np.uint8)]

    def weigh(self, edges: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """The score of each edge, -inf where there is none."""
        padded = np.append(scores, -np.inf)
        out = [padded[e] if k else padded[np.maximum(e, -1)] for k, e in enumerate(edges)]
        odd = edges[0] < -1
        if odd.any():
            chars, at = np.unique(-2 - edges[0][odd], return_inverse=True)
            out[0][odd] = np.array([scores[self.spell(int(c))].sum() for c in chars])[at]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that encode() gave, without the blank put before it."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Words of one length together, no more than CHARS characters at a time (or one word)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        n = len(words[order[a]])
        b, most = a, max(1, CHARS // n)
        while b < len(order) and b - a < most and len(words[order[b]]) == n:
            b += 1
        yield order[a:b], [words[i] for i in order[a:b]]
        a = b


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def forward(weights: list[np.ndarray], n: int, reduce=_log_sum) -> np.ndarray:
    """For each place from 0 to n the log-probability of all segmentations of what is before it (or of the best, with np.max)."""
    out = np.zeros((n + 1, len(weights[0])))
    for j in range(1, n + 1):
        out[j] = reduce([out[j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)])
    return out


def backward(weights: list[np.ndarray], n: int, reduce=_log_sum) -> np.ndarray:
    """The same for what is after each place."""
    out = np.zeros((n + 1, len(weights[0])))
    for i in range(n - 1, -1, -1):
        out[i] = reduce([out[i + k] + weights[k - 1][:, i] for k in range(1, min(n - i, len(weights)) + 1)])
    return out


def best(terms: list[np.ndarray]) -> np.ndarray:
    return np.max(np.stack(terms), axis=0)


def marginals(p: Pieces, words: list[str], scores: np.ndarray) -> np.ndarray:
    """The natural log-probability of each word, over all its segmentations."""
    out = np.zeros(len(words))
    for at, group in by_length(words):
        n = len(group[0])
        out[at] = forward(p.weigh(p.edges(group), scores), n)[n]
    return out


def expected(p: Pieces, words: list[str], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each as often as it counts."""
    out = np.zeros(p.size)
    for at, group in by_length(words):
        n = len(group[0])
        edges = p.edges(group)
        weights = p.weigh(edges, scores)
        a, b = forward(weights, n), backward(weights, n)
        c = counts[at]
        for k, (e, w) in enumerate(zip(edges, weights, strict=True), 1):
            use = e >= 0
            if k == 1:
                use |= e < -1
            share = np.exp(a[: n - k + 1].T + w + b[k:].T - a[n][:, None]) * c[:, None]
            whole = e >= 0
            out += np.bincount(e[whole], share[whole], p.size)
            if k == 1 and (e < -1).any():
                for char in np.unique(e[e < -1]):
                    np.add.at(out, p.spell(int(-2 - char)), share[e == char].sum())
    return out


def astar(p: Pieces, word: str, scores: np.ndarray, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations, from the end backwards; the forward Viterbi score of a place is exactly what is still to come.

    Among equals the one that has come furthest goes first. The n best hold at most n ways from a place to the end, so
    a place is left at most n times, and the search ends after n times the places however many segmentations tie.
    """
    n = len(word)
    into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    ahead = [0.0] + [-np.inf] * n
    for j in range(1, n + 1):
        for i in range(max(0, j - p.longest), j):
            if (piece := p.index.get(word[i:j])) is not None:
                edge = (i, float(scores[piece]), (piece,))
            elif i == j - 1:
                spelled = p.spell(ord(word[i]))
                edge = (i, float(scores[spelled].sum()), tuple(spelled.tolist()))
            else:
                continue
            into[j].append(edge)
            ahead[j] = max(ahead[j], ahead[i] + edge[1])
    agenda: list[tuple[float, int, int, float, tuple]] = [(-ahead[n], n, 0, 0.0, ())]
    out, pushed, left = [], 0, [n_best] * (n + 1)
    while agenda and len(out) < n_best:
        _, at, _, score, tail = heapq.heappop(agenda)
        if not left[at]:
            continue
        left[at] -= 1
        if at == 0:
            ids: list[int] = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            out.append((score, tuple(ids)))
            continue
        for i, w, ids in into[at]:
            if left[i]:
                pushed += 1
                heapq.heappush(agenda, (-(score + w + ahead[i]), i, pushed, score + w, (ids, tail)))
    return out


def viterbi(p: Pieces, words: list[str], scores: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some words at a time: their places in the list, the best scores, how much less the second best have, the best ids one word after the other, and their numbers.

    A second-best path uses an edge that the best does not; so its score is the most that such an edge can reach.
    """
    for at, group in by_length(words):
        n = len(group[0])
        edges = p.edges(group)
        weights = p.weigh(edges, scores)
        a, b = forward(weights, n, best), backward(weights, n, best)
        rows = np.arange(len(group))
        through = [a[: n - k + 1].T + w + b[k:].T for k, w in enumerate(weights, 1)]
        here = np.full(len(group), n)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while (here > 0).any():
            live = here > 0
            reach = np.full((len(weights), len(group)), -np.inf)
            for k, w in enumerate(weights, 1):
                use = np.flatnonzero(here >= k)
                reach[k - 1, use] = a[here[use] - k, use] + w[use, here[use] - k]
            step = reach.argmax(axis=0) + 1
            for k in range(1, len(weights) + 1):
                use = np.flatnonzero(live & (step == k))
                if len(use):
                    start = here[use] - k
                    taken.append((rows[use], start, edges[k - 1][use, start]))
                    through[k - 1][use, start] = -np.inf
            here = np.where(live, here - step, here)
        second = np.max([t.max(axis=1) for t in through], axis=0)
        r, s, e = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.lexsort((s, r))
        ids, r = e[order], r[order]
        if (ids < 0).any():  # characters spelled in bytes
            spelled = [(x,) if x >= 0 else p.spell(-2 - x) for x in ids.tolist()]
            r = np.repeat(r, np.fromiter(map(len, spelled), np.int64, len(spelled)))
            ids = np.concatenate(spelled)
        yield at, a[n], a[n] - second, ids, np.bincount(r, minlength=len(group))
