"""Runs of bytes (words, say) of many texts at once: their places, their hashes, and a table of those met before.

Texts are joined into one buffer and everything is done on arrays over it; no object is made for a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are taken together (or one text), and bytes of a run from which it is hashed as a whole.
TOGETHER, LONG = 1_000_000, 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
#: Of each byte: whether it is one of the blanks between words; and the lower case of A-Z.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def batches(texts: list[str | None], most: int = TOGETHER) -> Iterator[list[str | None]]:
    """The texts in order, some at a time."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (size == 0 or size + len(texts[high] or "") <= most):
            size, high = size + len(texts[high] or ""), high + 1
        yield texts[low:high]
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the input changes about half of the output's."""
    x = (x ^ (x >> np.uint64(33))) * _C
    x = (x ^ (x >> np.uint64(33))) * _D
    return x ^ (x >> np.uint64(33))


class Buffer:
    """Texts one after the other. ends: where each ends."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"".join([*raw, bytes(8)])
        self.ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        self.size = len(self.raw) - 8
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def first(self) -> np.ndarray:
        """Which bytes a text begins with."""
        out = np.zeros(self.size + 1, bool)
        out[0] = True
        out[self.ends] = True
        return out[:-1]

    def lower(self) -> None:
        """A-Z in lower case from here on."""
        self.bytes = LOWER[self.bytes]
        self.raw = self.bytes.tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of other bytes than blanks."""
        black = ~BLANK[self.bytes[: self.size]]
        first = self.first()
        start = np.flatnonzero(black & (first | ~np.concatenate([[False], black[:-1]])))
        last = np.concatenate([first[1:], [True]]) if self.size else first
        end = np.flatnonzero(black & (last | ~np.concatenate([black[1:], [False]]))) + 1
        return start, end

    def per_text(self, start: np.ndarray) -> np.ndarray:
        """How many of the runs are in each text."""
        upto = np.searchsorted(start, self.ends, "left")
        return np.diff(upto, prepend=0)

    def hashes(self, start: np.ndarray, end: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Two independent 64-bit hashes of each run (or one)."""
        n = end - start
        one, two = n.astype(np.uint64) * _A, n.astype(np.uint64) * _B if both else None
        eight = np.ndarray((max(self.size, 1),), "<u8", self.bytes, strides=(1,))
        act, at, j = None, start, 0
        while len(at) and j < LONG:
            left = (n if act is None else n[act]) - j
            word = eight[at + j] & _MASK[np.minimum(left, 8)]
            for h, mul, spice in ((one, _C, _A), (two, _D, _B)) if both else ((one, _C, _A),):
                x = ((h if act is None else h[act]) ^ word) * mul
                x = (x ^ (x >> np.uint64(29))) * spice
                x ^= x >> np.uint64(32)
                if act is None:
                    h[:] = x
                else:
                    h[act] = x
            j += 8
            live = np.flatnonzero(left > 8)
            act = live if act is None else act[live]
            at = at[live]
        for i in np.flatnonzero(n > LONG).tolist():
            x = xxhash.xxh3_128_intdigest(self.raw[start[i] : end[i]])
            one[i] = x & (2**64 - 1)
            if both:
                two[i] = x >> 64
        return one, two


class Met:
    """Numbers from 0 for the runs met so far, told apart by 128 bits of hash. An open-addressed table on arrays."""

    def __init__(self, most: int):
        self.bits = max(10, (2 * most).bit_length())
        self.most = most
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.one, self.two, self.number, self.count = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        out = np.full(len(one), -1, np.int64)
        left, slot = np.arange(len(one)), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            number = self.number[slot]
            same = (self.one[slot] == one[left]) & (self.two[slot] == two[left]) & (number >= 0)
            out[left[same]] = number[same]
            on = np.flatnonzero((number >= 0) & ~same)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers in order for runs that are all different and all new."""
        numbers = np.arange(self.count, self.count + len(one), dtype=np.int32)
        self.count += len(one)
        while self.count > 1 << (self.bits - 1):
            self._double()
        left, slot = np.arange(len(one)), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.number[slot] < 0
            self.number[slot[free]] = numbers[left[free]]  # of those that ask for one place the last gets it
            got = self.number[slot] == numbers[left]
            self.one[slot[got]], self.two[slot[got]] = one[left[got]], two[left[got]]
            on = np.flatnonzero(~got)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return numbers.astype(np.int64)

    def _double(self) -> None:
        used = np.flatnonzero(self.number >= 0)
        one, two, number, count = self.one[used], self.two[used], self.number[used], self.count
        order = np.argsort(number)
        self.bits += 1
        self.clear()
        self.add(one[order], two[order])
        self.count = count

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes by number."""
        used = np.flatnonzero(self.number >= 0)
        order = used[np.argsort(self.number[used])]
        return self.one[order], self.two[order]

    def look_up(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run, and the first places of the runs that are new and now numbered from the old count on."""
        at = self.find(one, two)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at, missing
        order = np.lexsort((two[missing], one[missing]))
        a, b = one[missing][order], two[missing][order]
        other = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(other) - 1
        # lexsort is stable: the first of each group is the first place of its run.
        at[missing[order]] = self.add(a[other], b[other])[group]
        return at, missing[order][other]


class Rows:
    """A growing array of some width, or rows of numbers of any length: flat, start and size."""

    def __init__(self, kind):
        self.flat, self.used = np.zeros(1 << 14, kind), 0
        self.start, self.size, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        k = len(sizes)
        self.start, self.size, self.flat = (_room(x, n) for x, n in ((self.start, self.count + k), (self.size, self.count + k), (self.flat, self.used + len(flat))))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.count : self.count + k] = sizes
        self.start[self.count : self.count + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count += k

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Some rows, one after the other."""
        size = self.size[at].astype(np.int64)
        out = np.repeat(self.start[at] - (np.cumsum(size) - size), size)
        return self.flat[out + np.arange(len(out))]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    while n > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x
