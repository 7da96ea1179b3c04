"""Encoding with files of the tokenizers library.

Most words of a corpus occur often, and neither tokenizer used here joins anything across the start of a
run of blanks, or between a letter and a mark after it. So texts are cut there, each distinct piece is encoded once by the library,
and a worker keeps the ids of the pieces it has met. Texts in which that cut would not be exact are encoded whole.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .runs import BLANK, LOWER, Buffer, Met, Rows, batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed values. White space of Unicode beside the ASCII blanks, before one of those.
_ODD_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t\n\r\x0b\x0c]")
#: Pieces that a worker keeps while a task runs; about 60 bytes each.
KNOWN = 400_000
#: Fixed values. Both tokenizers split between a letter and these, so what precedes them is encoded apart.
_MARK = np.isin(np.arange(256), list(b".,;:!?|%$#&*"))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
END = 2
#: Byte-level vocabularies write a byte that prints as that character, and the others, in order, from U+0100 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: The same as a table of 256 characters; a line break stays itself and stands between words.
_AS_CHARS = "".join("\n" if b == 10 else chr(_BYTE_CHARS.get(b, b)) for b in range(256))
#: Words that go to the library in one text.
_LINES = 4096


class Encoder:
    """Ids of whole texts, with add_special_tokens=False. blanks: whether the tokenizer gives ids to blanks."""

    def __init__(self, path: str, blanks: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.blanks = Tokenizer.from_file(path), blanks
        self.library.encode_special_tokens = True
        # The model alone, for words that the steps before it would leave as they are: one word a line.
        self.lines = Tokenizer(self.library.model)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        names = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        self.width = np.array([len((x or "").removesuffix(suffix)) for x in names])  # bytes that a token stands for
        self.clear()

    def clear(self) -> None:
        """Forgets the pieces."""
        self.met, self.ids, self.again = Met(KNOWN), Rows(np.uint32), np.zeros(2 * KNOWN, bool)

    def _thin(self) -> None:
        """Keeps the pieces that were met again after the texts that brought them."""
        keep = np.flatnonzero(self.again[: self.met.count])
        keep = keep if len(keep) < KNOWN // 2 else keep[:0]
        (one, two), flat, sizes = self.met.keys(), self.ids.gather(keep), self.ids.size[keep]
        self.clear()
        self.met.add(one[keep], two[keep])
        self.ids.add(flat, sizes)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, w: bytes) -> bool:
        """Lower-case Latin letters, composed, with one blank before them at most if blanks count: one word for the tokenizer."""
        letters = w.decode("utf-8", "replace").removeprefix(" ") if self.blanks else w.decode("utf-8", "replace")
        return letters.isalpha() and max(letters) < "\u0250" and (self.blanks or letters == letters.lower())

    def _words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for plain words. A token's bytes are known, so the ids of words in one text are told apart by their lengths."""
        texts = [pieces[i : i + _LINES] for i in range(0, len(pieces), _LINES)]
        lines = [codecs.charmap_decode(b"\n".join(x), "strict", _AS_CHARS)[0] for x in texts]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.lines.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        upto, ends = np.cumsum(self.width[flat]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(upto, ends)
        if len(pieces) and (len(flat) == 0 or last[-1] != len(flat) - 1 or (upto[last] != ends).any()):
            raise ValueError("tokens do not add up to the words they stand for")
        return flat, np.diff(last, prepend=-1)

    def _cut(self, text: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces: blanks (if they count) and what follows them, marks after a letter apart."""
        b = text.bytes[: text.size]
        before = np.concatenate([[0], b[:-1]]) if len(b) else b
        split = _MARK[b] & _LETTER[before]
        blank, first = BLANK[b], text.first()
        if self.blanks:
            start = np.flatnonzero(first | split | (blank & ~BLANK[before]))
            return start, np.append(start[1:], text.size)
        start = np.flatnonzero(~blank & (first | split | BLANK[before]))
        stop = blank & (~BLANK[before]) | split | first
        return start, np.append(np.flatnonzero(stop), text.size)[np.searchsorted(np.flatnonzero(stop), start, "right")]

    def _learn(self, text: Buffer, start: np.ndarray, end: np.ndarray) -> None:
        """Ids of new pieces, in their order."""
        other = np.concatenate([[0], np.cumsum(~_LETTER[text.bytes[: text.size]])])
        odd = other[end] - other[start]
        if self.blanks:
            odd -= (text.bytes[start] == 32) & (end - start > 1)
        pieces = [text.raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        plain = odd == 0
        for i in np.flatnonzero(~plain).tolist():
            plain[i] = self._plain(pieces[i])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        flat, sizes = self._words([pieces[i] for i in order[: plain.sum()].tolist()])
        rest = [pieces[i].decode("utf-8", "surrogatepass") for i in order[plain.sum() :].tolist()]
        ids = [e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)]
        found = Rows(np.uint32)
        found.add(flat, sizes)
        found.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        back = np.argsort(order, kind="stable")
        self.ids.add(found.gather(back), found.size[back])

    def _some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and how many each has."""
        text = Buffer(texts)
        start, end = self._cut(text)
        if not self.blanks and len(start):  # the tokenizer lowers case; words of ASCII alone are lowered here already
            wide = np.concatenate([[0], np.cumsum(text.bytes[: text.size] > 127)])
            low, keep = LOWER[text.bytes], np.flatnonzero(wide[end] > wide[start])
            size = end[keep] - start[keep]
            at = np.repeat(start[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            low[at] = text.bytes[at]
            text.bytes, text.raw = low, low.tobytes()
        if self.met.count > KNOWN:
            self._thin()
        known = self.met.count
        at, new = self.met.look_up(*text.hashes(start, end))
        if len(new):
            self._learn(text, start[new], end[new])
        if self.met.count > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(self.met.count, bool)])
        self.again[at[at < known]] = True
        upto = np.concatenate([[0], np.cumsum(self.ids.size[at])])
        numbers = text.per_text(start)
        ends = np.cumsum(numbers)
        return self.ids.gather(at), upto[ends] - upto[ends - numbers]

    def documents(self, texts: list[str | None], end: int = END) -> Iterator[np.ndarray]:
        """The ids of each text, and the end's after them."""
        for some in batches(texts):
            odd = {i for i, t in enumerate(some) if self.blanks and t and _ODD_BLANK.search(t)}
            flat, sizes = self._some([None if i in odd else t for i, t in enumerate(some)])
            at = 0
            for i, n in enumerate(sizes.tolist()):
                ids = self._whole([some[i]])[0] if i in odd else flat[at : at + n]
                yield np.append(ids, np.uint32(end))
                at += n


@lru_cache(maxsize=2)
def encoder(path: str, blanks: bool) -> Encoder:
    return Encoder(path, blanks)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@lru_cache(maxsize=4096)
def _shift(n: int) -> tuple[int, ...]:
    """What n zero bytes do to each bit of a CRC-32: squares of the step of one zero byte."""
    if n == 1:
        return tuple(zlib.crc32(b"\0", 1 << i ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32))
    half = _shift(n // 2)
    both = tuple(_times(half, x) for x in half)
    return tuple(_times(_shift(1), x) for x in both) if n % 2 else both


def _times(matrix: tuple[int, ...], x: int) -> int:
    out = 0
    for i in range(32):
        if x >> i & 1:
            out ^= matrix[i]
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two runs of bytes from theirs."""
    return _times(_shift(second_bytes), first) ^ second if second_bytes else first
