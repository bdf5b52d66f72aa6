"""Splitting texts into the pieces that byte-level BPE encodes separately, and the memo of pieces already encoded."""

from __future__ import annotations

import array
import operator
import re
from collections.abc import Callable

import numpy as np

from snapforge.llm.common import ragged_take

#: Code points on which this plain expression and the published pattern agree by construction: no digits but 0-9,
#: no number forms, and white space that every engine counts as such. Other texts take the published pattern itself.
_PLAIN_DOMAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")


def is_plain(text: str) -> bool:
    return _PLAIN_DOMAIN.fullmatch(text) is not None


class Splitter:
    """Matches of the public byte-level pattern."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return _PLAIN.findall(text) if is_plain(text) else self.pattern.findall(text)


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.new.append(piece)
        return at


class PieceMemo:
    """Token ids of texts, each distinct piece being encoded once while the memo holds it; it is emptied when full."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 700_000):
        self.split, self.encode, self.limit = split, encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lens = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.empty(max(n, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.index) > self.limit:
            self._clear()
        found = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.empty(int(counts.sum()), np.int32)
        to = 0
        for f in found:
            if len(f) > 1:
                at[to : to + len(f)] = array.array("i", operator.itemgetter(*f)(self.index))
            elif f:
                at[to] = self.index[f[0]]
            to += len(f)
        del found
        if new := self.index.new:
            ids, lens = self.encode(new)
            n, old = len(self.index), len(self.index) - len(new)
            self.starts, self.lens = self._room(self.starts, n), self._room(self.lens, n)
            self.flat = self._room(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.lens[old:n] = lens
            self.starts[old:n] = self.used + np.cumsum(lens) - lens
            self.used += len(ids)
            self.index.new = []
        per = self.lens[at]
        totals = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
        ends = np.cumsum(counts)
        return ragged_take(self.flat, self.starts[at], per), totals[ends] - totals[ends - counts]
