"""Words and byte ranges of many texts at once as numpy arrays: places and 64-bit hashes, no Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The odd base of the polynomial hash, its inverse modulo 2 ** 64, and a mixing multiplier.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = 0x110000
#: Code points hashed at once.
STRETCH = 1 << 19


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Rolled:
    """Hashes of any range of an array of bytes or code points in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(20, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        value = _values()[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) * MIX + np.uint64(1))
        np.cumsum(value * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def raw_texts(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


class Words:
    """Words of some texts, A-Z lower-cased, runs without ASCII white space: ``start``, ``stop`` in ``data``, the number
    ``doc`` of their text, ``counts`` per text, and ``hash``."""

    def __init__(self, texts: list[str | None]):
        raw = raw_texts(texts)
        self.data = LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)]
        gap = SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        #: Where each text begins, and one behind the last.
        self.begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) + 1
        self.counts = np.diff(np.searchsorted(self.start, self.begin))
        self.doc = np.repeat(np.arange(len(raw)), self.counts)
        self.hash = Rolled(self.data).of(self.start, self.stop)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``size`` words in a row of each text (a shorter text: all its words), and how many per text."""
        many = np.where(self.counts > 0, np.maximum(self.counts - size + 1, 1), 0)
        first = np.arange(int(many.sum())) + np.repeat((np.cumsum(self.counts) - self.counts) - (np.cumsum(many) - many), many)
        last = np.repeat(np.cumsum(self.counts), many)
        out = np.zeros(len(first), np.uint64)
        padded = np.append(self.hash, np.zeros(size, np.uint64))
        for k in range(size):
            out = mix(out * MIX + np.where(first + k < last, padded[first + k], np.uint64(k)))
        return out, many


@lru_cache(2)
def classes(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it belongs to a word (``alpha``: letters; ``word``: letters, numbers, underscore),
    and its lower case where that is one code point."""
    inside = np.fromiter(map(str.isalpha if kind == "alpha" else str.isalnum, map(chr, range(CODES))), bool, CODES)
    if kind == "word":
        inside[ord("_")] = True
    low = np.arange(CODES, dtype=np.uint32)
    for c in np.flatnonzero(np.fromiter((x != x.lower() for x in map(chr, range(CODES))), bool, CODES)).tolist():
        if len(x := chr(c).lower()) == 1:
            low[c] = ord(x)
    return inside, low


class CodeWords:
    """Words of some texts by classes of code points, lower-cased: ``start``, ``stop`` in ``codes``, ``counts`` per text."""

    def __init__(self, texts: list[str | None], kind: str):
        inside, low = classes(kind)
        raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
        gap = "\n".encode("utf-32-le")
        self.codes = low[np.frombuffer(gap + gap.join(raw) + gap, "<u4")]
        some = inside[self.codes]
        edge = np.flatnonzero(some[1:] != some[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        self.begin = np.concatenate([[0], np.cumsum([len(r) // 4 + 1 for r in raw])]) + 1
        self.counts = np.diff(np.searchsorted(self.start, self.begin))

    def hashes(self) -> np.ndarray:
        """A hash of each word, by stretches of words so that memory stays small; it does not depend on the place."""
        out, a = np.empty(len(self.start), np.uint64), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.stop, self.start[a] + STRETCH, "right")))
            lo, hi = self.start[a], self.stop[b - 1]
            out[a:b] = Rolled(self.codes[lo:hi]).of(self.start[a:b] - lo, self.stop[a:b] - lo)
            a = b
        return out
