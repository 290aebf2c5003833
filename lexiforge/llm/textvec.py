"""Vectorised text primitives: many texts become flat numpy arrays of code points, words and hashes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Character classes.
OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    first = {"L": LETTER, "N": NUMBER, "M": MARK}
    category = unicodedata.category
    for cp in range(0x32000):  # scripts end far below; the planes above hold no letters but the CJK extensions
        table[cp] = first.get(category(chr(cp))[0], OTHER)
    for cp in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _GOLD
    x ^= x >> np.uint64(32)
    return x


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of code points, and where each begins (one entry more than texts)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans have equal hashes wherever they stand."""
    size = 1 << max(16, int(len(cps)).bit_length())
    up, down = _powers(size)
    prefix = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + _GOLD) * up[: len(cps)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words (runs of letters, marks and digits) of texts.

    Returns their hashes, the first word of each text (one entry more than texts), and the code point where
    each word begins and ends, counted from its own text's beginning.
    """
    cps, bounds = code_points([lower(t) for t in texts])
    kind = char_classes()[cps]
    inside = np.zeros(len(cps) + 2, np.int8)
    inside[1:-1] = (kind == LETTER) | (kind == NUMBER) | (kind == MARK)
    first = np.diff(inside)
    begin = first == 1
    stop = first == -1
    # a text that ends in a word, followed by one that begins with a word: part them
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(cps))]
    joined = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
    begin[joined] = True
    stop[joined] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    of = np.searchsorted(start, bounds)
    shift = np.repeat(bounds[:-1], np.diff(of))
    return span_hashes(cps, start, end), of, start - shift, end - shift


def lower(text: str) -> str:
    """Lower case that keeps the number of code points, so that positions stay those of the input."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class HashTable:
    """Open addressing on arrays: 64-bit keys to consecutive numbers in order of arrival."""

    def __init__(self, room: int):
        size = 1 << (2 * room - 1).bit_length()
        self.keys, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.mask, self.count = np.uint64(size - 1), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        at = keys & self.mask
        held = self.number[at]
        off = np.flatnonzero((self.keys[at] != keys) & (held >= 0))
        held[(self.keys[at] != keys)] = -1
        where = at[off]
        while len(off):
            where = (where + np.uint64(1)) & self.mask
            got, same = self.number[where], self.keys[where] == keys[off]
            hit = same & (got >= 0)
            held[off[hit]] = got[hit]
            go = ~same & (got >= 0)
            off, where = off[go], where[go]
        return held

    def add(self, keys: np.ndarray) -> None:
        """Take up distinct keys that are not known yet."""
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.number[at] < 0
            ours, to = left[free], at[free]
            self.number[to] = ours + self.count  # of several keys for one place the last stays
            won = np.zeros(len(left), bool)
            won[free] = self.number[to] == ours + self.count
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + np.uint64(1)) & self.mask
        self.count += len(keys)

    def wider(self, more: int) -> "HashTable":
        """A copy with room for ``more`` further keys."""
        out = HashTable(self.count + more)
        known = np.flatnonzero(self.number >= 0)
        out.add(self.keys[known[np.argsort(self.number[known])]])
        return out


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to one word."""
    cps, _ = code_points([lower(word)])
    return int(span_hashes(cps, np.array([0]), np.array([len(cps)]))[0])


def chunks(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Consecutive slices of items whose sizes add up to about ``most``; each holds one item at least."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment ``values[bounds[i]:bounds[i+1]]``; 0 for an empty one."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
