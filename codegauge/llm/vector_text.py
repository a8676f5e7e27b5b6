"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: ASCII white space that parts words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_LONG = 4096


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Random values for bytes, and odd random multipliers for places in a word."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, 256, np.uint64), rng.integers(0, 2**64, _LONG, np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a space after each text, and the texts' starts (one more than texts)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their lengths in bytes, and each text's first word (one more than texts)."""
    space = _SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    if space[0]:  # the first byte is no edge
        end = end[end > 0]
    end = end[-len(begin) :] if len(begin) else end[:0]
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first
    size = end - begin
    table, power = _tables()
    inside = np.flatnonzero(~space)
    place = inside - np.repeat(begin, size)
    value = table[buf[inside]]
    value *= power[place % _LONG]
    far = place >= _LONG
    if far.any():  # in very long words later rounds get other values
        value[far] = mix(value[far] + (place[far] // _LONG).astype(np.uint64))
    at = np.zeros(len(begin), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64)), size, first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one text; of fewer words, the whole sequence is one; of none, empty."""
    n = len(hashes)
    if not n:
        return hashes
    m = min(n, k)
    out = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[i : n - m + 1 + i]
        out = mix(out)
    return out


def chunks(sizes: list[int], most: int = 1 << 18):
    """Ranges of texts of about `most` bytes together."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)
