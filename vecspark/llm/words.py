"""Words of many texts at once: positions and 64-bit hashes, with numpy over the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_GAMMA = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U64) + _U64(seed << 20)) * _U64(_GAMMA)) | _U64(1)


#: ASCII white space parts words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For words without punctuation: only ASCII letters, digits and bytes beyond ASCII belong to a word.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LETTER = constants(256, 1)[LOWER]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, _U64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[i] = table
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and its row. No word crosses the end of a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, ASCII letters in lower case."""
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, _U64)
        np.cumsum(_LETTER[data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U64))


_ORDER = constants(64, 2)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words; a text with fewer words gives one, of all its words."""
    if not len(hashes):
        return hashes, rows
    with np.errstate(over="ignore"):
        n = len(hashes) - size + 1
        full = np.zeros(0, _U64), np.zeros(0, np.int64)
        if n > 0:
            total = np.zeros(n, _U64)
            for j in range(size):
                total += hashes[j : j + n] * _ORDER[j]
            whole = rows[size - 1 :] == rows[:n]
            full = mix(total[whole] + _U64(size)), rows[:n][whole]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        count = np.diff(np.r_[begins, len(rows)])
        short = count < size
        begins, count = begins[short], count[short]
        total = np.zeros(len(begins), _U64)
        for j in range(size - 1):
            has = count > j
            total[has] += hashes[begins[has] + j] * _ORDER[j]
        h, r = np.r_[full[0], mix(total + count.astype(_U64))], np.r_[full[1], rows[begins]]
    return h, r
