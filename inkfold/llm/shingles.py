"""Word shingles as sorted 64-bit hashes, and circulant MinHash signatures of them.

Words are runs of anything but ``\\x20\\x09-\\x0D``, with A-Z lower-cased. A document's
set holds its distinct runs of ``WIDTH`` words; with fewer words, the whole sequence;
without words it is empty. Hashes are the same in every process.

A word's hash is the sum of one pseudo-random number for each (place in the word,
byte): tabulation hashing, in which two given words collide with a chance of 2**-64,
whatever structure they have.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WIDTH = 5
#: Slots of the MinHash universe.
UNIVERSE = 1 << 24

_u64 = np.uint64
_rng = np.random.default_rng(20240229)
_place = _rng.integers(1, 1 << 63, WIDTH, dtype=_u64) * _u64(2) + _u64(1)
_key = _rng.integers(1, 1 << 63, 2, dtype=_u64)
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_gap = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u64(33))) * _u64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _u64(33))) * _u64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _u64(33))


def word_hashes(text: bytes, part: int = 1 << 20) -> np.ndarray:
    """A hash of each lower-cased word of ``text`` in order, from prefix sums over parts that end between words."""
    if len(text) <= part:
        return _word_hashes(text)
    out, start = [], 0
    while start < len(text):
        end = _gap.search(text, start + part)
        end = end.start() if end else len(text)
        out.append(_word_hashes(text[start:end]))
        start = end
    return np.concatenate(out)


def _word_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _space[b], [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _u64)
    b = b[start[0] :]
    start, end = start - start[0], end - start[0]
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    number = _mix((place.astype(_u64) << _u64(8)) + b + _key[0]) ^ _key[1]
    total = np.concatenate((np.zeros(1, _u64), np.cumsum(number, dtype=_u64)))
    return _mix(total[end] - total[start] + (end - start).astype(_u64))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        w = word_hashes(text.encode("utf-8", "surrogatepass"))
        if not len(w):
            out.append(w)
            continue
        n = min(width, len(w))
        h = np.full(len(w) - n + 1, n, _u64)
        for k in range(n):
            h += w[k : len(w) - n + 1 + k] * _place[k % WIDTH]
        out.append(np.unique(_mix(h)))
    return out


def _permuted(x: np.ndarray, odd: tuple[int, ...]) -> np.ndarray:
    """A permutation of the universe, in place: odd multipliers and shifts are one-to-one on it."""
    mask = np.uint32(UNIVERSE - 1)
    for m in odd:
        x *= np.uint32(m)
        x &= mask
        x ^= x >> np.uint32(13)
    return x


def _rounded(rank: np.ndarray) -> np.ndarray:
    """Ranks in 16 bits: exact below 2**13, then rounded down to 13 bits. The order stays, so a minimum of rounded ranks is
    the rounded minimum; ranks of unlike sets become equal with a chance of some 1e-4, and never fewer of like ones."""
    shift = np.maximum(np.frexp(rank.astype(np.float32))[1] - 13, 0).astype(np.uint32)
    return ((shift << np.uint32(12)) + (rank >> shift)).astype(np.uint16)


@lru_cache(maxsize=2)
def _shifted(k: int) -> np.ndarray:
    """Row x holds the second permutation at x, x + 1, ..., x + k - 1: all its circular shifts at x, as rounded ranks."""
    p = np.empty(UNIVERSE + k - 1, np.uint16)
    for i in range(0, len(p), 1 << 20):
        x = np.arange(i, min(i + (1 << 20), len(p)), dtype=np.uint32) & np.uint32(UNIVERSE - 1)
        p[i : i + len(x)] = _rounded(_permuted(x, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE3D, 0x27D4EB2F)))
    return np.lib.stride_tricks.sliding_window_view(p, k)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` circulant MinHash coordinates of a set that isn't empty.

    The first permutation spreads the slots; coordinate j is the minimum of the second permutation shifted by j. A
    slot's k values stand side by side, so a set's signature is a minimum over rows.
    """
    x = _permuted((shingles & _u64(UNIVERSE - 1)).astype(np.uint32), (0x2C1B3C6D, 0x297A2D39))
    table = _shifted(k)
    low = None
    for i in range(0, len(x), 1024):
        m = table[x[i : i + 1024]].min(0)
        low = m if low is None else np.minimum(low, m)
    return low


@lru_cache(maxsize=4)
def _coefficients(bands: int, rows: int) -> np.ndarray:
    return np.random.default_rng(bands * 1000 + rows).integers(1, 1 << 63, (bands, rows), dtype=_u64) * _u64(2) + _u64(1)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key (as int64) for each band of ``rows`` coordinates; the band's number is part of it."""
    s = sig.reshape(bands, rows).astype(_u64)
    return _mix((_mix(s + _u64(1)) * _coefficients(bands, rows)).sum(1, dtype=_u64) + np.arange(bands, dtype=_u64)).view(np.int64)
