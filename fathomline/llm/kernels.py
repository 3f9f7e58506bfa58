"""Vectorised text kernels on numpy byte arrays: words, rolling hashes, sliding minima.

Range hashes are polynomial in Z/2^64 over a random byte table: with P the prefix sums of T[byte] * B^position, the hash
of [s, e) is (P[e] - P[s]) * B^-s, mixed. Ranges here are far shorter than the 2^11 symbols at which Thue-Morse strings
break such hashes, and wherever equality is decided two independent hashes (128 bits) or the text itself are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def base(seed: int) -> tuple[np.ndarray, int, int]:
    """Byte table, odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = int(rng.integers(2**40, 2**62)) * 8 + 5
    return table, b, pow(b, -1, 1 << 64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1), or of the inverse; grown by doubling and kept."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        b = base(seed)[2 if inverse else 1]
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(b, len(have), 1 << 64))])
        _powers[seed, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(symbols: np.ndarray, seed: int) -> np.ndarray:
    """n+1 prefix sums of uint64 symbols times powers of the base."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(seed, len(symbols)), out=out[1:])
    return out


def ranges(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Mixed hashes of [start, end) for prefix sums p."""
    return mix((p[ends] - p[starts]) * powers(seed, len(p), True)[starts])


def byte_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    return prefix(base(seed)[0][data], seed)


def gram_hashes(data: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Hashes of all n-byte strings of a block, each by its own place; lightly mixed, in place."""
    p = byte_prefix(data, seed)
    h = p[n:] - p[:-n]
    h *= powers(seed, len(h), True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and len(offsets) positions in them where each text's words begin."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n flags, True in the union of [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
