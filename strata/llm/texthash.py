"""Vectorised hashing of words, shingles and byte windows over many texts at once."""

from __future__ import annotations

import numpy as np

from strata.llm.common import SPACE_BYTES

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
#: Bytes hashed together; arrays of this many 64-bit words stay near the caches.
CHUNK = 1 << 19


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one-to-one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, CHUNK + 1024)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.cumprod(held, dtype=np.uint64)
        if n <= 8 * CHUNK:
            _POWERS[base] = held
    return held[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of values[i] * BASE^i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) that do not hang on the place, from prefix()."""
    return (sums[ends] - sums[starts]) * powers(BASE_INV, len(sums))[starts]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word; words never cross rows."""
    if len(raw) == 0:
        return (np.zeros(0, np.int64),) * 3
    space = _SPACE[raw]
    before = np.empty(len(raw), bool)
    before[1:] = space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    before[0] = True
    before[inner] = True
    after = np.empty(len(raw), bool)
    after[:-1] = space[1:]
    after[-1] = True
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


_WORDS = byte_table(11)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(spans_hash(prefix(_WORDS[raw]), starts, ends) + (ends - starts).astype(np.uint64))


def shingles(rows: np.ndarray, words: np.ndarray, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct: the sets of word shingles of n rows; a row of fewer words has one shingle of all."""
    counts = np.bincount(rows, minlength=n)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out_rows, out = [], []
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            total += words[j : len(words) - size + 1 + j] * powers(BASE, size)[j]
        inside = rows[: len(total)] == rows[size - 1 :]
        out_rows.append(rows[: len(total)][inside])
        out.append(mix(total[inside]))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = prefix(words)
        out_rows.append(short)
        out.append(mix(spans_hash(sums, starts[short], starts[short + 1]) + counts[short].astype(np.uint64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[keep], h[keep]
