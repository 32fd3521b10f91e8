"""Vectorised work on UTF-8 bytes: words, their hashes, polynomial hashes, mixing."""

from __future__ import annotations

import hashlib

import numpy as np

#: Odd multiplier of the polynomial hashes, its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case ASCII letters and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of tokens that white space separates.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """S with S[i] = sum of (data[j] + 1) * base^j for j < i, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = BASE_INV) -> np.ndarray:
    """The polynomial hash of data[start:end], the same wherever those bytes lie; not mixed."""
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end and row of each word. No word crosses rows."""
    low = LOWER[data]
    mask = kind[low]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return low, start, end, np.searchsorted(offs, start, "right") - 1


#: Words beyond these bytes are hashed one by one.
LONG_WORD = 256


def _chained(windows: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int, odd: int) -> np.ndarray:
    """Eight bytes at a time, each mixed in before the next: not a polynomial, so no family of words collides by form."""
    h = mix(size.astype(np.uint64) * np.uint64(odd) + np.uint64(seed))
    live, at, left = np.arange(len(start)), start, size
    while len(live):
        chunk = windows[at]
        short = np.flatnonzero(left < 8)
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        h[live] = mix((h[live] ^ chunk) * np.uint64(odd))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def word_codes(low: np.ndarray, start: np.ndarray, end: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """`halves` independent 64-bit hashes of each word."""
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    windows = np.ndarray((len(low) + 1,), "<u8", padded.data, 0, (1,))
    size = end - start
    long = np.flatnonzero(size > LONG_WORD)
    brief = np.where(size > LONG_WORD, 0, size)
    out = [_chained(windows, start, brief, seed, odd) for seed, odd in ((0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15), (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93))[:halves]]
    for i in long.tolist():
        digest = hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=16).digest()
        for k, h in enumerate(out):
            h[i] = np.frombuffer(digest, "<u8")[k]
    return out


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return word_codes(low, start, end, 1)[0]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def expand(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[i], start[i]+1, ... (length[i] of them) for every i, and the i of each."""
    total = int(length.sum())
    which = np.repeat(np.arange(len(length)), length)
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first, length) + np.repeat(start, length), which
