"""Sets of hashed word shingles, and their one-permutation MinHash signatures, in numpy.

A word's hash is a difference of prefix sums over the bytes of a whole batch, so no
Python loop sees words.  Shingles are 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from glossweave.llm.mph import mix

#: The bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Bytes of text that are hashed at a time.
CHUNK = 500_000


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return mix(np.arange(256, dtype=np.uint64), 21), space


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word."""
    value, space = _tables()
    b = np.frombuffer(data, np.uint8)
    gap = space[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(19, int(len(b)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(value[b] * up[: len(b)])])
        return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), 22)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of all its words if there are fewer."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append((t or "").encode())
        held += len(part[-1]) + 1
        if held >= CHUNK:
            out += _sets(part, k)
            part, held = [], 0
    return out + _sets(part, k)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, words = _word_hashes(b" ".join(texts).translate(LOWER))
    first = np.searchsorted(starts, begins)
    salts = mix(np.arange(k, dtype=np.uint64), 23) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        full = mix(sum((words[i : i + n] * salts[i] for i in range(k)), np.zeros(n, np.uint64)), 24)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * salts[: b - a]).sum()], np.uint64), 30 + int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    t, i = np.meshgrid(np.arange(4096), np.arange(BINS), indexing="ij")
    return (mix((t * BINS + i).astype(np.uint64), 25) % np.uint64(BINS)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS) minima of one permutation; each empty bin borrows from a bin that its own probes reach (optimal densification).

    The sets must not be empty.
    """
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for row, s in enumerate(sets):
        at = np.searchsorted(s >> np.uint64(57), np.arange(BINS + 1, dtype=np.uint64))
        has = at[1:] > at[:-1]
        out[row, has] = s[at[:-1][has]]
        filled[row] = has
    rows, bins = np.nonzero(~filled)
    probes = _probes()
    for t in range(len(probes)):
        if not len(rows):
            break
        source = probes[t, bins]
        ok = filled[rows, source]
        out[rows[ok], bins[ok]] = out[rows[ok], source[ok]]
        rows, bins = rows[~ok], bins[~ok]
    for r, b in zip(rows, bins, strict=True):
        out[r, b] = out[r, filled[r].argmax()]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) int64, different for equal rows in different bands."""
    with np.errstate(over="ignore"):
        rows = signature.reshape(len(signature), BANDS, ROWS)
        salts = mix(np.arange(ROWS, dtype=np.uint64), 26) | np.uint64(1)
        return mix((mix(rows, 27) * salts).sum(axis=2) + mix(np.arange(BANDS, dtype=np.uint64), 28), 29).view(np.int64)


def short(signature: np.ndarray) -> np.ndarray:
    """Two bytes a bin, for estimates: unequal minima agree with a chance of 2**-16."""
    return (mix(signature, 31) & np.uint64(65535)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
