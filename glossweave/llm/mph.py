"""Minimal perfect hash of 64-bit keys: hash, displace, and put single keys where room is left.

Keys fall into groups of about GROUP; the largest groups are placed first, each by
the smallest displacement that sends its keys to free, distinct slots.  A group of
one key stores its slot itself.  n keys take n slots, and a look-up computes two
hashes whatever n is.  Keys that were never stored also get a slot, so each slot
keeps a fingerprint.
"""

from __future__ import annotations

import numpy as np

GROUP = 3
#: The multipliers of the splitmix64 finalizer and its increment.
_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit permutation of x for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> np.ndarray:
    """Displacements by group, int64; keys: distinct uint64.  Negative: -1 - slot of the only key."""
    n = len(keys)
    groups = max(1, -(-n // GROUP))
    group = (mix(keys, 1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(groups + 1))
    counts = np.diff(ends)
    seeds, taken = np.zeros(groups, np.int64), np.zeros(n, bool)
    for g in np.argsort(-counts, kind="stable"):
        own = keys[order[ends[g] : ends[g + 1]]]
        if len(own) < 2:
            break
        first = 0
        while True:
            tries = np.arange(first, first + 64)
            slots = slot_of(own[None, :], tries[:, None], n)
            ordered = np.sort(slots, axis=1)
            good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(good.argmax())
                seeds[g] = first + at
                taken[slots[at]] = True
                break
            first += 64
    seeds[counts == 1] = -1 - np.flatnonzero(~taken)[: int((counts == 1).sum())]
    return seeds


def slot_of(keys: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + mix(seed.astype(np.uint64), 2)) % np.uint64(n)).astype(np.int64)


def find(seeds: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The slots of keys, 0 to n - 1."""
    seed = seeds[(mix(keys, 1) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, slot_of(keys, seed, n))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 3) >> np.uint64(32)).astype(np.uint32)
