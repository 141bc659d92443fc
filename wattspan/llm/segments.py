"""Vectorised segmentation of text blocks: byte classes, word bounds, hashes of words and of runs of words."""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np

#: Fixed odd multipliers.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LEVELS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Longer segments are hashed one by one.
LONG = 1024
#: The ASCII white space that separates words: space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): different values stay different."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: int = 1) -> list[np.ndarray]:
    """One uint64 hash a seed for each byte range [start, end) of ``data`` (uint8).

    Eight bytes at a time are mixed into the state of all ranges that are that long, so no structure of a text cancels out;
    of ranges of one length up to eight bytes no two are given one hash.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    state = [mix(size.astype(np.uint64) * _LEVELS[s] + np.uint64(BASES[s])) for s in range(seeds)]
    long = np.flatnonzero(size > LONG)
    rows = np.flatnonzero((size > 0) & (size <= LONG)) if len(long) or len(size) and size.min() == 0 else None
    at = 0
    while rows is None or len(rows):
        left = (size if rows is None else size[rows]) - at
        x = eight[(starts if rows is None else starts[rows]) + at]
        cut = np.flatnonzero(left < 8)
        x[cut] &= (np.uint64(1) << (left[cut] * 8).astype(np.uint64)) - np.uint64(1)
        for s in range(seeds):
            if rows is None:
                state[s] = mix(state[s] ^ x)
            else:
                state[s][rows] = mix(state[s][rows] ^ x)
        at += 8
        rows = np.flatnonzero(size > at) if rows is None else rows[left > 8]
    for i in long.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for s in range(seeds):
            state[s][i] = int.from_bytes(digest[8 * s : 8 * s + 8], "little")
    return state


def hash_runs(values: np.ndarray, n: int) -> np.ndarray:
    """One uint64 hash for each ``n`` consecutive values, by doubling: runs of 1, 2, 4, ... are put together in order."""
    out, used, power, size = None, 0, values, 1
    while True:
        if n & size:
            out = power if out is None else _join(out, power, used, size)
            used += size
        if size * 2 > n:
            return mix(out)
        power = _join(power, power, size, size)
        size *= 2


def _join(left: np.ndarray, right: np.ndarray, shift: int, size: int) -> np.ndarray:
    count = max(min(len(left), len(right) - shift), 0)
    level = _LEVELS[size.bit_length() % len(_LEVELS)]
    x = left[:count] * level
    x ^= x >> np.uint64(31)
    x += right[shift : shift + count]
    x *= np.uint64(BASES[0])
    x ^= x >> np.uint64(29)
    return x


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside WHITE."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~WHITE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Words:
    """The words of the texts of one block: bounds, and for each text the first word's index (one more at the end). A null text has no words."""

    def __init__(self, texts: list, fold: bool):
        parts = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self.data = FOLD[data] if fold else data
        self.starts, self.ends = word_bounds(self.data)
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))

    @cached_property
    def _plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each with one space behind it, and where each begins."""
        keep = ~WHITE[self.data]
        keep[self.ends] = True
        flat = self.data[keep]
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        flat[at[1:] - 1] = 0x20
        return flat, at

    def joined(self, i: int, removed: np.ndarray | None = None) -> bytes:
        """The words of text i that are not removed, joined by one space."""
        flat, at = self._plain
        a, b = self.first[i], self.first[i + 1]
        out = flat[at[a] : at[b]]
        if removed is not None and removed.any():
            out = out[np.repeat(~removed, np.diff(at[a : b + 1]))]
        return out[:-1].tobytes()

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of a cryptographic hash of each text's word sequence, as two int64 arrays."""
        digests = b"".join([hashlib.blake2b(self.joined(i), digest_size=16).digest() for i in range(len(self.first) - 1)])
        both = np.frombuffer(digests, np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


class WordIndex:
    """A bounded cache from segment hashes to a run of ids, kept as one flat array; emptied whole when it is full."""

    def __init__(self, limit: int = 600_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        #: Run i is flat[start[i]:start[i + 1]]; check[i] is its segment's second hash.
        self.start = np.zeros(1 << 12, np.int64)
        self.check = np.zeros(1 << 12, np.uint64)

    def add(self, key: int, check: int, ids) -> None:
        i, n = len(self.slot), len(ids)
        if i + 2 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.check = np.concatenate([self.check, np.zeros_like(self.check)])
        used = int(self.start[i])
        while used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used : used + n] = ids
        self.slot[key] = i
        self.check[i] = check
        self.start[i + 1] = used + n

    def expand(self, hashes: np.ndarray, checks: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and the running count of ids before each segment (one more at the end).

        encode(positions) gives the id lists of the segments at these positions, called once for unknown hashes. A segment
        whose second hash is not that of the run found under its first goes by both.
        """
        import pandas as pd

        if len(self.slot) > self.limit:
            self.clear()
        codes, distinct = pd.factorize(hashes)
        keys = distinct.tolist()
        get = self.slot.get
        slots = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            for k, check, ids in zip(missing.tolist(), checks[first[missing]].tolist(), encode(first[missing]), strict=True):
                slots[k] = len(self.slot)
                self.add(keys[k], check, ids)
        slots = slots[codes]
        if len(other := np.flatnonzero(self.check[slots] != checks)):
            apart = hashes.copy()
            apart[other] = mix(hashes[other] ^ mix(checks[other]))
            return self.expand(apart, checks, encode)
        lengths = self.start[slots + 1] - self.start[slots]
        before = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        where = np.arange(before[-1]) + np.repeat(self.start[slots] - before[:-1], lengths)
        return self.flat[where], before
