"""Minimal perfect hashes in shards, with the keys stored beside them.

A shard of n keys maps them onto 0..n-1 by hash and displace: keys fall into n / 4
buckets, and each bucket, largest first, takes the first displacement that sends all its
keys to free places; a bucket of one key simply names a place that is left. Two 64-bit
lanes of a 128-bit hash give the bucket and the place. Any other word also lands on some
place, so a lookup compares the stored key and answers -1 where it differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PER_BUCKET = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX, _MORE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def lanes(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(first: np.ndarray, shards: int | np.ndarray) -> np.ndarray:
    return (first % np.uint64(shards) if np.isscalar(shards) else first % shards.astype(np.uint64)).astype(np.int64)


def _bucket(first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(31))) * _MIX
    return ((mixed >> np.uint64(11)) % buckets.astype(np.uint64)).astype(np.int64)


def _place(second: np.ndarray, by: np.ndarray, size: np.ndarray) -> np.ndarray:
    mixed = second + (by.astype(np.uint64) + np.uint64(1)) * _ODD
    for shift, factor in ((30, _MIX), (27, _MORE)):  # every bit of the sum must reach every bit: else small shards may have no solution
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * factor
    return ((mixed ^ (mixed >> np.uint64(31))) % size.astype(np.uint64)).astype(np.int64)


def buckets_for(size: int) -> int:
    return -(-size // PER_BUCKET)


def build(keys: Sequence[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The displacements of a shard's buckets, and its keys in the order of their places."""
    n, count = len(keys), buckets_for(len(keys))
    by = np.zeros(count, np.int32)
    if not n:
        return by, []
    first, second = lanes(keys)
    bucket = _bucket(first, np.full(n, count))
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=count)
    start = np.cumsum(size) - size
    place, free = np.full(n, -1, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own = order[start[b] : start[b] + size[b]]
        d, many = 0, 64
        while True:  # displacements are tried a run at a time
            tried = _place(second[own][None, :], np.arange(d, d + many)[:, None], np.array(n))
            row = np.sort(tried, axis=1)
            good = free[tried].all(axis=1) & (row[:, 1:] != row[:, :-1]).all(axis=1)
            if good.any():
                d += int(good.argmax())
                break
            d, many = d + many, min(2 * many, 1 << 14)
        by[b], place[own] = d, _place(second[own], np.full(len(own), d), np.array(n))
        free[place[own]] = False
    single = np.flatnonzero(size == 1)
    left = np.flatnonzero(free)
    by[single], place[order[start[single]]] = -1 - left, left
    return by, [keys[i] for i in np.argsort(place)]


@dataclass
class Table:
    """Some or all shards of one set of keys. A shard that is not here has size 0."""

    sizes: np.ndarray  # of each shard
    starts: np.ndarray  # the first place of each shard among all of the set
    held: np.ndarray  # the first place of each shard among the keys that are here
    buckets: np.ndarray  # the first bucket of each shard
    by: np.ndarray
    keys: pa.Array  # binary, in the order of places

    @staticmethod
    def of(shards: int, parts: list[tuple[int, int, bytes, Sequence[bytes]]]) -> Table:
        """parts: (shard, first place among all, displacements as bytes, keys in order)."""
        sizes, starts, held, buckets = (np.zeros(shards, np.int64) for _ in range(4))
        n = m = 0
        for shard, start, by, keys in parts:
            sizes[shard], starts[shard], held[shard], buckets[shard] = len(keys), start, n, m
            n, m = n + len(keys), m + len(by) // 4
        return Table(sizes, starts, held, buckets, np.frombuffer(b"".join(p[2] for p in parts), np.int32), pa.array([k for p in parts for k in p[3]], pa.binary()))

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word among all keys of the set; -1 for a word that is no key of the shards here."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        first, second = lanes(words)
        shard = shard_of(first, len(self.sizes))
        at = np.flatnonzero(self.sizes[shard])
        shard, size = shard[at], self.sizes[shard[at]]
        by = self.by[self.buckets[shard] + _bucket(first[at], -(-size // PER_BUCKET))]
        place = np.where(by < 0, -1 - by.astype(np.int64), _place(second[at], np.maximum(by, 0), size))
        same = pc.equal(self.keys.take(pa.array(self.held[shard] + place)), pa.array([words[i] for i in at.tolist()], pa.binary())).to_numpy(zero_copy_only=False)
        out[at[same]] = (self.starts[shard] + place)[same]
        return out
