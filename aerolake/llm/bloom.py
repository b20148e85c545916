"""Pairs of Bloom filters, of keys seen once or more and of keys seen twice or more, built over partitions.

A filter is an array of 64-bit words. A key has one word and sets four bits of it, one in each quarter. Each task fills its
own pair and hands out the parts of it that have bits. Two pairs merge into one: once = either, twice = either, or what both
have in once, but only in words in which they share a bit of every quarter. A key seen by two tasks has its bits in both their
once filters, so it gets into twice and is never missed, while two keys of different tasks that share a bit or two set nothing.

A filter has a bounded size. What does not fit in one is split by ranges of the hash, of which each has a filter of its
own (``ranges``), so the share of keys that get in by chance stays the same at any number of keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 8
#: A filter has at most so many bits (32 MB).
MOST_BITS = 1 << 28
PART_BITS = 1 << 20
PARTS = "part int, task int, once binary, twice binary"


def bits_for(keys: float, most_bits: int = MOST_BITS) -> int:
    """Bits of a filter for about so many keys, as a power of two, within bounds."""
    return min(most_bits, max(PART_BITS, 1 << math.ceil(math.log2(max(1.0, BITS_A_KEY * keys)))))


def ranges(keys: float, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Ranges (first, last) of signed 64-bit hashes, as many as filters are needed for so many keys."""
    n = max(1, math.ceil(BITS_A_KEY * keys / most_bits))
    edges = [-(1 << 63) + (k << 64) // n for k in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bits in it of 64-bit hashes. Both come from the low bits of a product, so ranges of the hash do not matter."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.zeros(len(hashes), np.uint64)
    for quarter in range(4):
        mask |= np.uint64(1) << (np.uint64(16 * quarter) + ((mixed >> np.uint64(4 * quarter)) & np.uint64(15)))
    return ((mixed >> np.uint64(24)) & np.uint64(bits // 64 - 1)).astype(np.int64), mask


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, mask = places(hashes, 64 * len(words))
    return words[at] & mask == mask


def add(words: np.ndarray, hashes: np.ndarray) -> None:
    at, mask = places(hashes, 64 * len(words))
    np.bitwise_or.at(words, at, mask)


def add_seen(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    distinct, times = np.unique(hashes, return_counts=True)
    add(twice, distinct[(times > 1) | contains(once, distinct)])
    add(once, distinct)


def in_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of both in the words where they share one of every quarter."""
    both = a & b
    return np.where((both.view(np.uint16).reshape(-1, 4) != 0).all(axis=1), both, np.uint64(0))


def build(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, twice: bool) -> np.ndarray:
    """The filter of keys seen twice or more (else once or more) among the hashes of all batches of ``df``, on the driver.

    Its size is ``bits`` whatever the input. Task results meet in two steps, about the root of their number at a time.
    """
    part_words = PART_BITS // 64

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64 if twice else 0, np.uint64)
        for batch in batches:
            if len(hashes := hashes_of(batch)):
                add_seen(seen, again, hashes) if twice else add(seen, hashes)
        task = TaskContext.get().partitionId()
        for part in range(bits // PART_BITS):
            if (a := seen[part * part_words : (part + 1) * part_words]).any():
                yield packed(part, task, a, again[part * part_words : (part + 1) * part_words])

    def merge(parts: pa.Table) -> pa.Table:
        a, b = np.zeros(part_words, np.uint64), np.zeros(part_words if twice else 0, np.uint64)
        for x, y in zip(parts["once"], parts["twice"], strict=True):
            other = unpacked(x.as_py())
            if twice:
                b |= unpacked(y.as_py()) | in_both(a, other)
            a |= other
        return pa.Table.from_batches([packed(parts["part"][0].as_py(), parts["task"][0].as_py(), a, b)])

    filled = df.mapInArrow(fill, PARTS)
    fan = max(2, math.isqrt(max(1, df.rdd.getNumPartitions())))
    for keys in (["part", F.pmod("task", F.lit(fan))], ["part"]):
        filled = filled.groupBy(*keys).applyInArrow(merge, PARTS)
    out = np.zeros(bits // 64, np.uint64)
    for row in filled.select("part", "twice" if twice else "once").toLocalIterator():
        out[row[0] * part_words : (row[0] + 1) * part_words] = unpacked(bytes(row[1]))
    return out


def packed(part: int, task: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["part", "task", "once", "twice"])


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint64)
