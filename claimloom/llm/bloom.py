"""A blocked Bloom filter of 64-bit hashes, built by an aggregate and probed with numpy.

A hash picks a block of 512 bits with its top 16 bits and one bit in each of the block's eight
words with six of its low 48 bits each. The filter has at most 2^16 blocks (4 MiB), whatever the
number of keys: more keys mean more false hits, which an exact join behind it removes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 16


def build(keys: DataFrame, column: str, bits_per_key: int = 16) -> np.ndarray:
    """keys: a column of well-mixed longs -> blocks x 8 words; rows sent to the driver: one a block."""
    n, blocks = keys.count(), 64
    while blocks * 512 < n * bits_per_key and blocks < MAX_BLOCKS:
        blocks *= 2
    h = F.col(column)
    bit = lambda j: F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {6 * j}) & 63 as int))")
    rows = keys.where(h.isNotNull()).groupBy(F.expr(f"shiftrightunsigned({column}, 48) & {blocks - 1}").alias("block")).agg(*[F.bit_or(bit(j)).alias(f"w{j}") for j in range(8)])
    out = np.zeros((blocks, 8), np.int64)
    for r in rows.collect():  # at most MAX_BLOCKS rows
        out[r[0]] = r[1:]
    return out.view(np.uint64)


def hits(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be among the keys. Each of the eight words is read only for those that passed the ones before."""
    h = h.view(np.uint64)
    mask, left = np.uint64(len(bloom) - 1), np.arange(len(h))
    block = ((h >> np.uint64(48)) & mask).astype(np.int64)
    flat = bloom.ravel()
    for j in range(8):
        x = flat[block * 8 + j] >> ((h >> np.uint64(6 * j)) & np.uint64(63))
        on = np.flatnonzero(x & np.uint64(1))
        left, block, h = left[on], block[on], h[on]
    return left


def probe(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash whether it may be among the keys."""
    may = np.zeros(len(h), bool)
    may[hits(bloom, h)] = True
    return may


def hash64(*c: Column) -> Column:
    return F.xxhash64(*c)
