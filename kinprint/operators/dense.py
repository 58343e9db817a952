"""Work on whole blocks of pairs. Every task gets all hashes, a few bytes each, and nothing that is
made of their pairs is shuffled: a block of rows meets all columns where its results are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Pairs that are compared at once, and the most tasks that a table of blocks is dealt to.
CELLS, MAX_TASKS = 1 << 21, 1_000


class Points(NamedTuple):
    """Hashes in the order of their index. ``first`` has the place of each different string's least member, ascending."""

    idx: np.ndarray
    words: np.ndarray  # as in the frame
    kind: np.ndarray  # which of the different strings each has
    first: np.ndarray
    copies: np.ndarray

    @property
    def codes(self) -> np.ndarray:
        return packed(self.words[self.first])


def packed(words: np.ndarray) -> np.ndarray:
    """The same bits in the widest machine words that they fill; shorter strings in the narrowest that holds them."""
    words = words.astype(np.uint64)
    if words.shape[1] == 1:
        return (words >> np.uint64(16)).astype(np.uint16) if not (words & np.uint64(0xFFFF)).any() else words.astype(np.uint32)
    if words.shape[1] % 2:
        words = np.hstack([words, np.zeros((len(words), 1), np.uint64)])
    return words[:, ::2] << np.uint64(32) | words[:, 1::2]


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two packed arrays; bytes where they suffice."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    if a.shape[1] > 3:
        out = out.astype(np.uint16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def collected(hashes: DataFrame) -> Points:
    """All hashes, their different strings numbered by their first members."""
    rows = hashes.select("file_idx", "words").toArrow()
    idx = rows.column("file_idx").to_numpy().astype(np.int64)
    flat = rows.column("words").combine_chunks()
    words = flat.flatten().to_numpy(zero_copy_only=False) if len(idx) else np.zeros(0, np.int64)
    words = words.astype(np.uint64).reshape(len(idx), -1 if len(idx) else 1)
    order = np.argsort(idx, kind="stable")
    idx, words = idx[order], words[order]
    _, first, kind, copies = np.unique(words, axis=0, return_index=True, return_inverse=True, return_counts=True)
    by_first = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[by_first] = np.arange(len(first))
    return Points(idx, words, rank[kind.reshape(-1)], first[by_first], copies[by_first])


def by_block(spark: SparkSession, n: int, rows: int, work: Callable[[int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work(low, high)`` yields for consecutive blocks of ``rows`` of 0, ..., n - 1."""
    blocks = max(1, -(-n // rows))

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = k * rows, min(n, (k + 1) * rows)
                if low < high:
                    yield from work(low, high)

    return spark.range(0, blocks, 1, min(blocks, MAX_TASKS)).mapInArrow(run, schema)


def rows_at_once(columns: int) -> int:
    return max(1, CELLS // max(1, columns))


def kth_nearest(spark: SparkSession, codes: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """For each different string, the distance of a copy to its k-th nearest other hash."""
    near = spark.sparkContext.broadcast((codes, np.minimum(copies, k + 1).astype(np.float32)))

    def work(low, high):
        codes, copies = near.value
        d = between(codes[low:high], codes)
        core = np.zeros(high - low, np.int32)
        left = np.arange(high - low)
        t = 0
        while len(left):
            enough = (d[left] <= t).astype(np.float32) @ copies > k  # more than k: a copy meets itself
            core[left[enough]] = t
            left, t = left[~enough], t + 1
        yield pa.record_batch([pa.array(np.arange(low, high)), pa.array(core)], names=["at", "core"])

    n = len(codes)
    block = max(1, min(rows_at_once(n), -(-n // 48)))
    found = by_block(spark, n, block, work, "at long, core int").toArrow()
    out = np.zeros(n, np.int64)
    out[found.column("at").to_numpy()] = found.column("core").to_numpy()
    near.unpersist()
    return out
