"""Packed arrays and buckets: how blocks of documents ask the rest of the corpus about keys.

Rows of 64-bit keys are bulky in a shuffle. A block of documents sorts its distinct keys and
sends, for each bucket of a hash, one packed array; the bucket's answers come back in the
same order, without the keys.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned keys: differences, by byte planes, compressed."""
    step = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Any array, compressed as it is."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack_small(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def dealt(buckets: np.ndarray):
    """(bucket, places of its keys) for each bucket that has any; places keep their order."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    held = buckets[order]
    edge = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    for a, b in zip(edge, [*edge[1:], len(held)], strict=True):
        yield int(held[a]), order[a:b]


def release() -> None:
    """Give memory that a finished task has freed back to the system; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim
