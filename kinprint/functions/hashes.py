"""Perceptual fingerprints of gray grids: difference, cosine-transform and wavelet hashes.

The difference hash compares neighbours and is a column expression. The others need matrix
products and run on Arrow batches with NumPy.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinprint.functions import bits

MIN_SIZE, MAX_SIZE = 2, 1024
#: Coefficients are rounded before they meet the median, so a flat picture has no random bits.
DECIMALS = 6


def check_size(size: int) -> None:
    if not MIN_SIZE <= size <= MAX_SIZE:
        raise ValueError(f"hash size must be {MIN_SIZE} to {MAX_SIZE}")


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def raster_shape(algorithm: str, size: int) -> tuple[int, int]:
    """(width, height) of the grid that a hash is made of."""
    check_size(size)
    if algorithm in ("dhash", "dhash_left"):
        return size + 1, size
    if algorithm == "phash":
        side = max(32, 4 * size)
    elif algorithm == "whash":
        side = max(8, next_power_of_two(2 * size))
    else:
        raise ValueError(f"unknown hash {algorithm!r}")
    return side, side


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Integer gray value of 8-bit colours."""
    return F.shiftright(red * 77 + green * 150 + blue * 29, 8)


def dhash_bits(grid: Column, size: int, rising: bool = False) -> Column:
    """Row by row: is a cell larger than its right neighbour (``rising``: smaller)."""
    check_size(size)

    def compare(k: Column) -> Column:
        at = (F.floor(k / size) * (size + 1) + F.pmod(k, F.lit(size))).cast("int")
        left, right = F.get(grid, at), F.get(grid, at + 1)
        return F.when((left < right) if rising else (left > right), 1).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), compare)


def dhash(grid: Column, size: int, rising: bool = False) -> Column:
    return F.when(F.size(grid) == size * (size + 1), bits.pack(dhash_bits(grid, size, rising), size * size))


@functools.cache
def cosine_matrix(n: int) -> np.ndarray:
    """Unnormalised type-II cosine transform."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi / n * (x + 0.5) * k)


@functools.cache
def haar_matrix(n: int) -> np.ndarray:
    """Orthonormal Haar transform, coarsest row first; n is a power of two."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.vstack([np.kron(h, [1, 1]), np.kron(np.eye(len(h)), [1, -1])]) / math.sqrt(2)
    return h


def over_median(block: np.ndarray) -> np.ndarray:
    """Which entries exceed the median of all but the first; the first is compared as well."""
    flat = np.round(block.ravel(), DECIMALS)
    return (flat > np.median(flat[1:])).astype(np.uint8)


def transform_bits(grid: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    return over_median((matrix @ grid @ matrix.T)[:size, :size])


def words_of(flags: np.ndarray) -> list[int]:
    padded = np.zeros(bits.n_words(len(flags)) * bits.WORD, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded).view(">u4").astype(np.int64).tolist()


def grid_hash(algorithm: str, size: int, side: int | None = None):
    """A pandas UDF from a square grid (row by row) to words; null for grids of another shape.

    ``side`` overrides the grid's side, for grids that come from elsewhere than pictures.
    """
    if algorithm not in ("phash", "whash"):
        raise ValueError(f"unknown transform hash {algorithm!r}")
    side = side or raster_shape(algorithm, size)[0]
    if size > side:
        raise ValueError("the hash is larger than its grid")
    matrix = cosine_matrix(side) if algorithm == "phash" else haar_matrix(side)

    @F.pandas_udf("array<long>")
    def run(grids: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if g is None or len(g) != side * side
                else words_of(transform_bits(np.asarray(g, float).reshape(side, side), matrix, size))
                for g in grids
            ],
            dtype=object,
        )

    return run


#: Hash makers of gray rasters, by name; ``register_hash`` adds more.
RASTER_HASHES: dict = {}


def register_hash(name: str, make_bits, shape) -> None:
    """``make_bits(raster, size)`` gives 0/1 flags; ``shape(size)`` the (width, height) it wants."""
    RASTER_HASHES[name] = (make_bits, shape)


def _difference(raster: np.ndarray, size: int, rising: bool = False) -> np.ndarray:
    a, b = raster[:, :-1].astype(int), raster[:, 1:].astype(int)
    return ((a < b) if rising else (a > b)).astype(np.uint8).ravel()


register_hash("dhash", _difference, lambda s: raster_shape("dhash", s))
register_hash("dhash_left", functools.partial(_difference, rising=True), lambda s: raster_shape("dhash", s))
register_hash("phash", lambda r, s: transform_bits(r.astype(float), cosine_matrix(len(r)), s), lambda s: raster_shape("phash", s))
register_hash("whash", lambda r, s: transform_bits(r.astype(float), haar_matrix(len(r)), s), lambda s: raster_shape("whash", s))
