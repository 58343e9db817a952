"""Bit strings as columns.

A fingerprint of ``n`` bits is an array of 32-bit words held in longs, first bit highest, the last
word filled up with zeros. Longs keep words non-negative, which makes XOR, hex and bands simple.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32


def n_words(n_bits: int) -> int:
    return math.ceil(n_bits / WORD)


def pack(bits: Column, n_bits: int) -> Column:
    """Array of 0/1 to words."""
    padded = F.concat(bits, F.array_repeat(F.lit(0), n_words(n_bits) * WORD - n_bits))
    return F.array(
        *[
            F.aggregate(F.slice(padded, k * WORD + 1, WORD), F.lit(0).cast("long"), lambda a, x: a * 2 + x)
            for k in range(n_words(n_bits))
        ]
    )


def bit(words: Column, at: Column) -> Column:
    """The bit at a place, counted from the first."""
    word = F.element_at(words, (F.floor(at / WORD) + 1).cast("int"))
    return F.getbit(word, (F.lit(WORD - 1) - F.pmod(at, F.lit(WORD))).cast("int"))


def unpack(words: Column, n_bits: int) -> Column:
    """Words to an array of 0/1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda k: bit(words, k).cast("int"))


def to_hex(words: Column, n_bits: int) -> Column:
    """Two lower-case digits for each byte that the bits take."""
    digits = F.concat(*[F.lpad(F.hex(words[k]), 8, "0") for k in range(n_words(n_bits))])
    return F.lower(F.substring(digits, 1, 2 * math.ceil(n_bits / 8)))


def from_hex(text: Column, n_bits: int) -> Column:
    """The words of a hex string; null where it has another length or other characters."""
    size = 2 * math.ceil(n_bits / 8)
    padded = F.rpad(text, 8 * n_words(n_bits), "0")
    words = F.array(*[F.conv(F.substring(padded, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n_words(n_bits))])
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{size}}}$"), words)


def hamming(a: Column, b: Column, n_bits: int) -> Column:
    """The number of differing bits of two word arrays of one size."""
    parts = [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(n_words(n_bits))]
    return sum(parts[1:], parts[0])


def band(words: Column, begin: int, width: int) -> Column:
    """``width`` consecutive bits as one number; a band may span two words."""
    out = F.lit(0).cast("long")
    at = begin
    while at < begin + width:
        k, inside = divmod(at, WORD)
        take = min(WORD - inside, begin + width - at)
        piece = F.shiftright(words[k], WORD - inside - take).bitwiseAND(F.lit((1 << take) - 1))
        out = F.shiftleft(out, take).bitwiseOR(piece)
        at += take
    return out
