"""BM25 in single precision, as plain Python for the driver and as Columns.

A field's length is kept as one byte: exact up to 23, then the four leading
bits. Scores are defined by float32 arithmetic in a fixed order, so that equal
statistics give equal bits on any engine.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
#: Lengths below this are kept exactly.
EXACT = 24


def f32(x: float) -> float:
    """The nearest single-precision number, infinite beyond the largest."""
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return math.copysign(math.inf, x)


def encode_length(n: int) -> int:
    """The byte that stands for a field of ``n`` tokens."""
    v = n - EXACT
    if v < 8:
        return n
    shift = v.bit_length() - 4
    return EXACT + ((v >> shift) & 7 | (shift + 1) << 3)


def decode_length(b: int) -> int:
    """The least length that ``b`` stands for."""
    if b < EXACT + 8:
        return b
    b -= EXACT
    return EXACT + ((b & 7 | 8) << ((b >> 3) - 1))


def encoded_length(n: Column) -> Column:
    """``encode_length`` as a smallint Column."""
    v = n - EXACT
    shift = F.length(F.bin(v)) - 4
    top = F.call_function("shiftright", v, shift.cast("int")).bitwiseAND(F.lit(7))
    return F.when(v < 8, n).otherwise(F.lit(EXACT) + top.bitwiseOR((shift + 1) * 8)).cast("smallint")


def idf(doc_freq: int, doc_count: int) -> float:
    """The rarity of a term: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return f32(math.log(1 + (doc_count - doc_freq + 0.5) / (doc_freq + 0.5)))


def idf_sum(idfs: list[float]) -> float:
    """The rarity of a phrase; a repeated term counts each time."""
    return f32(sum(idfs))


def average_length(sum_total_term_freq: int, doc_count: int) -> float:
    return f32(sum_total_term_freq / doc_count)


def length_factors(average: float) -> list[float]:
    """For each length byte the factor that frequencies are multiplied by."""
    return [f32(1 / f32(f32(K1) * f32(f32(1 - B) + f32(f32(f32(B) * f32(decode_length(b))) / average)))) for b in range(256)]


class Bm25:
    """Scores of one term or phrase."""

    def __init__(self, boost: float, idf_value: float, average: float):
        self.weight = f32(f32(boost) * idf_value)
        self.factors = length_factors(average)

    @classmethod
    def for_term(cls, boost: float, doc_freq: int, doc_count: int, sum_total_term_freq: int) -> Bm25:
        return cls(boost, idf(doc_freq, doc_count), average_length(sum_total_term_freq, doc_count))

    def score(self, freq: float, norm: int = 1) -> float:
        w = self.weight
        return f32(w - f32(w / f32(1 + f32(f32(freq) * self.factors[norm]))))

    def column(self, freq: Column, norm: Column, factors: Column | None = None) -> Column:
        """The score as a float Column; ``factors``: the 256 factors as an array, shared between terms."""
        return score_column(F.lit(self.weight).cast("float"), freq, F.get(factors if factors is not None else factor_array(self.factors), norm.cast("int")))


def factor_array(factors: list[float]) -> Column:
    """The factors as one literal array; as text, since a call for each would take the driver longer than the query."""
    return F.expr(f"array({', '.join(f'{x!r}F' for x in factors)})")


def score_column(weight: Column, freq: Column, factor: Column) -> Column:
    """w - w / (1 + freq * factor), rounded to float after each step."""
    x = freq.cast("float") * factor
    return weight - (weight / (F.lit(1).cast("float") + x)).cast("float")
