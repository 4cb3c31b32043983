"""Scalar functions as columns; vectors are arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least argument of a logarithm, and the code's scales for stored log probabilities.
LOG_FLOOR, LNA_SCALE, LNA_LEAST, LNA_SHORT_SCALE = 1e-50, 1820.0, -36.008, 24.0


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log10_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.pow(F.lit(10.0), -F.abs(a - b))) / F.lit(math.log(10))


def safe_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(LOG_FLOOR)))


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x)."""
    return F.when(F.abs(x) < 1e-12, F.lit(1.0)).otherwise(F.sin(F.lit(math.pi) * x) / (F.lit(math.pi) * x))


def modulo(a: Column, b: Column) -> Column:
    """The remainder that is not negative."""
    return F.pmod(a, b)


def upper_median(values: Column) -> Column:
    """Of an array the middle element, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def byte_text(text: Column) -> Column:
    """Each byte of the text as one letter, so that distances count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_distance(a: Column, b: Column) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(byte_text(a), byte_text(b))


def cut(distance: Column, most: int) -> Column:
    """A distance, most + 1 where it is more than `most`."""
    return F.least(distance, F.lit(most + 1))


def cut_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance in bytes, most + 1 where it is more than `most`."""
    d = F.levenshtein(byte_text(a), byte_text(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def lna_encode(lp: Column) -> Column:
    """A log probability as an unsigned 16-bit number."""
    return F.when(lp < LNA_LEAST, F.lit(65535)).otherwise(F.floor(-lp * LNA_SCALE + 0.5).cast("int"))


def lna_decode(code: Column, width: int = 2) -> Column:
    return code / F.lit(-LNA_SCALE if width == 2 else -LNA_SHORT_SCALE)
