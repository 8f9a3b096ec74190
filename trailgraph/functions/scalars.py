"""Scalar functions on columns and on plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fixed value of the closeness sample size: about the natural logarithm of 1000.
CLOSENESS_CONSTANT = 6.907


def sample_size(n: int, eps: float) -> int:
    """Sources to draw for an error of eps: ceil(log2(n) / (2 eps^2))."""
    return math.ceil(math.log2(n) / (2 * eps * eps)) if n > 1 else 0


def closeness_sample_size(eps: float) -> int:
    """Sources to draw for closeness, whatever the number of vertices."""
    return math.ceil(CLOSENESS_CONSTANT / (2 * eps * eps))


def sample_size_column(n: Column, eps: Column) -> Column:
    return F.ceil(F.log2(n) / (F.lit(2.0) * eps * eps)).cast("long")


def closeness_sample_size_column(eps: Column) -> Column:
    return F.ceil(F.lit(CLOSENESS_CONSTANT).cast("double") / (F.lit(2.0) * eps * eps)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; NaN where b is 0, also under ANSI mode."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan")))


def bucket(value: Column, scale: float) -> Column:
    """The number of the bucket of width 1 / scale."""
    return F.floor(value * F.lit(float(scale))).cast("long")


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def hexadecimal(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))
