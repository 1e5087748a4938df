"""Rounding as numerical libraries do it: scale, round half to even, scale back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column | str, digits: int = 2) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)
