"""Helpers for oracle comparisons (used by the query wiring and tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def snap(c, digits: int = DIGITS):
    """``floor(x·10^d + 0.5) / 10^d`` in plain IEEE arithmetic, which both
    engines evaluate bit-identically (their ``round`` functions treat decimal
    ties differently)."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def stable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Snap every DOUBLE column: engines differ around 1e-13 in sums."""
    return df.select(*[snap(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])
