"""Doubles as integers in the same order: the next double up is one more."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST = -(2**63)


def ordinal(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits >= 0, bits, np.int64(_LEAST) - bits)


def from_ordinal(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.int64)
    return np.where(n >= 0, n, np.int64(_LEAST) - n).view(np.float64)


def _java(method: str, x: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit(method), x)


def ordinal_column(x: Column) -> Column:
    """As ordinal, on a column, without Python workers."""
    bits = _java("doubleToRawLongBits", x.cast("double")).cast("long")
    return F.transform(F.array(bits), lambda b: F.when(b >= 0, b).otherwise(F.lit(_LEAST) - b))[0]


def from_ordinal_column(n: Column) -> Column:
    return _java("longBitsToDouble", F.when(n >= 0, n).otherwise(F.lit(_LEAST) - n)).cast("double")
