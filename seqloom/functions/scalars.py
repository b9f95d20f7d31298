"""Score post-processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half to even, as numeric libraries round.
_ROUNDERS = {"ceil": F.ceil, "floor": F.floor, "around": F.bround}


def trunc(score: Column, method: str) -> Column:
    if method not in _ROUNDERS:
        raise ValueError(f"unknown rounding method {method!r}; use one of {sorted(_ROUNDERS)}")
    return _ROUNDERS[method](score).cast("double")


def cutoff(score: Column, threshold: float) -> Column:
    """1 strictly above the threshold, else 0."""
    return F.when(score > threshold, 1).otherwise(0)
