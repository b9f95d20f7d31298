"""Seeded draws that come out the same on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: exact in a signed 64-bit integer


def hash_bits(*parts: Column | int | str) -> Column:
    """A 52-bit non-negative integer from the md5 of the parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def hash_slot(size: Column | int, *parts: Column | int | str) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.pmod(hash_bits(*parts), size.cast("long"))
