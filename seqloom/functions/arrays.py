"""Column functions over the short, fixed-width arrays of examples and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# Timestamps above this are milliseconds; one bucket step of the log time gap.
MILLISECONDS_ABOVE = 1e12
GAP_LOG_STEP = 0.301


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it.

    Without it, an expression inside a lambda runs again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pad_left_with(seq: Column, length: int, fill: Column) -> Column:
    """Last ``length`` elements of ``seq``, filled up on the left."""
    kept = F.when(F.size(seq) > length, F.slice(seq, -length, length)).otherwise(seq)
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(length) - F.size(seq), F.lit(0))), kept)


def pad_left(seq: Column, length: int) -> Column:
    return pad_left_with(seq, length, F.lit(0).cast("long"))


def pad_right_with(seq: Column, length: int, fill: Column) -> Column:
    """First ``length`` elements of ``seq``, filled up on the right: one row of a score matrix."""
    missing = F.greatest(F.lit(length) - F.size(seq), F.lit(0))
    return F.concat(F.slice(seq, 1, length), F.array_repeat(fill, missing))


def masked_index(seq: Column, length: int) -> Column:
    """One flag per training position: 1 where a next item exists, 0 on the left pad."""
    ones = F.least(F.greatest(F.size(seq) - 1, F.lit(0)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), F.lit(length) - ones), F.array_repeat(F.lit(1), ones))


def time_features(time_seq: Column, length: int, milliseconds: bool = False) -> Column:
    """Padded timestamps as ``[year, month, day, hour, minute, second]`` in UTC.

    Built on zone-free timestamps, so the session time zone does not matter.
    """

    def fields(t: Column) -> Column:
        if milliseconds:
            t = F.when(t > MILLISECONDS_ABOVE, F.floor(t / 1000)).otherwise(t)
        zero = F.lit(0)
        at = F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, t)
        return F.array(F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at), F.second(at))

    return F.transform(pad_left(time_seq, length), fields)


def utc_epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    days = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def time_gap_buckets(time_seq: Column, length: int, buckets: int = 128) -> Column:
    """``length`` rows of ``length`` log-scaled gaps: row i holds ``ts[i+1] - ts[j]`` for each j.

    The last row reuses the last timestamp. ``time_seq`` must already have ``length`` elements.
    """

    def bucket(later: Column, earlier: Column) -> Column:
        gap = F.greatest(F.abs(later - earlier), F.lit(1))
        return F.least(F.floor(F.log(gap.cast("double")) / GAP_LOG_STEP), F.lit(buckets)).cast("int")

    following = F.concat(F.slice(time_seq, 2, length - 1), F.slice(time_seq, -1, 1))
    return F.transform(following, lambda later: F.transform(time_seq, lambda t: bucket(later, t)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(vec: Column, eps: float = 0.0) -> Column:
    """``vec`` divided by its length; ``eps`` is the smallest length used as divisor."""
    length = F.greatest(norm(vec), F.lit(eps)) if eps else norm(vec)
    # try_divide leaves the zero vector without a direction: its entries become null.
    return let(length, lambda n: F.transform(vec, lambda x: F.try_divide(x.cast("double"), n)))
