"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

# A key is heavy from this share of the mean shuffle partition on, and from so many rows at least.
HEAVY_SHARE, HEAVY_ROWS = 0.25, 1_000


def heavy_keys(
    rows: DataFrame, key: str, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """``key``, ``salts`` of the keys that one task shouldn't hold, and into how many parts to split them.

    Keys are counted with a combine on the map side, unless ``sizes`` (``key``, ``n``) has their numbers, written
    already. As a heavy key holds a fixed share of the rows, at most ``partitions / share`` keys are heavy,
    whatever the input.
    """
    if sizes is None:
        sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        sizes = materialize(sizes, "key-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least, int(total / partitions * share))
    return sizes.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def heavy_join(
    many: DataFrame,
    few: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    share: float = HEAVY_SHARE,
    least: int = HEAVY_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``many`` joined with ``few`` on ``key`` (inner, left or left_semi), heavy keys of ``many`` split.

    The rows of a heavy key are dealt to its parts by a hash of the columns ``spread_by``, which should tell
    them apart; the rows of ``few`` with that key are repeated once for each part. All other rows are in
    part 0. So no task holds a whole heavy key, without relying on adaptive execution.
    """
    heavy = heavy_keys(many, key, share, least, sizes)
    if heavy.isEmpty():
        return many.join(few, key, how)
    # A bounded number of keys, see heavy_keys.
    salts = F.broadcast(heavy)
    dealt = F.pmod(F.xxhash64(*spread_by), F.col("salts")).cast("int")
    left = many.join(salts, key, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("salts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    right = few.join(salts, key, "left").withColumn("_salt", parts).drop("salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
