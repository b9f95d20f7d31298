"""Exact global and per-group order without putting a large group into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

# Rows of one group that a single task may sort. Larger groups are split over range partitions.
MAX_GROUP_ROWS = 2_000_000
# Rows a sort with a limit may hold in one task. Longer reports use the distributed rank.
MAX_LIMIT_ROWS = 10_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above, the row number below


def _placed(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Rows sorted over range partitions, each with its partition and its place inside it."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered = ordered.withColumn("_slot", F.monotonically_increasing_id())
    return materialize(ordered, "ordered").withColumns(
        {
            "_part": F.shiftright("_slot", _ROW_BITS),
            "_row": F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )


def _offsets(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per range partition, the totals of all partitions before it.

    Only one row per partition reaches the driver, so the broadcast is bounded by the number of
    shuffle partitions.
    """
    names = list(totals)
    per_part = placed.groupBy("_part").agg(*[c.alias(n) for n, c in totals.items()]).collect()
    per_part.sort(key=lambda r: r["_part"])
    before = [[0, *accumulate(r[n] for r in per_part)] for n in names]
    rows = [(r["_part"], *[b[i] for b in before]) for i, r in enumerate(per_part)]
    fields = ", ".join(f"{n}_before long" for n in names)
    return F.broadcast(placed.sparkSession.createDataFrame(rows, f"_part long, {fields}"))


def global_rank(df: DataFrame, order_by: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Zero-based position of every row in the order of ``order_by`` (unique keys)."""
    placed = _placed(df, order_by)
    offsets = _offsets(placed, {"rows": F.count(F.lit(1))})
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("rows_before") + F.col("_row"))
        .drop("_part", "_row", "_slot", "rows_before")
    )


def running_totals(df: DataFrame, order_by: Sequence[str | Column], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums of whole-number columns: ``totals`` maps a new name to its column."""
    placed = _placed(df, order_by)
    offsets = _offsets(placed, {n: F.sum(c) for n, c in totals.items()})
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_{n}": F.sum(c).over(within) for n, c in totals.items()})
    summed = summed.join(offsets, "_part")
    summed = summed.withColumns({n: F.col(f"_{n}") + F.col(f"{n}_before") for n in totals})
    return summed.drop("_part", "_row", "_slot", *[f"_{n}" for n in totals], *[f"{n}_before" for n in totals])


def group_positions(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    position: str = "pos",
    size: str = "n",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Zero-based position of each row inside its group, and the group's size.

    Groups of ordinary size use one window shuffle. Groups above ``max_group_rows`` take the
    distributed rank instead: their rows spread over range partitions and no task holds a whole
    group. Both ways give the same numbers.
    """
    group_by = list(group_by)
    sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias(size))
    largest = sizes.agg(F.max(size)).first()[0] or 0
    if largest <= max_group_rows:
        return _window_positions(df, group_by, order_by, position, size)
    # At most rows / max_group_rows groups are this large, which bounds the broadcast.
    large = F.broadcast(sizes.filter(F.col(size) > max_group_rows))
    same = [df[c].eqNullSafe(large[c]) for c in group_by]
    ordinary = _window_positions(df.join(large, same, "left_anti"), group_by, order_by, position, size)
    ranked = global_rank(df.join(large, same, "left_semi"), [*group_by, *order_by], "_rank")
    starts = ranked.groupBy(*group_by).agg(F.min("_rank").alias("_start"), F.count(F.lit(1)).alias(size))
    starts = F.broadcast(starts.withColumnsRenamed({c: f"_{c}" for c in group_by}))
    split = (
        ranked.join(starts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group_by])
        .withColumn(position, F.col("_rank") - F.col("_start"))
        .drop("_rank", "_start", *[f"_{c}" for c in group_by])
    )
    return ordinary.unionByName(split)


def _window_positions(df, group_by, order_by, position, size) -> DataFrame:
    group = Window.partitionBy(*group_by)
    return df.withColumns(
        {
            position: (F.row_number().over(group.orderBy(*order_by)) - 1).cast("long"),
            size: F.count(F.lit(1)).over(group),
        }
    )


def take_first(df: DataFrame, order_by: Sequence[str], n: int, max_limit_rows: int = MAX_LIMIT_ROWS) -> DataFrame:
    """The first ``n`` rows in the order of the columns ``order_by`` (unique, without nulls).

    A short report is a sort with a limit. For a long one only the keys are ranked, and the rows up
    to the n-th key are kept where they are.
    """
    if n <= max_limit_rows:
        return df.orderBy(*order_by).limit(n)
    keys = global_rank(df.select(*order_by), order_by, "_rank")
    last = keys.filter(F.col("_rank") == n - 1).select(*order_by).first()
    if last is None:
        return df
    return df.filter(F.struct(*order_by) <= F.struct(*[F.lit(last[c]).alias(c) for c in order_by]))


def exact_percentiles(df: DataFrame, value: str, levels: Sequence[float]) -> DataFrame:
    """``(level, value)`` with linear interpolation, without one buffer of all values.

    Equal values are counted first, so a value that fills a third of the rows is one row of the
    ordered table.
    """
    counted = df.select(F.col(value).cast("double").alias("_v")).filter("_v is not null")
    counted = counted.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, ["_v"], {"_end": "_n"})
    last = (ranked.agg(F.max("_end")).first()[0] or 1) - 1
    cells = [
        F.struct(F.lit(float(q)).alias("level"), F.lit(r).alias("_r"), F.lit(q * last - math.floor(q * last)).alias("_part"))
        for q in levels
        for r in {math.floor(q * last), math.ceil(q * last)}
    ]
    covers = F.filter(F.array(*cells), lambda c: (c["_r"] < F.col("_end")) & (c["_r"] >= F.col("_end") - F.col("_n")))
    hits = ranked.select("_v", F.explode(covers).alias("c")).groupBy("c.level").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("c._part").alias("_part")
    )
    return hits.select("level", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def running_max(
    df: DataFrame, group_by: Sequence[str], place: str, values: dict[str, Column], block: int = 100_000
) -> DataFrame:
    """Largest value so far in each group, in the order of the dense zero-based column ``place``.

    A group is cut into blocks of ``block`` places: running maxima inside the blocks, then the
    maxima of the blocks before, so a long group is spread over tasks.
    """
    rows = df.withColumns({f"_{n}": c for n, c in values.items()}).withColumn("_block", F.floor(F.col(place) / block))
    key = [*group_by, "_block"]
    inside = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group_by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(*[F.max(f"_{n}").alias(f"_{n}") for n in values])
    blocks = blocks.select(*key, *[F.max(f"_{n}").over(earlier).alias(f"_{n}_before") for n in values])
    local = rows.withColumns({n: F.max(f"_{n}").over(inside) for n in values}).join(blocks, key)
    # greatest skips nulls: the first block has nothing before it.
    done = local.withColumns({n: F.greatest(n, f"_{n}_before") for n in values})
    return done.drop("_block", *[f"_{n}" for n in values], *[f"_{n}_before" for n in values])
