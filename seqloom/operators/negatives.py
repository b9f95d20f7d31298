"""Negative sampling without retry loops.

A draw ``r`` below the number of allowed ids is mapped to the r-th id outside the excluded set, so
one hash per negative is enough and the result does not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import cosine, hash_bits

# Fixed value: negatives closer to the target than this cosine count as the same item.
FALSE_NEGATIVE_COSINE = 0.99


def complement_id(draw: Column, excluded: Column, item_num: int) -> Column:
    """The id in ``[1, item_num - 1]`` at place ``draw`` (taken modulo) outside sorted ``excluded``."""
    start = F.pmod(draw, F.lit(item_num - 1) - F.size(excluded)) + 1
    return F.aggregate(excluded, start.cast("long"), lambda x, s: F.when(s <= x, x + 1).otherwise(x))


def _excluding(rows: DataFrame, column: str | None, item_num: int) -> DataFrame:
    """Add ``_excluded``: the sorted distinct valid ids of an array column."""
    if column is None:
        return rows.withColumn("_excluded", F.array().cast("array<long>"))
    valid = F.filter(column, lambda x: (x >= 1) & (x <= item_num - 1))
    return rows.withColumn("_excluded", F.array_sort(F.array_distinct(valid)))


def _draws(count: Column, item_num: int, *parts) -> Column:
    """``count`` draws; a sequence that leaves no id to draw gives null."""
    places = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))
    drawn = F.transform(places, lambda p: complement_id(hash_bits(*parts, p), F.col("_excluded"), item_num))
    none_asked = F.array().cast("array<long>")
    possible = F.size("_excluded") < item_num - 1
    return F.when(count <= 0, none_asked).when(possible, drawn)


def sample_negatives(chunks: DataFrame, item_num: int, seed: int) -> DataFrame:
    """``neg_item``: one id per transition, uniform over the items outside the sequence."""
    rows = _excluding(chunks, "item_seq", item_num)
    steps = F.size("item_seq") - 1
    drawn = _draws(steps, item_num, seed, F.col("user_id"), F.col("seq_no"))
    return rows.withColumn("neg_item", drawn).drop("_excluded")


def negative_rejects(chunks: DataFrame, item_num: int) -> DataFrame:
    """Sequences that contain the whole catalogue, so that no negative exists."""
    rows = _excluding(chunks, "item_seq", item_num)
    return rows.filter(F.size("_excluded") >= item_num - 1).drop("_excluded")


def negatives_per_example(num_negatives: int, world_size: int, batch_size: int) -> int:
    return math.ceil(num_negatives / world_size / batch_size)


def sample_fixed_negatives(chunks: DataFrame, count: int, item_num: int, seed: int, exclude: bool = True) -> DataFrame:
    """``count`` negatives per sequence. Id models exclude the sequence, text models nothing."""
    rows = _excluding(chunks, "item_seq" if exclude else None, item_num)
    drawn = _draws(F.lit(count), item_num, seed, "fixed", F.col("user_id"), F.col("seq_no"))
    return rows.withColumn("neg_item", drawn).drop("_excluded")


def random_left_pad(chunks: DataFrame, width: int, item_num: int, seed: int, column: str = "item_seq") -> DataFrame:
    """Fill ``column`` up on the left with random ids it does not contain, and keep the last ``width``."""
    rows = _excluding(chunks, column, item_num)
    missing = F.greatest(F.lit(width) - F.size(column), F.lit(0))
    pad = _draws(missing, item_num, seed, "pad", F.col("user_id"), F.col("seq_no"))
    kept = F.when(F.size(column) > width, F.slice(column, -width, width)).otherwise(F.col(column))
    return rows.withColumn(column, F.concat(pad, kept)).drop("_excluded")


def position_negatives(chunks: DataFrame, length: int, count: int, item_num: int, seed: int) -> DataFrame:
    """``length`` rows of ``count`` ids, drawn from all items; they may hit the positive."""

    def at(p: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda j: hash_bits(seed, "position", F.col("user_id"), F.col("seq_no"), p, j),
        )
        return F.transform(bits, lambda b: F.pmod(b, F.lit(item_num - 1)) + 1)

    return chunks.withColumn("neg_items", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def batch_negatives(examples: DataFrame) -> DataFrame:
    """``batch_id``, ``shared_negatives``: the negatives of all examples of a batch, in example order.

    One row for each batch, which its examples name by ``batch_id``: as much output as input.
    ``examples`` has ``batch_id``, ``example`` and ``neg_item``; a group is one training batch.
    """
    ordered = F.array_sort(F.collect_list(F.struct("example", "neg_item")))
    return examples.groupBy("batch_id").agg(F.flatten(ordered["neg_item"]).alias("shared_negatives"))


def shared_batch_negatives(examples: DataFrame) -> DataFrame:
    """Every example with a copy of its batch's negatives (:func:`batch_negatives`), where each must stand alone."""
    return examples.join(batch_negatives(examples), "batch_id")


def mask_false_negatives(pairs: DataFrame, vectors: DataFrame, threshold: float = FALSE_NEGATIVE_COSINE) -> DataFrame:
    """Keep ``(target_item, neg_item)`` rows whose vectors are not nearly the same.

    ``vectors`` is ``(item_id, vec)``. The cosine is worked out once per distinct pair of items;
    only the ids travel with the rows.
    """
    targets = vectors.select(F.col("item_id").alias("target_item"), F.col("vec").alias("_target"))
    negs = vectors.select(F.col("item_id").alias("neg_item"), F.col("vec").alias("_neg"))
    distinct = pairs.select("target_item", "neg_item").distinct().join(targets, "target_item").join(negs, "neg_item")
    scored = distinct.select("target_item", "neg_item", cosine(F.col("_target"), F.col("_neg")).alias("cosine"))
    return pairs.join(scored.filter(F.col("cosine") <= threshold), ["target_item", "neg_item"])
