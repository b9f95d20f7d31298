"""Shards and batches of training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import global_rank


def shard_round_robin(df: DataFrame, order_by: Sequence[str], shards: int) -> DataFrame:
    """Row i goes to shard ``i mod shards``; the last shards may be one row shorter."""
    ranked = global_rank(df, order_by, "row_no")
    return ranked.withColumn("shard", F.pmod("row_no", F.lit(shards)).cast("int"))


def shard_consecutive(df: DataFrame, order_by: Sequence[str], batch_size: int, shards: int) -> DataFrame:
    """Equal shards of consecutive rows, whole batches each; the last row fills up the tail."""
    ranked = global_rank(df, order_by, "row_no")
    rows = df.count()
    shard_rows = -(-rows // (batch_size * shards)) * batch_size
    # Fewer than batch_size * shards extra copies, made from the one last row.
    fill = shard_rows * shards - rows
    last = ranked.filter(F.col("row_no") == rows - 1)
    extra = last.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(fill, 1))))).filter(F.lit(fill > 0))
    extra = extra.withColumn("row_no", F.col("row_no") + F.col("_copy")).drop("_copy")
    return ranked.unionByName(extra).withColumn("shard", F.floor(F.col("row_no") / shard_rows).cast("int"))


def shuffled_shards(df: DataFrame, key: Sequence[str], shards: int, seed: int, epoch: int) -> DataFrame:
    """Round-robin shards of an order that changes with every epoch."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))
    return shard_round_robin(df.withColumn("_draw", draw), ["_draw", *key], shards).drop("_draw")


def batched(df: DataFrame, order_by: Sequence[str], batch_size: int) -> DataFrame:
    """Number the rows and cut them into batches: ``row_no``, ``batch_id`` and ``example``.

    The order is sampled before it is made, which reads ``df`` twice: add costly columns afterwards.
    """
    ranked = global_rank(df, order_by, "row_no")
    return ranked.withColumns(
        {
            "batch_id": F.floor(F.col("row_no") / batch_size).cast("long"),
            "example": F.pmod("row_no", F.lit(batch_size)).cast("int"),
        }
    )


def ragged_history_index(histories: DataFrame, eval_rows: DataFrame) -> DataFrame:
    """``(batch_id, example, item_id)`` for every history item of every batched evaluation row.

    ``histories`` is the long ``(user_id, item_id, ...)`` form, so no history is gathered in a row.
    """
    place = eval_rows.select("user_id", "batch_id", "example")
    return histories.join(place, "user_id").select("batch_id", "example", *[c for c in histories.columns if c != "user_id"])


def packed_rows(tokens: DataFrame, max_len: int, slots: int) -> DataFrame:
    """Add ``slots`` zero ids to each row's ``input_ids``, with its length and right-aligned positions."""
    length = F.size("input_ids") + slots
    return tokens.withColumns(
        {
            "packed_ids": F.concat("input_ids", F.array_repeat(F.lit(0).cast("long"), slots)),
            "packed_len": length,
            "position_ids": F.transform(
                F.sequence(F.lit(0), length - 1), lambda i: i + F.lit(max_len) - F.size("input_ids")
            ),
        }
    )


def packed_batches(rows: DataFrame) -> DataFrame:
    """Concatenate the packed rows of each batch without padding; a group is one training batch."""
    ordered = F.array_sort(F.collect_list(F.struct("example", "packed_ids", "packed_len", "position_ids")))
    grouped = rows.groupBy("batch_id").agg(ordered.alias("_rows"))
    return grouped.select(
        "batch_id",
        F.flatten("_rows.packed_ids").alias("input_ids"),
        F.col("_rows.packed_len").alias("cu_input_lens"),
        F.flatten("_rows.position_ids").alias("position_ids"),
    )
