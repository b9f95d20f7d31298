"""User histories, splits, training chunks and evaluation examples.

A history stays in long form, one row per interaction with its place ``pos`` (0 is the oldest) and
the length ``n`` of its history, so one very active user spreads over many tasks. Arrays are built
only where their width is bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import pad_left
from seqloom.operators.ordering import MAX_GROUP_ROWS, group_positions

# Interactions held out at the end of a history, by phase.
HELD_OUT = {"valid": 2, "test": 1}


def sort_interactions(inter: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(flags) == 1:
        flags = flags * len(by)
    if len(flags) != len(by):
        raise ValueError(f"{len(by)} sort columns but {len(flags)} directions")
    return inter.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in zip(by, flags)])


def user_histories(
    inter: DataFrame, order_by: Sequence[str] = ("timestamp", "row_ord"), max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    return group_positions(inter, ["user_id"], list(order_by), max_group_rows=max_group_rows).select(
        "user_id", "item_id", "timestamp", "pos", "n"
    )


def _in_order(column: str):
    return F.col(f"_seq.{column}")


def _arrays(rows: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Parallel item and time arrays of groups whose size the caller has bounded."""
    seq = F.array_sort(F.collect_list(F.struct(at, "item_id", "timestamp"))).alias("_seq")
    return rows.groupBy(*key).agg(seq).select(
        *key, _in_order("item_id").alias("item_seq"), _in_order("timestamp").alias("time_seq")
    )


def user_sequences(histories: DataFrame, segment: int) -> DataFrame:
    """Item and time arrays per user, in segments of at most ``segment`` interactions, which bounds an array.

    An ordinary user is one row with ``segment_no`` 0. A longer history goes on in further rows.
    """
    cut = histories.withColumn("segment_no", F.floor(F.col("pos") / segment).cast("int"))
    return _arrays(cut, ["user_id", "segment_no"], "pos")


def split_leave_two_out(histories: DataFrame) -> DataFrame:
    """Training part: everything but the last two interactions of each user."""
    train = histories.filter(F.col("pos") < F.col("n") - 2)
    return train.withColumn("n", F.col("n") - 2)


def split_keep_all(histories: DataFrame) -> DataFrame:
    return histories


SPLITS = {"leave_two_out": split_leave_two_out, "keep_all": split_keep_all}


def chunk_rows(train: DataFrame, max_len: int, data_split: bool | None = True) -> DataFrame:
    """Assign rows to training sequences: ``seq_no``, ``seq_pos`` and ``seq_len``.

    A history longer than the width ``max_len + 1`` loses its oldest ``n mod width`` interactions
    and is cut into consecutive chunks of that width. With ``data_split=False`` it stays whole.
    """
    width = max_len + 1
    long_history = (F.col("n") > width) & F.lit(data_split is None or bool(data_split))
    skipped = F.when(long_history, F.col("n") % width).otherwise(0)
    at = F.col("pos") - skipped
    kept = train.filter(F.col("pos") >= skipped)
    return kept.withColumns(
        {
            "seq_no": F.when(long_history, F.floor(at / width)).otherwise(0).cast("int"),
            "seq_pos": F.when(long_history, at % width).otherwise(at).cast("long"),
            "seq_len": F.when(long_history, F.lit(width)).otherwise(F.col("n")).cast("long"),
        }
    )


def chunk_sequences(train: DataFrame, max_len: int, data_split: bool | None = True) -> DataFrame:
    """Training sequences as arrays of at most ``max_len + 1`` interactions.

    Of an uncut longer history these are the last ones, which is all that a training example reads;
    ``seq_len`` still gives the whole length and :func:`chunk_rows` all its rows.
    """
    rows = chunk_rows(train, max_len, data_split)
    used = rows.filter(F.col("seq_pos") >= F.col("seq_len") - (max_len + 1))
    return _arrays(used, ["user_id", "seq_no", "seq_len"], "seq_pos")


def prefix_augment(train: DataFrame, max_len: int) -> DataFrame:
    """Every prefix of length 2 and more of every chunk. Chunks of one item give none."""
    chunks = chunk_sequences(train, max_len).filter(F.size("item_seq") >= 2)
    ends = chunks.select("user_id", "seq_no", "item_seq", F.explode(F.sequence(F.lit(2), F.size("item_seq"))).alias("end"))
    return ends.select("user_id", "seq_no", "end", F.expr("slice(item_seq, 1, end)").alias("item_seq"))


def eval_examples(histories: DataFrame, phase: str, max_len: int) -> DataFrame:
    """One row per user: the held-out target and the last ``max_len`` interactions before it.

    Only ``max_len + 1`` rows of a history are collected. ``history_len`` is the full length;
    :func:`eval_rows` has all its items in order. Users without a target are in :func:`eval_rejects`.
    """
    target_at = F.col("n") - HELD_OUT[phase]
    window = histories.filter((F.col("pos") <= target_at) & (F.col("pos") >= target_at - max_len))
    is_target = F.col("pos") == target_at
    seen = F.array_sort(F.collect_list(F.when(~is_target, F.struct("pos", "item_id", "timestamp"))))
    rows = window.groupBy("user_id").agg(
        seen.alias("_seq"),
        F.max(F.when(is_target, F.col("item_id"))).alias("target"),
        F.first(target_at).alias("history_len"),
    )
    return rows.select(
        "user_id",
        F.lit(phase).alias("phase"),
        _in_order("item_id").alias("history"),
        _in_order("timestamp").alias("time_seq"),
        pad_left(_in_order("item_id"), max_len).alias("item_seq"),
        "target",
        "history_len",
    )


def eval_rejects(histories: DataFrame, phase: str) -> DataFrame:
    """Users too short to have a target in this phase."""
    return histories.filter(F.col("n") < HELD_OUT[phase]).select("user_id", "n").distinct()


def eval_history(histories: DataFrame, phase: str) -> DataFrame:
    """All ``(user_id, item_id)`` seen before the target: the items masked in ranking."""
    seen = histories.filter(F.col("pos") < F.col("n") - HELD_OUT[phase])
    return seen.select("user_id", "item_id").distinct()


def eval_rows(histories: DataFrame, phase: str) -> DataFrame:
    """The whole history before the target and the target itself, one row for each interaction.

    ``pos`` orders the rows of a user; the target, marked by ``is_target``, is the last of them.
    """
    target_at = F.col("n") - HELD_OUT[phase]
    is_target = (F.col("pos") == target_at).alias("is_target")
    return histories.filter(F.col("pos") <= target_at).select("user_id", "pos", "item_id", "timestamp", is_target)


def next_item_pairs(chunks: DataFrame) -> DataFrame:
    """Transitions ``(input_item, target_item)`` inside each training sequence."""
    steps = F.arrays_zip(
        F.expr("slice(item_seq, 1, size(item_seq) - 1)").alias("input_item"),
        F.expr("slice(item_seq, 2, size(item_seq) - 1)").alias("target_item"),
    )
    rows = chunks.filter(F.size("item_seq") >= 2).select("user_id", "seq_no", F.posexplode(steps).alias("step", "pair"))
    return rows.select("user_id", "seq_no", "step", "pair.input_item", "pair.target_item")


def cross_dataset_examples(
    train_inter: DataFrame, eval_inter: DataFrame, max_len: int, order_by: Sequence[str] = ("timestamp", "row_ord")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train on every row of one dataset, validate and test on another."""
    train = chunk_sequences(split_keep_all(user_histories(train_inter, order_by)), max_len)
    other = user_histories(eval_inter, order_by)
    return train, eval_examples(other, "valid", max_len), eval_examples(other, "test", max_len)


def cross_dataset_rows(
    train_inter: DataFrame, eval_inter: DataFrame, max_len: int, order_by: Sequence[str] = ("timestamp", "row_ord")
) -> DataFrame:
    """The three parts of :func:`cross_dataset_examples` in long form, histories whole.

    Columns are ``part``, ``user_id``, ``seq_no`` (-1 outside the training part), ``pos`` in the sequence,
    ``item_id`` and ``is_target``; ids are text, as those of the two datasets may differ in type.
    """
    columns = ["part", F.col("user_id").cast("string"), "seq_no", "pos", F.col("item_id").cast("string"), "is_target"]
    train = chunk_rows(split_keep_all(user_histories(train_inter, order_by)), max_len).withColumn("pos", F.col("seq_pos"))
    parts = train.withColumns({"part": F.lit("train"), "is_target": F.lit(False)}).select(*columns)
    other = user_histories(eval_inter, order_by)
    for phase in HELD_OUT:
        rows = eval_rows(other, phase).withColumns({"part": F.lit(phase), "seq_no": F.lit(-1)})
        parts = parts.unionByName(rows.select(*columns))
    return parts
