import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom import functions as fn
from seqloom import plans
from seqloom.operators import sequences as seq
from seqloom.plans import examples
from tests.helpers import log, rows

ORDER = ["timestamp", "row_ord"]


def chunks(spark, n, max_len=3, data_split=True):
    train = seq.split_keep_all(seq.user_histories(log(spark, {1: list(range(1, n + 1))}), ORDER))
    got = seq.chunk_sequences(train, max_len, data_split).orderBy("seq_no").collect()
    return [r["item_seq"] for r in got]


@pytest.mark.parametrize("n,want", [
    (3, [[1, 2, 3]]),
    (4, [[1, 2, 3, 4]]),
    (5, [[2, 3, 4, 5]]),
    (8, [[1, 2, 3, 4], [5, 6, 7, 8]]),
    (9, [[2, 3, 4, 5], [6, 7, 8, 9]]),
])
def test_chunks(spark, n, want):
    assert chunks(spark, n) == want
    assert chunks(spark, n, data_split=None) == want


def test_uncut_sequence_keeps_all_rows_and_the_window_read_from_it(spark):
    train = seq.user_histories(log(spark, {1: list(range(1, 10))}), ORDER)
    assert seq.chunk_rows(train, 3, data_split=False).filter("seq_no = 0").count() == 9
    assert chunks(spark, 9, data_split=False) == [[6, 7, 8, 9]]


def test_prefixes(spark):
    train = seq.user_histories(log(spark, {1: [1, 2, 3], 2: [1]}), ORDER)
    assert rows(seq.prefix_augment(train, 5), "user_id", "end", "item_seq") == [(1, 2, [1, 2]), (1, 3, [1, 2, 3])]


def test_eval_examples(spark):
    placed = seq.user_histories(log(spark, {1: [1, 2, 3, 4]}), ORDER)
    valid = seq.eval_examples(placed, "valid", 3).first()
    test = seq.eval_examples(placed, "test", 3).first()
    assert (valid["history"], valid["target"], valid["item_seq"]) == ([1, 2], 3, [0, 1, 2])
    assert (test["history"], test["target"], test["item_seq"]) == ([1, 2, 3], 4, [1, 2, 3])
    assert test["history_len"] == 3


def test_eval_of_short_users(spark):
    placed = seq.user_histories(log(spark, {1: [7], 2: [8, 9]}), ORDER)
    assert rows(seq.eval_examples(placed, "valid", 3), "user_id", "history", "target") == [(2, [], 8)]
    assert rows(seq.eval_rejects(placed, "valid")) == [(1, 1)]
    assert rows(seq.eval_examples(placed, "test", 3), "user_id", "target") == [(1, 7), (2, 9)]


def test_training_never_sees_the_held_out_items(spark):
    placed = seq.user_histories(log(spark, {u: list(range(u, u + 3 + u % 20)) for u in range(30)}), ORDER)
    train = seq.split_leave_two_out(placed)
    assert train.join(placed.filter("pos >= n - 2"), ["user_id", "pos"], "left_semi").count() == 0
    sizes = {len(r["item_seq"]) for r in seq.chunk_sequences(train.filter("n > 4"), 3).collect()}
    assert sizes == {4}


@pytest.mark.parametrize("partitions,bound", [(1, 10**6), (8, 10**6), (8, 5)])
def test_sequences_do_not_depend_on_partitions_or_skew(spark, partitions, bound):
    rng = random.Random(5)
    data = {0: [rng.randrange(50) for _ in range(400)], **{u: [rng.randrange(50) for _ in range(u)] for u in range(1, 30)}}
    df = log(spark, data).orderBy(F.rand(seed=partitions)).repartition(partitions)
    placed = seq.user_histories(df, ORDER, max_group_rows=bound)
    got = {r["user_id"]: r["item_seq"] for r in seq.user_sequences(placed, 100).collect()}
    assert got == {u: items for u, items in data.items() if items}


def test_long_history_is_split_into_segments(spark):
    placed = seq.user_histories(log(spark, {1: list(range(10))}), ORDER)
    got = rows(seq.user_sequences(placed, segment=4), "segment_no", "item_seq")
    assert got == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]


def test_later_events_do_not_change_earlier_positions(spark):
    short = seq.user_histories(log(spark, {1: [5, 6, 7]}), ORDER)
    longer = seq.user_histories(log(spark, {1: [5, 6, 7, 8, 9]}), ORDER)
    assert set(rows(short, "item_id", "pos")) <= set(rows(longer, "item_id", "pos"))


def test_next_item_pairs(spark):
    train = seq.user_histories(log(spark, {1: [4, 5, 6], 2: [9]}), ORDER)
    got = rows(seq.next_item_pairs(seq.chunk_sequences(train, 5)), "user_id", "input_item", "target_item")
    assert got == [(1, 4, 5), (1, 5, 6)]


def test_sort_directions(spark):
    df = log(spark, {1: [3, 1], 2: [2]})
    assert [r["item_id"] for r in seq.sort_interactions(df, ["user_id", "item_id"], [False, True]).collect()] == [2, 1, 3]
    assert [r["item_id"] for r in seq.sort_interactions(df, "item_id", False).collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        seq.sort_interactions(df, ["user_id", "item_id", "timestamp"], [True, False])


def array(spark, values, expr):
    df = spark.createDataFrame([(values,)], "s array<long>")
    return df.select(expr(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("values,want", [([], [0, 0, 0]), ([5], [0, 0, 5]), ([1, 2, 3, 4], [2, 3, 4])])
def test_pad_left(spark, values, want):
    assert array(spark, values, lambda s: fn.pad_left(s, 3)) == want


@pytest.mark.parametrize("values,want", [([], [0, 0, 0]), ([5], [0, 0, 0]), ([1, 2, 3], [0, 1, 1]), ([1] * 9, [1, 1, 1])])
def test_masked_index(spark, values, want):
    assert array(spark, values, lambda s: fn.masked_index(s, 3)) == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_features_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = [1_710_054_000, 1_710_054_000_500]
        got = array(spark, stamps, lambda s: fn.time_features(s, 3, milliseconds=True))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    at = datetime.datetime.fromtimestamp(1_710_054_000, datetime.UTC)
    want = [at.year, at.month, at.day, at.hour, at.minute, at.second]
    assert got == [[1970, 1, 1, 0, 0, 0], want, want]


def test_time_gap_buckets(spark):
    stamps = [0, 1, 100, 10**60 % 10**15]
    got = array(spark, stamps, lambda s: fn.time_gap_buckets(s, 4))
    follow = [*stamps[1:], stamps[-1]]
    want = [[min(int(math.log(max(abs(b - a), 1)) / 0.301), 128) for a in stamps] for b in follow]
    assert got == want


def test_cross_dataset(spark):
    web = log(spark, {1: [1, 2], 2: [3, 4]})
    shop = log(spark, {7: [5, 6, 7, 8]})
    train, valid, test = seq.cross_dataset_examples(web, shop, 10, ORDER)
    assert rows(train, "user_id", "item_seq") == [(1, [1, 2]), (2, [3, 4])]
    assert rows(valid, "history", "target") == [([5, 6], 7)]
    assert rows(test, "history", "target") == [([5, 6, 7], 8)]


@pytest.mark.parametrize("phase,target", [("valid", 18), ("test", 19)])
def test_eval_rows_hold_the_whole_history(spark, phase, target):
    placed = seq.user_histories(log(spark, {1: list(range(20)), 2: [7]}), ORDER)
    got = rows(seq.eval_rows(placed, phase).filter("user_id = 1"), "item_id", "is_target")
    assert got == sorted([(i, i == target) for i in range(target + 1)], key=repr)
    assert rows(seq.eval_rows(placed, phase).filter("user_id = 2"), "item_id") == ([(7,)] if phase == "test" else [])


def test_cross_dataset_rows_have_three_whole_parts(spark):
    web, shop = log(spark, {1: [1, 2, 3, 4, 5]}), log(spark, {7: list(range(20))})
    found = seq.cross_dataset_rows(web, shop, 3, ORDER)
    part = lambda name: {tuple(r)[2:] for r in found.filter(F.col("part") == name).collect()}
    assert part("train") == {(0, k, str(k + 2), False) for k in range(4)}
    assert part("valid") == {(-1, k, str(k), k == 18) for k in range(19)}
    assert part("test") == {(-1, k, str(k), k == 19) for k in range(20)}


def test_whole_queries_leave_nothing_out(spark):
    sf = "/root/testdata/sf0.001"
    some = plans.queries()
    chunk = examples.chunks(spark, sf)
    assert some["bucketize_all_time_gaps"](spark, sf).count() == chunk.count()
    whole = some["whole_sequence_rows"](spark, sf)
    assert whole.count() == whole.groupBy("user_id").agg(F.max("seq_len").alias("n")).agg(F.sum("n")).first()[0]
    assert some["user_sequence_segments"](spark, sf).filter("segment_no > 0").count() > 0
