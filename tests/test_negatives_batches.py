import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom import functions as fn
from seqloom import sources
from seqloom.operators import batches, negatives, text
from seqloom.session import scratch_path
from tests.helpers import rows


def sequences(spark, *items):
    data = [(u, 0, list(s)) for u, s in enumerate(items)]
    return spark.createDataFrame(data, "user_id long, seq_no int, item_seq array<long>")


def test_complement_rank(spark):
    df = spark.createDataFrame([([2, 3, 7],)], "ex array<long>")
    got = [df.select(negatives.complement_id(F.lit(r), F.col("ex"), 11)).first()[0] for r in range(7)]
    assert got == [1, 4, 5, 6, 8, 9, 10]
    assert got[2] == 5


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 12), min_size=2, max_size=9), st.integers(0, 1000))
def test_negatives_are_never_members(spark, items, seed):
    drawn = negatives.sample_negatives(sequences(spark, items), 14, seed).first()["neg_item"]
    assert len(drawn) == len(items) - 1
    assert set(drawn) <= set(range(1, 14)) - set(items)


def test_negatives_are_about_uniform(spark):
    df = spark.range(400).select(
        F.col("id").alias("user_id"), F.lit(0).alias("seq_no"), F.array(*[F.lit(i).cast("long") for i in (1, 2, 2, 3, 1)]).alias("item_seq")
    )
    drawn = negatives.sample_negatives(df, 9, 3).select(F.explode("neg_item").alias("x")).collect()
    counts = Counter(r["x"] for r in drawn)
    assert set(counts) == {4, 5, 6, 7, 8}
    assert max(counts.values()) - min(counts.values()) < 0.25 * 1600 / 5


def test_whole_catalogue_in_a_sequence_is_rejected(spark):
    df = sequences(spark, [1, 2, 3], [1, 2])
    assert rows(negatives.negative_rejects(df, 4), "user_id") == [(0,)]
    got = {r["user_id"]: r["neg_item"] for r in negatives.sample_negatives(df, 4, 1).collect()}
    assert got == {0: None, 1: [3]}


def test_fixed_negatives_and_pads(spark):
    df = sequences(spark, [1, 2, 3], [4])
    assert negatives.negatives_per_example(512, 3, 16) == math.ceil(512 / 3 / 16)
    for r in negatives.sample_fixed_negatives(df, 50, 8, 1).collect():
        assert len(r["neg_item"]) == 50
        assert not set(r["neg_item"]) & set(r["item_seq"])
    free = negatives.sample_fixed_negatives(df, 200, 8, 1, exclude=False).first()["neg_item"]
    assert set(free) == set(range(1, 8))
    for before, after in zip(df.collect(), negatives.random_left_pad(df, 5, 8, 1).collect()):
        assert len(after["item_seq"]) == 5
        assert after["item_seq"][-len(before["item_seq"]):] == before["item_seq"]
        assert not set(after["item_seq"][: -len(before["item_seq"])]) & set(before["item_seq"])
    assert negatives.random_left_pad(df, 2, 8, 1).first()["item_seq"] == [2, 3]


def test_position_negatives(spark):
    got = negatives.position_negatives(sequences(spark, [1, 2]), 4, 6, 10, 1).first()["neg_items"]
    assert [len(p) for p in got] == [6] * 4
    assert all(1 <= i <= 9 for p in got for i in p)


def test_batch_negatives_are_shared(spark):
    data = [(b, e, [b * 100 + e * 10 + i for i in range(2)]) for b in range(3) for e in range(4)]
    df = spark.createDataFrame(data, "batch_id long, example int, neg_item array<long>").repartition(5)
    got = negatives.shared_batch_negatives(df)
    for r in got.collect():
        assert r["shared_negatives"] == [r["batch_id"] * 100 + e * 10 + i for e in range(4) for i in range(2)]


def test_false_negatives_are_masked(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "item_id long, vec array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "target_item long, neg_item long")
    assert rows(negatives.mask_false_negatives(pairs, vectors), "target_item", "neg_item") == [(1, 3), (1, 3)]


def test_item_text(spark):
    info = spark.createDataFrame(
        [("a", "A", None, "B"), ("b", "nan", "", None)], "item_id string, title string, tag string, description string"
    )
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("[PAD]",)], "item_id string")
    got = rows(text.item_text(items, info, prompt="P: "))
    assert got == [("[PAD]", ""), ("a", "P: title: Adescription: B"), ("b", "P: "), ("c", "")]


@pytest.mark.parametrize("value,want", [("a b", {"a b"}), ("a b c d", {"a b c", "b c d"}), ("", set()), ("x x x x", {"x x x"}), ("Élan_1, VITAL!", {"élan_1 vital"})])
def test_ngrams(spark, value, want):
    df = spark.createDataFrame([(value,)], "t string").select(fn.ngrams(fn.words(F.col("t")), 3).alias("g"))
    assert set(df.first()["g"]) == want


def test_overlap(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], [1])], "a array<int>, b array<int>")
    jaccard, containment = fn.lexical_overlap(F.col("a"), F.col("b"))
    assert rows(df.select(jaccard, containment)) == [(0.0, 0.0), (2 / 5, 2 / 3)]


def test_join_text(spark):
    df = spark.createDataFrame([(None, "b", "c"), ("a", None, None)], "x string, y string, z string")
    assert rows(df.select(fn.join_text(df.columns, ["x", "y", "missing"]).alias("t"))) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        fn.join_text(df.columns, ["missing"])


def test_own_tokenizer(spark):
    df = spark.createDataFrame([("abcd",), ("",)], "t string")
    got = text.tokenize_with(df, "t", lambda: lambda s: [ord(c) for c in s], 3)
    assert rows(got, "input_ids") == [([97, 98, 99],), ([],)]


@pytest.mark.parametrize("n,batch,shards", [(10, 2, 3), (12, 2, 3), (1, 4, 2), (7, 1, 7)])
def test_shards(spark, n, batch, shards):
    df = spark.range(n).repartition(4)
    got = {r["id"]: r["shard"] for r in batches.shard_round_robin(df, ["id"], shards).collect()}
    assert got == {i: i % shards for i in range(n)}
    per_shard = math.ceil(n / batch / shards) * batch
    want = list(range(n)) + [n - 1] * (per_shard * shards - n)
    placed = sorted((r["row_no"], r["id"], r["shard"]) for r in batches.shard_consecutive(df, ["id"], batch, shards).collect())
    assert [p[1] for p in placed] == want
    assert [p[2] for p in placed] == [i // per_shard for i in range(len(want))]


def test_epochs_reshuffle(spark):
    df = spark.range(50)
    one = rows(batches.shuffled_shards(df, ["id"], 5, 1, 0))
    assert one == rows(batches.shuffled_shards(df.repartition(6), ["id"], 5, 1, 0))
    assert one != rows(batches.shuffled_shards(df, ["id"], 5, 1, 1))


def test_packed_batches(spark):
    df = spark.createDataFrame([(0, 0, [7, 8]), (0, 1, []), (1, 0, [9])], "batch_id long, example int, input_ids array<long>")
    got = {r["batch_id"]: r for r in batches.packed_batches(batches.packed_rows(df, 4, 2)).collect()}
    assert got[0]["input_ids"] == [7, 8, 0, 0, 0, 0]
    assert got[0]["cu_input_lens"] == [4, 2]
    assert got[0]["position_ids"] == [2, 3, 4, 5, 4, 5]
    assert got[1]["position_ids"] == [3, 4, 5]


def test_shards_are_written_one_file_each_in_order(spark):
    path = scratch_path(spark, "shards")
    rows_ = spark.range(1000).select(F.col("id").alias("row_no"), F.pmod(F.hash("id"), F.lit(3)).cast("int").alias("shard"))
    manifest = sources.write_shards(rows_.filter("shard <> 1").repartition(5), path, 4)
    assert [r["shard"] for r in manifest.orderBy("shard").collect()] == [0, 1, 2, 3]
    counts = {r["shard"]: r["rows"] for r in manifest.collect()}
    assert counts[1] == counts[3] == 0 and counts[0] + counts[2] == rows_.filter("shard <> 1").count()
    back = spark.read.parquet(path).select("row_no", "shard", "_metadata.file_name", "_metadata.row_index").collect()
    for k in (0, 2):
        of = sorted((r for r in back if r["shard"] == k), key=lambda r: r["row_index"])
        assert len({r["file_name"] for r in of}) == 1 and len(of) == counts[k]
        assert [r["row_no"] for r in of] == sorted(r["row_no"] for r in of)
