import math

import pytest
from pyspark.sql import functions as F

from seqloom.operators import idmap, sampling, stats
from tests.helpers import log, rows


def tokens(spark, values):
    return spark.createDataFrame([(t, i) for i, t in enumerate(values)], "item_id string, row_ord long")


@pytest.mark.parametrize("partitions", [1, 8])
def test_factorize_by_first_appearance(spark, partitions):
    df = tokens(spark, ["b", "a", "b", "c", None]).repartition(partitions)
    got = rows(idmap.factorize(df, "item_id", ["row_ord"]))
    assert got == [("[PAD]", 0), ("a", 2), ("b", 1), ("c", 3)]


def test_factorize_with_catalog(spark):
    catalog, seen = tokens(spark, ["x", "a"]), tokens(spark, ["b", "a", "c"])
    got = rows(idmap.factorize_with_catalog(catalog, seen, ["row_ord"], ["row_ord"]))
    assert got == [("[PAD]", 0), ("a", 2), ("b", 3), ("c", 4), ("x", 1)]


def test_encode_and_decode(spark):
    items = idmap.factorize(tokens(spark, ["b", "a"]), "item_id", ["row_ord"])
    users = spark.createDataFrame([("[PAD]", 0), ("u", 1)], "token string, id long")
    df = spark.createDataFrame([("u", "a"), ("u", "?"), ("v", "b"), (None, "b")], "user_id string, item_id string")
    assert rows(idmap.encode_ids(df, users, items), "user_id", "item_id") == sorted(
        [(1, 2), (1, None), (None, 1), (None, 1)], key=repr
    )
    seqs = spark.createDataFrame([(1, [0, 0, 2, 1]), (2, [1])], "user_id long, item_seq array<long>")
    got = rows(idmap.decode_ids(seqs, items, ["user_id"], "item_seq"))
    assert got == [(1, ["0", "0", "a", "b"]), (2, ["b"])]


def test_user_fraction_drops_the_front(spark):
    df = spark.createDataFrame([(u, u * 10) for u in range(1, 101)], "user_id long, item_id long")
    kept = {r["user_id"] for r in sampling.drop_user_fraction(df, 90).collect()}
    assert math.floor(100 * (1 - 90 / 100)) == 9
    assert kept == set(range(10, 101))


def test_user_fraction_sorts_numbers_read_as_text_by_value(spark):
    df = spark.createDataFrame([(u, 1) for u in ["10", "9", "100", "-2"]], "user_id string, item_id long")
    assert {r["user_id"] for r in sampling.drop_user_fraction(df, 50).collect()} == {"10", "100"}


def test_user_fraction_sorts_strings_by_code_point(spark):
    df = spark.createDataFrame([(u, 1) for u in ["10", "9", "a", "B"]], "user_id string, item_id long")
    assert {r["user_id"] for r in sampling.drop_user_fraction(df, 50).collect()} == {"B", "a"}


def test_relevance_threshold_is_inclusive(spark):
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    scores = spark.createDataFrame([(1, 0.35), (2, 0.34)], "user_id long, score double")
    assert rows(sampling.filter_by_relevance(pairs, scores, 0.35), "user_id") == [(1,)]


def test_truncate_words_and_random_documents(spark):
    df = spark.createDataFrame([(1, "  a  b\n c "), (2, "")], "doc_id long, text string")
    got = df.select("doc_id", sampling.truncate_words(F.col("text"), 2).alias("t"))
    assert rows(got) == [(1, "a b"), (2, "")]
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    first = rows(sampling.random_documents(docs, 10, 1))
    assert len(first) == 10
    assert first == rows(sampling.random_documents(docs.repartition(7), 10, 1))
    assert first != rows(sampling.random_documents(docs, 10, 2))


def test_interaction_fraction_keeps_the_most_recent(spark):
    df = log(spark, {1: list(range(10)), 2: [5, 6, 7]})
    got = rows(sampling.interaction_fraction(df, 30, ["timestamp", "row_ord"]), "user_id", "item_id")
    assert got == [(1, 7), (1, 8), (1, 9), (2, 7)]


def test_profile_counts_the_pad(spark):
    df = log(spark, {1: [1, 2], 2: [1, 1, 3, 3]})
    row = stats.dataset_profile(df).first()
    assert (row["user_num"], row["item_num"], row["inter_num"]) == (3, 4, 6)
    assert (row["avg_actions_of_users"], row["avg_actions_of_items"]) == (3.0, 2.0)
    assert row["sparsity"] == pytest.approx(1 - 6 / 3 / 4)


def test_adjacency_keeps_parallel_edges(spark):
    df = log(spark, {1: [1, 1, 2]})
    got = rows(stats.normalized_adjacency(df, user_num=2), "src", "dst", "weight")
    item1, item2 = 1 / math.sqrt(3 * 2), 1 / math.sqrt(3 * 1)
    want = [(1, 3, item1)] * 2 + [(3, 1, item1)] * 2 + [(1, 4, item2), (4, 1, item2)]
    assert [r[:2] for r in got] == sorted(w[:2] for w in want)
    assert sum(r[2] for r in got) == pytest.approx(sum(w[2] for w in want))
