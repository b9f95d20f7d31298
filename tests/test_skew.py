"""A key with a third of all rows: the joins must be open to splitting, and the results whole."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import idmap, joins, leakage, sampling, scoring, stats, webcorpus
from seqloom.session import materialize

ROWS = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "24",
}


@pytest.fixture(scope="module", autouse=True)
def small_partitions(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def log(spark):
    pick = lambda salt, n: F.when(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(3)) == 0, 0).otherwise(
        1 + F.pmod(F.xxhash64(F.lit(salt + 1), "id"), F.lit(n))
    ).cast("long")
    rows = spark.range(ROWS).select(
        pick(1, 2000).alias("user_id"), pick(5, 500).alias("item_id"), F.col("id").alias("row_ord")
    )
    return materialize(rows.repartition(16), "skewed-log")


def ids(log, column):
    return materialize(log.select(F.col(column).cast("string").alias("token"), F.col(column).alias("id")).distinct(), "ids")


def assert_split(df, rows=ROWS):
    assert len(df.collect()) == rows
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_encode_ids(log):
    assert_split(idmap.encode_ids(log, ids(log, "user_id"), ids(log, "item_id")))


def test_adjacency(log):
    assert_split(stats.normalized_adjacency(log, 3000), 2 * ROWS)


def test_dropped_users(log):
    dropped = ids(log, "user_id").filter("id % 7 = 1").select(F.col("id").alias("user_id"))
    kept = log.filter("user_id % 7 <> 1").count()
    assert_split(sampling.anti_filter_users(log, dropped), kept)


def test_average_rank(log):
    scores = log.select("user_id", F.col("row_ord").alias("item_id"), F.col("item_id").cast("double").alias("score"))
    assert_split(scoring.average_rank(scores, max_group_rows=1000))


def test_links_to_a_popular_page(spark, log):
    pages = spark.range(501).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"))
    links = log.select((F.col("row_ord") + 1000).alias("page_id"), F.concat(F.lit("http://a.com/"), "item_id").alias("target_url"))
    assert_split(webcorpus.link_pairs(pages, materialize(links, "links")))


@pytest.fixture
def without_help(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def task_sizes(df):
    """Rows of each task that makes the rows of ``df``, largest first."""
    used = [F.max(c) for c in df.columns]  # else a join may be left out
    by_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows"), *used)
    return sorted((r["rows"] for r in by_task.collect()), reverse=True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_heavy_keys_are_split_without_adaptive_execution(log, without_help, how):
    few = log.select("item_id").distinct().filter("item_id % 5 <> 3").withColumn("n", F.col("item_id") * 2)
    few = few if how != "left_semi" else few.select("item_id")
    split = joins.heavy_join(log, few, "item_id", ["row_ord"], how)
    plain = log.join(few, "item_id", how)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).isEmpty() and split.count() == plain.count()
    many, few_rows = task_sizes(split), task_sizes(plain)
    assert few_rows[0] > 5 * few_rows[len(few_rows) // 2]
    assert many[0] <= 2 * many[len(many) // 2]


def test_heavy_join_of_light_or_null_keys(spark, log):
    rows = spark.createDataFrame([(None, 1), (2, 2), (2, 3)], "item_id long, row_ord long")
    few = spark.createDataFrame([(2, "a")], "item_id long, n string")
    for least in (1, 1000):
        got = joins.heavy_join(rows, few, "item_id", ["row_ord"], "left", least=least).collect()
        assert sorted(map(tuple, got), key=repr) == [(2, 2, "a"), (2, 3, "a"), (None, 1, None)]
    assert joins.heavy_keys(log, "row_ord").isEmpty()
    assert [r["item_id"] for r in joins.heavy_keys(log, "item_id").collect()] == [0]


def test_a_gram_in_a_third_of_the_corpus(spark, without_help):
    common = "one two three four five"
    texts = spark.range(6000).select(
        F.col("id").alias("corpus_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(common + " "), F.col("id").cast("string"))).otherwise(
            F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(6)])
        ).alias("text"),
    )
    queries = spark.createDataFrame([(1, common), (2, "w0x1 w1x1 w2x1 w3x1 w4x1 w5x1")], "query_id long, text string")
    found = leakage.near_verbatim_pairs(queries, texts).collect()
    assert {(r["query_id"], r["corpus_id"]) for r in found} == {(1, i) for i in range(0, 6000, 3)} | {(2, 1)}
