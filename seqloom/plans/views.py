"""The given tables read as recommendation data, in Spark and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import utc_epoch_seconds
from seqloom.operators.idmap import encode_ids, factorize
from seqloom.operators.sequences import user_histories
from seqloom.session import materialize

LENGTH = 10
SEED = 7

_prepared: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prepared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries of one session read; it is written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _prepared:
        _prepared[key] = materialize(build(), name)
    return _prepared[key]


def joined(values: Column, sep: str = ",") -> Column:
    """An array as text, so that results compare across engines."""
    return F.array_join(values.cast("array<string>"), sep)


def joined_rows(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: joined(r, ":")), ",")


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def with_sql(*tables: str, select: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n" + select


# Clean log: each event is an interaction of its user with the item "<type>-<k>".
INTER = """inter AS (
  SELECT event_type || '-' || json_extract_string(props, '$.k') AS item_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id AS row_ord
  FROM events)"""


def inter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("item_id"),
        F.col("user_id").cast("string").alias("user_id"),
        utc_epoch_seconds(F.col("ts")).alias("timestamp"),
        F.col("event_id").alias("row_ord"),
    )


# Log with ties and short users: each order line is an interaction of its customer with its part.
ORDER_KEYS = ("o_orderkey", "l_linenumber", "item_id")
ORDER_INTER = """ointer AS (
  SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp, o_orderkey, l_linenumber
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def order_inter(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        utc_epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
        "o_orderkey",
        "l_linenumber",
    )


USERS = """users AS (
  SELECT user_id AS token, row_number() OVER (ORDER BY min(row_ord)) AS id FROM inter GROUP BY user_id)"""
ITEMS = """items AS (
  SELECT item_id AS token, row_number() OVER (ORDER BY min(row_ord)) AS id FROM inter GROUP BY item_id)"""
ENCODED = """enc AS (
  SELECT u.id AS user_id, i.id AS item_id, timestamp, row_ord
  FROM inter JOIN users u ON u.token = inter.user_id JOIN items i ON i.token = inter.item_id)"""
POSITIONS = """pos AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, row_ord) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM enc)"""
LOG = (INTER, USERS, ITEMS, ENCODED, POSITIONS)


def user_map(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf, "user-map", lambda: factorize(inter(spark, sf), "user_id", ["row_ord"]))


def item_map(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf, "item-map", lambda: factorize(inter(spark, sf), "item_id", ["row_ord"]))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(
        spark, sf, "encoded", lambda: encode_ids(inter(spark, sf), user_map(spark, sf), item_map(spark, sf))
    )


def histories(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf, "histories", lambda: user_histories(encoded(spark, sf), ["timestamp", "row_ord"]))


def item_num(spark: SparkSession, sf: str) -> int:
    """Number of item ids, the pad included."""
    return item_map(spark, sf).count()


# Training chunks of the clean log: width LENGTH + 1, the last two interactions held out.
_WIDTH = LENGTH + 1
CHUNKS = f"""train AS (SELECT user_id, item_id, timestamp, pos, n - 2 AS n FROM pos WHERE pos < n - 2),
cut AS (
  SELECT *, CASE WHEN n > {_WIDTH} THEN n % {_WIDTH} ELSE 0 END AS skipped FROM train),
chunk_rows AS (
  SELECT user_id, item_id, timestamp,
         CAST(CASE WHEN n > {_WIDTH} THEN (pos - skipped) // {_WIDTH} ELSE 0 END AS INT) AS seq_no,
         CASE WHEN n > {_WIDTH} THEN (pos - skipped) % {_WIDTH} ELSE pos END AS seq_pos
  FROM cut WHERE pos >= skipped),
chunks AS (
  SELECT user_id, seq_no, list(item_id ORDER BY seq_pos) AS item_seq, list(timestamp ORDER BY seq_pos) AS time_seq
  FROM chunk_rows GROUP BY user_id, seq_no)"""

# Item vectors: the given embeddings dealt to the dense item ids.
VECTORS = """vecs AS (
  SELECT i.id AS item_id, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM items i JOIN embeddings e ON e.vec_id = i.id % (SELECT count(*) FROM embeddings))"""


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        given = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
        count = given.count()
        items = item_map(spark, sf).filter("id > 0").select(F.col("id").alias("item_id"))
        return items.join(given, F.col("vec_id") == F.col("item_id") % count).select("item_id", "vec")

    return prepared(spark, sf, "item-vectors", build)


def sql_list(values: Sequence[object]) -> str:
    return ", ".join(str(v) for v in values)


# Held-out examples and what is masked in ranking.
TEST = """test_rows AS (SELECT user_id, item_id AS target FROM pos WHERE pos = n - 1),
hist AS (SELECT DISTINCT user_id, item_id FROM pos WHERE pos < n - 1),
uvec_parts AS (
  SELECT p.user_id, u.i, avg(u.x) AS x
  FROM pos p JOIN vecs v USING (item_id), LATERAL (SELECT unnest(v.vec) AS x, generate_subscripts(v.vec, 1) AS i) u
  WHERE p.pos < p.n - 1 GROUP BY p.user_id, u.i),
uvecs AS (SELECT user_id, list(x ORDER BY i) AS vec FROM uvec_parts GROUP BY user_id)"""
SCORES = """scores AS (
  SELECT user_id, item_id, round(list_cosine_similarity(u.vec, v.vec), 9) AS score
  FROM uvecs u CROSS JOIN vecs v)"""
RANKED = """masked AS (SELECT s.* FROM scores s ANTI JOIN hist h ON h.user_id = s.user_id AND h.item_id = s.item_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM masked)"""
RECOMMEND = (*LOG, VECTORS, TEST, SCORES, RANKED)


# CRC-32 in SQL: a table of 256 entries by the rule of the polynomial, then a fold over the bytes of a text.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS entries
  FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    each = f"list_transform(range(1, len({hexed}) + 1, 2), lambda p: ('0x' || substr({hexed}, p, 2))::BIGINT)"
    fold = f"list_reduce([4294967295::BIGINT] || {each}, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))"
    return f"xor({fold}, 4294967295::BIGINT)"
