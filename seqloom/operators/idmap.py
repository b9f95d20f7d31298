"""Dense integer ids by first appearance; 0 is the pad."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import global_rank

PAD_TOKEN = "[PAD]"
PAD_SPREAD = 4096


def _first_seen(df: DataFrame, column: str, row_ord: Sequence[str]) -> DataFrame:
    """Tokens with their first place; combined on the map side, so a hot token costs nothing."""
    order = F.col(row_ord[0]) if len(row_ord) == 1 else F.struct(*row_ord)
    tokens = df.filter(F.col(column).isNotNull())
    return tokens.groupBy(F.col(column).cast("string").alias("token")).agg(F.min(order).alias("_first"))


def _numbered(first_seen: DataFrame, start: int) -> DataFrame:
    ranked = global_rank(first_seen, ["_first", "token"], "_rank")
    return ranked.select("token", (F.col("_rank") + start).alias("id"))


def _with_pad(ids: DataFrame) -> DataFrame:
    pad = ids.sparkSession.range(1).select(F.lit(PAD_TOKEN).alias("token"), F.lit(0).cast("long").alias("id"))
    return pad.unionByName(ids)


def factorize(df: DataFrame, column: str, row_ord: Sequence[str]) -> DataFrame:
    """Id map ``(token, id)``. Nulls get no id."""
    return _with_pad(_numbered(_first_seen(df, column, row_ord), 1))


def factorize_with_catalog(
    catalog: DataFrame, inter: DataFrame, catalog_ord: Sequence[str], inter_ord: Sequence[str], column: str = "item_id"
) -> DataFrame:
    """Catalogue tokens first, then the log's other tokens, each in order of first appearance."""
    listed = factorize(catalog, column, catalog_ord)
    start = listed.count()
    others = _first_seen(inter, column, inter_ord).join(listed, "token", "left_anti")
    return listed.unionByName(_numbered(others, start))


def encode_ids(inter: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """Replace user and item tokens by ids; a token without an id becomes null."""
    users = user_map.select(F.col("token").alias("user_id"), F.col("id").alias("_user"))
    items = item_map.select(F.col("token").alias("item_id"), F.col("id").alias("_item"))
    typed = inter.withColumns({"user_id": F.col("user_id").cast("string"), "item_id": F.col("item_id").cast("string")})
    joined = typed.join(users, "user_id", "left").join(items, "item_id", "left")
    return joined.withColumns({"user_id": F.col("_user"), "item_id": F.col("_item")}).drop("_user", "_item")


def decode_ids(rows: DataFrame, item_map: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Ids of a bounded array column back to tokens, in order; the pad 0 stays ``0``."""
    exploded = rows.select(*key, F.posexplode(column).alias("_at", "_id"))
    # Pads are the most frequent id and need no lookup: keys without a match spread them out.
    nowhere = -1 - F.pmod(F.xxhash64(*key), F.lit(PAD_SPREAD))
    keyed = exploded.withColumn("id", F.when(F.col("_id") == 0, nowhere).otherwise(F.col("_id")))
    tokens = keyed.join(item_map, "id", "left").select(
        *key, "_at", F.when(F.col("_id") == 0, "0").otherwise(F.col("token")).alias("_token")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_token")))
    return tokens.groupBy(*key).agg(ordered.alias("_tokens")).select(*key, F.col("_tokens._token").alias(column))
