"""Deterministic down-sampling of users, items, pairs and documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqloom.operators.ordering import global_rank, group_positions, take_first

WHOLE_NUMBER = r"^[+-]?[0-9]{1,18}$"  # longer ids are text


def dropped_users(inter: DataFrame, keep_percent: int, user: str = "user_id") -> DataFrame:
    """The users to drop: the front of the sorted ids, ``floor(users * (1 - keep/100))`` of them.

    Numeric ids sort as numbers, also where they are read as text and all are whole numbers; other
    strings sort by code point. The fraction is evaluated in floating point, so 90 percent of 100 users
    drops 9.
    """
    users = inter.select(user).filter(F.col(user).isNotNull()).distinct()
    whole = F.bool_and(F.col(user).cast("string").rlike(WHOLE_NUMBER)).alias("whole")
    seen = users.agg(F.count(F.lit(1)).alias("n"), whole).first()
    cut = math.floor(seen["n"] * (1 - keep_percent / 100))
    order = [user]
    if seen["whole"] and isinstance(users.schema[user].dataType, StringType):
        order = ["_number", user]
        users = users.withColumn("_number", F.col(user).cast("decimal(38,0)"))
    return global_rank(users, order, "_rank").filter(F.col("_rank") < cut).select(user)


def anti_filter_users(inter: DataFrame, dropped: DataFrame) -> DataFrame:
    return inter.join(dropped, "user_id", "left_anti")


def drop_user_fraction(inter: DataFrame, keep_percent: int) -> DataFrame:
    return anti_filter_users(inter, dropped_users(inter, keep_percent))


def semi_filter_items(info: DataFrame, inter: DataFrame) -> DataFrame:
    """Item text of the items that still occur. Items are de-duplicated before the join."""
    return info.join(inter.select("item_id").distinct(), "item_id", "left_semi")


def filter_by_relevance(pairs: DataFrame, scores: DataFrame, threshold: float, key: str = "user_id") -> DataFrame:
    """Pairs with a score of at least ``threshold``; pairs without a score are dropped."""
    passing = scores.filter(F.col("score") >= threshold).select(key, "score")
    return pairs.join(passing, key)


def truncate_words(text: Column, n: int = 100) -> Column:
    """The first ``n`` blank-separated words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def random_documents(docs: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` documents picked by the md5 of seed and id: the same ones on every run."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return take_first(docs.withColumn("_draw", draw), ["_draw", key], n).drop("_draw")


def interaction_fraction(inter: DataFrame, percent: int, order_by: list[str]) -> DataFrame:
    """The most recent ``percent`` of each user's interactions, rounded up."""
    placed = group_positions(inter, ["user_id"], order_by)
    kept = F.floor((F.col("n") * percent + 99) / 100)
    return placed.filter(F.col("pos") >= F.col("n") - kept).drop("pos", "n")
