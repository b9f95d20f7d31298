"""Dataset statistics and the normalised user-item graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize


def user_counter(inter: DataFrame) -> DataFrame:
    return inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def item_counter(inter: DataFrame) -> DataFrame:
    return inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def avg_actions_of_users(inter: DataFrame) -> DataFrame:
    return user_counter(inter.filter("user_id is not null")).agg(F.avg("n").alias("avg_actions_of_users"))


def avg_actions_of_items(inter: DataFrame) -> DataFrame:
    return item_counter(inter.filter("item_id is not null")).agg(F.avg("n").alias("avg_actions_of_items"))


def dataset_profile(inter: DataFrame) -> DataFrame:
    """One row: id counts (each with the pad), interactions, means and sparsity."""
    counts = inter.agg(
        F.countDistinct("user_id").alias("u"),
        F.countDistinct("item_id").alias("i"),
        F.count("user_id").alias("of_users"),
        F.count("item_id").alias("of_items"),
        F.count(F.lit(1)).alias("inter_num"),
    )
    nums = counts.withColumns({"user_num": F.col("u") + 1, "item_num": F.col("i") + 1})
    return nums.select(
        "user_num",
        "item_num",
        "inter_num",
        F.try_divide("of_users", "u").alias("avg_actions_of_users"),
        F.try_divide("of_items", "i").alias("avg_actions_of_items"),
        (1 - F.col("inter_num") / F.col("user_num") / F.col("item_num")).alias("sparsity"),
    )


def sparsity(inter: DataFrame) -> DataFrame:
    return dataset_profile(inter).select("sparsity")


def normalized_adjacency(encoded: DataFrame, user_num: int) -> DataFrame:
    """Edges ``(src, dst, weight)`` in both directions, weight ``1/sqrt(deg(src) * deg(dst))``.

    Item ids are shifted by ``user_num``; parallel edges are kept and count in the degrees. The
    weight is symmetric, so the degrees are joined once per interaction and not once per edge. The
    degrees are written first: a join reads them through a shuffle of its own, which lets the
    engine split the interactions of a hot user or item.
    """
    users = materialize(user_counter(encoded).withColumnRenamed("n", "user_degree"), "user-degrees")
    items = materialize(item_counter(encoded).withColumnRenamed("n", "item_degree"), "item-degrees")
    weighted = encoded.join(users, "user_id").join(items, "item_id")
    node = F.col("item_id") + F.lit(user_num)
    weight = 1 / F.sqrt(F.col("user_degree") * F.col("item_degree"))
    both = F.array(
        F.struct(F.col("user_id").alias("src"), node.alias("dst")),
        F.struct(node.alias("src"), F.col("user_id").alias("dst")),
    )
    return weighted.select(F.explode(both).alias("edge"), weight.alias("weight")).select("edge.*", "weight")
