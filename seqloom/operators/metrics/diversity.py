"""Coverage, popularity and inequality of the recommended items (``topk`` rows with a rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.joins import heavy_join
from seqloom.operators.metrics.registry import RANKING, long_form, metric
from seqloom.operators.ordering import global_rank, running_totals

# Fixed value: share of the items that count as the tail when none is given.
DEFAULT_TAIL = 0.1


def _within(k: int) -> Column:
    return F.col("rank") <= k


def _user_means(rows: DataFrame, name: str, value: Column, topk) -> DataFrame:
    """Mean over users of the mean of ``value`` over the user's first k rows."""
    per_user = rows.groupBy("user_id").agg(*[F.avg(F.when(_within(k), value)).alias(f"v{k}") for k in topk])
    means = per_user.agg(*[F.avg(f"v{k}").alias(f"v{k}") for k in topk])
    return long_form(means, {(name, k): F.col(f"v{k}") for k in topk})


def recommended_counts(best: DataFrame, topk) -> DataFrame:
    """How often each item is recommended within each cutoff: ``(k, item_id, cnt)``.

    Counted per item and rank first, so a popular item is a handful of rows from there on.
    """
    per_rank = best.groupBy("item_id", "rank").agg(F.count(F.lit(1)).alias("c"))
    cutoffs = F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(set(topk))]), lambda k: k >= F.col("rank")))
    return per_rank.select("item_id", "c", cutoffs.alias("k")).groupBy("k", "item_id").agg(F.sum("c").alias("cnt"))


@metric("itemcoverage", RANKING, ["topk", "num_items"])
def item_coverage(inputs, topk) -> DataFrame:
    seen = recommended_counts(inputs["topk"], topk).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(inputs["num_items"])
    return seen.select(F.lit("itemcoverage").alias("metric"), F.col("k").cast("int").alias("k"), share.alias("value"))


@metric("averagepopularity", RANKING, ["topk", "count_items"], smaller=True)
def average_popularity(inputs, topk) -> DataFrame:
    # An item may be in every list.
    rows = heavy_join(inputs["topk"], inputs["count_items"].select("item_id", "n"), "item_id", ["user_id"], "left")
    return _user_means(rows, "averagepopularity", F.coalesce("n", F.lit(0)), topk)


@metric("shannonentropy", RANKING, ["topk"])
def shannon_entropy(inputs, topk) -> DataFrame:
    """Entropy of the recommended items, divided by the number of distinct ones.

    With counts c that sum to T, the entropy is ``ln T - sum(c ln c) / T``: one pass, no join.
    """
    sums = recommended_counts(inputs["topk"], topk).groupBy("k").agg(
        F.sum("cnt").alias("t"), F.sum(F.col("cnt") * F.ln("cnt")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    entropy = (F.ln("t") - F.col("s") / F.col("t")) / F.col("n")
    return sums.select(F.lit("shannonentropy").alias("metric"), F.col("k").cast("int").alias("k"), entropy.alias("value"))


@metric("giniindex", RANKING, ["topk", "num_items"], smaller=True)
def gini_index(inputs, topk) -> DataFrame:
    """Inequality of the recommendation counts; items never recommended count as zeros.

    Items with the same count are one row: ``m`` of them at places ``e - m + 1 .. e`` add
    ``count * (m * (2e - m + 1) - m * (N + 1))``, so only distinct counts are ordered.
    """
    n_items = inputs["num_items"]
    same = recommended_counts(inputs["topk"], topk).groupBy("k", "cnt").agg(F.count(F.lit(1)).alias("m"))
    placed = running_totals(same, ["k", "cnt"], {"e": "m"})
    per_k = same.groupBy("k").agg(F.sum("m").alias("m_k"), F.sum(F.col("cnt") * F.col("m")).alias("total"))
    # Places of one cutoff end at the number of items; earlier cutoffs in the order are taken off.
    before = placed.groupBy("k").agg(F.min(F.col("e") - F.col("m")).alias("before"))
    rows = placed.join(F.broadcast(per_k.join(before, "k")), "k")
    end = F.col("e") - F.col("before") + F.lit(n_items) - F.col("m_k")
    part = F.col("cnt") * F.col("m") * (2 * end - F.col("m") + 1 - F.lit(n_items + 1))
    sums = rows.groupBy("k").agg(F.sum(part).alias("s"), F.first("total").alias("total"))
    gini = F.col("s") / F.col("total") / F.lit(n_items)
    return sums.select(F.lit("giniindex").alias("metric"), F.col("k").cast("int").alias("k"), gini.alias("value"))


def tail_items(counts: DataFrame, tail_ratio: float | None = None) -> DataFrame:
    """The long tail of ``(item_id, n)``: at most ``tail_ratio`` interactions when it is above 1,
    else that share of the items, the rarest first and the lowest id first among equals."""
    ratio = DEFAULT_TAIL if tail_ratio is None or tail_ratio <= 0 else tail_ratio
    if ratio > 1:
        return counts.filter(F.col("n") <= ratio).select("item_id")
    cut = max(int(counts.count() * ratio), 1)
    return global_rank(counts, ["n", "item_id"], "_rank").filter(F.col("_rank") < cut).select("item_id")


@metric("tailpercentage", RANKING, ["topk", "count_items"])
def tail_percentage(inputs, topk) -> DataFrame:
    tail = tail_items(inputs["count_items"], inputs.get("tail_ratio")).withColumn("_tail", F.lit(1.0))
    rows = inputs["topk"].join(tail, "item_id", "left")
    return _user_means(rows, "tailpercentage", F.coalesce("_tail", F.lit(0.0)), topk)
