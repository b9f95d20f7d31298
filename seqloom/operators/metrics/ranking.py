"""Ranking accuracy. Each metric is an aggregate over one user's rows ``(rank, rel, pos_len)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics.registry import RANKING, long_form, metric, per_user_metric


def _within(k: int) -> Column:
    return F.col("rank") <= k


def _hits(k: int) -> Column:
    return F.coalesce(F.sum(F.when(_within(k), F.col("rel"))), F.lit(0))


def _positives() -> Column:
    return F.max("pos_len")


@per_user_metric("hit")
def hit(k: int, depth: int) -> Column:
    return F.when(_hits(k) > 0, 1.0).otherwise(0.0)


@per_user_metric("mrr")
def mrr(k: int, depth: int) -> Column:
    first = F.min(F.when(_within(k) & (F.col("rel") == 1), F.col("rank")))
    return F.coalesce(1 / first, F.lit(0.0))


@per_user_metric("map")
def average_precision(k: int, depth: int) -> Column:
    """Precision summed at the hits, over the number of hits that were possible by rank k."""
    gained = F.sum(F.when(_within(k), F.col("rel") * F.col("hits_so_far") / F.col("rank")))
    possible = F.least(F.lit(k), F.greatest(_positives(), F.lit(1)))
    return F.coalesce(gained, F.lit(0.0)) / possible


@per_user_metric("recall")
def recall(k: int, depth: int) -> Column:
    """Null for a user without positives."""
    return F.try_divide(_hits(k), _positives())


@per_user_metric("ndcg")
def ndcg(k: int, depth: int) -> Column:
    gain = F.sum(F.when(_within(k), F.col("rel") / F.log2(F.col("rank") + 1.0)))
    ranks = F.sequence(F.lit(1).cast("long"), F.greatest(F.least(F.lit(k), _positives()), F.lit(1)).cast("long"))
    ideal = F.aggregate(ranks, F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1.0))
    return F.coalesce(gain, F.lit(0.0)) / ideal


@per_user_metric("precision")
def precision(k: int, depth: int) -> Column:
    return _hits(k) / k


@metric("gauc", RANKING, ["mean_rank"])
def gauc(inputs, topk) -> DataFrame:
    """Area under the curve per user from average ranks, weighted by the user's positives."""
    p, n = F.col("pos_len"), F.col("n_candidates")
    usable = inputs["mean_rank"].filter((p > 0) & (n - p > 0))
    wins = (n + 1) * p - p * (p + 1) / 2 - F.col("pos_rank_sum")
    area = F.sum(wins / ((n - p) * p) * p)
    return long_form(usable.agg(F.try_divide(area, F.sum(p)).alias("v")), {("gauc", None): F.col("v")})
