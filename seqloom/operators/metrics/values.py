"""Metrics of predicted values. The input ``scored`` has ``score`` and ``label``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics.registry import VALUE, long_form, metric
from seqloom.operators.ordering import running_totals

# Fixed value: predictions are kept this far from 0 and 1.
LOGLOSS_EPS = 1e-15


def roc_curve(scored: DataFrame) -> DataFrame:
    """False and true positives at every distinct score, highest score first.

    Rows are combined per score before they are ordered, and the sums run over range partitions.
    """
    positive = F.col("label") == 1
    per_score = scored.groupBy("score").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"), (-F.col("score")).alias("_down")
    )
    curve = running_totals(per_score, ["_down"], {"fps": "neg", "tps": "pos"})
    return curve.select("score", "fps", "tps", "neg", "pos")


@metric("auc", VALUE, ["scored"])
def auc(inputs, topk) -> DataFrame:
    """Trapezoids under the curve; null when one class is missing."""
    curve = roc_curve(inputs["scored"])
    height = F.col("tps") - F.col("pos") / 2
    total = curve.agg(F.sum(F.col("neg") * height).alias("area"), F.max("fps").alias("n"), F.max("tps").alias("p"))
    return long_form(total, {("auc", None): F.try_divide(F.col("area"), F.col("n") * F.col("p"))})


@metric("mae", VALUE, ["scored"], smaller=True)
def mae(inputs, topk) -> DataFrame:
    error = F.avg(F.abs(F.col("score") - F.col("label"))).alias("v")
    return long_form(inputs["scored"].agg(error), {("mae", None): F.col("v")})


@metric("rmse", VALUE, ["scored"], smaller=True)
def rmse(inputs, topk) -> DataFrame:
    error = F.col("score") - F.col("label")
    return long_form(inputs["scored"].agg(F.sqrt(F.avg(error * error)).alias("v")), {("rmse", None): F.col("v")})


@metric("logloss", VALUE, ["scored"], smaller=True)
def logloss(inputs, topk) -> DataFrame:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - LOGLOSS_EPS)), F.lit(LOGLOSS_EPS))
    loss = -F.col("label") * F.ln(p) - (1 - F.col("label")) * F.ln(1 - p)
    return long_form(inputs["scored"].agg(F.avg(loss).alias("v")), {("logloss", None): F.col("v")})
