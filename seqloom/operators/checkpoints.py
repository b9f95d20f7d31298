"""Best checkpoint and early stop of many training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics import registered
from seqloom.operators.ordering import group_positions, running_max

# Parameter defaults of the training configurations: patience, and the metric that is watched.
PATIENCE = 10


def better_is_bigger(metric: str) -> bool:
    """Direction of a registered metric; its cutoff (``ndcg@200``) does not matter."""
    name = metric.lower().split("@")[0]
    if name not in registered():
        raise ValueError(f"unknown metric {metric!r}")
    return not registered()[name].smaller


def best_checkpoint(history: DataFrame, patience: int = PATIENCE, metric: str = "ndcg@200") -> DataFrame:
    """Replay early stopping over a metrics history ``(run_id, epoch, score)``, one row per run.

    ``metric`` names what the score is, which decides the direction.

    A score at least as good as the best so far becomes the best one (the later epoch wins a tie).
    A run stops at the first epoch with more than ``patience`` worse scores in a row behind it;
    later epochs do not count.
    """
    bigger = better_is_bigger(metric)
    placed = group_positions(history, ["run_id"], ["epoch"], "_at", "_n")
    signed = F.col("score") if bigger else -F.col("score")
    scored = running_max(placed, ["run_id"], "_at", {"_best": signed})
    improved = F.when(signed >= F.col("_best"), F.struct("_at", "epoch", "score"))
    steps = running_max(scored, ["run_id"], "_at", {"_last": improved})
    state = F.struct("_at", "_last", (F.col("_at") - F.col("_last._at")).alias("_worse"))
    steps = steps.select("run_id", state.alias("_s"))
    # The state at the stop, or else at the end, already names the best epoch before it.
    over = F.when(F.col("_s._worse") > patience, F.col("_s._at"))
    runs = steps.groupBy("run_id").agg(F.min_by("_s", over).alias("_stop"), F.max_by("_s", F.col("_s._at")).alias("_end"))
    runs = runs.withColumn("_s", F.coalesce("_stop", "_end"))
    return runs.select(
        "run_id",
        F.col("_s._last.epoch").alias("best_epoch"),
        F.col("_s._last.score").alias("best_score"),
        (F.col("_s._at") + 1).alias("epochs_run"),
        F.col("_s._worse").alias("worse_steps"),
        F.col("_stop").isNotNull().alias("stopped_early"),
    )
