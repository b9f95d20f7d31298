"""Sinks. Every task writes its own part file, so writers never share one file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Quotes are doubled and blanks at the ends of a field are kept.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_relevance_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per scored pair. A masked score is not a JSON number: it becomes null + flag."""
    masked = F.col("score").isNull() | (F.col("score") == float("-inf"))
    df.select(
        "interaction", "target", F.when(~masked, F.col("score")).alias("score"), masked.alias("masked")
    ).write.mode(mode).json(path, ignoreNullFields=False)


def write_interactions(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("item_id", "user_id", "timestamp").write.mode(mode).csv(path, **_CSV)


def write_item_info(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, **_CSV)


def write_pairs(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """Leakage pairs, most similar first across the ordered part files."""
    order = [F.desc("cosine"), F.asc("query_id"), F.asc("rank")]
    pairs.orderBy(*order).write.mode(mode).csv(path, **_CSV)


def write_shards(sharded: DataFrame, path: str, shards: int, order: str = "row_no", mode: str = "error") -> DataFrame:
    """One Parquet file for each shard, ``path/shard=<k>``, its rows in ``order``; returns the manifest.

    ``sharded`` has a column ``shard`` from 0 to below ``shards``. Its value is the number of the partition, so
    every shard is one task and one file, and no hash puts two of them together. The manifest (``shard``,
    ``rows``, ``first``, ``last``) is counted from what was written and kept in ``path/_manifest``, which
    readers of the folder pass over. A shard without rows has no file and 0 rows.
    """
    spark = sharded.sparkSession
    placed = sharded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", order)
    placed.write.mode(mode).partitionBy("shard").parquet(path)
    written = spark.read.schema(sharded.schema).parquet(path).groupBy("shard")
    counts = written.agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    manifest = every.join(counts, "shard", "left").fillna(0, ["rows"]).orderBy("shard")
    manifest.coalesce(1).write.mode(mode).json(f"{path}/_manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/_manifest")


def append_run_metrics(metrics: DataFrame, run: Mapping[str, str | None], path: str) -> None:
    """Add one run's metrics ``(split, metric, k, value)`` to a history table over many runs.

    An empty report or a value that is not finite is refused before anything is written. A rerun
    under the same ``run_id`` replaces its own rows; other runs keep theirs.
    """
    unusable = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    totals = metrics.agg(F.count(F.lit(1)).alias("n"), F.count_if(unusable).alias("bad")).first()
    if totals["n"] == 0:
        raise ValueError("the report has no metrics")
    if totals["bad"]:
        raise ValueError(f"{totals['bad']} metric values are not finite")
    fields = ["run_id", "model", "dataset", "checkpoint"]
    rows = metrics.select(
        *[F.lit(run.get(f)).cast("string").alias(f) for f in fields],
        F.current_timestamp().alias("completed_at_utc"),
        "split",
        "metric",
        F.col("k").cast("int").alias("k"),
        F.col("value").cast("double").alias("value"),
    )
    writer = rows.write.mode("overwrite").partitionBy("run_id")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
