"""Reports, metric histories and score post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import functions as fn
from seqloom import sources
from seqloom.operators.checkpoints import best_checkpoint as best_of_runs
from seqloom.operators.ordering import group_positions
from seqloom.plans.corpora import AUDIT_SQL, audit_pairs
from seqloom.plans.ranking import RECORDS_SQL, TOPK, metrics, scored_events, scored_records
from seqloom.plans.registry import query
from seqloom.plans.views import LOG, encoded, joined, rounded, table, with_sql
from seqloom.session import scratch_path


@query(f"SELECT *, score IS NULL AS masked FROM ({RECORDS_SQL})")
def relevance_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "relevance-jsonl")
    sources.write_relevance_jsonl(scored_records(spark, sf), path)
    back = spark.read.schema("interaction array<string>, target string, score double, masked boolean").json(path)
    return back.withColumn("interaction", joined(F.col("interaction")))


@query(AUDIT_SQL)
def leakage_pairs_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs-csv")
    sources.write_pairs(audit_pairs(spark, sf), path)
    schema = audit_pairs(spark, sf).schema
    back = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return back.withColumns({c: rounded(c) for c in ("jaccard_5gram", "containment_5gram")})


@query(
    """SELECT 'first' AS run_id, 'test' AS split, 'mae' AS metric,
              round(avg(abs(least(value / 500, 1.0) - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)), 6) AS value
       FROM events
       UNION ALL
       SELECT 'second', 'test', 'rmse',
              round(sqrt(avg((least(value / 500, 1.0) - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) ** 2)), 6)
       FROM events"""
)
def append_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "run-metrics")
    # The first run is written twice: its second report replaces the first one.
    for run, names in (("first", ["MAE", "RMSE"]), ("second", ["RMSE"]), ("first", ["MAE"])):
        report = metrics.evaluate({"scored": scored_events(spark, sf)}, names, TOPK).withColumn("split", F.lit("test"))
        sources.append_run_metrics(report, {"run_id": run, "model": "content-mean", "dataset": "events"}, path)
    return spark.read.parquet(path).select("run_id", "split", "metric", rounded("value").alias("value"))


# Each user's events as one run: the event's place is the epoch and its value the score.
_STOPS = """runs AS (SELECT pos.user_id AS run_id, pos.pos AS epoch, events.value AS score
                     FROM pos JOIN events ON events.event_id = pos.row_ord),
best AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY epoch) AS best FROM runs),
last_best AS (
  SELECT *, max(CASE WHEN score >= best THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS best_at FROM best),
stops AS (
  SELECT run_id, min(CASE WHEN epoch - best_at > 5 THEN epoch END) AS stop, max(epoch) AS last FROM last_best GROUP BY run_id)"""


@query(
    with_sql(
        *LOG,
        _STOPS,
        select="""SELECT run_id, max(best_at) AS best_epoch, round(arg_max(best, epoch), 6) AS best_score, count(*) AS epochs_run,
                         arg_max(epoch - best_at, epoch) AS worse_steps, any_value(stop) IS NOT NULL AS stopped_early
                  FROM last_best JOIN stops USING (run_id) WHERE epoch <= coalesce(stop, last) GROUP BY run_id""",
    )
)
def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select(F.col("event_id").alias("row_ord"), F.col("value").alias("score"))
    log = encoded(spark, sf).select("user_id", "row_ord", "timestamp")
    places = log.join(values, "row_ord").select(
        F.col("user_id").alias("run_id"), F.struct("timestamp", "row_ord").alias("epoch"), "score"
    )
    runs = group_positions(places, ["run_id"], ["epoch"], "at", "n").select("run_id", F.col("at").alias("epoch"), "score")
    return best_of_runs(runs, patience=5).withColumn("best_score", rounded("best_score"))


@query(
    """SELECT event_id, ceil(value / 7) AS up, floor(value / 7) AS down, round_even(value / 7, 0) AS near,
              CAST(CASE WHEN value > 100 THEN 1 ELSE 0 END AS INT) AS above FROM events"""
)
def score_rounding(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("value") / 7
    return table(spark, sf, "events").select(
        "event_id",
        fn.trunc(score, "ceil").alias("up"),
        fn.trunc(score, "floor").alias("down"),
        fn.trunc(score, "around").alias("near"),
        fn.cutoff(F.col("value"), 100).alias("above"),
    )
