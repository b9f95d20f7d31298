"""Catalogue scoring, ranking metrics, value metrics, diversity and contrastive metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import functions as fn
from seqloom.operators import idmap, metrics, scoring, sequences, stats
from seqloom.operators.leakage import hashed_words
from seqloom.plans.examples import BATCHED, DRAWN_FROM, batched_examples
from seqloom.plans.registry import query
from seqloom.plans.views import (
    CHUNKS,
    LENGTH,
    LOG,
    RANKED,
    RECOMMEND,
    SCORES,
    TEST,
    VECTORS,
    histories,
    inter,
    item_map,
    item_num,
    item_vectors,
    joined,
    prepared,
    rounded,
    table,
    with_sql,
)
from seqloom.session import spread

TOPK = (5, 10)
DEPTH = max(TOPK)


def test_history(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.eval_history(histories(spark, sf), "test")


def test_targets(spark: SparkSession, sf: str) -> DataFrame:
    last = histories(spark, sf).filter(F.col("pos") == F.col("n") - 1)
    return last.select("user_id", "item_id")


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        seen = histories(spark, sf).filter(F.col("pos") < F.col("n") - 1)
        return scoring.mean_user_vectors(seen, item_vectors(spark, sf))

    return prepared(spark, sf, "user-vectors", build)


def recommended(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.top_k_of_catalog(
        user_vectors(spark, sf), item_vectors(spark, sf), DEPTH, test_history(spark, sf)
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    best = prepared(spark, sf, "recommended", lambda: recommended(spark, sf))
    return scoring.hit_matrix(best, test_targets(spark, sf))


def rounded_values(df: DataFrame) -> DataFrame:
    """Metric values under their key text ``name@k``."""
    key = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", "k"))
    return df.select(key.alias("metric"), rounded("value").alias("value"))


# Vectors.


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 13))::BIGINT % 64 AS slot, count(*) AS n
              FROM w GROUP BY ALL)
        SELECT d.doc_id, array_to_string(list_transform(range(64), lambda i: CAST(coalesce(m[i][1], 0) AS INT)), ',') AS vec
        FROM documents d LEFT JOIN (SELECT doc_id, map_from_entries(list((slot, n))) AS m FROM c GROUP BY doc_id) x
          ON x.doc_id = d.doc_id""".replace("m[i][1]", "m[i]")
)
def embed_table(spark: SparkSession, sf: str) -> DataFrame:
    vectors = scoring.embed_table(spread(table(spark, sf, "documents")), "doc_id", "text", hashed_words(64))
    return vectors.select("doc_id", joined(F.col("vec").cast("array<int>")).alias("vec"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x:
              x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total,
              round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first
       FROM embeddings"""
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = table(spark, sf, "embeddings").select("vec_id", fn.l2_normalize(F.col("embedding")).alias("unit"))
    total = F.aggregate("unit", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", rounded(total).alias("total"), rounded(F.col("unit")[0]).alias("first"))


@query(
    with_sql(
        *LOG,
        VECTORS,
        TEST,
        select="SELECT user_id, CAST(i - 1 AS INT) AS i, round(x, 6) + 0.0::DOUBLE AS x FROM uvec_parts",
    )
)
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = user_vectors(spark, sf).select("user_id", F.posexplode("vec").alias("i", "x"))
    return rows.withColumn("x", rounded("x"))


@query(
    with_sql(*LOG, VECTORS, TEST, SCORES, select="SELECT user_id, item_id, score FROM scores")
)
def score_full_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_full_catalog(user_vectors(spark, sf), item_vectors(spark, sf))


@query(
    with_sql(
        *LOG, VECTORS, TEST, SCORES, RANKED, select="SELECT user_id, item_id, score FROM masked"
    )
)
def mask_candidates(spark: SparkSession, sf: str) -> DataFrame:
    scores = scoring.score_full_catalog(user_vectors(spark, sf), item_vectors(spark, sf))
    return scoring.mask_candidates(scores, test_history(spark, sf))


@query(
    with_sql(
        *RECOMMEND,
        select=f"""SELECT user_id, CAST(rank AS INT) AS rank, item_id, score
                   FROM ranked WHERE rank <= {DEPTH}""",
    )
)
def top_k_of_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return recommended(spark, sf)


@query(
    with_sql(
        *LOG,
        """counts AS (SELECT user_id, item_id, count(*) AS score FROM enc GROUP BY ALL),
           r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM counts)""",
        select="SELECT user_id, CAST(rank AS INT) AS rank, item_id, score FROM r WHERE rank <= 20",
    )
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    counts = histories(spark, sf).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score"))
    return scoring.top_k(counts, 20)


RECORDS_SQL = with_sql(
    *RECOMMEND,
    select=f"""SELECT repeat('0,', greatest({LENGTH} - any_value(p.n)::INT + 1, 0)) || string_agg(i.token, ',' ORDER BY p.pos)
                        AS interaction, any_value(ti.token) AS target, any_value(m.score) AS score
               FROM pos p JOIN items i ON i.id = p.item_id
                 JOIN test_rows t ON t.user_id = p.user_id JOIN items ti ON ti.id = t.target
                 LEFT JOIN masked m ON m.user_id = p.user_id AND m.item_id = t.target
               WHERE p.pos < p.n - 1 AND p.pos >= p.n - 1 - {LENGTH} GROUP BY p.user_id""",
)


def scored_records(spark: SparkSession, sf: str) -> DataFrame:
    examples = sequences.eval_examples(histories(spark, sf), "test", LENGTH)
    scored = scoring.target_scores(
        examples.select("user_id", "target"), user_vectors(spark, sf), item_vectors(spark, sf), test_history(spark, sf)
    )
    named = examples.withColumnRenamed("item_seq", "interaction")
    decoded = idmap.decode_ids(named, item_map(spark, sf), ["user_id"], "interaction")
    return scoring.relevance_records(scored, decoded, item_map(spark, sf))


@query(RECORDS_SQL)
def relevance_records(spark: SparkSession, sf: str) -> DataFrame:
    records = scored_records(spark, sf)
    return records.select(joined(F.col("interaction")).alias("interaction"), "target", "score")


HITS = f"""hits AS (
  SELECT t.user_id, r.rank, CASE WHEN r.item_id = t.target THEN 1 ELSE 0 END AS rel, 1 AS pos_len
  FROM test_rows t LEFT JOIN ranked r ON r.user_id = t.user_id AND r.rank <= {DEPTH})"""


@query(
    with_sql(
        *RECOMMEND,
        HITS,
        select="SELECT user_id, CAST(coalesce(rank, 0) AS INT) AS rank, rel, CAST(pos_len AS BIGINT) AS pos_len FROM hits",
    )
)
def hit_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).withColumn("rank", F.coalesce("rank", F.lit(0)))


# Average ranks need ties: the score is how often a user met an item.
_FREQUENCY = """freq AS (SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS score FROM enc GROUP BY ALL),
avg_ranks AS (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) +
            (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS avg_rank FROM freq)"""


def item_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    counted = histories(spark, sf).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return counted


@query(
    with_sql(*LOG, _FREQUENCY, select="SELECT user_id, item_id, score, CAST(avg_rank AS DOUBLE) AS avg_rank FROM avg_ranks")
)
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.average_rank(item_frequencies(spark, sf))


@query(
    with_sql(
        *LOG,
        _FREQUENCY,
        "positives AS (SELECT DISTINCT user_id, item_id FROM pos WHERE pos >= n - 2)",
        select="""SELECT user_id, CAST(sum(CASE WHEN p.item_id IS NOT NULL THEN avg_rank ELSE 0 END) AS DOUBLE) AS pos_rank_sum,
                         count(*) AS n_candidates, count(p.item_id) AS pos_len
                  FROM avg_ranks a LEFT JOIN positives p USING (user_id, item_id) GROUP BY user_id""",
    )
)
def rank_sums(spark: SparkSession, sf: str) -> DataFrame:
    positives = histories(spark, sf).filter(F.col("pos") >= F.col("n") - 2)
    return scoring.rank_sums(scoring.average_rank(item_frequencies(spark, sf)), positives)


_MEAN_RANK = """cells AS (
  SELECT s.user_id, s.item_id, CASE WHEN h.item_id IS NULL THEN s.score ELSE CAST('-Infinity' AS DOUBLE) END AS score
  FROM scores s LEFT JOIN hist h ON h.user_id = s.user_id AND h.item_id = s.item_id
  UNION ALL SELECT user_id, 0, CAST('-Infinity' AS DOUBLE) FROM uvecs),
cell_ranks AS (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC) +
            (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS avg_rank FROM cells),
mean_rank AS (
  SELECT c.user_id, CAST(sum(CASE WHEN c.item_id = t.target THEN avg_rank ELSE 0 END) AS DOUBLE) AS pos_rank_sum,
         count(*) FILTER (WHERE score > '-Infinity') AS n_candidates, CAST(1 AS BIGINT) AS pos_len
  FROM cell_ranks c JOIN test_rows t USING (user_id) GROUP BY c.user_id)"""


def mean_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mean_rank_stats(
        user_vectors(spark, sf), item_vectors(spark, sf), test_targets(spark, sf), test_history(spark, sf)
    )


@query(with_sql(*RECOMMEND, _MEAN_RANK, select="SELECT * FROM mean_rank"))
def mean_rank_stats(spark: SparkSession, sf: str) -> DataFrame:
    return mean_ranks(spark, sf)


# Ranking metrics.

_USER_METRICS = {
    "hit": "CASE WHEN count(*) FILTER (WHERE rel = 1 AND rank <= k) > 0 THEN 1.0 ELSE 0.0 END",
    "mrr": "coalesce(1.0 / min(rank) FILTER (WHERE rel = 1 AND rank <= k), 0)",
    "map": "coalesce(sum(rel * so_far / rank) FILTER (WHERE rank <= k), 0) / least(k, max(pos_len))",
    "recall": "coalesce(sum(rel) FILTER (WHERE rank <= k), 0) / max(pos_len)",
    "ndcg": """coalesce(sum(rel / log2(rank + 1)) FILTER (WHERE rank <= k), 0)
               / list_sum(list_transform(range(1, least(k, max(pos_len)) + 1), lambda r: 1 / log2(r + 1)))""",
    "precision": "coalesce(sum(rel) FILTER (WHERE rank <= k), 0) / k",
}

# Several positives per user: both held-out items against the recommendations from the older ones.
_TWO_HELD = f"""hits2 AS (
  SELECT user_id, rank, rel, pos_len, sum(rel) OVER (PARTITION BY user_id ORDER BY rank) AS so_far FROM (
    SELECT c.user_id, r.rank, CASE WHEN p.item_id IS NULL THEN 0 ELSE 1 END AS rel, c.pos_len
    FROM (SELECT user_id, count(DISTINCT item_id) AS pos_len FROM pos WHERE pos >= n - 8 GROUP BY user_id) c
    LEFT JOIN ranked r ON r.user_id = c.user_id AND r.rank <= {DEPTH}
    LEFT JOIN (SELECT DISTINCT user_id, item_id FROM pos WHERE pos >= n - 8) p
      ON p.user_id = c.user_id AND p.item_id = r.item_id))"""


def _wide_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The last eight interactions as positives, so that precision and ideal gain have several."""
    best = prepared(spark, sf, "recommended", lambda: recommended(spark, sf))
    return scoring.hit_matrix(best, histories(spark, sf).filter(F.col("pos") >= F.col("n") - 8))


def _register_user_metric(name: str, expression: str) -> None:
    sql = with_sql(
        *RECOMMEND,
        _TWO_HELD,
        f"""per_user AS (SELECT user_id, k, {expression} AS v
                         FROM hits2, (SELECT unnest([{', '.join(map(str, TOPK))}]) AS k) GROUP BY user_id, k)""",
        select=f"""SELECT '{name}@' || k AS metric, round(avg(v), 6) AS value FROM per_user GROUP BY k""",
    )

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded_values(metrics.evaluate({"hits": _wide_hits(spark, sf)}, [name], TOPK))

    run.__name__ = f"metric_{name}"
    query(sql)(run)


for _name, _expression in _USER_METRICS.items():
    _register_user_metric(_name, _expression)


RECOMMENDER_SQL = with_sql(
    *RECOMMEND,
    HITS,
    f"""per_user AS (
      SELECT user_id, k, coalesce(sum(rel) FILTER (WHERE rank <= k), 0) AS recall,
             coalesce(sum(rel / log2(rank + 1)) FILTER (WHERE rank <= k), 0) AS ndcg
      FROM hits, (SELECT unnest([{', '.join(map(str, TOPK))}]) AS k) GROUP BY user_id, k)""",
    select="""SELECT 'recall@' || k AS metric, round(avg(recall), 6) AS value FROM per_user GROUP BY k
              UNION ALL SELECT 'ndcg@' || k, round(avg(ndcg), 6) FROM per_user GROUP BY k""",
)


@query(RECOMMENDER_SQL)
def evaluate_recommender(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and NDCG of the content-mean recommender over the whole catalogue."""
    return rounded_values(metrics.evaluate({"hits": hits(spark, sf)}, ["Recall", "NDCG"], TOPK))


@query(
    with_sql(
        *RECOMMEND,
        _MEAN_RANK,
        select="""SELECT 'gauc' AS metric,
                    round(sum(((n_candidates + 1) * pos_len - pos_len * (pos_len + 1) / 2 - pos_rank_sum)
                          / ((n_candidates - pos_len) * pos_len) * pos_len) / sum(pos_len), 6) AS value
                  FROM mean_rank WHERE pos_len > 0 AND n_candidates > pos_len""",
    )
)
def metric_gauc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_values(metrics.evaluate({"mean_rank": mean_ranks(spark, sf)}, ["gauc"], TOPK))


# Value metrics: an event's value as the predicted chance that it is a purchase.
_SCORED = """scored AS (
  SELECT least(value / 500, 1.0) AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"""
_CURVE = """per_score AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg, sum(neg) OVER (ORDER BY score DESC) AS fps, sum(pos) OVER (ORDER BY score DESC) AS tps
  FROM per_score)"""


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
    )


@query(
    with_sql(
        _SCORED,
        _CURVE,
        select="SELECT round(score, 6) AS score, CAST(fps AS BIGINT) AS fps, CAST(tps AS BIGINT) AS tps FROM curve",
    )
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = metrics.values.roc_curve(scored_events(spark, sf))
    return curve.select(rounded("score").alias("score"), "fps", "tps")


@query(
    with_sql(
        _SCORED,
        _CURVE,
        select="""SELECT 'auc' AS metric,
                         round(sum(neg * (tps - pos / 2)) / (max(fps) * max(tps)), 6) AS value FROM curve""",
    )
)
def metric_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_values(metrics.evaluate({"scored": scored_events(spark, sf)}, ["AUC"], TOPK))


@query(
    with_sql(
        _SCORED,
        select="""SELECT 'mae' AS metric, round(avg(abs(score - label)), 6) AS value FROM scored
                  UNION ALL SELECT 'rmse', round(sqrt(avg((score - label) ** 2)), 6) FROM scored
                  UNION ALL SELECT 'logloss', round(avg(
                    -label * ln(greatest(least(score, 1 - 1e-15), 1e-15))
                    - (1 - label) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15))), 6) FROM scored""",
    )
)
def metric_losses(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_values(metrics.evaluate({"scored": scored_events(spark, sf)}, ["MAE", "RMSE", "LogLoss"], TOPK))


# Diversity metrics.

_KS = f"(SELECT unnest([{', '.join(map(str, TOPK))}]) AS k)"
_COUNTS = """train_counts AS (SELECT item_id, count(*) AS n FROM pos WHERE pos < n - 2 GROUP BY item_id)"""
_REC_COUNTS = f"""rec AS (SELECT k, item_id, count(*) AS cnt FROM ranked, {_KS} WHERE rank <= k GROUP BY k, item_id)"""


def train_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_counter(sequences.split_leave_two_out(histories(spark, sf)).drop("n"))


def _diversity(spark: SparkSession, sf: str, name: str) -> DataFrame:
    best = prepared(spark, sf, "recommended", lambda: recommended(spark, sf))
    inputs = {
        "topk": best,
        "num_items": item_num(spark, sf),
        "count_items": train_counts(spark, sf),
        "tail_ratio": 0.3,
    }
    return rounded_values(metrics.evaluate(inputs, [name], TOPK))


@query(
    with_sql(
        *RECOMMEND,
        _REC_COUNTS,
        select="""SELECT 'itemcoverage@' || k AS metric,
                         round(count(*) / (SELECT count(*) + 1 FROM items), 6) AS value FROM rec GROUP BY k""",
    )
)
def metric_itemcoverage(spark: SparkSession, sf: str) -> DataFrame:
    return _diversity(spark, sf, "ItemCoverage")


@query(
    with_sql(
        *RECOMMEND,
        _COUNTS,
        f"""per_user AS (SELECT user_id, k, avg(coalesce(c.n, 0)) AS v
                         FROM ranked r LEFT JOIN train_counts c USING (item_id), {_KS} WHERE rank <= k GROUP BY user_id, k)""",
        select="""SELECT 'averagepopularity@' || k AS metric, round(avg(v), 6) AS value
                  FROM per_user GROUP BY k""",
    )
)
def metric_averagepopularity(spark: SparkSession, sf: str) -> DataFrame:
    return _diversity(spark, sf, "AveragePopularity")


@query(
    with_sql(
        *RECOMMEND,
        _REC_COUNTS,
        "p AS (SELECT k, cnt / sum(cnt) OVER (PARTITION BY k) AS p FROM rec)",
        select="""SELECT 'shannonentropy@' || k AS metric, round(-sum(p * ln(p)) / count(*), 6) AS value
                  FROM p GROUP BY k""",
    )
)
def metric_shannonentropy(spark: SparkSession, sf: str) -> DataFrame:
    return _diversity(spark, sf, "ShannonEntropy")


@query(
    with_sql(
        *RECOMMEND,
        _REC_COUNTS,
        """placed AS (SELECT k, cnt, (SELECT count(*) + 1 FROM items) AS n, count(*) OVER (PARTITION BY k) AS m,
                             row_number() OVER (PARTITION BY k ORDER BY cnt) AS r, sum(cnt) OVER (PARTITION BY k) AS total
                      FROM rec)""",
        select="""SELECT 'giniindex@' || k AS metric,
                         round(sum((2 * (n - m + r) - n - 1) * cnt) / max(total) / max(n), 6) AS value
                  FROM placed GROUP BY k""",
    )
)
def metric_giniindex(spark: SparkSession, sf: str) -> DataFrame:
    return _diversity(spark, sf, "GiniIndex")


@query(
    with_sql(
        *RECOMMEND,
        _COUNTS,
        """tail AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY n, item_id) AS r,
                           greatest(CAST(floor(count(*) OVER () * 0.3::DOUBLE) AS BIGINT), 1) AS cut FROM train_counts)
                    WHERE r <= cut)""",
        f"""per_user AS (SELECT user_id, k, avg(CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END) AS v
                         FROM ranked r LEFT JOIN tail t USING (item_id), {_KS} WHERE rank <= k GROUP BY user_id, k)""",
        select="""SELECT 'tailpercentage@' || k AS metric, round(avg(v), 6) AS value
                  FROM per_user GROUP BY k""",
    )
)
def metric_tailpercentage(spark: SparkSession, sf: str) -> DataFrame:
    return _diversity(spark, sf, "TailPercentage")


# Contrastive logits: the input item's vector against the next item and the batch's negatives.

_LOGITS = """steps AS (
  SELECT batch_id, example, p AS step, q.vec AS qv, t.vec AS tv
  FROM (SELECT batch_id, example, item_seq, unnest(range(len(item_seq) - 1)) AS p FROM batched) b
  JOIN vecs q ON q.item_id = b.item_seq[p + 1] JOIN vecs t ON t.item_id = b.item_seq[p + 2]),
negs AS (
  SELECT batch_id, v.vec AS nv FROM (SELECT batch_id, unnest(neg_item) AS item_id FROM batched) JOIN vecs v USING (item_id)),
pairs AS (
  SELECT s.*, list_cosine_similarity(qv, nv) / 0.07 AS logit, list_cosine_similarity(tv, nv) AS same
  FROM steps s JOIN negs n USING (batch_id)),
logits AS (
  SELECT batch_id, example, step, any_value(list_cosine_similarity(qv, tv)) / 0.07 AS pos_logit,
         coalesce(list(logit) FILTER (WHERE same <= 0.99), []) AS neg_logits, 1 + count(*) AS width
  FROM pairs GROUP BY batch_id, example, step)"""
_CONTRASTIVE = (*LOG, CHUNKS, VECTORS, DRAWN_FROM, BATCHED, _LOGITS)


def contrastive_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training positions with their vectors, and the negatives of each batch."""
    vectors = item_vectors(spark, sf)
    examples = batched_examples(spark, sf)
    steps = F.arrays_zip(
        F.expr("slice(item_seq, 1, size(item_seq) - 1)").alias("query"),
        F.expr("slice(item_seq, 2, size(item_seq) - 1)").alias("target"),
    )
    rows = examples.filter(F.size("item_seq") > 1).select("batch_id", "example", F.posexplode(steps).alias("step", "pair"))
    rows = rows.select("batch_id", "example", "step", "pair.query", "pair.target")
    queries = vectors.select(F.col("item_id").alias("query"), F.col("vec").alias("query_vec"))
    targets = vectors.select(F.col("item_id").alias("target"), F.col("vec").alias("target_vec"))
    positions = rows.join(queries, "query").join(targets, "target").drop("query", "target")
    negs = examples.select("batch_id", "example", F.posexplode("neg_item").alias("at", "item_id")).join(vectors, "item_id")
    return positions, negs.select("batch_id", F.struct("example", "at").alias("place"), "vec")


@query(
    with_sql(
        *_CONTRASTIVE,
        select="""SELECT batch_id, CAST(example AS INT) AS example, CAST(step AS INT) AS step,
                         round(pos_logit, 6) + 0.0::DOUBLE AS pos_logit, CAST(len(neg_logits) AS INT) AS survivors,
                         round(list_sum(neg_logits), 6) + 0.0::DOUBLE AS neg_total FROM logits""",
    )
)
def nce_logits(spark: SparkSession, sf: str) -> DataFrame:
    logits = metrics.contrastive.nce_logits(*contrastive_inputs(spark, sf))
    total = F.aggregate("neg_logits", F.lit(0.0), lambda a, x: a + x)
    return logits.groupBy("batch_id", "example", "step").agg(
        rounded(F.max("pos_logit")).alias("pos_logit"),
        F.sum(F.size("neg_logits")).cast("int").alias("survivors"),
        rounded(F.sum(total)).alias("neg_total"),
    )


@query(
    with_sql(
        *_CONTRASTIVE,
        """placed AS (SELECT *, 1 + len(list_filter(neg_logits, lambda x: x > pos_logit)) AS place,
             ln(exp(pos_logit) + coalesce(list_sum(list_transform(neg_logits, lambda x: exp(x))), 0)) - pos_logit AS loss
           FROM logits)""",
        select="""SELECT metric, round(value, 6) AS value FROM (
          SELECT 'nce_loss' AS metric, avg(loss) AS value FROM placed
          UNION ALL SELECT 'nce_samples', avg(1 + len(neg_logits)) FROM placed
          UNION ALL SELECT 'nce_top' || k || '_acc',
                           CASE WHEN min(width) >= k THEN avg(CASE WHEN place <= k THEN 1.0 ELSE 0.0 END) END
                    FROM placed, (SELECT unnest([1, 5, 10, 50, 100]) AS k) GROUP BY k)
        WHERE value IS NOT NULL""",
    )
)
def nce_metrics(spark: SparkSession, sf: str) -> DataFrame:
    values = metrics.contrastive.nce_metrics(metrics.contrastive.nce_state(*contrastive_inputs(spark, sf)))
    return values.select("metric", rounded("value").alias("value"))
