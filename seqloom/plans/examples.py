"""Sequences, training and evaluation examples, negatives, tokens and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import functions as fn
from seqloom import sources
from seqloom.operators import batches, negatives, sequences, text
from seqloom.plans.registry import query, renamed, sql
from seqloom.plans.views import (
    CHUNKS,
    LENGTH,
    LOG,
    ORDER_INTER,
    ORDER_KEYS,
    SEED,
    VECTORS,
    encoded,
    histories,
    item_num,
    item_vectors,
    joined,
    joined_rows,
    order_inter,
    prepared,
    rounded,
    table,
    with_sql,
)
from seqloom.session import scratch_path, spread

WIDTH = LENGTH + 1
OPOS = """opos AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
  FROM ointer WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, o_orderkey, l_linenumber, item_id))"""
# Interactions of one array at most; longer histories go on in further rows.
LONG_SEGMENT = 4096
_PAD = f"repeat('0,', greatest({LENGTH} - len(s), 0)::INT)"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return sequences.chunk_sequences(sequences.split_leave_two_out(histories(spark, sf)), LENGTH)

    return prepared(spark, sf, "chunks", build)


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: joined(F.col(c)) for c in columns})


# Sequences.


@query(with_sql(ORDER_INTER, select="SELECT * FROM ointer ORDER BY timestamp DESC, o_orderkey, l_linenumber, item_id"))
def sort_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.sort_interactions(order_inter(spark, sf), ["timestamp", *ORDER_KEYS], [False, True, True, True])


@query(
    with_sql(
        ORDER_INTER,
        OPOS,
        select=f"""SELECT user_id, CAST(pos // {LONG_SEGMENT} AS INT) AS segment_no, string_agg(item_id, ',' ORDER BY pos) AS item_seq,
                          string_agg(timestamp, ',' ORDER BY pos) AS time_seq FROM opos GROUP BY ALL""",
    )
)
def user_sequences(spark: SparkSession, sf: str) -> DataFrame:
    placed = sequences.user_histories(order_inter(spark, sf), ["timestamp", *ORDER_KEYS])
    return _as_text(sequences.user_sequences(placed, LONG_SEGMENT), "item_seq", "time_seq")


@query(with_sql(*LOG, select="SELECT user_id, item_id, timestamp, pos, n - 2 AS n FROM pos WHERE pos < n - 2"))
def split_leave_two_out(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.split_leave_two_out(histories(spark, sf))


@query(with_sql(*LOG, select="SELECT user_id, item_id, timestamp, pos, n FROM pos"))
def split_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.split_keep_all(histories(spark, sf))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select="""SELECT user_id, seq_no, array_to_string(item_seq, ',') AS item_seq,
                         array_to_string(time_seq, ',') AS time_seq FROM chunks""",
    )
)
def chunk_sequences(spark: SparkSession, sf: str) -> DataFrame:
    train = sequences.split_leave_two_out(histories(spark, sf))
    return _as_text(sequences.chunk_sequences(train, LENGTH).drop("seq_len"), "item_seq", "time_seq")


@query(
    with_sql(
        *LOG,
        select=f"""SELECT user_id, n - 2 AS seq_len, string_agg(item_id, ',' ORDER BY pos) AS item_seq
                   FROM pos WHERE pos < n - 2 AND pos >= n - 2 - {WIDTH} GROUP BY user_id, n""",
    )
)
def sequence_tails(spark: SparkSession, sf: str) -> DataFrame:
    """The last items of each training history; ``whole_sequences`` has all of them."""
    train = sequences.split_leave_two_out(histories(spark, sf))
    whole = sequences.chunk_sequences(train, LENGTH, data_split=False)
    return _as_text(whole.select("user_id", "seq_len", "item_seq"), "item_seq")


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select="""SELECT user_id, seq_no, CAST(e AS INT) AS end, array_to_string(item_seq[1:e], ',') AS item_seq
                  FROM chunks, LATERAL (SELECT unnest(range(2, len(item_seq) + 1)) AS e) WHERE len(item_seq) >= 2""",
    )
)
def prefix_augment(spark: SparkSession, sf: str) -> DataFrame:
    train = sequences.split_leave_two_out(histories(spark, sf))
    return _as_text(sequences.prefix_augment(train, LENGTH), "item_seq")


def _eval_sql(phase: str, held: int) -> str:
    return with_sql(
        ORDER_INTER,
        f"""opos AS (
          SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
          FROM ointer WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, o_orderkey, l_linenumber, item_id)),
        seen AS (
          SELECT user_id, any_value(n) AS n, max(CASE WHEN pos = n - {held} THEN item_id END) AS target,
                 coalesce(list(item_id ORDER BY pos) FILTER (WHERE pos < n - {held} AND pos >= n - {held} - {LENGTH}), [])
                   AS s FROM opos GROUP BY user_id HAVING any_value(n) >= {held})""",
        select=f"""SELECT user_id, '{phase}' AS phase, target, n - {held} AS history_len,
                          array_to_string(s, ',') AS history,
                          array_to_string(list_concat(list_transform(range(greatest({LENGTH} - len(s), 0)),
                                                      lambda i: '0'), s), ',') AS item_seq FROM seen""",
    )


def _eval(spark: SparkSession, sf: str, phase: str) -> DataFrame:
    log = order_inter(spark, sf)
    placed = sequences.user_histories(log, ["timestamp", *ORDER_KEYS])
    examples = sequences.eval_examples(placed.withColumn("item_id", F.col("item_id").cast("long")), phase, LENGTH)
    rows = examples.withColumn("target", F.col("target").cast("string")).drop("time_seq")
    return _as_text(rows, "history", "item_seq")


@query(_eval_sql("valid", 2))
def eval_examples_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _eval(spark, sf, "valid")


@query(_eval_sql("test", 1))
def eval_examples_test(spark: SparkSession, sf: str) -> DataFrame:
    return _eval(spark, sf, "test")


@query(with_sql(ORDER_INTER, select="SELECT user_id, count(*) AS n FROM ointer GROUP BY user_id HAVING count(*) < 2"))
def eval_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.eval_rejects(sequences.user_histories(order_inter(spark, sf), ["timestamp", *ORDER_KEYS]), "valid")


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select="""SELECT user_id, seq_no, array_to_string(list_concat(list_transform(range(15 - len(item_seq)),
                         lambda i: 0), item_seq), ',') AS padded FROM chunks""",
    )
)
def pad_left(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("user_id", "seq_no", joined(fn.pad_left(F.col("item_seq"), 15)).alias("padded"))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select="""SELECT user_id, seq_no, array_to_string(list_concat(item_seq, list_transform(range(15 - len(item_seq)),
                         lambda i: -1)), ',') AS padded FROM chunks""",
    )
)
def pad_right(spark: SparkSession, sf: str) -> DataFrame:
    padded = fn.pad_right_with(F.col("item_seq"), 15, F.lit(-1).cast("long"))
    return chunks(spark, sf).select("user_id", "seq_no", joined(padded).alias("padded"))


_TIME = """list_transform({seq}, lambda t: year(make_timestamp(t * 1000000)) || ':' || month(make_timestamp(t * 1000000))
  || ':' || day(make_timestamp(t * 1000000)) || ':' || hour(make_timestamp(t * 1000000)) || ':' ||
  minute(make_timestamp(t * 1000000)) || ':' || second(make_timestamp(t * 1000000)))"""


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select=f"""SELECT user_id, seq_no, array_to_string(
                     {_TIME.format(seq='list_concat(list_transform(range(13 - len(time_seq)), lambda i: 0), time_seq)')},
                     ',') AS time_ids FROM chunks""",
    )
)
def time_features(spark: SparkSession, sf: str) -> DataFrame:
    features = fn.time_features(F.col("time_seq"), 13, milliseconds=True)
    return chunks(spark, sf).select("user_id", "seq_no", joined_rows(features).alias("time_ids"))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select=f"""SELECT user_id, seq_no, repeat('0', ({LENGTH + 2} - least(len(item_seq) - 1, {LENGTH + 2}))::INT) ||
                   repeat('1', least(len(item_seq) - 1, {LENGTH + 2})::INT) AS mask FROM chunks""",
    )
)
def masked_index(spark: SparkSession, sf: str) -> DataFrame:
    mask = fn.masked_index(F.col("item_seq"), LENGTH + 2)
    return chunks(spark, sf).select("user_id", "seq_no", joined(mask, "").alias("mask"))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        select="""SELECT user_id, seq_no, CAST(i AS INT) AS step, item_seq[i + 1] AS input_item, item_seq[i + 2] AS target_item
                  FROM chunks, LATERAL (SELECT unnest(range(len(item_seq) - 1)) AS i) WHERE len(item_seq) >= 2""",
    )
)
def next_item_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.next_item_pairs(chunks(spark, sf))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        f"full_chunks AS (SELECT * FROM chunks WHERE len(time_seq) = {WIDTH})",
        select=f"""SELECT user_id, seq_no, array_to_string(list_transform(range({WIDTH}), lambda i:
                     array_to_string(list_transform(time_seq, lambda t: least(CAST(floor(ln(greatest(
                       abs(time_seq[least(i + 2, {WIDTH})] - t), 1)) / 0.301) AS BIGINT), 128)), ':')), ',') AS gaps
                   FROM full_chunks""",
    )
)
def bucketize_full_time_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Of chunks of full width only; ``bucketize_time_gaps`` has all."""
    full = chunks(spark, sf).filter(F.size("time_seq") == WIDTH)
    gaps = fn.time_gap_buckets(F.col("time_seq"), WIDTH)
    return full.select("user_id", "seq_no", joined_rows(gaps).alias("gaps"))


@query(
    with_sql(
        *LOG,
        ORDER_INTER,
        """opos AS (
          SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n
          FROM ointer WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, o_orderkey, l_linenumber, item_id)),
        cross_cut AS (
          SELECT user_id, item_id, pos - (CASE WHEN n > 11 THEN n % 11 ELSE 0 END) AS place, n FROM opos)""",
        select="""SELECT 'train' AS part, user_id, CAST(CASE WHEN n > 11 THEN place // 11 ELSE 0 END AS INT) AS seq_no,
                         string_agg(item_id, ',' ORDER BY place) AS item_seq, '' AS target
                  FROM cross_cut WHERE place >= 0 GROUP BY ALL
                  UNION ALL
                  SELECT part, CAST(user_id AS VARCHAR), -1,
                         coalesce(string_agg(CASE WHEN pos < n - held AND pos >= n - held - 10 THEN item_id END, ',' ORDER BY pos), ''),
                         CAST(max(CASE WHEN pos = n - held THEN item_id END) AS VARCHAR)
                  FROM pos, (VALUES ('valid', 2), ('test', 1)) AS phases(part, held) WHERE n >= held GROUP BY part, user_id""",
    )
)
def cross_dataset_examples(spark: SparkSession, sf: str) -> DataFrame:
    log = order_inter(spark, sf).withColumn("row_ord", F.struct(*ORDER_KEYS)).drop("o_orderkey", "l_linenumber")
    train, valid, test = sequences.cross_dataset_examples(log, encoded(spark, sf), LENGTH)
    rows = train.select(
        F.lit("train").alias("part"), "user_id", "seq_no", joined(F.col("item_seq")).alias("item_seq"), F.lit("").alias("target")
    )
    for part, held_out in (("valid", valid), ("test", test)):
        rows = rows.unionByName(
            held_out.select(
                F.lit(part).alias("part"),
                F.col("user_id").cast("string").alias("user_id"),
                F.lit(-1).alias("seq_no"),
                joined(F.col("history")).alias("item_seq"),
                F.col("target").cast("string").alias("target"),
            )
        )
    return rows


# Long forms: every row of a history, also where the forms above have the last items only.

SEGMENT = 8


@query(
    with_sql(
        ORDER_INTER,
        OPOS,
        select=f"""SELECT user_id, CAST(pos // {SEGMENT} AS INT) AS segment_no, string_agg(item_id, ',' ORDER BY pos) AS item_seq,
                          string_agg(timestamp, ',' ORDER BY pos) AS time_seq FROM opos GROUP BY ALL""",
    )
)
def user_sequence_segments(spark: SparkSession, sf: str) -> DataFrame:
    placed = sequences.user_histories(order_inter(spark, sf), ["timestamp", *ORDER_KEYS])
    return _as_text(sequences.user_sequences(placed, SEGMENT), "item_seq", "time_seq")


@query(
    with_sql(*LOG, select="SELECT user_id, pos AS seq_pos, n - 2 AS seq_len, item_id, timestamp FROM pos WHERE pos < n - 2")
)
def whole_sequence_rows(spark: SparkSession, sf: str) -> DataFrame:
    train = sequences.split_leave_two_out(histories(spark, sf))
    rows = sequences.chunk_rows(train, LENGTH, data_split=False)
    return rows.select("user_id", "seq_pos", "seq_len", "item_id", "timestamp")


@query(
    with_sql(
        *LOG,
        select="""SELECT user_id, n - 2 AS seq_len, CAST(pos // 4096 AS INT) AS segment_no, string_agg(item_id, ',' ORDER BY pos) AS item_seq
                  FROM pos WHERE pos < n - 2 GROUP BY ALL""",
    )
)
def whole_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """All items of each training history, in arrays of bounded width."""
    train = sequences.split_leave_two_out(histories(spark, sf))
    segments = sequences.user_sequences(train, LONG_SEGMENT).drop("time_seq")
    sizes = train.groupBy("user_id").agg(F.max("n").alias("seq_len"))
    return _as_text(segments.join(sizes, "user_id"), "item_seq")


def _eval_rows_sql(held: int) -> str:
    select = f"SELECT user_id, pos, item_id, timestamp, pos = n - {held} AS is_target FROM opos WHERE pos <= n - {held}"
    return with_sql(ORDER_INTER, OPOS, select=select)


def _eval_rows(spark: SparkSession, sf: str, phase: str) -> DataFrame:
    return sequences.eval_rows(sequences.user_histories(order_inter(spark, sf), ["timestamp", *ORDER_KEYS]), phase)


@query(_eval_rows_sql(2))
def eval_rows_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _eval_rows(spark, sf, "valid")


@query(_eval_rows_sql(1))
def eval_rows_test(spark: SparkSession, sf: str) -> DataFrame:
    return _eval_rows(spark, sf, "test")


@query(
    with_sql(
        *LOG,
        CHUNKS,
        f"""padded AS (
          SELECT user_id, seq_no, list_concat(list_transform(range({WIDTH} - len(time_seq)), lambda i: 0), time_seq) AS ts
          FROM chunks)""",
        select=f"""SELECT user_id, seq_no, array_to_string(list_transform(range({WIDTH}), lambda i:
                     array_to_string(list_transform(ts, lambda t: least(CAST(floor(ln(greatest(
                       abs(ts[least(i + 2, {WIDTH})] - t), 1)) / 0.301) AS BIGINT), 128)), ':')), ',') AS gaps
                   FROM padded""",
    )
)
def bucketize_all_time_gaps(spark: SparkSession, sf: str) -> DataFrame:
    padded = chunks(spark, sf).withColumn("time_seq", fn.pad_left(F.col("time_seq"), WIDTH))
    gaps = fn.time_gap_buckets(F.col("time_seq"), WIDTH)
    return padded.select("user_id", "seq_no", joined_rows(gaps).alias("gaps"))


query(sql()["bucketize_all_time_gaps"])(renamed(bucketize_all_time_gaps, "bucketize_time_gaps"))


@query(
    with_sql(
        *LOG,
        ORDER_INTER,
        OPOS,
        f"""cross_cut AS (
          SELECT user_id, item_id, pos - (CASE WHEN n > {WIDTH} THEN n % {WIDTH} ELSE 0 END) AS place, n FROM opos)""",
        select=f"""SELECT 'train' AS part, user_id, CAST(CASE WHEN n > {WIDTH} THEN place // {WIDTH} ELSE 0 END AS INT) AS seq_no,
                          CASE WHEN n > {WIDTH} THEN place % {WIDTH} ELSE place END AS pos, item_id, false AS is_target
                   FROM cross_cut WHERE place >= 0
                   UNION ALL
                   SELECT part, CAST(user_id AS VARCHAR), -1, pos, CAST(item_id AS VARCHAR), pos = n - held
                   FROM pos, (VALUES ('valid', 2), ('test', 1)) AS phases(part, held) WHERE pos <= n - held""",
    )
)
def cross_dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    log = order_inter(spark, sf).withColumn("row_ord", F.struct(*ORDER_KEYS)).drop("o_orderkey", "l_linenumber")
    return sequences.cross_dataset_rows(log, encoded(spark, sf), LENGTH)


# Negatives. The SQL draws the r-th id outside the sorted excluded ids.


def _draw_sql(parts: str, excluded: str) -> str:
    bits = f"('0x' || substr(md5({parts}), 1, 13))::BIGINT"
    start = f"{bits} % (m - 1 - len({excluded})) + 1"
    return f"list_reduce(list_prepend({start}, {excluded}), lambda x, s: CASE WHEN s <= x THEN x + 1 ELSE x END)"


DRAWN_FROM = "src AS (SELECT *, list_sort(list_distinct(item_seq)) AS ex, (SELECT count(*) + 1 FROM items) AS m FROM chunks)"


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        select=f"""SELECT user_id, seq_no, array_to_string(list_transform(range(len(item_seq) - 1), lambda p:
                     {_draw_sql(f"'{SEED}|' || user_id || '|' || seq_no || '|' || p", "ex")}), ',') AS neg_item
                   FROM src""",
    )
)
def sample_negatives(spark: SparkSession, sf: str) -> DataFrame:
    drawn = negatives.sample_negatives(chunks(spark, sf), item_num(spark, sf), SEED)
    return drawn.select("user_id", "seq_no", joined(F.col("neg_item")).alias("neg_item"))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        "src2 AS (SELECT *, CAST([] AS BIGINT[]) AS none FROM src)",
        select=f"""SELECT user_id, seq_no,
                     array_to_string(list_transform(range(4), lambda p:
                       {_draw_sql(f"'{SEED}|fixed|' || user_id || '|' || seq_no || '|' || p", "ex")}), ',') AS id_negatives,
                     array_to_string(list_transform(range(4), lambda p:
                       {_draw_sql(f"'{SEED}|fixed|' || user_id || '|' || seq_no || '|' || p", "none")}), ',') AS text_negatives
                   FROM src2""",
    )
)
def sample_fixed_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows, items = chunks(spark, sf), item_num(spark, sf)
    count = negatives.negatives_per_example(512, 8, 16)
    by_id = negatives.sample_fixed_negatives(rows, count, items, SEED).withColumnRenamed("neg_item", "id_negatives")
    both = negatives.sample_fixed_negatives(by_id, count, items, SEED, exclude=False)
    return _as_text(
        both.select("user_id", "seq_no", "id_negatives", F.col("neg_item").alias("text_negatives")),
        "id_negatives",
        "text_negatives",
    )


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        select=f"""SELECT user_id, seq_no, array_to_string(list_concat(list_transform(range(15 - len(item_seq)), lambda p:
                     {_draw_sql(f"'{SEED}|pad|' || user_id || '|' || seq_no || '|' || p", "ex")}), item_seq), ',') AS item_seq
                   FROM src""",
    )
)
def random_left_pad(spark: SparkSession, sf: str) -> DataFrame:
    padded = negatives.random_left_pad(chunks(spark, sf), 15, item_num(spark, sf), SEED)
    return padded.select("user_id", "seq_no", joined(F.col("item_seq")).alias("item_seq"))


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        select=f"""SELECT user_id, seq_no, array_to_string(list_transform(range({LENGTH}), lambda p:
                     array_to_string(list_transform(range(3), lambda j: ('0x' || substr(md5('{SEED}|position|' || user_id
                       || '|' || seq_no || '|' || p || '|' || j), 1, 13))::BIGINT % (m - 1) + 1), ':')), ',') AS neg_items
                   FROM src""",
    )
)
def position_negatives(spark: SparkSession, sf: str) -> DataFrame:
    drawn = negatives.position_negatives(chunks(spark, sf), LENGTH, 3, item_num(spark, sf), SEED)
    return drawn.select("user_id", "seq_no", joined_rows(F.col("neg_items")).alias("neg_items"))


BATCHED = f"""batched AS (
  SELECT *, (row_number() OVER (ORDER BY user_id, seq_no) - 1) // 16 AS batch_id,
         (row_number() OVER (ORDER BY user_id, seq_no) - 1) % 16 AS example,
         list_transform(range(4), lambda p:
           {_draw_sql(f"'{SEED}|fixed|' || user_id || '|' || seq_no || '|' || p", "ex")}) AS neg_item
  FROM src)"""


def batched_examples(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        drawn = negatives.sample_fixed_negatives(chunks(spark, sf), 4, item_num(spark, sf), SEED)
        return batches.batched(drawn, ["user_id", "seq_no"], 16)

    return prepared(spark, sf, "batched-examples", build)


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        BATCHED,
        """shared AS (SELECT batch_id, array_to_string(flatten(list(neg_item ORDER BY example)), ',') AS shared_negatives
                      FROM batched GROUP BY batch_id)""",
        select="SELECT batch_id, CAST(example AS INT) AS example, user_id, seq_no, shared_negatives FROM batched JOIN shared USING (batch_id)",
    )
)
def shared_batch_negatives(spark: SparkSession, sf: str) -> DataFrame:
    shared = negatives.shared_batch_negatives(batched_examples(spark, sf))
    rows = shared.select("batch_id", "example", "user_id", "seq_no", "shared_negatives")
    return _as_text(rows, "shared_negatives")


@query(
    with_sql(
        *LOG,
        CHUNKS,
        DRAWN_FROM,
        BATCHED,
        select="SELECT batch_id, array_to_string(flatten(list(neg_item ORDER BY example)), ',') AS shared_negatives FROM batched GROUP BY batch_id",
    )
)
def batch_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return _as_text(negatives.batch_negatives(batched_examples(spark, sf)), "shared_negatives")


@query(
    with_sql(
        *LOG,
        CHUNKS,
        VECTORS,
        DRAWN_FROM,
        f"""pairs AS (
          SELECT user_id, seq_no, p AS step, item_seq[p + 2] AS target_item,
                 {_draw_sql(f"'{SEED}|' || user_id || '|' || seq_no || '|' || p", "ex")} AS neg_item
          FROM src, LATERAL (SELECT unnest(range(len(item_seq) - 1)) AS p))""",
        select="""SELECT target_item, neg_item, user_id, seq_no, CAST(step AS INT) AS step,
                         round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0::DOUBLE AS cosine
                  FROM pairs JOIN vecs a ON a.item_id = target_item JOIN vecs b ON b.item_id = neg_item
                  WHERE list_cosine_similarity(a.vec, b.vec) <= 0.2""",
    )
)
def mask_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    drawn = negatives.sample_negatives(chunks(spark, sf), item_num(spark, sf), SEED)
    steps = F.arrays_zip(F.expr("slice(item_seq, 2, size(neg_item))").alias("target_item"), F.col("neg_item"))
    rows = drawn.select("user_id", "seq_no", F.posexplode(steps).alias("step", "pair"))
    pairs = rows.select("user_id", "seq_no", "step", "pair.target_item", "pair.neg_item")
    kept = negatives.mask_false_negatives(pairs, item_vectors(spark, sf), 0.2)
    return kept.withColumn("cosine", rounded("cosine"))


# Text and tokens.


@query(
    r"""SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:64], ' ') AS tokens
        FROM documents"""
)
def tokenize_truncate(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.tokenize_truncate(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", joined(tokens, " ").alias("tokens"))


@query(
    """SELECT p_partkey, trim(coalesce(CASE WHEN p_size > 10 THEN p_name END, '') || ' ' || p_brand || ' ' ||
              coalesce(CASE WHEN p_size < 40 THEN p_type END, '')) AS text FROM part"""
)
def join_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("title"),
        F.col("p_brand").alias("tag"),
        F.when(F.col("p_size") < 40, F.col("p_type")).alias("description"),
    )
    return parts.select("p_partkey", fn.join_text(parts.columns, ["title", "tag", "description", "other"]).alias("text"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 3),
                       lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w)
        SELECT doc_id, len(grams) AS grams, md5(array_to_string(list_sort(grams), '|')) AS digest FROM g"""
)
def word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", fn.words(F.col("text")).alias("words"))
    grams = docs.select("doc_id", fn.ngrams(F.col("words"), 5).alias("grams"))
    digest = F.md5(F.array_join(F.sort_array("grams"), "|"))
    return grams.select("doc_id", F.size("grams").cast("long").alias("grams"), digest.alias("digest"))


# Shards and batches.


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no,
              CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS shard FROM orders"""
)
def shard_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return batches.shard_round_robin(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM orders),
       c AS (SELECT count(*) AS rows, CAST(ceil(count(*) / 64.0 / 7) AS BIGINT) * 64 AS size FROM orders),
       f AS (SELECT * FROM r UNION ALL
             SELECT (SELECT max(o_orderkey) FROM orders), rows + i
             FROM c, LATERAL (SELECT unnest(range(size * 7 - rows)) AS i))
       SELECT o_orderkey, row_no, CAST(row_no // size AS INT) AS shard FROM f, c"""
)
def shard_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    return batches.shard_consecutive(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 64, 7)


@query(
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY md5('{SEED}|3|' || o_orderkey), o_orderkey) - 1 AS row_no,
               CAST((row_number() OVER (ORDER BY md5('{SEED}|3|' || o_orderkey), o_orderkey) - 1) % 7 AS INT) AS shard
        FROM orders"""
)
def shuffled_shards(spark: SparkSession, sf: str) -> DataFrame:
    return batches.shuffled_shards(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7, SEED, epoch=3)


# Shards as files: how many there are and in which order their rows stand is read from the files.


def _shard_files(spark: SparkSession, sharded: DataFrame, shards: int, stride: int) -> DataFrame:
    """The manifest, the number of files, and whether the k-th row of a file is the shard's k-th."""
    path = scratch_path(spark, "shards")
    manifest = sources.write_shards(sharded, path, shards)
    read = spark.read.parquet(path).select("shard", "row_no", "_metadata.file_name", "_metadata.row_index")
    met = read.join(F.broadcast(manifest.select("shard", "first")), "shard")  # one row for each shard
    in_order = F.bool_and(F.col("row_no") == F.col("first") + F.col("row_index") * stride)
    found = met.groupBy("shard").agg(F.countDistinct("file_name").alias("files"), in_order.alias("in_order"))
    return manifest.join(found, "shard").select("shard", "files", "rows", "first", "last", "in_order")


@query(
    """SELECT CAST(s AS INT) AS shard, CAST(1 AS BIGINT) AS files, size AS rows, s * size AS first, (s + 1) * size - 1 AS last, true AS in_order
       FROM (SELECT CAST(ceil(count(*) / 64.0 / 7) AS BIGINT) * 64 AS size FROM orders), (SELECT unnest(range(7)) AS s)"""
)
def written_shards(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _shard_files(spark, batches.shard_consecutive(orders, ["o_orderkey"], 64, 7), 7, 1)


@query(
    """SELECT CAST(s AS INT) AS shard, CAST(1 AS BIGINT) AS files, (n - s + 6) // 7 AS rows, s AS first, s + ((n - s + 6) // 7 - 1) * 7 AS last,
              true AS in_order FROM (SELECT count(*) AS n FROM orders), (SELECT unnest(range(7)) AS s)"""
)
def written_shuffled_shards(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _shard_files(spark, batches.shuffled_shards(orders, ["o_orderkey"], 7, SEED, epoch=3), 7, 7)


@query(
    with_sql(
        *LOG,
        """rows AS (SELECT DISTINCT user_id FROM pos),
           placed AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // 16 AS batch_id,
                             CAST((row_number() OVER (ORDER BY user_id) - 1) % 16 AS INT) AS example FROM rows)""",
        select="SELECT batch_id, example, item_id, pos FROM pos JOIN placed USING (user_id) WHERE pos < n - 1",
    )
)
def ragged_history_index(spark: SparkSession, sf: str) -> DataFrame:
    placed = histories(spark, sf)
    examples = sequences.eval_examples(placed, "test", LENGTH).select("user_id", "target")
    rows = batches.batched(examples, ["user_id"], 16)
    seen = placed.filter(F.col("pos") < F.col("n") - 1).select("user_id", "item_id", "pos")
    return batches.ragged_history_index(seen, rows)


@query(
    r"""WITH t AS (
          SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:64], lambda w:
                   ('0x' || substr(md5(w), 1, 13))::BIGINT % 31999 + 1) AS ids FROM documents),
        r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM t)
        SELECT batch_id, array_to_string(flatten(list(list_concat(ids, [0]) ORDER BY doc_id)), ',') AS input_ids,
               array_to_string(list(len(ids) + 1 ORDER BY doc_id), ',') AS cu_input_lens,
               array_to_string(flatten(list(list_transform(range(len(ids) + 1), lambda i: i + 64 - len(ids))
                 ORDER BY doc_id)), ',') AS position_ids
        FROM r GROUP BY batch_id"""
)
def packed_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = batches.batched(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 8)
    tokens = text.token_ids(text.tokenize_truncate(F.col("text")), 32000)
    rows = docs.select("batch_id", "example", tokens.alias("input_ids"))
    packed = batches.packed_batches(batches.packed_rows(rows, text.MAX_TEXT_LENGTH, 1))
    return _as_text(packed, "input_ids", "cu_input_lens", "position_ids")
