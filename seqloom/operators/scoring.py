"""Scoring of a whole catalogue: exact cosine, history masking, top-k and ranks.

The users-by-items score table is never written. Users are cut into batches and items into blocks;
a task holds one batch and one block, and returns only its k best items or its counts. A catalogue
whose measured size is small is broadcast instead, and users stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import dot, l2_normalize
from seqloom.operators.ordering import MAX_GROUP_ROWS, group_positions
from seqloom.session import materialize

# Largest item matrix sent to every executor, in bytes of its float64 values.
BROADCAST_BYTES = 64 << 20
# A cell of users and items at most, and the memory of its vectors, which counts where they are wide.
USERS_PER_BATCH = 8192
ITEMS_PER_BLOCK = 32768
CELL_BYTES = 256 << 20
# Scores held at once inside a task: some ten arrays of as many numbers stand beside them while they are worked on.
SCORE_CELLS = 500_000
COLUMN_GROUP = 64
# Items of a stream that a task scores at once.
STREAM_ITEMS = 4096
# Dimensions that are averaged as columns of their own.
MAX_SUM_COLUMNS = 512
# Texts that an encoder gets at once: so many, of so many bytes.
TEXTS_AT_ONCE, TEXT_BYTES = 1024, 2 << 20
# Scores are rounded before they are compared, so ties do not depend on summation order.
SCORE_DIGITS = 9
SCORE_STEP = 10.0**-SCORE_DIGITS


def embed_table(
    df: DataFrame, key: str, text: str, load: Callable[[], Callable[[Sequence[str]], np.ndarray]], name: str = "vec"
) -> DataFrame:
    """Vectors of a text column by a caller's encoder, which ``load`` opens once per task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for batch in batches:
            for keys, texts in text_slices(batch):
                vectors = np.asarray(encoder(texts), dtype="float64")
                ends = np.arange(len(texts) + 1, dtype="int32") * vectors.shape[1]
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, vectors.ravel())], [key, name])

    schema = T.StructType([df.schema[key], T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.select(key, text).mapInArrow(encode, schema)


def text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts (null: empty) of at most ``TEXTS_AT_ONCE`` rows that hold about ``TEXT_BYTES``, one row at least.

    A batch is Arrow's; only the texts of a slice become Python's, several times as large.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype="int64"), 0
    while at < len(sizes):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right"))
        to = min(max(fit, at + 1), at + TEXTS_AT_ONCE)
        part = batch.slice(at, to - at)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
        at = to


def normalized(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Unit vectors; rows without a direction (zero length) are left out."""
    unit = vectors.withColumn(vec, l2_normalize(F.col(vec)))
    return unit.filter(F.col(vec)[0].isNotNull())


def mean_pool(
    rows: DataFrame, key: Sequence[str], dim: int, vec: str = "vec", weight: str | None = None
) -> DataFrame:
    """(Weighted) mean vector of each group, combined on the map side.

    Up to ``MAX_SUM_COLUMNS`` dimensions are summed as plain columns in generated code, which is
    several times faster than a vector aggregate; longer vectors use the latter.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if dim > MAX_SUM_COLUMNS:
        mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")), w)
        return rows.groupBy(*key).agg(mean.alias("_mean")).select(*key, vector_to_array("_mean").alias(vec))
    sums = [F.sum(F.col(vec)[i].cast("double") * w).alias(f"_{i}") for i in range(dim)]
    totals = rows.groupBy(*key).agg(F.sum(w).alias("_weight"), *sums)
    return totals.select(*key, F.array(*[F.col(f"_{i}") / F.col("_weight") for i in range(dim)]).alias(vec))


def dimension(vectors: DataFrame, vec: str = "vec") -> int:
    first = vectors.select(F.size(vec).alias("n")).first()
    return first["n"] if first else 0


def mean_user_vectors(history: DataFrame, item_vecs: DataFrame) -> DataFrame:
    """Model-free user encoder: the mean vector of a user's interactions, counting repeats.

    Repeats are counted before the join, so a vector is fetched once per user and item.
    """
    counted = history.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_times"))
    return mean_pool(counted.join(item_vecs, "item_id"), ["user_id"], dimension(item_vecs), weight="_times")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _scores(users: np.ndarray, items: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, SCORE_CELLS // max(1, len(items)))
    for start in range(0, len(users), step):
        part = slice(start, start + step)
        yield part, users[part] @ items.T


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded value of the k best finite scores per row.

    Equal rounded scores go to the lower column. The k-th largest of the maxima of column groups is
    a lower bound of the k-th score, so only the few scores above it are rounded and sorted.
    """
    least = np.full((len(scores), 1), -np.inf)
    if scores.shape[1] >= k * COLUMN_GROUP:
        tops = np.maximum.reduceat(scores, np.arange(0, scores.shape[1], COLUMN_GROUP), axis=1)
        least = np.partition(tops, -k, axis=1)[:, -k, None] - 2 * SCORE_STEP
    elif scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k, None] - 2 * SCORE_STEP
    rows, cols = np.divmod(np.flatnonzero(scores >= least), scores.shape[1])
    values = scores[rows, cols]
    finite = np.isfinite(values)
    rows, cols, values = rows[finite], cols[finite], np.round(values[finite], SCORE_DIGITS)
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    first = np.searchsorted(rows, rows, side="left")
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept], values[kept]


def _masked(scores: np.ndarray, row: np.ndarray, item: np.ndarray, item_ids: np.ndarray) -> np.ndarray:
    """Set the given (row, item id) cells to minus infinity; ``item_ids`` is sorted."""
    at = np.searchsorted(item_ids, item)
    known = (at < len(item_ids)) & (item_ids[np.minimum(at, len(item_ids) - 1)] == item)
    scores[row[known], at[known]] = -np.inf
    return scores


def _flat_masks(row: np.ndarray, lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """One (row, item id) pair per list element."""
    if not len(row):
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    return np.repeat(row, lists.map(len)), np.concatenate(lists.to_list()).astype("int64")


def _cells(users: pd.DataFrame, mask_row: np.ndarray, mask_item: np.ndarray, item_ids: np.ndarray, items: np.ndarray):
    """Masked score slices of one user batch against one item block."""
    order = np.argsort(mask_row, kind="stable")
    mask_row, mask_item = mask_row[order], mask_item[order]
    for part, scores in _scores(_matrix(users["vec"]), items):
        here = slice(*np.searchsorted(mask_row, (part.start, part.start + len(scores))))
        yield part, _masked(scores, mask_row[here] - part.start, mask_item[here], item_ids)


def _top_k_cell(users, mask_row, mask_item, item_ids, items, k) -> Iterator[pd.DataFrame]:
    ids = users["user_id"].to_numpy()
    for part, scores in _cells(users, mask_row, mask_item, item_ids, items):
        rows, cols, values = _best(scores, k)
        yield pd.DataFrame({"user_id": ids[part][rows], "item_id": item_ids[cols], "score": values})


def _score_cell(users, mask_row, mask_item, item_ids, items, k) -> Iterator[pd.DataFrame]:
    """Every finite score, in no order."""
    ids = users["user_id"].to_numpy()
    for part, scores in _cells(users, mask_row, mask_item, item_ids, items):
        rows, cols = np.nonzero(np.isfinite(scores))
        yield pd.DataFrame({"user_id": ids[part][rows], "item_id": item_ids[cols], "score": np.round(scores[rows, cols], SCORE_DIGITS)})


def _rank_cell(users, mask_row, mask_item, item_ids, items, k) -> Iterator[pd.DataFrame]:
    """Per user: how many unmasked items score above, level with the target, and at all."""
    ids, target = users["user_id"].to_numpy(), users["target_score"].to_numpy()
    for part, scores in _cells(users, mask_row, mask_item, item_ids, items):
        # Equal after rounding means less than half a step apart.
        wanted = target[part][:, None]
        above = np.count_nonzero(scores > wanted + SCORE_STEP / 2, axis=1)
        level = np.count_nonzero(scores >= wanted - SCORE_STEP / 2, axis=1) - above
        finite = np.count_nonzero(scores > -np.inf, axis=1)
        yield pd.DataFrame({"user_id": ids[part], "above": above, "level": level, "finite": finite})


TOP_K_SCHEMA = "user_id long, item_id long, score double"
RANK_SCHEMA = "user_id long, above long, level long, finite long"


def _over_catalog(
    users: DataFrame,
    item_vecs: DataFrame,
    masks: DataFrame | None,
    cell,
    schema: str,
    k: int,
    broadcast_bytes: int,
    cell_scores: int | None = None,
) -> DataFrame:
    """Run ``cell`` over every user and every item; a user may get one result per item block.

    ``cell_scores`` bounds the scores of a user batch and an item block, for cells that return them all.
    """
    size = item_vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if masks is None:
        masks = users.sparkSession.range(0).selectExpr("id as user_id", "id as item_id")  # starts no Python worker
    if size["n"] * (size["dim"] or 1) * 8 <= broadcast_bytes:
        return _with_broadcast_items(users, item_vecs, masks, cell, schema, k)
    shape = cell_shape(size["dim"] or 1, cell_scores=cell_scores)
    return _with_item_blocks(users, item_vecs, masks, cell, schema, k, size["n"], shape)


def cell_shape(dimension: int, cell_bytes: int | None = None, cell_scores: int | None = None) -> tuple[int, int]:
    """Users and items of a cell: four items for each user, as both sides stand in memory twice, as rows and as
    a matrix of float64 values; at most ``cell_scores`` scores where they are all returned."""
    users = max(1, (cell_bytes or CELL_BYTES) // (5 * 2 * 8 * dimension))
    if cell_scores is not None:
        users = max(1, min(users, math.isqrt(cell_scores // 4)))
    return min(USERS_PER_BATCH, users), min(ITEMS_PER_BLOCK, 4 * users)


def _local(vectors: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and matrix of a vector table whose size has been checked."""
    table = vectors.select(key, "vec").toArrow().sort_by(key)
    values = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table[key].to_numpy(), values.reshape(len(table), -1) if len(table) else values.reshape(0, 0)


def _with_broadcast_items(users, item_vecs, masks, cell, schema, k) -> DataFrame:
    item_ids, items = _local(item_vecs, "item_id")
    if not len(item_ids):
        return users.sparkSession.createDataFrame([], schema)
    shared = users.sparkSession.sparkContext.broadcast((item_ids, items))
    # Only catalogue items are masked, so a user's list is no longer than the measured catalogue.
    listed = masks.join(F.broadcast(item_vecs.select("item_id")), "item_id", "left_semi")
    per_user = listed.groupBy("user_id").agg(F.collect_set("item_id").alias("_masked"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, items = shared.value
        for rows in batches:
            listed = rows["_masked"].notna().to_numpy()
            mask_row, mask_item = _flat_masks(np.flatnonzero(listed), rows["_masked"][listed])
            yield from cell(rows, mask_row, mask_item, item_ids, items, k)

    return users.join(per_user, "user_id", "left").mapInPandas(score, schema)


def _with_item_blocks(users, item_vecs, masks, cell, schema, k, n_items, shape) -> DataFrame:
    """Grid of user batches and item blocks, joined by their two numbers.

    Batches and blocks come from hashes of unique ids, so they are even whatever the data look
    like. A user row is sent once per block, an item row once per batch, a mask exactly once: the
    masks of a user within one block are a list no longer than the block.
    """
    per_batch, per_block = shape
    blocks = -(-n_items // per_block)
    batches = max(1, -(-users.count() // per_batch))
    batch = F.pmod(F.xxhash64("user_id"), F.lit(batches)).alias("_batch")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("_block")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block")
    every_batch = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("_batch")
    user_side = users.select("*", batch).select("*", every_block)
    mask_side = masks.select("user_id", "item_id", batch, block).groupBy("user_id", "_batch", "_block")
    mask_side = mask_side.agg(F.collect_set("item_id").alias("_hidden"))
    left = user_side.unionByName(mask_side, allowMissingColumns=True)
    right = item_vecs.select("item_id", "vec", block).select("*", every_batch)

    def score(rows: pd.DataFrame, catalog: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        is_user = rows["_hidden"].isna()
        batch_users, hidden = rows[is_user], rows[~is_user]
        if batch_users.empty or catalog.empty:
            return pd.DataFrame(columns=columns)
        catalog = catalog.sort_values("item_id")
        row_of = pd.Series(np.arange(len(batch_users)), index=batch_users["user_id"].to_numpy())
        hidden = hidden[hidden["user_id"].isin(row_of.index)]
        mask_row, mask_item = _flat_masks(row_of.loc[hidden["user_id"]].to_numpy(), hidden["_hidden"])
        parts = cell(batch_users, mask_row, mask_item, catalog["item_id"].to_numpy(), _matrix(catalog["vec"]), k)
        return pd.concat(list(parts), ignore_index=True)

    grid = ["_batch", "_block"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(score, schema)


def _merged(best: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = best.sort_values(["user_id", "score", "item_id"], ascending=[True, False, True])
    return ordered[ordered.groupby("user_id").cumcount() < k]


def best_of_stream(queries: DataFrame, corpus: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`top_k_of_catalog` for few users and a large catalogue.

    The users are sent to every task, when their measured size allows it, and the catalogue is
    read once where it lies. A task keeps k items per user and returns them at its end.
    """
    users, items = normalized(queries), normalized(corpus)
    size = users.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if size["n"] == 0 or size["n"] * max(size["dim"], k * 3) * 8 > broadcast_bytes:
        return top_k_of_catalog(queries, corpus, k, broadcast_bytes=broadcast_bytes)
    shared = users.sparkSession.sparkContext.broadcast(_local(users, "user_id"))
    # Vectors stand three times in a task, as rows, stacked and as results of a conversion.
    step = max(1, min(STREAM_ITEMS, CELL_BYTES // (8 * 3 * 8 * size["dim"])))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), step):
                yield rows.iloc[at : at + step]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user_ids, wanted = shared.value
        rows_of = pd.DataFrame({"user_id": user_ids, "vec": list(wanted)})
        nothing = np.zeros(0, dtype="int64")
        best: pd.DataFrame | None = None
        for rows in slices(batches):
            rows = rows.sort_values("item_id")
            found = list(_top_k_cell(rows_of, nothing, nothing, rows["item_id"].to_numpy(), _matrix(rows["vec"]), k))
            best = _merged(pd.concat(found if best is None else [best, *found], ignore_index=True), k)
        if best is not None:
            yield best

    return top_k(items.select("item_id", "vec").mapInPandas(search, TOP_K_SCHEMA), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best items per user with rank 1..k; equal scores go to the lower item id."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "rank", "item_id", "score")


def top_k_of_catalog(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    k: int,
    history: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rank all items for every user by cosine and keep the k best that are not in ``history``.

    Vectors are ``(user_id, vec)`` and ``(item_id, vec)`` with whole-number ids. A user with fewer
    than k candidates gets fewer rows.
    """
    best = _over_catalog(
        normalized(user_vecs), normalized(item_vecs), history, _top_k_cell, TOP_K_SCHEMA, k, broadcast_bytes
    )
    return top_k(best, k)


def score_full_catalog(user_vecs: DataFrame, item_vecs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every user's cosine with every item, in long form. Prefer :func:`top_k_of_catalog`.

    Scores leave a task in parts of ``SCORE_CELLS``, unsorted, so its memory does not depend on their number.
    """
    return _over_catalog(
        normalized(user_vecs), normalized(item_vecs), None, _score_cell, TOP_K_SCHEMA, 0, broadcast_bytes, SCORE_CELLS
    )


def mask_candidates(scores: DataFrame, history: DataFrame) -> DataFrame:
    """Drop the pad and every item of the user's history, the target too if it is a repeat."""
    return scores.filter(F.col("item_id") != 0).join(history.distinct(), ["user_id", "item_id"], "left_anti")


def target_scores(examples: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Cosine of each user with the held-out target; null where the target is masked.

    One dot product per user, instead of a lookup in all scores.
    """
    users = normalized(user_vecs).withColumnRenamed("vec", "_user")
    items = normalized(item_vecs).select(F.col("item_id").alias("target"), F.col("vec").alias("_target"))
    scored = examples.join(users, "user_id").join(items, "target")
    scored = scored.withColumn("score", F.round(dot(F.col("_user"), F.col("_target")), SCORE_DIGITS)).drop("_user", "_target")
    if history is None:
        return scored
    seen = history.distinct().select("user_id", F.col("item_id").alias("target"), F.lit(True).alias("_seen"))
    scored = scored.join(seen, ["user_id", "target"], "left")
    return scored.withColumn("score", F.when(F.col("_seen").isNull(), F.col("score"))).drop("_seen")


def relevance_records(scored: DataFrame, decoded: DataFrame, item_map: DataFrame) -> DataFrame:
    """``(interaction, target, score)`` with tokens: the padded history, its next item, its score."""
    targets = item_map.select(F.col("id").alias("target"), F.col("token").alias("_token"))
    rows = scored.select("user_id", "target", "score").join(targets, "target")
    return rows.join(decoded, "user_id").select("user_id", "interaction", F.col("_token").alias("target"), "score")


def hit_matrix(best: DataFrame, positives: DataFrame) -> DataFrame:
    """``(user_id, rank, rel, pos_len)`` for every rank; a user without results has one null rank."""
    positives = positives.select("user_id", "item_id").distinct()
    counts = positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("pos_len"))
    marked = best.join(positives.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left")
    rows = marked.select("user_id", "rank", F.coalesce("_hit", F.lit(0)).alias("rel"))
    joined = counts.join(rows, "user_id", "full_outer")
    return joined.select(
        "user_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("pos_len", F.lit(0)).alias("pos_len")
    )


def average_rank(scores: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Descending rank of each score per user; equal scores share the mean of their ranks."""
    negated = scores.withColumn("_down", -F.col("score"))
    placed = group_positions(negated, ["user_id"], ["_down", "item_id"], "_pos", "_n", max_group_rows)
    shared = placed.groupBy("user_id", "score").agg(((F.min("_pos") + F.max("_pos")) / 2 + 1).alias("avg_rank"))
    # Written, so that the join shuffles both sides and a score shared by very many rows is split.
    return scores.join(materialize(shared, "shared-ranks"), ["user_id", "score"])


def rank_sums(ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """``(user_id, pos_rank_sum, n_candidates, pos_len)`` from a table of scored rows with ranks."""
    marked = ranked.join(positives.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left")
    return marked.groupBy("user_id").agg(
        F.sum(F.when(F.col("_hit") == 1, F.col("avg_rank")).otherwise(0.0)).alias("pos_rank_sum"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count("_hit").alias("pos_len"),
    )


def mean_rank_stats(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    targets: DataFrame,
    history: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Average rank of each user's target in the masked catalogue: counts only, no score table.

    ``targets`` is ``(user_id, item_id)``, one per user. A masked target ties with all masked
    cells (the pad and the distinct history) behind the finite ones.
    """
    users, items = normalized(user_vecs), normalized(item_vecs)
    targets = targets.select("user_id", "item_id")
    history = history.select("user_id", "item_id").distinct()
    target_vecs = items.select("item_id", F.col("vec").alias("_target"))
    scored = users.join(targets, "user_id").join(target_vecs, "item_id")
    scored = scored.select("user_id", "vec", F.round(dot(F.col("vec"), F.col("_target")), SCORE_DIGITS).alias("target_score"))
    # The target's own cell is hidden and added back below, so it is never compared with itself.
    hidden = history.unionByName(targets).distinct()
    cells = _over_catalog(scored, items, hidden, _rank_cell, RANK_SCHEMA, 0, broadcast_bytes)
    counts = cells.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("above", "level", "finite")])
    seen = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_seen"))
    repeats = history.join(targets, ["user_id", "item_id"], "left_semi").select("user_id", F.lit(True).alias("_repeat"))
    joined = counts.join(seen, "user_id", "left").join(repeats, "user_id", "left")
    repeat, masked = F.coalesce("_repeat", F.lit(False)), F.coalesce("_seen", F.lit(0)) + 1
    return joined.select(
        "user_id",
        F.when(repeat, F.col("finite") + (masked + 1) / 2)
        .otherwise(F.col("above") + (F.col("level") + 2) / 2)
        .alias("pos_rank_sum"),
        (F.col("finite") + F.when(repeat, 0).otherwise(1)).alias("n_candidates"),
        F.lit(1).cast("long").alias("pos_len"),
    )
