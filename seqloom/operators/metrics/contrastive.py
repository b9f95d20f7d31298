"""Contrastive logits in tiles, and their metrics from states that merge."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.metrics.registry import long_form
from seqloom.operators.negatives import FALSE_NEGATIVE_COSINE
from seqloom.session import materialize

# The starting and the fixed temperature, the largest scale, the accuracy cutoffs.
START_SCALE = math.log(1 / 0.07)
FIXED_SCALE = math.log(1 / 0.05)
MAX_SCALE = math.log(100)
NCE_CUTOFFS = (1, 5, 10, 50, 100)

# Memory for the vectors and the products of one tile: it bounds a group, whatever a batch has.
CELL_BYTES = 64 << 20
MAX_TILE = 2048
_KEY = "batch_id long, example int, step int"
LOGIT_SCHEMA = f"{_KEY}, tile int, pos_logit double, neg_logits array<double>, width int"
STATE_SCHEMA = f"{_KEY}, pos_logit double, top double, scaled double, total double, survivors long, above long, negatives long"


def tile_rows(dimension: int, cell_bytes: int = CELL_BYTES) -> int:
    """Vectors on each side of a tile, so that both sides and three products of them fit in ``cell_bytes``."""
    # n * (3 * dimension) + n * n * 3 numbers of eight bytes.
    n = (-3 * dimension + math.sqrt(9 * dimension**2 + 12 * cell_bytes / 8)) / 6
    return max(1, min(MAX_TILE, int(n)))


def _unit(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.chunked_array(flat.chunks if isinstance(flat, pa.ChunkedArray) else [flat])
    matrix = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks]])
    matrix = matrix.astype("float64").reshape(-1, dimension)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _cells(positions: DataFrame, negatives: DataFrame, tile: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Both sides dealt to the tiles of their batch, and the dimension: a position meets each tile of negatives
    once. Tiles are filled by a hash of the place in the batch, so they hold ``tile`` rows, about."""
    if "place" not in negatives.columns:
        # Without a place of their own negatives are numbered, and written so that the numbers stay.
        negatives = materialize(negatives.withColumn("place", F.monotonically_increasing_id()), "negatives")
    dimension = (positions.agg(F.max(F.size("target_vec"))).first()[0]) or 1
    tile = tile or tile_rows(dimension)
    sizes = lambda df, name: df.groupBy("batch_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    # One row for each batch.
    tiles = sizes(positions, "slices").join(sizes(negatives.select("batch_id"), "tiles"), "batch_id", "left")
    tiles = materialize(tiles.fillna(1, ["tiles"]), "tiles")
    dealt = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = positions.join(tiles, "batch_id").withColumns(
        {"slice": dealt("slices", "example", "step"), "tile": every("tiles")}
    )
    right = negatives.join(tiles, "batch_id").withColumns({"tile": dealt("tiles", "place"), "slice": every("slices")})
    vector = lambda c: F.col(c).cast("array<double>").alias(c)
    key = ["batch_id", "slice", "tile"]
    left = left.select(*key, "example", "step", vector("query_vec"), vector("target_vec"))
    return left, right.select(*key, vector("vec")), dimension


def _over_tiles(
    positions: DataFrame,
    negatives: DataFrame,
    scale: float,
    threshold: float,
    tile: int | None,
    schema: str,
    columns: Callable[[np.ndarray, np.ndarray, np.ndarray], dict],
) -> DataFrame:
    """``columns`` of (positive logits, logits, which are kept) for every tile of every batch."""
    factor = math.exp(min(max(scale, 0.0), MAX_SCALE))
    left, right, dimension = _cells(positions, negatives, tile)
    names = [c.split()[0] for c in schema.split(", ")]

    def cell(key: tuple, rows: pa.Table, negs: pa.Table) -> pa.Table:
        batch, _, number = (k.as_py() for k in key)
        queries, targets = _unit(rows["query_vec"], dimension), _unit(rows["target_vec"], dimension)
        shared = _unit(negs["vec"], dimension)
        scores = factor * (queries @ shared.T)
        kept = targets @ shared.T <= threshold
        found = columns(factor * (queries * targets).sum(axis=1), scores, kept)
        n = rows.num_rows
        known = {"batch_id": np.full(n, batch), "tile": np.full(n, number, np.int32), "negatives": np.full(n, len(shared))}
        known |= {"width": np.full(n, 1 + len(shared), np.int32), "example": rows["example"], "step": rows["step"], **found}
        return pa.table({c: known[c] for c in names})

    left = left.withColumns({c: F.col(c).cast("int") for c in ("example", "step")})
    left = left.withColumn("batch_id", F.col("batch_id").cast("long"))
    right = right.withColumn("batch_id", F.col("batch_id").cast("long"))
    group = ["batch_id", "slice", "tile"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(cell, schema)


def nce_logits(
    positions: DataFrame,
    negatives: DataFrame,
    scale: float = START_SCALE,
    threshold: float = FALSE_NEGATIVE_COSINE,
    tile: int | None = None,
) -> DataFrame:
    """Scaled cosine logits of every training position, a row for each tile of its batch's negatives: the
    positive's logit and those of the tile's surviving negatives.

    ``positions``: ``batch_id, example, step, query_vec, target_vec``. ``negatives``: ``batch_id, vec``,
    shared by the batch, and ``place`` (unique in the batch) where they have one. Negatives closer to the
    target than ``threshold`` are left out; ``width`` counts the positive and the tile's negatives before that. A
    position without negatives has one row. For losses and accuracies use :func:`nce_state`, which writes
    no logits.
    """

    def columns(pos: np.ndarray, scores: np.ndarray, kept: np.ndarray) -> dict:
        ends = np.r_[0, kept.sum(axis=1).cumsum()].astype(np.int32)
        return {"pos_logit": pos, "neg_logits": pa.ListArray.from_arrays(ends, pa.array(scores[kept]))}

    return _over_tiles(positions, negatives, scale, threshold, tile, LOGIT_SCHEMA, columns)


def nce_state(
    positions: DataFrame,
    negatives: DataFrame,
    scale: float = START_SCALE,
    threshold: float = FALSE_NEGATIVE_COSINE,
    tile: int | None = None,
) -> DataFrame:
    """What losses and accuracies need of the logits of each position (see :func:`nce_logits`), one row.

    ``pos_logit``; of the surviving negatives the largest logit ``top``, the sum ``scaled`` of
    ``exp(logit - top)``, the sum ``total`` of the logits, their number ``survivors`` and how many are
    ``above`` the positive's; the number of all ``negatives``. Each tile gives such a state and states
    merge, so logits of one tile only are in memory. Without survivors ``top`` is minus infinity.
    """

    def columns(pos: np.ndarray, scores: np.ndarray, kept: np.ndarray) -> dict:
        masked = np.where(kept, scores, -np.inf)
        top = masked.max(axis=1, initial=-np.inf)
        scaled = np.exp(masked - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1)
        counts = {"survivors": kept.sum(axis=1), "above": (masked > pos[:, None]).sum(axis=1)}
        return {"pos_logit": pos, "top": top, "scaled": scaled, "total": np.where(kept, scores, 0.0).sum(axis=1)} | counts

    parts = _over_tiles(positions, negatives, scale, threshold, tile, STATE_SCHEMA, columns)
    merged = parts.groupBy("batch_id", "example", "step").agg(
        F.max("pos_logit").alias("pos_logit"),
        F.max("top").alias("top"),
        F.collect_list(F.struct("top", "scaled")).alias("parts"),  # one for each tile
        *[F.sum(c).alias(c) for c in ("total", "survivors", "above", "negatives")],
    )
    moved = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.when(p["scaled"] > 0, p["scaled"] * F.exp(p["top"] - F.col("top"))).otherwise(0.0))
    return merged.withColumn("scaled", moved).select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")])


def nce_loss_of(pos: Column, top: Column, scaled: Column) -> Column:
    """Cross entropy of the positive: log-sum-exp of all logits minus the positive's."""
    high = F.greatest(pos, top)
    return high + F.ln(F.exp(pos - high) + F.when(scaled > 0, scaled * F.exp(top - high)).otherwise(0.0)) - pos


def nce_metrics(state: DataFrame) -> DataFrame:
    """Mean loss, mean number of surviving logits, and how often the positive is in the top k, of
    :func:`nce_state`."""
    rows = state.select(
        nce_loss_of(F.col("pos_logit"), F.col("top"), F.col("scaled")).alias("loss"),
        (F.col("survivors") + 1).alias("survivors"),
        (F.col("above") + 1).alias("place"),
        (F.col("negatives") + 1).alias("width"),
    )
    means = rows.agg(
        F.avg("loss").alias("nce_loss"),
        F.avg("survivors").alias("nce_samples"),
        F.min("width").alias("width"),
        *[F.avg((F.col("place") <= k).cast("double")).alias(f"nce_top{k}_acc") for k in NCE_CUTOFFS],
    )
    named = {("nce_loss", None): F.col("nce_loss"), ("nce_samples", None): F.col("nce_samples")}
    for k in NCE_CUTOFFS:
        # A cutoff beyond the number of logits is not reported.
        named[(f"nce_top{k}_acc", None)] = F.when(F.col("width") >= k, F.col(f"nce_top{k}_acc"))
    return long_form(means, named).filter(F.col("value").isNotNull())
