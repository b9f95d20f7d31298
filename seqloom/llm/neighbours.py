"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

TRAIN_ROWS = 20_000  # at most so many vectors train the two codebooks
ROUNDS = 10
MIN_CENTROIDS, MAX_CENTROIDS = 8, 256  # of each half: at most 65,536 cells
# A query goes on through its cells until it has met this share of all vectors, and so many at least.
# Half is what unclustered vectors of 64 dimensions need for nine in ten of the true neighbours.
SHARE, MIN_CANDIDATES = 0.5, 5_000
BLOCK, CHUNK = 16_384, 4_096  # vectors and queries of a task's cell group, about
_SLICE = 64  # queries scored at once


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(x[:, :half], self.first), _nearest(x[:, half:], self.second)

    def closeness(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of both halves of queries to all centroids: the negative inner products, whose sum
        over a pair of centroids estimates the negative inner product with the pair's vectors."""
        half = self.first.shape[1]
        return -(q[:, :half] @ self.first.T), -(q[:, half:] @ self.second.T)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def _train(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k evenly spaced rows; a centroid that loses all rows stays where it is."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centroids)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids in the order of their summed distance, until their vectors reach ``wanted``.

    Both lists are sorted; a heap holds the frontier. The pair (i, j) is followed by (i + 1, j), and
    by (i, j + 1) only from the first row, so each pair enters once.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    sizes = counts[a][:, b].tolist()
    heap, found, met = [(x[0] + y[0], 0, 0)], [], 0
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        if sizes[i][j]:
            found.append((int(a[i]), int(b[j])))
            met += sizes[i][j]
        if i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if i == 0 and j + 1 < len(y):
            heapq.heappush(heap, (x[0] + y[j + 1], 0, j + 1))
    return found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vec`` (bytes of doubles) of the vectors that take part, and ``dim``."""
    schema = "vec_id long, vec binary, dim int"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, dims = [], [], []
            for name, values in zip(batch.column("vec_id").to_pylist(), batch.column("vec")):
                if name is None or not values.is_valid or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(name)
                    data.append((x + 0.0).tobytes())  # one zero: -0.0 becomes 0.0
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "vec", "dim"]
            )

    return vectors.mapInArrow(convert, schema)


def _few_ids(keep: int):
    """Per batch the least ``keep`` ids of each vector."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for name, vec in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()):
                ids.setdefault(vec, []).append(name)
            kinds = (pa.binary(), pa.list_(pa.int64()))
            columns = ([*ids], [sorted(x)[:keep] for x in ids.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["vec", "ids"])

    return reduce


def _classes(usable: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their least ``keep`` ids: no query can want more of equal vectors. Batches
    reduce first and salted groups next, so a vector with very many ids meets as a few lists."""
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
    parts = usable.mapInArrow(_few_ids(keep), "vec binary, ids array<long>")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(32)))
    salted = parts.groupBy("vec", "salt").agg(least.alias("ids"))
    return salted.groupBy("vec").agg(least.alias("ids"))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    share: float = SHARE,
    min_candidates: int = MIN_CANDIDATES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each of ``queries`` the ``k`` found vectors of
    largest inner product other than its own, ties by the smaller id.

    Both tables have ``vec_id`` and ``vec`` (array of float or double); the ids of the queries are ids of
    ``vectors``. The index covers all vectors: each half is quantised by its own codebook, trained on
    at most TRAIN_ROWS vectors, and a pair of centroids is a cell. A query takes the cells in the order
    of summed distance until it has met ``share`` of all distinct vectors and ``min_candidates`` at
    least, and scores their vectors exactly, in double precision. Fewer candidates than ``k`` give
    fewer rows.

    Null, empty and zero vectors, such with null or non-finite components, rows without an id and
    vectors of another than the most frequent length (the larger of equals) take no part. Equal
    vectors are scored once and stand for their ids. A repeated id counts once. Other columns are not
    read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = materialize(_usable(vectors.select("vec_id", "vec")), "vectors")
    dims = usable.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims[0]["dim"]
    usable = usable.filter(F.col("dim") == dim).drop("dim")
    classes = materialize(_classes(usable, k + 1), "vector-classes")
    total = classes.count()
    books = _codebooks(classes, dim, total)
    index = materialize(classes.mapInArrow(_assign(books, dim), "a int, b int, vec binary, ids array<long>"), "index")
    counts = np.zeros((len(books.first), len(books.second)), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # MAX_CENTROIDS squared rows at most
        counts[r["a"], r["b"]] = r["count"]
    groups, blocks = _groups(counts.sum(1))

    asked = _usable(queries.select("vec_id", "vec")).filter(F.col("dim") == dim)
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "vec").distinct(), "queries")
    distinct = materialize(asked.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()), "query-vectors")
    wanted = max(min_candidates, int(np.ceil(share * total)))
    plan = distinct.mapInArrow(_plan(books, counts, groups, dim, wanted), "q long, vec binary, home int, g int, cells binary")
    plan = materialize(plan, "query-cells")
    homes = {r["home"]: -(-r["n"] // CHUNK) for r in plan.groupBy("home").agg(F.countDistinct("q").alias("n")).collect()}
    parts = F.get(F.array(*[F.lit(homes.get(g, 1)) for g in range(len(blocks))]), F.col("home"))
    chunk = F.struct("home", F.pmod("q", parts).alias("part"))
    n_blocks = F.get(F.array(*[F.lit(n) for n in blocks]), F.col("g"))
    plan = plan.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    of_a = F.get(F.array(*[F.lit(int(g)) for g in groups]), F.col("a"))
    placed = index.withColumn("g", of_a)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec"), F.get(F.array(*[F.lit(n) for n in blocks]), F.col("g"))).cast("int"))
    met = plan.select(F.col("g").alias("g"), F.col("chunk").alias("chunk")).distinct()
    placed = placed.join(met, "g")
    key = ["g", "block", "chunk"]
    scored = plan.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(
        _score(len(books.second), dim, k + 1), "q long, vec_id long, score double"
    )
    # A query that is its own neighbour is dropped after its vector's list is joined, so one more is kept.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    top = materialize(top.join(distinct, "q"), "vector-neighbours")
    lists = top.groupBy("vec").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("near"))
    lists = materialize(lists.withColumn("near", F.array_sort("near")), "neighbour-lists")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    out = asked.join(lists, "vec").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def _codebooks(classes: DataFrame, dim: int, total: int) -> Codebooks:
    share = min(1.0, TRAIN_ROWS / total)
    sample = classes.filter(F.pmod(F.xxhash64(F.lit(3), "vec"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = [r["vec"] for r in sample.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(TRAIN_ROWS).collect()]
    if not rows:
        rows = [classes.first()["vec"]]
    x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, dim)
    k = min(len(x), int(np.clip(round(4 * total**0.25), MIN_CENTROIDS, MAX_CENTROIDS)))
    return Codebooks(_train(x[:, : dim // 2], k), _train(x[:, dim // 2 :], k))


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First-half centroids in groups of about BLOCK vectors, and the blocks a larger group is cut in."""
    groups, blocks, held = np.zeros(len(sizes), np.int64), [1], 0
    for a, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            blocks.append(1)
            held = 0
        groups[a], held = len(blocks) - 1, held + n
        blocks[-1] = max(1, -(-held // BLOCK))
    return groups, blocks


def _assign(books: Codebooks, dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = books.cells(_matrix(batch.column("vec"), dim))
                arrays = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), batch.column("vec"), batch.column("ids")]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "vec", "ids"])

    return assign


def _plan(books: Codebooks, counts: np.ndarray, groups: np.ndarray, dim: int, wanted: int):
    """Per query and group of cells one row with the cells to visit there (pairs of 16-bit numbers)."""
    names = ["q", "vec", "home", "g", "cells"]
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                first, second = books.closeness(_matrix(batch.column("vec"), dim))
                for q, vec, x, y in zip(batch.column("q").to_pylist(), batch.column("vec").to_pylist(), first, second):
                    cells = np.array(traverse(x, y, counts, wanted), np.int64)
                    of = groups[cells[:, 0]]
                    for g in np.unique(of).tolist():
                        rows.append((q, vec, int(of[0]), g, cells[of == g].astype("<u2").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

    return plan


def _score(n_second: int, dim: int, keep: int):
    empty = pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return empty
        x = _matrix(held.column("vec"), dim)
        ids = held.column("ids").to_pylist()
        least = np.array([i[0] for i in ids])
        cell = held.column("a").to_numpy().astype(np.int64) * n_second + held.column("b").to_numpy()
        present, place = np.unique(cell, return_inverse=True)
        out: tuple[list, list, list] = ([], [], [])
        queries, visits = asked.column("q").to_pylist(), asked.column("cells").to_pylist()
        for at in range(0, len(queries), _SLICE):
            part = _matrix(asked.column("vec").slice(at, _SLICE), dim)
            scores = part @ x.T
            for row, q, cells in zip(scores, queries[at : at + _SLICE], visits[at : at + _SLICE]):
                pairs = np.frombuffer(cells, "<u2").reshape(-1, 2).astype(np.int64)
                seen = np.isin(present, pairs[:, 0] * n_second + pairs[:, 1])[place]
                near = np.flatnonzero(seen)
                if len(near) > keep:
                    edge = np.partition(row[near], len(near) - keep)[len(near) - keep]
                    near = near[row[near] >= edge]
                near = near[np.lexsort((least[near], -row[near]))][:keep]
                for i in near.tolist():
                    out[0].extend([q] * len(ids[i]))
                    out[1].extend(ids[i])
                    out[2].extend([float(row[i])] * len(ids[i]))
        return pa.table({"q": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return score
