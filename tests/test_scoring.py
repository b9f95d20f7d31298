import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.operators import scoring
from seqloom.operators.leakage import hashed_words
from tests.helpers import rows

USERS, ITEMS, DIM = 23, 57, 5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    users, items = rng.normal(size=(USERS, DIM)), rng.normal(size=(ITEMS, DIM))
    items[10] = items[11] * 2  # same direction: a tie for every user
    seen = {(u, int(i)) for u in range(USERS) for i in rng.integers(1, ITEMS, size=u)}
    seen |= {(0, i) for i in range(1, ITEMS - 2)}  # one user has seen nearly everything
    frames = (
        spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_id long, vec array<double>"),
        spark.createDataFrame([(i, items[i].tolist()) for i in range(1, ITEMS)], "item_id long, vec array<double>"),
        spark.createDataFrame(sorted(seen), "user_id long, item_id long"),
    )
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(users) @ unit(items).T, 9)
    scores[:, 0] = -np.inf
    for u, i in seen:
        scores[u, i] = -np.inf
    return frames, scores


@pytest.fixture(params=["broadcast", "blocks"])
def budget(request, monkeypatch):
    if request.param == "broadcast":
        return scoring.BROADCAST_BYTES
    monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", 10)
    monkeypatch.setattr(scoring, "USERS_PER_BATCH", 6)
    return 0


def best(scores, k):
    for u, row in enumerate(scores):
        order = [i for i in np.lexsort((np.arange(len(row)), -row)) if np.isfinite(row[i])]
        for rank, i in enumerate(order[:k], 1):
            yield (u, rank, int(i), row[i])


def flat(pairs):
    return sorted((r[:-1], pytest.approx(r[-1], abs=1e-8)) for r in pairs)


@pytest.mark.parametrize("group", [1, 4, 64])
def test_best_of_each_row(monkeypatch, group):
    monkeypatch.setattr(scoring, "COLUMN_GROUP", group)
    rng = np.random.default_rng(12)
    scores = np.round(rng.normal(size=(50, 37)), 1)  # many ties
    scores[rng.random(scores.shape) < 0.4] = -np.inf
    scores[0] = -np.inf
    for k in (1, 3, 9, 37, 50):
        rows_, cols, values = scoring._best(scores, k)
        want = [(u, i, s) for u, _, i, s in best(scores, k)]
        assert list(zip(rows_.tolist(), cols.tolist(), values.tolist())) == want


@pytest.mark.parametrize("k", [1, 4, 100])
def test_top_k_of_catalog(spark, data, budget, k):
    (users, items, seen), scores = data
    got = sorted(tuple(r) for r in scoring.top_k_of_catalog(users, items, k, seen, budget).collect())
    want = sorted(best(scores, k))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)


def test_few_users_large_catalogue(spark, data, budget):
    (users, items, _), _ = data
    got = rows(scoring.best_of_stream(users, items.repartition(9), 4, budget), "user_id", "rank", "item_id")
    assert got == rows(scoring.top_k_of_catalog(users, items, 4), "user_id", "rank", "item_id")


def test_mean_rank_of_targets(spark, data, budget):
    (users, items, seen), scores = data
    target = {u: 1 + (u * 7) % (ITEMS - 1) for u in range(USERS)}
    frame = spark.createDataFrame(list(target.items()), "user_id long, item_id long")
    got = {r["user_id"]: r for r in scoring.mean_rank_stats(users, items, frame, seen, budget).collect()}
    repeats = 0
    for u, t in target.items():
        row = scores[u]
        rank = (row > row[t]).sum() + ((row == row[t]).sum() + 1) / 2
        repeats += row[t] == -np.inf
        assert got[u]["pos_rank_sum"] == rank
        assert got[u]["n_candidates"] == np.isfinite(row).sum()
    assert repeats


def test_long_form_and_masking(spark, data):
    (users, items, seen), scores = data
    every = scoring.score_full_catalog(users, items)
    assert every.count() == USERS * (ITEMS - 1)
    left = scoring.mask_candidates(every, seen)
    assert left.count() == int(np.isfinite(scores).sum())


@pytest.mark.parametrize("bound", [7, 200])
def test_all_scores_come_in_bounded_parts(spark, data, monkeypatch, bound):
    """Neither a batch of users nor a cell of users and items is returned whole."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(50, DIM))
    monkeypatch.setattr(scoring, "SCORE_CELLS", bound)
    users = pd.DataFrame({"user_id": np.arange(50), "vec": list(vectors)})
    nothing = np.zeros(0, dtype="int64")
    parts = list(scoring._score_cell(users, nothing, nothing, np.arange(5), vectors[:5], 0))
    assert max(map(len, parts)) <= bound and sum(map(len, parts)) == 250
    per_batch, per_block = scoring.cell_shape(DIM, cell_scores=bound)
    assert per_batch * per_block <= bound
    (users, items, _), _ = data
    got = {r[:2]: r[2] for r in scoring.score_full_catalog(users, items, 0).collect()}
    want = {r[:2]: r[2] for r in scoring.score_full_catalog(users, items).collect()}
    assert len(got) == USERS * (ITEMS - 1) and got == pytest.approx(want, abs=1e-8)


def test_masked_scores_of_small_parts(spark, data, monkeypatch):
    monkeypatch.setattr(scoring, "SCORE_CELLS", 50)
    (users, items, seen), scores = data
    left = scoring.mask_candidates(scoring.score_full_catalog(users, items, 0), seen).collect()
    want = {(u, int(i)): scores[u, i] for u, i in np.argwhere(np.isfinite(scores))}
    assert {r[:2]: pytest.approx(r[2], abs=1e-8) for r in left} == want
    shape = scoring.cell_shape(DIM, cell_scores=50)
    assert shape[0] * shape[1] <= 50


def test_target_scores_mask_repeats(spark, data):
    (users, items, seen), scores = data
    examples = spark.createDataFrame([(0, 1), (1, ITEMS - 1)], "user_id long, target long")
    got = dict(rows(scoring.target_scores(examples, users, items, seen), "user_id", "score"))
    assert got[0] is None
    assert got[1] == pytest.approx(scores[1, ITEMS - 1]) or scores[1, ITEMS - 1] == -np.inf
    unmasked = dict(rows(scoring.target_scores(examples, users, items), "user_id", "score"))
    assert unmasked[0] is not None


def test_changing_the_pad_vector_changes_nothing(spark, data):
    (users, items, seen), _ = data
    pad = spark.createDataFrame([(0, [100.0] * DIM)], "item_id long, vec array<double>")
    hidden = seen.unionByName(users.select("user_id", F.lit(0).cast("long").alias("item_id")))
    got = rows(scoring.top_k_of_catalog(users, items.unionByName(pad), 5, hidden), "user_id", "rank", "item_id")
    assert got == rows(scoring.top_k_of_catalog(users, items, 5, seen), "user_id", "rank", "item_id")


@pytest.mark.parametrize("bound", [0, 10**6])
def test_average_rank_shares_ties(spark, bound):
    values = [6, 3, 3, 2, 2, 2, 1]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "user_id long, item_id long, score double")
    got = dict(rows(scoring.average_rank(df, bound), "item_id", "avg_rank"))
    assert [got[i] for i in range(7)] == [1, 2.5, 2.5, 5, 5, 5, 7]


@pytest.mark.parametrize("columns", [0, 512])
def test_mean_pool_and_user_vectors(spark, monkeypatch, columns):
    monkeypatch.setattr(scoring, "MAX_SUM_COLUMNS", columns)
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "item_id long, vec array<double>")
    seen = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (6, 2)], "user_id long, item_id long")
    got = dict(rows(scoring.mean_user_vectors(seen, vecs)))
    assert got[5] == pytest.approx([2 / 3, 2 / 3])
    assert got[6] == [0.0, 2.0]


def test_vectors_without_direction_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "item_id long, vec array<double>")
    assert rows(scoring.normalized(df)) == [(2, [0.6, 0.8])]


def test_encoder_is_opened_per_task(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    got = dict(rows(scoring.embed_table(df, "doc_id", "text", hashed_words(8))))
    assert sum(got[1]) == 3 and max(got[1]) >= 2
    assert got[2] == [0.0] * 8


def test_encoder_gets_texts_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(scoring, "TEXTS_AT_ONCE", 4)
    monkeypatch.setattr(scoring, "TEXT_BYTES", 100)
    texts = ["a" * n for n in (10, 0, 90, 1, 500, 60, 60)] + [None] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array(texts)], ["k", "t"])
    slices = list(scoring.text_slices(batch))
    assert [k for keys, _ in slices for k in keys.to_pylist()] == list(range(16))
    assert [t for _, part in slices for t in part] == [t or "" for t in texts]
    assert max(len(part) for _, part in slices) == 4
    assert all(len(part) == 1 or sum(map(len, part)) <= 100 for _, part in slices)


def test_hits_of_users_without_results(spark):
    top = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.8)], "user_id long, rank int, item_id long, score double")
    positives = spark.createDataFrame([(1, 6), (2, 9)], "user_id long, item_id long")
    assert rows(scoring.hit_matrix(top, positives)) == [(1, 1, 0, 1), (1, 2, 1, 1), (2, None, 0, 1)]


def test_cells_fit_their_memory(spark, monkeypatch):
    for dim in (1, 64, 4096, 100_000):
        users, items = scoring.cell_shape(dim, 64 << 20)
        assert users >= 1 and items >= users and (users == 1 or (users + items) * 2 * 8 * dim <= 64 << 20)
    assert scoring.cell_shape(64) == (scoring.USERS_PER_BATCH, scoring.ITEMS_PER_BLOCK)
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(20, 512)), rng.normal(size=(60, 512))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, vec array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vec array<double>")
    monkeypatch.setattr(scoring, "CELL_BYTES", 5 * 2 * 8 * 512 * 4)  # four users, sixteen items
    got = scoring.top_k_of_catalog(users, items, 5, broadcast_bytes=0).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit(u) @ unit(v).T), axis=1)[:, :5]
    assert {(r["user_id"], r["rank"], r["item_id"]) for r in got} == {(a, k + 1, b) for a, row in enumerate(want.tolist()) for k, b in enumerate(row)}
