import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import metrics
from tests.helpers import rows


def hits(spark, *users):
    """Users as ``(flags by rank, number of positives)``."""
    data = []
    for u, (flags, pos_len) in enumerate(users):
        data += [(u, r, f, pos_len) for r, f in enumerate(flags, 1)] or [(u, None, 0, pos_len)]
    return spark.createDataFrame(data, "user_id long, rank int, rel int, pos_len long")


def values(df):
    return {(r["metric"], r["k"]): r["value"] for r in df.collect()}


RANKING = ["Hit", "MRR", "MAP", "Recall", "NDCG", "Precision"]


def test_one_user(spark):
    got = values(metrics.evaluate({"hits": hits(spark, ([0, 1, 0, 1], 2))}, RANKING, 4))
    ndcg = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    want = {"hit": 1, "mrr": 0.5, "map": 0.5, "recall": 1, "ndcg": ndcg, "precision": 0.5}
    assert got == {(n, 4): pytest.approx(v) for n, v in want.items()}


def brute(flags, pos_len, k, depth):
    flags = (flags + [0] * depth)[:depth]
    got = flags[:k]
    precisions = [sum(flags[: j + 1]) / (j + 1) * f for j, f in enumerate(got)]
    cap = min(k, max(min(pos_len, depth), 1))
    return {
        "hit": float(any(got)),
        "mrr": next((1 / r for r, f in enumerate(got, 1) if f), 0.0),
        "map": sum(precisions) / cap,
        "recall": sum(got) / pos_len if pos_len else None,
        "ndcg": sum(f / math.log2(r + 1) for r, f in enumerate(got, 1)) / sum(1 / math.log2(r + 1) for r in range(1, cap + 1)),
        "precision": sum(got) / k,
    }


def test_many_users_against_brute_force(spark):
    rng = np.random.default_rng(1)
    users = []
    for _ in range(40):
        flags = (rng.random(int(rng.integers(0, 11))) < 0.3).astype(int).tolist()
        users.append((flags, sum(flags) + int(rng.integers(0, 3))))
    got = values(metrics.evaluate({"hits": hits(spark, *users)}, RANKING, [1, 3, 10]))
    for k in (1, 3, 10):
        per_user = [brute(f, p, k, 10) for f, p in users]
        for name in ("hit", "mrr", "map", "recall", "ndcg", "precision"):
            known = [u[name] for u in per_user if u[name] is not None]
            assert got[(name, k)] == pytest.approx(np.mean(known)), (name, k)
    for name in ("hit", "recall"):
        assert got[(name, 1)] <= got[(name, 3)] <= got[(name, 10)]


def test_suite_checks_its_arguments(spark):
    given = {"hits": hits(spark, ([1], 1)), "scored": spark.createDataFrame([(0.5, 1)], "score double, label int")}
    with pytest.raises(ValueError, match="unknown"):
        metrics.evaluate(given, ["nothing"], 5)
    with pytest.raises(ValueError, match="together"):
        metrics.evaluate(given, ["recall", "auc"], 5)
    with pytest.raises(ValueError, match="inputs"):
        metrics.evaluate(given, ["gauc"], 5)
    for bad in (0, -1, [], [5, 0], "5", [2.5], True):
        with pytest.raises(ValueError):
            metrics.evaluate(given, ["recall"], bad)
    assert values(metrics.evaluate({"hits": hits(spark, ([0, 0, 1], 3))}, ["RECALL"], 3, decimals=2)) == {("recall", 3): 0.33}


def test_own_metric(spark):
    @metrics.per_user_metric("last_hit")
    def last_hit(k, depth):
        return F.coalesce(F.max(F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("rank"))), F.lit(0))

    assert "last_hit" in metrics.registered()
    assert values(metrics.evaluate({"hits": hits(spark, ([1, 0, 1], 2))}, ["Last_Hit"], [2, 3])) == {
        ("last_hit", 2): 1.0, ("last_hit", 3): 3.0}
    with pytest.raises(ValueError):
        metrics.metric("odd", "neither", [])(lambda inputs, topk: None)


def test_directions():
    smaller = {n for n, m in metrics.registered().items() if m.smaller}
    assert {"mae", "rmse", "logloss", "averagepopularity", "giniindex"} <= smaller
    assert not smaller & {"hit", "mrr", "map", "recall", "ndcg", "precision", "gauc", "auc", "itemcoverage"}


def mean_rank(spark, *users):
    return spark.createDataFrame(list(enumerate_users(users)), "user_id long, pos_rank_sum double, n_candidates long, pos_len long")


def enumerate_users(users):
    for u, r in enumerate(users):
        yield (u, *r)


def test_gauc(spark):
    run = lambda *users: values(metrics.evaluate({"mean_rank": mean_rank(spark, *users)}, ["gauc"], 5))[("gauc", None)]
    assert run((1.0, 4, 1)) == 1.0
    assert run((4.0, 4, 1)) == 0.0
    # Users without positives or without negatives do not count; others weigh by their positives.
    assert run((1.0, 4, 1), (0.0, 4, 0), (3.0, 2, 2)) == 1.0
    assert run((1.0, 4, 1), (3 + 4.0, 4, 2)) == pytest.approx((1.0 * 1 + 0.0 * 2) / 3)
    assert run((0.0, 4, 0)) is None


def test_auc_and_curve(spark):
    rng = np.random.default_rng(2)
    score, label = np.round(rng.random(500), 2), (rng.random(500) < 0.3).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int").repartition(5)
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert values(metrics.evaluate({"scored": df}, ["auc"], 5))[("auc", None)] == pytest.approx(want)
    curve = {r["score"]: (r["fps"], r["tps"]) for r in metrics.values.roc_curve(df).collect()}
    for s in np.unique(score):
        assert curve[float(s)] == ((neg >= s).sum(), (pos >= s).sum())
    assert values(metrics.evaluate({"scored": df.filter("label = 1")}, ["auc"], 5))[("auc", None)] is None


def test_losses(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.0, 1)], "score double, label int")
    got = values(metrics.evaluate({"scored": df}, ["mae", "rmse", "logloss"], 5))
    assert got[("mae", None)] == pytest.approx((0.1 + 0.2 + 1) / 3)
    assert got[("rmse", None)] == pytest.approx(math.sqrt((0.01 + 0.04 + 1) / 3))
    assert got[("logloss", None)] == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(1e-15)) / 3)


def recommended(spark, *users):
    data = [(u, r, i, 0.0) for u, items in enumerate(users) for r, i in enumerate(items, 1)]
    return spark.createDataFrame(data, "user_id long, rank int, item_id long, score double")


def counts(spark, **by_name):
    return spark.createDataFrame([(ord(n), c) for n, c in by_name.items()], "item_id long, n long")


def test_gini_entropy_coverage(spark):
    run = lambda name, n_items, *users: values(
        metrics.evaluate({"topk": recommended(spark, *users), "num_items": n_items}, [name], [1, 2]))
    four = ([1], [2], [2], [2])
    assert run("GiniIndex", 4, *four)[("giniindex", 1)] == pytest.approx(0.625)
    assert run("ShannonEntropy", 4, [1, 2], [1, 2])[("shannonentropy", 2)] == pytest.approx(math.log(2) / 2)
    assert run("ItemCoverage", 8, [1, 2], [1, 3]) == {("itemcoverage", 1): 1 / 8, ("itemcoverage", 2): 3 / 8}


def test_gini_against_brute_force(spark):
    rng = np.random.default_rng(3)
    users = [rng.permutation(30)[:6].tolist() for _ in range(25)]
    got = values(metrics.evaluate({"topk": recommended(spark, *users), "num_items": 40}, ["giniindex"], [2, 6]))
    for k in (2, 6):
        _, c = np.unique([i for u in users for i in u[:k]], return_counts=True)
        c = np.sort(c)
        idx = np.arange(40 - len(c) + 1, 41)
        assert got[("giniindex", k)] == pytest.approx(((2 * idx - 41) * c).sum() / c.sum() / 40)


def test_tail(spark):
    given = counts(spark, a=1, b=1, c=5, d=9)
    tail = lambda ratio: {chr(r["item_id"]) for r in metrics.diversity.tail_items(given, ratio).collect()}
    assert tail(0.5) == {"a", "b"}
    assert tail(5) == {"a", "b", "c"}
    assert tail(None) == tail(0) == tail(-1) == {"a"}
    inputs = {"topk": recommended(spark, [ord("a"), ord("d")], [ord("c"), ord("b")]), "count_items": given, "tail_ratio": 0.5}
    assert values(metrics.evaluate(inputs, ["tailpercentage"], [1, 2])) == {
        ("tailpercentage", 1): 0.5, ("tailpercentage", 2): 0.5}
    inputs["topk"] = recommended(spark, [ord("a"), ord("d")], [ord("c"), ord("z")])
    assert values(metrics.evaluate(inputs, ["averagepopularity"], 2)) == {("averagepopularity", 2): (5 + 2.5) / 2}


@pytest.mark.parametrize("tile", [None, 2])
def test_contrastive_logits(spark, tile):
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    q, t, n = rng.normal(size=(3, 3, 4)), rng.normal(size=(3, 3, 4)), rng.normal(size=(2, 5, 4))
    n[0, 0] = t[0, 1] * 3  # a false negative of one position
    n[1] = t[1, 2]  # all are false negatives of one position
    positions = [(b, e, 0, q[b, e].tolist(), t[b, e].tolist()) for b in range(3) for e in range(3)]
    negs = [(b, v.tolist()) for b in range(2) for v in n[b]]  # the last batch has none
    given = (
        spark.createDataFrame(positions, "batch_id long, example int, step int, query_vec array<double>, target_vec array<double>"),
        spark.createDataFrame(negs, "batch_id long, vec array<double>"),
    )
    losses, sizes, places = [], [], []
    got = {}
    for r in metrics.contrastive.nce_logits(*given, scale=math.log(20), tile=tile).collect():
        got.setdefault((r["batch_id"], r["example"]), []).append(r)
        assert r["width"] <= 1 + (tile or 5) * 3
    states = metrics.contrastive.nce_state(*given, scale=math.log(20), tile=tile)
    state = {(r["batch_id"], r["example"]): r for r in states.collect()}
    assert len(state) == 9
    for b in range(3):
        for e in range(3):
            negs_of = n[b] if b < 2 else np.zeros((0, 4))
            keep = unit(negs_of) @ unit(t[b, e]) <= 0.99
            pos, neg = 20 * unit(q[b, e]) @ unit(t[b, e]), 20 * (unit(negs_of) @ unit(q[b, e]))[keep]
            rows, one = got[b, e], state[b, e]
            assert [r["pos_logit"] for r in rows] == pytest.approx([pos] * len(rows)) and one["pos_logit"] == pytest.approx(pos)
            assert sorted(x for r in rows for x in r["neg_logits"]) == pytest.approx(sorted(neg))
            assert (one["survivors"], one["above"], one["negatives"]) == (len(neg), (neg > pos).sum(), len(negs_of))
            assert one["total"] == pytest.approx(neg.sum())
            if len(neg):
                assert one["top"] + math.log(one["scaled"]) == pytest.approx(np.log(np.exp(neg).sum()))
            losses.append(np.log(np.exp([pos, *neg]).sum()) - pos)
            sizes.append(1 + len(neg))
            places.append(1 + (neg > pos).sum())
    assert min(sizes) == 1 and max(sizes) == 6
    result = {r["metric"]: r["value"] for r in metrics.contrastive.nce_metrics(states).collect()}
    assert result["nce_loss"] == pytest.approx(np.mean(losses))
    assert result["nce_samples"] == pytest.approx(np.mean(sizes))
    assert result["nce_top1_acc"] == pytest.approx(np.mean([p <= 1 for p in places]))
    assert set(result) == {"nce_loss", "nce_samples", "nce_top1_acc"}


def test_contrastive_tiles_fit_their_memory():
    for dimension in (1, 64, 2048, 100_000):
        n = metrics.contrastive.tile_rows(dimension, 64 << 20)
        assert n == 1 or 8 * n * (3 * dimension + 3 * n) <= 64 << 20
    assert metrics.contrastive.tile_rows(64) >= 1024


def test_contrastive_state_of_many_negatives(spark):
    """A batch of 28,672 negatives in tiles, against one matrix product."""
    rng = np.random.default_rng(8)
    q, t, n = rng.normal(size=(6, 16)), rng.normal(size=(6, 16)), rng.normal(size=(28_672, 16))
    positions = spark.createDataFrame(
        [(0, e, 0, a.tolist(), b.tolist()) for e, (a, b) in enumerate(zip(q, t))],
        "batch_id long, example int, step int, query_vec array<double>, target_vec array<double>",
    )
    negs = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(n)], "batch_id long, place int, vec array<double>")
    got = metrics.contrastive.nce_state(positions, negs, tile=1024).orderBy("example").collect()
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    logits = unit(q) @ unit(n).T / 0.07
    kept = unit(t) @ unit(n).T <= 0.99
    for e, r in enumerate(got):
        own = logits[e][kept[e]]
        assert (r["survivors"], r["above"], r["negatives"]) == (len(own), (own > r["pos_logit"]).sum(), 28_672)
        assert r["top"] + math.log(r["scaled"]) == pytest.approx(np.log(np.exp(own).sum()))
