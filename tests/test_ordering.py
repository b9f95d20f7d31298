import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.operators import ordering
from tests.helpers import rows


def test_global_rank_is_dense_over_many_partitions(spark):
    keys = random.Random(1).sample(range(100_000), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = rows(ordering.global_rank(df, ["k"]), "rank", "k")
    assert got == sorted(((i, k) for i, k in enumerate(sorted(keys))), key=repr)


def test_global_rank_of_nothing(spark):
    assert ordering.global_rank(spark.createDataFrame([], "k long"), ["k"]).count() == 0


@pytest.mark.parametrize("bound", [0, 3, 400, 10_000])
def test_group_positions_do_not_depend_on_the_split(spark, bound):
    rng = random.Random(2)
    # One group holds half of all rows.
    data = [(0 if rng.random() < 0.5 else rng.randrange(50), at) for at in rng.sample(range(10_000), 1500)]
    data += [(None, 1), (None, 2)]
    df = spark.createDataFrame(data, "g long, at long").repartition(5)
    want = []
    for g in {g for g, _ in data}:
        members = sorted(at for h, at in data if h == g)
        want += [(g, at, pos, len(members)) for pos, at in enumerate(members)]
    got = rows(ordering.group_positions(df, ["g"], ["at"], max_group_rows=bound), "g", "at", "pos", "n")
    assert got == sorted(want, key=repr)


def test_running_totals(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(5), rng.randrange(3)) for k in rng.sample(range(100_000), 3000)]
    df = spark.createDataFrame(data, "k long, a long, b long").repartition(6)
    want, a, b = [], 0, 0
    for k, x, y in sorted(data):
        a, b = a + x, b + y
        want.append((k, a, b))
    got = rows(ordering.running_totals(df, ["k"], {"ta": "a", "tb": "b"}), "k", "ta", "tb")
    assert got == sorted(want, key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=30), block=st.integers(1, 7))
def test_running_max_in_blocks(spark, values, block):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g long, at long, v long")
    got = ordering.running_max(df, ["g"], "at", {"top": F.col("v")}, block=block)
    want = list(np.maximum.accumulate(values))
    assert [r["top"] for r in sorted(got.collect(), key=lambda r: r["at"])] == want


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("n", [1, 7, 40, 200])
def test_take_first_both_ways(spark, limit, n):
    df = spark.createDataFrame([((i * 37) % 100, i) for i in range(100)], "k long, v long")
    got = rows(ordering.take_first(df, ["k"], n, max_limit_rows=limit), "k")
    assert got == sorted(((k,) for k in range(min(n, 100))), key=repr)


def test_exact_percentiles_match_numpy(spark):
    values = np.random.default_rng(4).normal(size=997)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    levels = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = {r["level"]: r["value"] for r in ordering.exact_percentiles(df, "v", levels).collect()}
    assert [got[q] for q in levels] == pytest.approx([np.percentile(values, 100 * q) for q in levels], abs=1e-12)
