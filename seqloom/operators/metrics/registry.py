"""Metric registry and the metric suite."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKING = "ranking"
VALUE = "value"
_KINDS = (RANKING, VALUE)

METRIC_SCHEMA = ("metric", "k", "value")


@dataclass(frozen=True)
class Metric:
    """``needs`` names the inputs of :func:`evaluate`; ``smaller`` tells which direction is better.

    A ``per_user`` metric is an aggregate expression over one user's hit rows at cutoff k, so any
    number of them share one pass. Other metrics return their own ``(metric, k, value)`` rows.
    """

    name: str
    kind: str
    needs: tuple[str, ...]
    smaller: bool
    fn: Callable
    per_user: bool = False


_REGISTRY: dict[str, Metric] = {}


def _register(entry: Metric) -> None:
    if entry.kind not in _KINDS:
        raise ValueError(f"metric kind must be one of {_KINDS}, not {entry.kind!r}")
    _REGISTRY[entry.name] = entry


def metric(name: str, kind: str, needs: Sequence[str], smaller: bool = False):
    """Register ``fn(inputs, topk) -> DataFrame(metric, k, value)``."""

    def add(fn: Callable) -> Callable:
        _register(Metric(name.lower(), kind, tuple(needs), smaller, fn))
        return fn

    return add


def per_user_metric(name: str, smaller: bool = False):
    """Register ``fn(k, depth) -> Column``, an aggregate over one user's hit rows."""

    def add(fn: Callable[[int, int], Column]) -> Callable:
        _register(Metric(name.lower(), RANKING, ("hits",), smaller, fn, per_user=True))
        return fn

    return add


def registered() -> dict[str, Metric]:
    return dict(_REGISTRY)


def long_form(wide: DataFrame, values: Mapping[tuple[str, int | None], Column]) -> DataFrame:
    """Turn a one-row table into ``(metric, k, value)`` rows."""
    cells = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).cast("int").alias("k"), c.cast("double").alias("value"))
        for (m, k), c in values.items()
    ]
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def hit_rows(hits: DataFrame) -> DataFrame:
    """Add the number of hits up to each rank. A user has at most as many rows as the deepest cutoff."""
    so_far = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("hits_so_far", F.sum("rel").over(so_far))


def per_user_values(hits: DataFrame, names: Sequence[str], topk: Sequence[int]) -> DataFrame:
    """One row per user with a column ``name@k`` for every metric and cutoff."""
    depth = max(topk)
    columns = [_REGISTRY[n].fn(k, depth).alias(f"{n}@{k}") for n in names for k in topk]
    return hit_rows(hits).groupBy("user_id").agg(*columns)


def _per_user_means(hits: DataFrame, names: Sequence[str], topk: Sequence[int]) -> DataFrame:
    keys = [(n, k) for n in names for k in topk]
    means = per_user_values(hits, names, topk).agg(*[F.avg(F.col(f"`{n}@{k}`")).alias(f"{n}_{k}") for n, k in keys])
    return long_form(means, {(n, k): F.col(f"{n}_{k}") for n, k in keys})


def _cutoffs(topk: int | Sequence[int]) -> list[int]:
    cutoffs = [topk] if isinstance(topk, int) else list(topk)
    if not cutoffs or any(not isinstance(k, int) or isinstance(k, bool) or k <= 0 for k in cutoffs):
        raise ValueError(f"topk must be a positive whole number or a list of them, not {topk!r}")
    return cutoffs


def evaluate(
    inputs: Mapping[str, DataFrame | int | float | None],
    metrics: Sequence[str],
    topk: int | Sequence[int],
    decimals: int | None = None,
) -> DataFrame:
    """Values of the named metrics as ``(metric, k, value)``; names are case-insensitive."""
    cutoffs = _cutoffs(topk)
    names = [m.lower() for m in metrics]
    unknown = [n for n in names if n not in _REGISTRY]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; registered are {sorted(_REGISTRY)}")
    kinds = {_REGISTRY[n].kind for n in names}
    if len(kinds) != 1:
        raise ValueError("ranking metrics and value metrics cannot be evaluated together")
    missing = sorted({need for n in names for need in _REGISTRY[n].needs if need not in inputs})
    if missing:
        raise ValueError(f"the metrics need the inputs {missing}")
    shared = [n for n in names if _REGISTRY[n].per_user]
    frames = [_per_user_means(inputs["hits"], shared, cutoffs)] if shared else []
    frames += [_REGISTRY[n].fn(inputs, cutoffs) for n in names if not _REGISTRY[n].per_user]
    result = reduce(DataFrame.unionByName, [f.select(*METRIC_SCHEMA) for f in frames])
    return result if decimals is None else result.withColumn("value", F.round("value", decimals))
