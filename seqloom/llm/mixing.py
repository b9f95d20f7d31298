"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import hash_bits
from seqloom.functions.hashing import HEX_DIGITS
from seqloom.llm.words import free_names, word_count
from seqloom.operators.ordering import running_totals
from seqloom.session import materialize

MAX_COPIES = 3
LAST_ROWS = 1_000  # of a source, after the first that is too large for what is missing


def source_targets(
    sizes: DataFrame, weights: Sequence[float], max_copies: int = MAX_COPIES, total: int | None = None
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from the rows (``source``, ``source_size``).

    Sources in the order of their code points, null last, get the weights in turn and share
    ``total`` (default: all sizes) in proportion. No target passes ``max_copies`` times the source's
    size; the excess goes to the others by weight. The shares then are ``level * weight``, where the
    sources that stop at their bound are those of the least bound for their weight, so one running
    sum finds the level. The table has one row for each source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    rows = rows.withColumns(
        {"bound": F.col("source_size") * float(max_copies), "budget": _total(everything, total, max_copies)}
    )
    ratio = F.col("bound") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "level": (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
            / F.sum("weight").over(onward),
            "ratio": ratio,
        }
    )
    # The first source whose bound is above its share sets the level for itself and all later ones.
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("bound"), F.coalesce(open_level * F.col("weight"), F.col("bound")))
    return rows.select("source", "source_size", target.alias("target"))


def _total(everything, total: int | None, max_copies: int) -> Column:
    if total is None:
        return F.sum("source_size").over(everything).cast("double")
    return F.least(F.lit(float(total)), F.sum("source_size").over(everything).cast("double") * max_copies)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float],
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = 11,
    max_copies: int = MAX_COPIES,
    total: int | None = None,
) -> DataFrame:
    """Every document's id, source, ``size`` (words), ``source_size``, ``target``, ``copies``
    and the random number ``u``.

    A document of a source with target t and size s is wanted t / s times. The whole part is
    allocated for certain; what is left of the target is a sample without replacement in Pareto
    order: documents rank by ``(u / (1 - u)) / (f / (1 - f))`` with a random u and the fraction f as
    inclusion probability, and the first that fill the rest are taken. The document at the edge is
    taken if that brings the source nearer to its target, so a source misses it by half a document
    at most.

    The random number comes from the seed, the id and the text, so reruns agree, whatever the
    partitions. Documents without words have no copies beyond the whole part. Null ids, texts and
    sources are kept (null source: a source of its own, last; null text: no words). Repeated rows
    have the same rank and follow one another in any order. An empty table gives an empty table. Other
    columns are not read.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    u = _draw(F.col("doc_id"), F.col("text"), seed)
    sized = read.select("doc_id", "source", word_count(F.col("text")).alias("size"), u.alias("u"))
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, max_copies, total), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    wanted = F.col("target") / F.col("source_size")
    shares = sized.join(targets, same).drop(targets["source"]).withColumn("whole", F.floor(wanted))
    shares = shares.withColumn("fraction", F.when(F.col("source_size") > 0, wanted - F.col("whole")).otherwise(0.0))
    shares = shares.withColumn("whole", F.when(F.col("source_size") > 0, F.col("whole")).otherwise(0))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("fraction") / (1 - F.col("fraction")))
    drawn = shares.withColumn("rank", F.when(F.col("fraction") > 0, odds).otherwise(F.lit(float("inf"))))
    drawn = drawn.withColumn("one", F.lit(1).cast("long"))
    summed = running_totals(drawn, ["source", "rank", "doc_id", "u", "row"], {"end": "size", "nth": "one"})
    summed = materialize(summed, "ranked-sizes")
    starts = summed.groupBy("source").agg(F.min(F.col("end") - F.col("size")).alias("base"), F.min("nth").alias("first"))
    starts = materialize(starts, "starts").withColumnRenamed("source", "of")
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    sampled = F.col("fraction") > 0
    placed = placed.withColumns(
        {"taken": F.col("end") - F.col("base"), "nth": F.col("nth") - F.col("first"), "missing": rest}
    ).withColumn("fits", sampled & (F.col("taken") <= F.col("missing")))
    edges = placed.filter(sampled).groupBy("source").agg(
        (F.max("missing") - F.coalesce(F.max(F.when(F.col("fits"), F.col("taken"))), F.lit(0))).alias("gap"),
        F.sum(F.col("fits").cast("long")).alias("n_fits"),
    )
    edges = materialize(edges, "edges").withColumnRenamed("source", "of")
    last = placed.filter(sampled & ~F.col("fits") & (F.col("size") > 0))
    last = last.join(edges, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("nth") < F.col("n_fits") + LAST_ROWS)
    filled = last.select("source", "nth", "row", "size", "gap").groupBy("source").applyInPandas(_fill, "row long")
    filled = materialize(filled, "last-rows").withColumnRenamed("row", "filled")
    placed = placed.join(filled, F.col("row") == F.col("filled"), "left")
    extra = F.col("fits") | F.col("filled").isNotNull()
    copies = (F.col("whole") + extra.cast("long")).cast("int")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "u")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows after the edge, in order, that still fit into the gap; then the one of the others that
    brings it nearest to zero, if any does."""
    rows, gap, chosen = rows.sort_values("nth"), float(rows["gap"].iloc[0]), []
    for row, size in zip(rows["row"], rows["size"]):
        if size <= gap:
            chosen.append(row)
            gap -= size
    others = rows[~rows["row"].isin(chosen)]
    off = (others["size"] - gap).abs()
    if len(others) and off.min() < gap:
        chosen.append(others["row"].loc[off.idxmin()])
    return pd.DataFrame({"row": pd.Series(chosen, dtype="int64")})


def repeat_copies(docs: DataFrame, mixed: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 11) -> DataFrame:
    """The documents as often as the ``copies`` of ``mix_sources`` say, with the seed given there.

    Rows alike in id and text stand for one another: one of them is repeated as often as all are wanted.
    """
    own, of, copies, nth, u = free_names(docs.columns, "__id", "__of", "__copies", "__n", "__u")
    counts = mixed.groupBy("doc_id", "u").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    counts = counts.select(F.col("doc_id").alias(own), F.col("u").alias(of), F.col("copies").alias(copies))
    drawn = docs.withColumn(u, _draw(F.col(doc_id), F.col(text), seed)).dropDuplicates([doc_id, u])
    joined = drawn.join(counts, drawn[doc_id].eqNullSafe(F.col(own)) & (F.col(u) == F.col(of)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """52 random bits as a number between 0 and 1; half a bit is added so that it is neither."""
    bits = hash_bits(seed, F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (bits + 0.5) / float(16**HEX_DIGITS)
