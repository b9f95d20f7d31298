"""Line dedup: later copies of runs of lines are deleted, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import SPACES, mixed
from seqloom.session import materialize

MIN_LINES = 2
LONG_LINE = (10, 60)  # words or characters from which a line can be a run of its own
# Documents that lose lines, which are sent to all tasks at most, some 30 MB; more are joined by id.
BROADCAST_DOCS, BROADCAST_RUNS = 200_000, 1_000_000
_ROWS = 4096  # of a batch that leaves a task, about


def _stripped(text: str) -> list[str]:
    return [line.strip(SPACES) for line in text.split("\n")]


def _is_long(line: str, long_line: tuple[int, int]) -> bool:
    words, chars = long_line
    return len(line) >= chars or (len(line) >= 2 * words - 1 and len(line.encode().split()) >= words)


def _selected(hashes: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: for each window of ``width`` lines the place of its least hash, of equal ones the last."""
    back = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.arange(len(back)) + width - 1 - back.argmin(axis=1)


def _fingerprints(min_lines: int, long_line: tuple[int, int] | None):
    """The lines that winnowing selects, one row each: the line's hash ``print``, its place ``at``, the hashes of the
    lines around it that its windows reach (``around``, of which the first lies at ``low``), and where the
    windows begin (``starts``) of which it is the least. A long line is a window of its own."""
    names = ["print", "doc_id", "key", "at", "low", "around", "starts", "size"]
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "key", "text"))):
                lines = [x for x in _stripped(text) if x]
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
                signed = hashes.view(np.int64).tolist()
                if long_line is not None:
                    rows += [(signed[i], doc, key, i, i, [signed[i]], [i], 1) for i, x in enumerate(lines) if _is_long(x, long_line)]
                if len(lines) < min_lines:
                    continue
                chosen = _selected(mixed(hashes), min_lines)
                cuts = np.flatnonzero(np.diff(chosen)) + 1  # windows that share their least line lie together
                for starts in np.split(np.arange(len(chosen)), cuts):
                    first, last, at = int(starts[0]), int(starts[-1]), int(chosen[starts[0]])
                    rows.append((signed[at], doc, key, at, first, signed[first : last + min_lines], starts.tolist(), min_lines))
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return find


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line: tuple[int, int] | None = None) -> DataFrame:
    """Per (``doc_id``, ``key``) the runs that also stand earlier: their places ``at``, among the lines
    that are not blank, and their numbers of lines ``size``."""
    schema = "print long, doc_id long, key long, at long, low long, around array<long>, starts array<long>, size long"
    read = docs.filter("doc_id is not null and text is not null")
    selected = materialize(read.mapInArrow(_fingerprints(min_lines, long_line), schema), "fingerprints")
    prints = selected.groupBy("size", "print").agg(F.count(F.lit(1)).alias("times"))
    prints = materialize(prints.filter("times > 1").drop("times"), "prints")
    # From a fingerprint that stands elsewhere, too, its windows reach to both sides: these lines must agree.
    met = selected.join(prints, ["size", "print"]).select("size", "doc_id", "key", "low", "around", F.explode("starts").alias("at"))
    window = F.slice("around", (F.col("at") - F.col("low") + 1).cast("int"), F.col("size").cast("int"))
    met = materialize(met.select("size", "doc_id", "key", "at", window.alias("window")), "met")
    place = F.struct("doc_id", "key", "at")
    firsts = met.groupBy("size", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = materialize(firsts.filter("times > 1").drop("times"), "first-runs")
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    apart = F.col("first.at") + F.col("size") <= F.col("at")
    earlier = F.when(same, apart).otherwise(F.struct("first.doc_id", "first.key") < F.struct("doc_id", "key"))
    later = met.join(firsts, ["size", "window"]).filter(earlier)
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("at"))


def _cut():
    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(text: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for body, starts in zip(text, at):
            if body is None:
                rows.append((None, 0, 0))
                continue
            lines = body.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip(SPACES)]
            gone = {full[s["at"] + k] for s in (() if starts is None else starts) for k in range(s["size"])}
            kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else body
            rows.append((kept, len(full), len(gone)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    return cut.asNondeterministic()  # so that a filter on the result doesn't run it again


def line_dedup(
    docs: DataFrame,
    min_lines: int = MIN_LINES,
    text: str = "text",
    doc_id: str = "doc_id",
    long_line: tuple[int, int] | None = None,
) -> DataFrame:
    """The documents with their later repeated runs of lines deleted, ``n_lines`` and ``n_removed``.

    Lines end at a line feed and are compared without surrounding white space. Blank lines stay and
    don't count. A run is ``min_lines`` or more lines in a row; it is deleted where the same run stands
    in an earlier document (smaller id; equal ids by a hash of the text) or earlier in the same one
    without overlap. With ``long_line`` (words, characters) a single line of at least so many words or
    characters is a run, too; shorter lines that repeat alone stay.

    Winnowing: of every ``min_lines`` lines in a row the least line hash is selected, one row where the least
    one changes, with the hashes of the lines around it. Equal runs select equal lines, so a run whose
    selected line occurs nowhere else has no copy. The other selected lines are extended to both sides:
    each window around them is compared by the hashes of all its lines (64 bits each) with its
    first place, and longer runs are the union of such windows. A run with many copies costs one row
    for each. Texts stay where they are while the runs to
    delete fit BROADCAST_RUNS.

    Null texts stay null, empty texts empty. Rows without an id stay as they are and delete nothing.
    Rows that are alike in id and text are treated alike. All columns pass through; columns named
    ``n_lines`` or ``n_removed`` are replaced. Ids are whole numbers. An empty table stays empty.
    """
    key = F.xxhash64(F.col(text))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    found = materialize(repeated_runs(read, min_lines, long_line), "later-runs")
    found = found.select("doc_id", "key", F.col("at").alias("runs"))
    size = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs")).first()
    few = size["docs"] <= BROADCAST_DOCS and size["runs"] <= BROADCAST_RUNS
    # One column holds the row, so that no name of the caller's meets one of these. Beyond the bounds all texts
    # are shuffled once, by id.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    joined = rows.join(F.broadcast(found) if few else found, ["doc_id", "key"], "left")
    joined = joined.withColumn("cut", _cut()("text", "runs"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    kept = [F.col("cut.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept]
    return joined.select(*kept, "cut.n_lines", "cut.n_removed")
