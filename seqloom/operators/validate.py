"""Input conforming and checks. Each check returns all its violations as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The expected first line of a file, the shortest history (two training, one
# validation and one test interaction), the largest metric cutoff, and an integer as text
# (blanks around it, a sign and single underscores between digits are accepted).
HEADER = "item_id,user_id,timestamp"
MIN_HISTORY = 4
MIN_ITEMS = 200
INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"

# Bytes of a file that are read at a time, the longest first line, and files of a task.
FIRST_BYTES, HEADER_BYTES, FILES_PER_TASK = 4096, 1 << 16, 200


def conform_columns(df: DataFrame, mapping: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping)).select(*order)


def add_constant_columns(df: DataFrame, constants: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, headers = batch.column("file").to_pylist(), []
        for name in names:
            store, path = FileSystem.from_uri(name)
            with store.open_input_stream(path) as stream:  # compressed files by their ending
                start = b""
                while len(start) < HEADER_BYTES and not re.search(rb"[\r\n]", start) and (more := stream.read(FIRST_BYTES)):
                    start += more
            headers.append(re.split(rb"\r\n|\r|\n", start[:HEADER_BYTES])[0].decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(headers, pa.string())], ["file", "header"])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``header``: the first line of every file, of which only the first bytes are read.

    Files are opened in tasks, FILES_PER_TASK each. A first line longer than HEADER_BYTES is cut there. Files in a
    store that only Spark can open are read as lines instead.
    """
    lines = spark.read.text(path)
    files = lines.inputFiles()  # the names, which the driver has listed anyway
    try:
        if files:
            FileSystem.from_uri(files[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _first_lines_read(lines)
    named = spark.createDataFrame([(f,) for f in files], "file string")
    tasks = -(-len(files) // FILES_PER_TASK) or 1
    return named.repartition(tasks).mapInArrow(_first_lines, "file string, header string")


def _first_lines_read(lines: DataFrame) -> DataFrame:
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    # The first line lies in the block at offset 0; the id rises with the lines inside a task.
    return placed.filter("block = 0").groupBy("file").agg(F.min_by("value", "line_no").alias("header"))


def check_headers(spark: SparkSession, path: str) -> DataFrame:
    """Files whose first line is not the expected header. A byte order mark is accepted."""
    seen = F.regexp_replace("header", r"^\uFEFF", "")
    return first_lines(spark, path).filter(seen != HEADER)


def _empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def invalid_rows(raw: DataFrame, columns: Sequence[str] = ("item_id", "user_id", "timestamp")) -> DataFrame:
    """Rows with an empty or missing field, or with a field too many."""
    bad = _empty(columns[0])
    for name in columns[1:]:
        bad = bad | _empty(name)
    if "extra" in raw.columns:
        bad = bad | F.col("extra").isNotNull()
    return raw.filter(bad)


def invalid_timestamps(raw: DataFrame, column: str = "timestamp") -> DataFrame:
    return raw.filter(~F.coalesce(F.col(column).rlike(INTEGER_TEXT), F.lit(False)))


def short_history_users(inter: DataFrame, min_n: int = MIN_HISTORY) -> DataFrame:
    return inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_n)


def catalog_too_small(inter: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """One row with the item count when it is below the largest cutoff, else none."""
    return inter.agg(F.countDistinct("item_id").alias("items")).filter(F.col("items") < min_items)


def interaction_summary(inter: DataFrame) -> DataFrame:
    return inter.agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("interactions"),
    )


def null_id_report(encoded: DataFrame) -> DataFrame:
    return encoded.agg(
        F.coalesce(F.bool_or(F.col("item_id").isNull()), F.lit(False)).alias("null_items"),
        F.coalesce(F.bool_or(F.col("user_id").isNull()), F.lit(False)).alias("null_users"),
        F.count_if(F.col("item_id").isNull() | F.col("user_id").isNull()).alias("rows"),
    )


def missing_item_text(inter: DataFrame, info: DataFrame) -> DataFrame:
    return inter.select("item_id").distinct().join(info, "item_id", "left_anti")


def check_interactions(inter: DataFrame, raw: DataFrame, min_n: int = MIN_HISTORY, min_items: int = MIN_ITEMS) -> DataFrame:
    """All violations of the row and data checks in one table ``(check, key, detail)``."""

    def rows(name: str, df: DataFrame, key: Column, detail: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
        )

    fields = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in ("item_id", "user_id", "timestamp")])
    empty = inter.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return (
        rows("empty field", invalid_rows(raw), fields, F.lit(None))
        .unionByName(rows("timestamp", invalid_timestamps(raw), fields, F.col("timestamp")))
        .unionByName(rows("short history", short_history_users(inter, min_n), F.col("user_id"), F.col("n")))
        .unionByName(rows("short history", empty, F.lit(None), F.col("n")))
        .unionByName(rows("few items", catalog_too_small(inter, min_items), F.lit(None), F.col("items")))
    )
