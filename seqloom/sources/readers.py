"""Readers for interaction logs, item catalogues and item text."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.ordering import group_positions
from seqloom.session import materialize

# The column layout of an interaction file, in this order.
INTERACTION_COLUMNS = ["item_id", "user_id", "timestamp"]
INTERACTION_SCHEMA = "item_id string, user_id string, timestamp long"



def _with_file_order(df: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("row_ord", place)


def read_interactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Interaction log. CSV columns are taken by position and the header names are ignored.

    Run :func:`seqloom.operators.validate.check_headers` first: a file with swapped columns is
    read without an error. A missing path raises. ``row_ord`` keeps the order of the files.
    """
    if fmt == "csv":
        df = spark.read.schema(INTERACTION_SCHEMA).csv(path, header=True, enforceSchema=True)
    else:
        df = spark.read.format(fmt).load(path)
    casts = [F.col("item_id").cast("string"), F.col("user_id").cast("string"), F.col("timestamp").cast("long")]
    return _with_file_order(df).select(*[c.alias(n) for c, n in zip(casts, INTERACTION_COLUMNS)], "row_ord")


def read_raw_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The same files as text fields, one row for each line but the header, for the row checks.

    A line that has not three fields stands whole in ``extra``; an empty one has no fields.
    """
    lines = _with_file_order(spark.read.text(path).select("value", "_metadata"))
    # The first line of a file lies in the block at offset 0; the row number rises with the lines inside a task.
    first = lines.filter("row_ord.block = 0").groupBy("row_ord.file").agg(F.min("row_ord.row").alias("header"))
    first = F.broadcast(first.withColumnRenamed("file", "header_file"))
    is_header = (F.col("row_ord.file") == F.col("header_file")) & (F.col("row_ord.row") == F.col("header"))
    lines = lines.join(first, is_header, "left_anti").select("value", "row_ord")
    schema = "item_id string, user_id string, timestamp string, extra string"
    fields = F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "extra"})
    return lines.withColumn("fields", fields).select(*[f"fields.{c}" for c in INTERACTION_COLUMNS], "fields.extra", "row_ord")


def with_row_numbers(raw: DataFrame) -> DataFrame:
    """Add ``row_no``, the row number in its file. The header is row 1, so data start at 2."""
    placed = group_positions(raw.withColumn("file", F.col("row_ord.file")), ["file"], ["row_ord"], "_at", "_n")
    return placed.withColumn("row_no", F.col("_at") + 2).drop("_at", "_n")


def read_item_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Item universe: a file in the interaction layout of which only the item id is used."""
    return read_interactions(spark, path, fmt).select("item_id", "row_ord")


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``row_ord`` of every record of the CSV files, headers included; a record may go over lines.

    Lines are read in parallel blocks. A line begins a record where the quotes before it in its file are
    even in number. One count for each block gives the parity at its start, a running count the parity
    of each line; then the lines of the records that have several are put together.
    """
    lines = _with_file_order(spark.read.text(path, lineSep="\n").select("value", "_metadata"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = ["row_ord.file", "row_ord.block"]
    blocks = lines.groupBy(*place).agg(F.sum(quotes).alias("quotes"))  # one row for each block of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2), "csv-blocks")
    rows = lines.select("value", "row_ord", *place, quotes.alias("quotes")).join(blocks.select("file", "block", "odd"), ["file", "block"])
    inside = Window.partitionBy("file", "block").orderBy("row_ord")
    earlier = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("begins", (earlier + F.col("odd")) % 2 == 0)
    # The line that begins a record; null for the lines of a block that go on with a record of an earlier one.
    begun = F.last(F.when(F.col("begins"), F.col("row_ord")), ignorenulls=True).over(inside)
    ends = (earlier + F.col("odd") + F.col("quotes")) % 2 == 0
    rows = rows.select("value", "row_ord", "file", "block", begun.alias("begun"), "begins", ends.alias("ends"))
    rows = materialize(rows, "csv-lines")
    last = rows.filter("begins").groupBy("file", "block").agg(F.max("row_ord").alias("last_begun"))
    so_far = F.last("last_begun", ignorenulls=True).over(before)
    every = blocks.select("file", "block").join(last, ["file", "block"], "left")
    carried = materialize(every.select("file", "block", so_far.alias("carried")), "csv-carried")
    alone = rows.filter("begins and ends").select("value", "row_ord")
    parts = rows.filter("not (begins and ends)").join(carried, ["file", "block"])
    parts = parts.groupBy(F.coalesce("begun", "carried").alias("row_ord"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct(F.col("row_ord").alias("at"), "value"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    records = alone.unionByName(parts.select(joined.alias("value"), "row_ord"))
    # A carriage return before the line feed that ends a record belongs to the line end.
    return records.withColumn("value", F.regexp_replace("value", "\\r$", "")).filter(F.col("value") != "")


def _read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Text columns by the names in the first file's header, and ``row_ord``."""
    records = _csv_records(spark, path)
    first = records.groupBy("row_ord.file").agg(F.min(F.struct("row_ord", "value")).alias("header"))
    first = materialize(first, "csv-headers")  # one row for each file
    head = first.orderBy("file").limit(1).select("header.value").first()
    if head is None:
        raise ValueError(f"no header in {path}")
    text = F.regexp_replace(F.lit(head[0]), "^\\uFEFF", "")
    count = len(next(csv.reader([head[0]])))
    wide = ", ".join(f"_{i} string" for i in range(count))
    options = {"escape": '"', "maxCharsPerColumn": "-1"}
    names = spark.range(1).select(F.from_csv(text, F.lit(wide), options).alias("r")).select("r.*").first()
    places = first.select(F.col("header.row_ord").alias("header"))
    data = records.join(F.broadcast(places), F.col("row_ord") == F.col("header"), "left_anti")
    read = data.select(F.from_csv("value", F.lit(wide), options).alias("r"), "row_ord")
    return read.select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)], "row_ord")


def read_item_info(spark: SparkSession, path: str, text_keys: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Item text by column name; of a repeated item id the last row is kept.

    CSV fields may hold line ends and doubled quotes, and one file is read by many tasks: a field that
    holds a quote must be quoted, as the writers here do. All files have the header of the first.
    """
    if fmt == "csv":
        df = _read_csv_text(spark, path)
    else:
        df = _with_file_order(spark.read.format(fmt).load(path))
    return last_row_per_item(df.select(F.col("item_id").cast("string"), *text_keys, "row_ord"), text_keys)


def last_row_per_item(df: DataFrame, text_keys: Sequence[str], row_ord: str = "row_ord") -> DataFrame:
    last = F.max_by(F.struct(*text_keys), row_ord).alias("_last")
    return df.groupBy("item_id").agg(last).select("item_id", *[f"_last.{k}" for k in text_keys])
