"""Content-addressed WARC archive: payloads once by digest, exact record headers beside them."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.arrays import let
from seqloom.session import materialize, scratch_path

# Fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
END = CRLF + CRLF
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b"

# Characters of text in one archive file, about: a reader takes a file as a whole.
FILE_CHARS = 16 << 20
# Numbers of rows that are sent to all tasks at most, 8 MB.
BROADCAST_ROWS = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits are eight times 20."""

    def letters(part: Column) -> Column:
        return F.concat(
            *[
                F.substring(F.lit(BASE32), (F.floor(part / 32**k) % 32 + 1).cast("int"), F.lit(1))
                for k in (3, 2, 1, 0)
            ]
        )

    def spelled(digest: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda g: let(F.conv(F.substr(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("long"), letters),
        )
        return F.array_join(groups, "")

    return let(F.sha1(payload), spelled)


def _numbered(pages: DataFrame) -> DataFrame:
    """The rows with a number that is the same in every reading of an unchanged table."""
    payload = F.coalesce(F.col("html"), F.lit("")).alias("payload")
    return pages.select("page_id", "url", payload).withColumn("row", F.monotonically_increasing_id())


def make_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One record for each row of (``page_id``, ``url``, ``html``) without its payload: ``row``, ``digest`` (SHA-256
    of the payload), ``header`` (exact text), ``refers_to``, ``payload_bytes`` and ``stored`` (true for one
    row of each payload).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest page id
    is the response and the others revisit it. A null payload is empty, a null url is left out of
    the header. Rows without an id can't be referred to and are responses, as are repeated rows of
    the largest id. Other columns are not read; an empty table has no records. ``pages`` must be a
    table whose rows come alike each time it is read, as files do.
    """
    read = _numbered(pages)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")  # a header value stays on its line
    raw = F.encode("payload", "UTF-8")
    read = read.select(
        "row",
        "page_id",
        url.alias("url"),
        F.sha2(raw, 256).alias("digest"),
        base32_sha1(raw).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    read = materialize(read, "warc-pages")
    # The first row and the last page of each payload, written, so that one with many pages can be split.
    eligible = F.when(F.col("payload_bytes") >= min_bytes, F.col("page_id"))
    known = read.groupBy("digest").agg(F.min("row").alias("first_row"), F.max(eligible).alias("last_page"))
    joined = read.join(materialize(known, "warc-digests"), "digest")
    refers = F.when(F.col("last_page") != eligible, F.col("last_page"))
    joined = joined.withColumn("refers_to", refers).withColumn("header", _header())
    stored = (F.col("row") == F.col("first_row")).alias("stored")
    return materialize(joined.select("row", "digest", "header", "refers_to", "payload_bytes", stored), "warc-records")


def _header() -> Column:
    """The exact header block, without the empty line that ends it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    page = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(page(F.col("page_id")), F.concat(F.lit("<urn:row:"), "row", F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", F.when(F.col("url") != "", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", page(F.col("refers_to")))),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
    )


def store(pages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive: ``payloads`` (digest, payload), each content once, and ``headers`` (exact header
    text, digest of the payload, ``full`` where the payload belongs to the record).

    ``records`` are those of ``pages`` (:func:`make_records`). Payloads go straight from the pages to
    the archive: where few rows are copies their numbers are sent to all tasks, else both sides are joined by number.
    Numbers that don't fit the pages stop the job.
    """
    copies = records.filter("not stored").select("row")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = _numbered(pages).select("row", "payload").join(F.broadcast(copies) if few else copies, "row", "left_anti")
    path = scratch_path(pages.sparkSession, "warc-payloads")
    digest = F.sha2(F.encode("payload", "UTF-8"), 256).alias("digest")
    kept.select(digest, "payload").write.option("compression", "zstd").parquet(path)
    payloads = pages.sparkSession.read.schema("digest string, payload string").parquet(path)
    found = payloads.select("digest").distinct().count(), payloads.count()
    if found != (n := records.filter("stored").count(), n):
        raise ValueError("the pages have changed since their records were made")
    return payloads, records.select("digest", "header", F.col("refers_to").isNull().alias("full"))


def reconstruct(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The original records as text: header, empty line, payload (none for a revisit).

    A payload that doesn't have the digest it is stored under stops the job. Empty tables give none.
    """
    wrong = F.sha2(F.encode("payload", "UTF-8"), 256) != F.col("digest")
    checked = payloads.select(
        "digest", F.when(wrong, F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).otherwise(F.col("payload")).alias("payload")
    )
    whole = headers.filter("full").join(checked, "digest").select(F.concat("header", F.lit(CRLF), "payload").alias("record"))
    return whole.unionByName(headers.filter("not full").select(F.concat("header", F.lit(CRLF)).alias("record")))


def write_archives(records: DataFrame, path: str, mean_chars: float) -> None:
    """Records as WARC files, each compressed as a whole, of FILE_CHARS characters on average at most.

    Records are written where they are, without a shuffle.
    """
    each = max(1, int(FILE_CHARS / max(1.0, mean_chars)))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files under ``path``, compressed or not: its header fields, and length and
    digests of the payload it carries, worked out anew from the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, "record_id string, record_type string, refers_to string, stated string, bytes long, digest string")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_py()
            rows = list(_records(gzip.decompress(raw) if raw[:2] == GZIP else raw))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (*[pa.string()] * 4, pa.int64(), pa.string())
            names = ("record_id", "record_type", "refers_to", "stated", "bytes", "digest")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _records(raw: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(raw):
        stop = raw.index(END.encode(), at)
        version, *lines = raw[at:stop].decode().split(CRLF)
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = stop + len(END)
        at = start + int(fields["Content-Length"])
        payload = raw[start:at]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and stated != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        if raw[at : at + len(END)] != END.encode():
            raise ValueError(f"no end of record at byte {at}")
        at += len(END)
        yield fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), stated, len(payload), digest
