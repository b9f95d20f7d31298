"""Resampling towards a target distribution: word features hashed by a vectorised CRC-32.

CRC-32 is linear over bits. The checksum of a word is the exclusive or of what each byte adds at its
distance from the end, taken from one table, and of a constant of the word's length. So all words of a
block of texts are hashed by one gather and one ``bitwise_xor.reduceat``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import global_rank
from seqloom.session import drop_scratch, materialize, scratch_path

POLYNOMIAL = np.uint32(0xEDB88320)  # fixed value of CRC-32, bits reversed
ONES = np.uint32(0xFFFFFFFF)
DEPTH = 32  # distances from the end that the table has; longer words are folded in blocks of so many bytes
BLOCK_BYTES = 1 << 20  # of words hashed at once
SLICE_BYTES = 8 << 20  # of texts looked at at once, if one text isn't longer
BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
LOG_STEPS = 1000  # gains and scores are whole thousandths of natural logarithms

# Bytes of words: digits, letters, and all of characters beyond ASCII. A-Z count as a-z.
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWERED = np.where(_UPPER, _CODES + 32, _CODES)
_OF_WORD = ((_LOWERED >= 48) & (_LOWERED <= 57)) | ((_LOWERED >= 97) & (_LOWERED <= 122)) | (_CODES >= 128)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ POLYNOMIAL, table >> 1).astype(np.uint32)
    return table


class WordHasher:
    """CRC-32 of the lower-cased words of UTF-8 texts."""

    def __init__(self, depth: int = DEPTH):
        self.depth, step = depth, _byte_table()
        on = lambda v: (v >> np.uint32(8)) ^ step[v & np.uint32(255)]  # one zero byte further
        rows = [step[_LOWERED]]
        for _ in range(depth - 1):
            rows.append(on(rows[-1]))
        self.table = np.where(_OF_WORD, np.stack(rows), 0).astype(np.uint32).ravel()
        states = [ONES]
        for _ in range(depth):
            states.append(on(states[-1]))
        self.start = np.array(states, np.uint32)  # what the starting state has become after so many bytes
        lanes = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
        for _ in range(depth):
            lanes = on(lanes)
        self.moves = [lanes]  # entry k: each byte of a state moved on by depth * 2**k zero bytes

    def _moved(self, states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """States after ``blocks`` times ``depth`` zero bytes, bit by bit of that number."""
        states = states.copy()
        for k in range(int(blocks.max(initial=0)).bit_length()):
            if k == len(self.moves):
                self.moves.append(self._step(self.moves[-1], self.moves[-1]))
            at = np.flatnonzero(blocks >> k & 1)
            states[at] = self._step(self.moves[k], states[at])
        return states

    @staticmethod
    def _step(lanes: np.ndarray, v: np.ndarray) -> np.ndarray:
        byte = lambda j: (v >> np.uint32(8 * j)) & np.uint32(255)
        return lanes[0][byte(0)] ^ lanes[1][byte(1)] ^ lanes[2][byte(2)] ^ lanes[3][byte(3)]

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words start and end; no word goes over the bounds of a text."""
        inside = _OF_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, at = np.empty(len(starts), np.uint32), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
            out[at:to] = self._block(data, starts[at:to], ends[at:to])
            at = to
        return out

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        long = lengths > self.depth
        low, high = starts[0], ends[-1]
        gaps = np.diff(starts, append=high)
        # Bytes between words have no entry but zero; of long words what is found here is replaced.
        distance = np.repeat(ends - 1, gaps) - np.arange(low, high)
        np.clip(distance, 0, self.depth - 1, out=distance)
        added = self.table[(distance << 8) | data[low:high]]
        out = np.bitwise_xor.reduceat(added, starts - low) ^ self.start[np.where(long, 0, lengths)] ^ ONES
        if long.any():
            out[long] = self._long(data, starts[long], ends[long])
        return out

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Long words: the bytes of each block, counted from the end, are folded first, then the blocks."""
        lengths, depth = ends - starts, self.depth
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum())
        back = np.repeat(first + lengths - 1, lengths) - place  # distance from the end
        added = self.table[(back % depth << 8) | data[np.repeat(starts - first, lengths) + place]]
        begins = np.flatnonzero(np.r_[True, back[:-1] // depth != back[1:] // depth] | np.isin(place, first))
        blocks = self._moved(np.bitwise_xor.reduceat(added, begins), back[begins] // depth)
        whole = np.bitwise_xor.reduceat(blocks, np.searchsorted(begins, first))
        return whole ^ self._moved(self.start[lengths % depth], lengths // depth) ^ ONES


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The bytes of texts in slices of bounded size: number of texts, bytes, bounds. Nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield to - at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def _bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def word_buckets(docs: DataFrame, buckets: int = BUCKETS, text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """``doc_id`` (if there is one), ``n_features`` and ``buckets``, one number for each word in its order
    (binary, little-endian, two bytes each up to 65,536 buckets, else four)."""
    named = [] if doc_id is None else [F.col(doc_id).alias("doc_id")]
    read = docs.select(*named, F.col(text).alias("text"))
    kept = [f"doc_id {kind}" for name, kind in read.dtypes if name == "doc_id"]
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            at = 0
            for n, data, bounds in _slices(batch.column("text")):
                starts, ends = hasher.spans(data, bounds)
                found = (hasher.hashes(data, starts, ends) % np.uint32(buckets)).astype(kind)
                cuts = np.searchsorted(starts, bounds)
                raw, each = found.tobytes(), kind.itemsize
                lists = [raw[a * each : b * each] for a, b in zip(cuts[:-1], cuts[1:])]
                ids = [batch.column("doc_id").slice(at, n)] if kept else []
                columns = [*ids, pa.array(np.diff(cuts), pa.int64()), pa.array(lists, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*["doc_id"] * len(kept), "n_features", "buckets"])
                at += n

    return read.mapInArrow(run, ", ".join([*kept, "n_features long", "buckets binary"]))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: features of all rows, summed in each task before they are shuffled."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for list_ in batch.column("buckets"):
                total += np.bincount(np.frombuffer(list_.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``gain`` of every bucket: how much likelier it is in ``target`` than in ``source``, both
    (``bucket``, ``n``), in thousandths of a natural logarithm, rounded down. One is added to each count."""
    total = lambda counts: counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_source, in_target = (F.lit(float(total(c) + buckets)) for c in (source, target))
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    met = every.join(source.withColumnRenamed("n", "s"), "bucket", "left")
    met = met.join(target.withColumnRenamed("n", "t"), "bucket", "left")
    more = lambda c: (F.coalesce(c, F.lit(0)) + 1).cast("double")
    odds = (more("t") * in_source) / (more("s") * in_target)
    return met.select("bucket", F.floor(F.lit(float(LOG_STEPS)) * F.ln(odds)).alias("gain"))


def weights(features: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``features`` with ``weight``, the sum of the gains of a row's features, in place of the buckets.

    The gains go to all tasks: ``buckets`` numbers, whatever the input.
    """
    dense = np.zeros(buckets, np.int64)
    for r in gains.collect():
        dense[r["bucket"]] = r["gain"]
    shared, kind = features.sparkSession.sparkContext.broadcast(dense), _bucket_type(buckets)
    kept = [c for c in features.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column("buckets")]
            arrays = [*[batch.column(c) for c in kept], pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "weight"])

    fields = ", ".join(f"{n} {t}" for n, t in features.select(*kept).dtypes)
    return features.mapInArrow(run, f"{fields}, weight long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1, null if not
    drawn).

    A feature is a word: a run of digits, letters and characters beyond ASCII, A-Z lower-cased, repeats
    counted. Its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. The weight is the sum of the
    bucket gains (:func:`bucket_gains`, all ``docs`` against all ``target`` texts). The score adds noise
    to it that depends on ``seed`` and id only, so that the highest scores are a draw without
    replacement in proportion to the exponential of the weights. Of the documents of ``min_words``
    words or more, ``percent`` percent are drawn, rounded down, highest score first.

    A null or empty text has no features and weight 0. Ties go to the smaller id, equal ids to fewer
    features. A null id counts as an empty name and comes last among ties. Repeated rows are ranked
    one by one. Other columns are not read. An empty table gives an empty one; an empty target leaves
    the sizes of the sources to decide.

    Texts are read once: their buckets are written, two bytes a word, then counted, then weighed.
    """
    spark = docs.sparkSession
    features_at = scratch_path(spark, "word-buckets")
    word_buckets(docs, buckets, text, doc_id).write.parquet(features_at)
    features = spark.read.parquet(features_at)
    source = materialize(bucket_counts(features, buckets), "source-counts")
    wanted = materialize(bucket_counts(word_buckets(target, buckets, text, None), buckets), "target-counts")
    weighed = weights(features, bucket_gains(source, wanted, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chance = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-float(LOG_STEPS)) * F.ln(-F.ln(chance)))
    weighed = weighed.withColumns({"score": F.col("weight") + noise, "_short": F.col("n_features") < min_words})
    scored = materialize(weighed.withColumn("_down", -F.col("score")), "scores")
    drop_scratch(spark, features_at)
    draws = percent * scored.filter("not _short").count() // 100
    placed = global_rank(scored, ["_short", "_down", F.col("doc_id").asc_nulls_last(), "n_features"], "_place")
    rank = F.when(F.col("_place") < draws, F.col("_place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
