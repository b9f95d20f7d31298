"""Packing: texts to tokens, concatenated in one order and cut into windows of one length."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.session import drop_scratch, materialize, scratch_path

WINDOW = 1024
SEPARATOR = 0  # the id after each document
# Fixed value: how the byte-level tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces of text whose ids one task remembers; it starts anew beyond them.
REMEMBERED_PIECES = 1 << 19
_ROWS = 256  # of a batch that leaves a task
_ID = np.dtype("<u4")

_NEWLINE = re.compile(r"(?<=\S)\n(?=\S)")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Characters below this one are classified alike by both libraries.
_LATIN_END = "\u0250"


class _Pieces(dict):
    """Ids of pieces of text as bytes, each worked out once while it is remembered."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_PIECES:
            self.clear()
        value = self[piece] = array("I", self.encode(self.lead + piece)).tobytes()
        return value


class Encoder:
    """Ids of a byte-level BPE tokenizer, word by word.

    Such a tokenizer splits a text before it merges: a single space between two visible characters
    always begins a piece, and a single line feed between them is a piece of its own. The pieces
    between those places are encoded one by one and remembered, which gives the same ids as the
    whole text. Pieces of Latin script without special tokens may go to ``ranks``, the same
    vocabulary for a faster library; all others go to the tokenizer itself.
    """

    def __init__(self, tokenizer_json: str, ranks: str | None = None):
        tokenizer = Tokenizer.from_str(tokenizer_json)
        special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
        exact = lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids
        encode = exact
        if ranks is not None:
            pairs = (line.split() for line in ranks.splitlines())
            vocabulary = {base64.b64decode(token): int(rank) for token, rank in pairs}
            fast = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})

            def encode(piece: str) -> list[int]:
                odd = max(piece) >= _LATIN_END or any(t in piece for t in special)
                return exact(piece) if odd else fast.encode_ordinary(piece)

        self.first, self.later = _Pieces(encode, ""), _Pieces(encode, " ")

    def ids(self, text: str | None) -> bytes:
        """The ids, little-endian in four bytes each, without the separator."""
        if not text:
            return b""
        out = []
        lines = text.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            lines = _NEWLINE.split(text)
        for n, line in enumerate(lines):
            if n:
                out.append(self.first["\n"])
            words = line.split(" ")
            if words != line.split():
                words = _SPACE.split(line)
            out.append(self.first[words[0]])
            out.extend(map(self.later.__getitem__, words[1:]))
        return b"".join(out)


def tokenize(docs: DataFrame, tokenizer_json: str, ranks: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ids`` (binary, the separator last), ``n_tokens``, ``part`` (the task's number) and
    ``before`` (tokens before the document in that task)."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, ranks))
    kind = dict(read.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(*shared.value), TaskContext.get().partitionId(), 0
        end = np.array([SEPARATOR], _ID).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [encoder.ids(t) + end for t in batch.column("text").to_pylist()]
                counts = [len(x) // _ID.itemsize for x in ids]
                starts = list(accumulate(counts, initial=before))
                before = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(ids, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(starts, pa.int64()),
                    ],
                    ["doc_id", "ids", "n_tokens", "part", "before"],
                )

    return read.mapInArrow(encode, f"doc_id {kind}, ids binary, n_tokens long, part int, before long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    window: int = WINDOW,
    pad_id: int = SEPARATOR,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Sequences of ``window`` tokens: ``sequence_id`` (from 0), ``n_tokens``, ``ids`` (binary,
    little-endian in four bytes) and ``pieces`` (``doc_id``, ``start``, ``length``, ``doc_tokens``,
    ``offset``) in order of their offset.

    ``tokenizer_path`` is the JSON file of a byte-level BPE tokenizer, ``ranks_path`` the same vocabulary
    as ranks, if there is one. Both are read here and sent with the job.

    Documents follow one another in the order in which they are read. The first pass writes their
    tokens with the running total in the task. The totals of the tasks, one row each, give every
    document its global place, and the second pass cuts at the multiples of the window. Windows that
    lie in one task are whole; the others come as boundary records of a window at most and are put
    together by their number. Only the last sequence is short; it is padded to the window unless its
    length is a power of two, and ``n_tokens`` has the length without padding.

    A null or empty text is the separator alone. Null ids, repeated rows and very long texts are
    packed like any other row. An empty table has no sequences. Other columns are not read.
    """
    spark = docs.sparkSession
    tokens_at = scratch_path(spark, "tokens")
    ranks = Path(ranks_path).read_text() if ranks_path else None
    tokenize(docs, Path(tokenizer_path).read_text(), ranks, text, doc_id).write.parquet(tokens_at)
    tokens = spark.read.parquet(tokens_at)
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases = list(accumulate((n for _, n in totals), initial=0))
    rows = [(part, base) for (part, _), base in zip(totals, bases)]
    # One row for each task of the first pass.
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    placed = tokens.join(offsets, "part").select(
        "doc_id", "ids", "n_tokens", (F.col("base") + F.col("before")).alias("place")
    )
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    piece = f"struct<doc_id:{kind},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"
    schema = f"sequence_id long, offset long, whole boolean, ids binary, pieces array<{piece}>"
    cut = materialize(placed.mapInArrow(_cutter(window, schema_of(docs, doc_id)), schema), "windows")
    drop_scratch(spark, tokens_at)
    inner = cut.filter("whole").select("sequence_id", "ids", "pieces")
    edge = cut.filter("not whole").groupBy("sequence_id")
    edge = edge.agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("parts"))
    edge = edge.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("pieces"),
    )
    n = (F.octet_length("ids") / _ID.itemsize).cast("long")
    pad = F.lit(np.array([pad_id], _ID).tobytes())
    full = n.bitwiseAND(n - 1) == 0
    missing = F.array_repeat(pad, F.greatest(F.lit(window) - n, F.lit(0)).cast("int"))
    padded = F.when(full, F.col("ids")).otherwise(F.concat("ids", F.aggregate(missing, F.lit(b""), lambda a, x: F.concat(a, x))))
    both = inner.unionByName(edge)
    return both.select("sequence_id", n.alias("n_tokens"), padded.alias("ids"), "pieces")


def schema_of(docs: DataFrame, doc_id: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.select(doc_id).schema[0].dataType)


def _cutter(window: int, id_type: pa.DataType):
    fields = [("doc_id", id_type), *[(n, pa.int64()) for n in ("start", "length", "doc_tokens", "offset")]]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.struct(fields)))
    names = ["sequence_id", "offset", "whole", "ids", "pieces"]
    size = _ID.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        begin = end = 0  # the run of tokens held back: its places, its ids, its pieces
        held: list[bytes] = []
        pieces: list[dict] = []

        def flush() -> None:
            nonlocal begin, held, pieces
            if held:
                done.append((begin // window, begin % window, end - begin == window, b"".join(held), pieces))
            begin, held, pieces = end, [], []

        def ready() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", "ids", "n_tokens", "place")]
            for at in range(batch.num_rows):
                name, ids, n, place = (c[at].as_py() for c in columns)
                if place != end:
                    flush()
                    begin = end = place
                start = 0
                while start < n:
                    length = min(n - start, window - end % window)
                    pieces.append(
                        {"doc_id": name, "start": start, "length": length, "doc_tokens": n, "offset": end % window}
                    )
                    held.append(ids[start * size : (start + length) * size])
                    start, end = start + length, end + length
                    if end % window == 0:
                        flush()
                if len(done) >= _ROWS:
                    yield ready()
        flush()
        yield ready()

    return cut


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece with the CRC-32 of its ids in the sequence."""
    pieces = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    part = F.substr("ids", (F.col("p.offset") * _ID.itemsize + 1).cast("int"), (F.col("p.length") * _ID.itemsize).cast("int"))
    return pieces.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
