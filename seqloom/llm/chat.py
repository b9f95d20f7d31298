"""Chat formatting from an event log: fold the events, render the messages, read them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks, and the control strings of common templates.
START, STOP = "<|im_start|>", "<|im_end|>"
CONTROL = (START, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
LEARNED_ROLE = "assistant"
# Events that begin a message anew; everything that came after it before then is void.
RESETS = ("start", "edit", "regenerate")

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_OPENS = "([" + "".join(sorted({re.escape(c[0]) for c in CONTROL})) + f"])(?={_TAILS})"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """A backslash breaks every control string after its first character; backslashes double."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _OPENS, r"$1\\")


def unescape(text: str) -> str:
    known = {"\\": "\\", "n": "\n"}
    return _ESCAPED.sub(lambda m: known.get(m[1], m[1]), text)


def message_events(rows: DataFrame, delta_chars: int = 512) -> DataFrame:
    """Finished rows (``conv_id``, ``turn``, ``role``, ``text``) as the log of a stream: each message
    starts and then grows by pieces of ``delta_chars`` characters.

    Rows of a conversation follow their turn, null last; equal turns follow role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    body = F.coalesce("text", F.lit(""))
    placed = rows.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", body.alias("body"))
    pieces = F.ceil(F.length("body") / delta_chars).cast("long")
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), pieces)))
    cut = F.substr("body", ((F.col("part") - 1) * delta_chars + 1).cast("int"), F.lit(delta_chars))
    return parts.select(
        "conv_id",
        (F.shiftleft("message", 32) + F.col("part")).alias("seq"),
        F.when(F.col("part") == 0, "start").otherwise("delta").alias("event"),
        "message",
        "role",
        F.when(F.col("part") == 0, "").otherwise(cut).alias("text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (``conv_id``, ``message``, ``role``, ``text``) of a log.

    The log has ``conv_id``, ``seq``, ``event``, ``message`` (its place in the conversation),
    ``role``, ``text``. ``start``, ``edit`` and ``regenerate`` give a message a new text and void all
    events before them of that message and of those after it; ``delta`` adds to the text. So an
    event stands if no later reset is at its place or before it. Null texts add nothing; the last
    role that is not null counts, else it is empty. Rows without a conversation form one
    conversation; events of equal sequence numbers follow their text; repeated deltas repeat their
    text. An empty log gives no messages. Other columns are not read.

    Pieces meet per message before conversations meet, so a conversation is moved as its messages.
    """
    reset = F.when(F.col("event").isin(*RESETS), F.col("seq"))
    item = F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role")
    per_message = events.groupBy("conv_id", "message").agg(F.collect_list(item).alias("log"), F.max(reset).alias("reset"))
    before = Window.partitionBy("conv_id").orderBy("message")
    standing = F.filter("log", lambda e: F.coalesce(e["seq"] >= F.col("since"), F.lit(True)))
    folded = per_message.withColumn("since", F.max("reset").over(before)).withColumn("log", F.array_sort(standing))
    folded = folded.filter(F.size("log") > 0)
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id",
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(F.transform("log", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss`` (start and length, in code points, of each
    text of the learned role, as it stands there)."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.struct("message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    end = STOP + "\n"
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(end))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        span = F.struct(begin.alias("start"), F.length(t["body"]).alias("length"))
        spans = F.when(t["role"] == LEARNED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((begin + F.length(t["body"]) + len(end)).alias("at"), spans.alias("spans"))

    loss = F.aggregate("turns", start, add, lambda s: s["spans"])
    return turns.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """What a reader finds in the formatted text: turns, and the text under the loss mask."""
    kind = dict(rendered.dtypes)["conv_id"]
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rendered.mapInArrow(_read, f"conv_id {kind}, {fields}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            learned = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append((len(turns), digest(said), len(learned), digest(learned), len(text)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        arrays = [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
        yield pa.RecordBatch.from_arrays(arrays, names)
