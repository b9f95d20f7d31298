"""Item text and tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import hash_slot, words

# Parameter defaults of the training configurations.
TEXT_KEYS = ("title", "tag", "description")
MAX_TEXT_LENGTH = 64


def prompt_text(keys: Sequence[str], prompt: str) -> Column:
    """``prompt`` and then ``key: value`` for every key that has a value, without separators."""
    parts = [
        F.when(F.col(k).isNotNull() & ~F.col(k).cast("string").isin("", "nan"), F.concat(F.lit(f"{k}: "), F.col(k)))
        for k in keys
    ]
    return F.concat(F.lit(prompt), *[F.coalesce(p, F.lit("")) for p in parts])


def item_text(items: DataFrame, info: DataFrame, keys: Sequence[str] = TEXT_KEYS, prompt: str = "") -> DataFrame:
    """Text of each item; an item without a row in ``info`` (the pad too) has empty text."""
    known = info.select("item_id", prompt_text(keys, prompt).alias("text"))
    return items.join(known, "item_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def tokenize_truncate(text: Column, max_len: int = MAX_TEXT_LENGTH) -> Column:
    """Default tokenizer: the first ``max_len`` lower-case words."""
    return F.slice(words(text), 1, max_len)


def token_ids(tokens: Column, vocabulary: int) -> Column:
    """Hashed token ids in ``[1, vocabulary - 1]``, for use without a model's vocabulary."""
    return F.transform(tokens, lambda t: hash_slot(vocabulary - 1, t) + 1)


def tokenize_with(
    rows: DataFrame, column: str, load: Callable[[], Callable[[str], list[int]]], max_len: int, name: str = "input_ids"
) -> DataFrame:
    """Token ids by a caller's tokenizer, which ``load`` opens once per task."""

    @F.pandas_udf("array<long>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield texts.map(lambda t: list(tokenizer(t))[:max_len])

    return rows.withColumn(name, encode(F.col(column)))
