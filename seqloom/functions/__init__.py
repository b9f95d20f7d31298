from seqloom.functions.arrays import (
    cosine,
    dot,
    l2_normalize,
    masked_index,
    pad_left,
    pad_left_with,
    pad_right_with,
    time_features,
    time_gap_buckets,
    utc_epoch_seconds,
)
from seqloom.functions.hashing import hash_bits, hash_slot
from seqloom.functions.scalars import cutoff, trunc
from seqloom.functions.words import hashed_ngrams, join_text, lexical_overlap, ngrams, words

__all__ = [
    "cosine",
    "cutoff",
    "dot",
    "hash_bits",
    "hash_slot",
    "hashed_ngrams",
    "join_text",
    "l2_normalize",
    "lexical_overlap",
    "masked_index",
    "ngrams",
    "pad_left",
    "pad_left_with",
    "pad_right_with",
    "time_features",
    "time_gap_buckets",
    "trunc",
    "utc_epoch_seconds",
    "words",
]
