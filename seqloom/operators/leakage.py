"""Leakage and near-duplicate audit between a query corpus and a larger corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dot, hash_slot, hashed_ngrams, lexical_overlap, words
from seqloom.operators.joins import heavy_join
from seqloom.operators.ordering import exact_percentiles, global_rank
from seqloom.operators.scoring import BROADCAST_BYTES, best_of_stream, normalized
from seqloom.session import materialize

# Neighbours per query, gram length, number of random pairs and their seed, length of
# the reported texts, reported percentiles and cosine levels, and the limits of the classes.
NEIGHBOURS = 5
GRAM = 5
RANDOM_PAIRS = 20_000
SEED = 0
TEXT_CUT = 300
PERCENTILES = (0.50, 0.90, 0.99)
COSINE_LEVELS = (0.95, 0.90, 0.85, 0.80)
NEAR_VERBATIM = 0.5
CLOSE = 0.85

# Letters, digits and underscores: what the column functions take for a word.
_WORD = re.compile(r"\w+")
GRAM_BYTES = 32  # of a hashed gram in a broadcast table
REMEMBERED_WORDS = 1 << 17  # slots that one task remembers, some 250 bytes each


def hashed_word_encoder(dim: int) -> Callable[[Sequence[str]], np.ndarray]:
    """Default encoder: word counts hashed into ``dim`` slots, without a model."""

    @lru_cache(maxsize=REMEMBERED_WORDS)
    def slot(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:13], 16) % dim

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            found = [slot(w) for w in _WORD.findall(text.lower())]
            row += np.bincount(found, minlength=dim)
        return out

    return encode


def hashed_words(dim: int) -> Callable[[], Callable[[Sequence[str]], np.ndarray]]:
    return partial(hashed_word_encoder, dim)


def knn_cosine(query: DataFrame, corpus: DataFrame, k: int = NEIGHBOURS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact nearest corpus texts of every query by cosine, with rank from 0.

    ``query`` is ``(query_id, vec)`` and ``corpus`` ``(corpus_id, vec)``. The corpus is the larger
    side: it is scored where it lies.
    """
    best = best_of_stream(
        query.withColumnRenamed("query_id", "user_id"),
        corpus.withColumnRenamed("corpus_id", "item_id"),
        k,
        broadcast_bytes=broadcast_bytes,
    )
    return best.select(
        F.col("user_id").alias("query_id"),
        F.col("item_id").alias("corpus_id"),
        (F.col("rank") - 1).alias("rank"),
        F.col("score").alias("cosine"),
    )


def _hashed_sets(texts: DataFrame, key: str, n: int, grams: str) -> DataFrame:
    """The gram sets as 64-bit hashes, without the texts."""
    return texts.select(key, hashed_ngrams(words(F.col("text")), n).alias(grams))


def pair_overlap(pairs: DataFrame, query: DataFrame, corpus: DataFrame, n: int = GRAM) -> DataFrame:
    """Add n-gram Jaccard and containment to ``(query_id, corpus_id)`` rows, from the whole texts.

    Only hashes of grams move: eight bytes each, in place of the texts and the grams themselves.
    """
    needed = corpus.join(pairs.select("corpus_id").distinct(), "corpus_id", "left_semi")
    q, c = _hashed_sets(query, "query_id", n, "_q"), _hashed_sets(needed, "corpus_id", n, "_c")
    joined = pairs.join(q, "query_id").join(c, "corpus_id")
    jaccard, containment = lexical_overlap(F.col("_q"), F.col("_c"))
    return joined.withColumns({"jaccard": jaccard, "containment": containment}).drop("_q", "_c")


def leakage_pairs(neighbours: DataFrame, query: DataFrame, corpus: DataFrame, n: int = GRAM) -> DataFrame:
    """The audit report: ids, rank, cosine, overlaps and the cut texts, most similar first.

    Texts are cut where they lie and joined last.
    """
    cut = lambda name: F.substring("text", 1, TEXT_CUT).alias(name)
    rows = pair_overlap(neighbours, query, corpus, n)
    rows = rows.join(query.select("query_id", cut("query_text")), "query_id")
    rows = rows.join(corpus.select("corpus_id", cut("corpus_text")), "corpus_id")
    return rows.select(
        "query_id",
        "corpus_id",
        "rank",
        "cosine",
        F.col("jaccard").alias(f"jaccard_{n}gram"),
        F.col("containment").alias(f"containment_{n}gram"),
        "query_text",
        "corpus_text",
    ).orderBy(F.desc("cosine"), "query_id", "rank")


def random_pair_cosines(query: DataFrame, corpus: DataFrame, pairs: int = RANDOM_PAIRS, seed: int = SEED) -> DataFrame:
    """Cosines of ``pairs`` hash-drawn (query, corpus) pairs: what unrelated texts look like."""
    query, corpus = normalized(query), normalized(corpus)
    # Only ids are ranked; vectors are fetched for the drawn pairs.
    q = global_rank(query.select("query_id"), ["query_id"], "_qi")
    c = global_rank(corpus.select("corpus_id"), ["corpus_id"], "_ci")
    n_query, n_corpus = q.count(), c.count()
    drawn = query.sparkSession.range(pairs).select(
        F.col("id").alias("pair"),
        hash_slot(n_query, seed, "query", F.col("id")).alias("_qi"),
        hash_slot(n_corpus, seed, "corpus", F.col("id")).alias("_ci"),
    )
    ids = drawn.join(q, "_qi").join(c, "_ci").select("pair", "query_id", "corpus_id")
    q_vecs = query.select("query_id", F.col("vec").alias("_q"))
    joined = ids.join(q_vecs, "query_id").join(corpus.select("corpus_id", F.col("vec").alias("_c")), "corpus_id")
    return joined.select("pair", "query_id", "corpus_id", F.round(dot(F.col("_q"), F.col("_c")), 9).alias("cosine"))


def _stat_rows(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    one = df.agg(*[c.cast("double").alias(f"s{i}") for i, c in enumerate(stats.values())])
    cells = [F.struct(F.lit(n).alias("stat"), F.col(f"s{i}").alias("value")) for i, n in enumerate(stats)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _percentile_rows(df: DataFrame, column: str, levels: Sequence[float]) -> DataFrame:
    rows = exact_percentiles(df, column, levels)
    return rows.select(F.concat(F.lit("p"), F.round(F.col("level") * 100).cast("int")).alias("stat"), "value")


def random_pair_baseline(cosines: DataFrame) -> DataFrame:
    """Mean, median, 99th percentile and maximum of the random pairs as ``(stat, value)``."""
    stats = _stat_rows(cosines, {"mean": F.avg("cosine"), "max": F.max("cosine")})
    return stats.unionByName(_percentile_rows(cosines, "cosine", (0.50, 0.99)))


def leakage_summary(pairs: DataFrame, n: int = GRAM) -> DataFrame:
    """Nearest-neighbour percentiles, queries above each cosine level, near-verbatim pairs."""
    nearest = pairs.filter(F.col("rank") == 0).select("cosine")
    above = {f"queries_above_{t:.2f}": F.count_if(F.col("cosine") > t) for t in COSINE_LEVELS}
    verbatim = {"near_verbatim_pairs": F.count_if(F.col(f"containment_{n}gram") > NEAR_VERBATIM)}
    return (
        _percentile_rows(nearest, "cosine", PERCENTILES)
        .unionByName(_stat_rows(nearest, {"max": F.max("cosine"), **above}))
        .unionByName(_stat_rows(pairs, verbatim))
    )


def classify_pairs(pairs: DataFrame, n: int = GRAM) -> DataFrame:
    """Leakage: close and near-verbatim. Same topic: close but different text. Else unrelated."""
    close = F.col("cosine") > CLOSE
    verbatim = F.col(f"containment_{n}gram") > NEAR_VERBATIM
    kind = F.when(close & verbatim, "leakage").when(close, "same topic").otherwise("unrelated")
    return pairs.withColumn("pair_class", kind)


def near_verbatim_pairs(
    query: DataFrame, corpus: DataFrame, n: int = GRAM, above: float = NEAR_VERBATIM, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """All (query, corpus) pairs whose gram containment is above ``above``, found without vectors.

    Exact, without a limit on frequent grams; a gram of very many texts is split over tasks. A pair above the level shares more than
    ``above * size`` grams of its smaller set, so at least one of them is among the
    ``size - floor(above * size)`` rarest grams of that set. Only those rare grams of the smaller
    side are joined; the pairs found are then checked on the whole texts. Grams travel as 64-bit
    hashes: equal hashes of different grams can only add a pair to check.
    """
    q = materialize(_gram_rows(query.select("query_id", "text"), "query_id", n), "query-grams")
    c = _gram_rows(corpus.select("corpus_id", "text"), "corpus_id", n)
    # From here on only corpus grams that some query has. Where those of the queries fit into every task, the corpus is
    # read once and nothing of it moves; else its grams are counted first, so that heavy ones are split.
    by_text, asked = ["corpus_id"], q.select("gram").distinct()
    if asked.count() * GRAM_BYTES <= broadcast_bytes:
        c = c.join(F.broadcast(asked), "gram", "left_semi")
    else:
        c = heavy_join(c, asked, "gram", by_text, "left_semi")
    c = materialize(c, "corpus-grams")
    frequency = materialize(c.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram-frequency")
    q = _rarest(q.join(frequency, "gram"), "query_id", above)
    sizes = frequency.withColumnRenamed("df", "n")
    c = _rarest(heavy_join(c, frequency, "gram", by_text, sizes=sizes), "corpus_id", above)
    c = materialize(c.withColumnsRenamed({n: f"corpus_{n}" for n in ("size", "found", "rare")}), "ranked-grams")
    # Neither text can share more grams than it has in common with the whole other side.
    enough = F.least("found", "corpus_found") > F.least("size", "corpus_size") * above
    wanted = (F.col("rare") & (F.col("size") <= F.col("corpus_size"))) | (F.col("corpus_rare") & (F.col("corpus_size") < F.col("size")))
    key = ["query_id", "corpus_id"]
    met = heavy_join(c, q, "gram", by_text, sizes=sizes).filter(enough & wanted)
    candidates = materialize(met.select(*key).distinct(), "candidates")
    found = pair_overlap(candidates, query, corpus, n).filter(F.col("containment") > above)
    return found.select(*key, "jaccard", "containment")


def _gram_rows(texts: DataFrame, key: str, n: int) -> DataFrame:
    # The size comes first, so that the set itself is not copied into every exploded row. The outer
    # form, because the inner one filters on the set and so builds it twice.
    sized = _hashed_sets(texts, key, n, "_hashes").select(key, F.size("_hashes").alias("size"), "_hashes")
    return sized.select(key, "size", F.explode_outer("_hashes").alias("gram")).filter("gram is not null")


def _rarest(grams: DataFrame, key: str, above: float) -> DataFrame:
    """Flag the grams of each text that may be needed to find a pair where it is the smaller side.

    Grams of the text that the other side lacks come first in the order; they find nothing.
    """
    order = Window.partitionBy(key).orderBy("df", "gram")
    ranked = grams.withColumn("_place", F.row_number().over(order))
    ranked = ranked.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy(key)))
    lacking = F.col("size") - F.col("found")
    prefix = F.col("size") - F.floor(F.col("size") * above)
    return ranked.withColumn("rare", F.col("_place") + lacking <= prefix).drop("_place", "df")
