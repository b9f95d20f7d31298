"""Weak supervision from web documents: relevance filter, links, pseudo-users, pair filter."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.arrays import let
from seqloom.functions.markup import attribute, start_tags, without_raw_text
from seqloom.functions.words import words
from seqloom.operators.ordering import global_rank, take_first
from seqloom.operators.sampling import filter_by_relevance
from seqloom.operators.scoring import SCORE_DIGITS, mean_user_vectors, target_scores
from seqloom.operators.sequences import eval_examples, eval_history, user_histories
from seqloom.operators.validate import add_constant_columns
from seqloom.session import materialize

# Characters of a subword, and the weight decay of the relevance filter.
SUBWORD, RIDGE = 4, 1e-3
SLICE_TEXTS, SLICE_SLOTS = 256, 1 << 20  # texts and their slots, repeats included, that are counted at once
SLICE_WORDS = 1 << 20  # of texts whose distinct words are hashed at once
SITE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)"
# White space around a URL, and what is left out inside it.
URL_EDGE, URL_BREAK = r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", r"[\t\n\r]"


@dataclass(frozen=True)
class RelevanceModel:
    """A linear model over hashed words and subwords; ``weights`` has one number for each slot."""

    weights: tuple[float, ...]
    bias: float
    subword: int

def _crc_tables(length: int) -> tuple[int, list[np.ndarray]]:
    """CRC-32 of ``length`` zero bytes, and by place and byte what that byte changes in it: changes add up by xor."""
    zero = bytes(length)
    base = zlib.crc32(zero)
    put = lambda i, b: zlib.crc32(zero[:i] + bytes([b]) + zero[i + 1 :]) ^ base
    return base, [np.array([put(i, b) for b in range(256)], np.int64) for i in range(length)]


def _slots_of(found: list[str], features: int, subword: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its own slot, where the slots of its runs begin and how many they are; then the slots of all runs.

    Runs of ASCII words are hashed as windows over their joined bytes, those of other words one by one.
    """
    marked = [f"<{w}>" for w in found]
    coded = [m.encode() for m in marked]
    whole = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % features
    lengths, plain = np.fromiter(map(len, marked), np.int64, len(coded)), np.fromiter(map(str.isascii, marked), bool, len(coded))
    runs = np.where(lengths > subword, lengths - subword + 1, 0)
    data = np.frombuffer(b"".join(c for c, p in zip(coded, plain) if p), np.uint8)
    base, tables = _crc_tables(subword)
    windows = np.full(max(0, len(data) - subword + 1), base, np.int64)
    for i, table in enumerate(tables):
        windows ^= table[data[i : i + len(windows)]]
    others = [m[i : i + subword] for m, r, p in zip(marked, runs, plain) if not p for i in range(r)]
    hashed = np.fromiter((zlib.crc32(f.encode()) for f in others), np.int64, len(others))
    first = np.zeros(len(coded), np.int64)
    first[plain] = np.cumsum(lengths[plain]) - lengths[plain]
    first[~plain] = len(windows) + np.cumsum(runs[~plain]) - runs[~plain]
    return whole, first, runs, np.r_[windows, hashed] % features


def _by_words(found: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of at most ``SLICE_WORDS`` words, one text at least."""
    ends, at = np.r_[0, np.cumsum(found.value_lengths().fill_null(0).to_numpy())], 0
    while at < len(found):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_WORDS, "right")) - 1)
        yield found.slice(at, to - at)
        at = to


def unit_vectors(found: pa.ListArray, features: int, subword: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts as lists of words: in slices, the number of texts, and by text and slot the number of the text in
    the slice, the slot and its entry in the text's unit vector of slot counts.

    Slots are CRC-32 modulo ``features`` of the words and of their runs of ``subword`` characters. A word
    stands between ``<`` and ``>``, so that its ends tell; one that is no longer than a run with them has no runs.
    """
    for part in _by_words(found):
        yield from _unit_vectors(part, features, subword)


def _unit_vectors(found: pa.ListArray, features: int, subword: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    coded = found.flatten().dictionary_encode()
    whole, first, runs, flat = _slots_of(coded.dictionary.to_pylist(), features, subword)  # each distinct word once
    code, ends = coded.indices.to_numpy(), np.cumsum(found.value_lengths().fill_null(0).to_numpy())
    slots_to = np.r_[0, np.cumsum(runs[code] + 1)][ends]  # slots of all texts up to this one
    to = 0
    while to < len(found):
        at = to
        fit = int(np.searchsorted(slots_to, (slots_to[at - 1] if at else 0) + SLICE_SLOTS, "right"))
        to = min(max(fit, at + 1), at + SLICE_TEXTS)
        low = ends[at - 1] if at else 0
        words_ = code[low : ends[to - 1]]
        text = np.searchsorted(ends[at:to] - low, np.arange(len(words_)), "right")
        n = runs[words_]
        inside = np.arange(n.sum()) + np.repeat(first[words_] - np.cumsum(n) + n, n)
        keys = np.r_[text * features + whole[words_], np.repeat(text * features, n) + flat[inside]]
        cells = (to - at) * features
        if cells <= 8 * len(keys):  # a count for every cell takes less time than a sort
            counts = np.bincount(keys, minlength=cells)
            keys = np.flatnonzero(counts)
            counts = counts[keys]
        else:
            keys, counts = np.unique(keys, return_counts=True)
        text, slots = np.divmod(keys, features)
        length = np.sqrt(np.bincount(text, counts.astype(float) ** 2, minlength=to - at))
        yield to - at, text, slots, counts / length[text]


def train_relevance_filter(
    positive: DataFrame, negative: DataFrame, features: int = 1 << 14, iterations: int = 20, subword: int = SUBWORD, ridge: float = RIDGE
) -> RelevanceModel:
    """Text classifier: target-domain texts against other web texts. Both have a ``text`` column.

    Logistic regression on the unit vectors of hashed words and subwords (:func:`unit_vectors`), fitted to
    all texts at once. Each round sums the gradient by slot, first in each task, so ``features`` numbers
    come back whatever the input. Step sizes follow from the texts: as no feature is negative, a slot's
    sum of ``x * (all x) / 4``, the bias included, bounds its curvature, so a plain step never raises the
    loss; rounds go on from a point ahead (accelerated gradient). Nothing is drawn: the same texts give
    the same model, in any order, and SQL can repeat it. Null and empty texts tell the bias only.
    """

    slot_type = np.min_scalar_type(features)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, text, slots, x in unit_vectors(batch.column("words"), features, subword):
                labels = batch.column("label").slice(at, n).to_numpy()
                sizes = np.bincount(text, minlength=n).astype("int32")
                # Entries of a text are whole multiples of the least one's; shares repeat, so they compress well.
                blobs = [a.tobytes() for a in (labels, sizes, slots.astype(slot_type), x)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], ["labels", "sizes", "slots", "shares"])
                at += n

    row = lambda label: [words(F.coalesce(F.col("text"), F.lit(""))).alias("words"), F.lit(label).alias("label")]
    rows = positive.select(*row(1.0)).unionByName(negative.select(*row(0.0)))
    # A row holds a slice of texts, as plain bytes: each round reads them all again.
    texts = materialize(rows.mapInArrow(vectors, "labels binary, sizes binary, slots binary, shares binary"), "labelled-vectors")
    spark = texts.sparkSession

    def by_slot(value: Callable[[np.ndarray, Callable[[np.ndarray | None], np.ndarray]], np.ndarray]) -> np.ndarray:
        """Sum over all texts of ``x`` times the text's value, by slot; each task adds up its own first.

        ``value`` has the labels of a slice and a function that gives each text's product with some weights, or
        its sum. The bias is one more slot, which every text has once.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(features + 1)
            for batch in batches:
                for row in zip(*[batch.column(k) for k in range(4)]):
                    labels, sizes, at, x = (np.frombuffer(b.as_buffer(), t) for b, t in zip(row, (float, "int32", slot_type, float)))
                    text, n = np.repeat(np.arange(len(labels)), sizes), len(labels)

                    def product(w: np.ndarray | None) -> np.ndarray:
                        return np.bincount(text, x if w is None else x * w[at], minlength=n) + (1 if w is None else w[-1])

                    values = value(labels, product)
                    total[:-1] += np.bincount(at, x * values[text], minlength=features)
                    total[-1] += values.sum()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "total"])

        parts = texts.mapInArrow(run, "slot long, total double").groupBy("slot").agg(F.sum("total").alias("total"))
        dense = np.zeros(features + 1)
        for r in parts.collect():
            dense[r["slot"]] = r["total"]
        return dense

    curvature = by_slot(lambda labels, product: product(None) / 4) + ridge
    at = ahead = np.zeros(features + 1)
    for k in range(iterations):
        weights = spark.sparkContext.broadcast(ahead)
        slope = by_slot(lambda labels, product: 1 / (1 + np.exp(-product(weights.value))) - labels)
        before, at = at, ahead - (slope + ridge * ahead) / curvature
        ahead = at + k / (k + 3) * (at - before)
    return RelevanceModel(tuple(at[:-1].tolist()), float(at[-1]), subword)


def score_documents(docs: DataFrame, model: RelevanceModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the chance that a text is of the target domain. Without words the bias decides."""
    weights = docs.sparkSession.sparkContext.broadcast(np.array(model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [np.zeros(0)]
            for n, of, slots, x in unit_vectors(batch.column("_words"), len(weights.value), model.subword):
                odds.append(np.bincount(of, weights.value[slots] * x, minlength=n) + model.bias)
            kept = [c for c in batch.schema.names if c not in ("_words", "score")]
            scores = pa.array(1 / (1 + np.exp(-np.concatenate(odds))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], [*kept, "score"])

    kept = docs.drop("score")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType())])
    return kept.withColumn("_words", words(F.coalesce(F.col(text), F.lit("")))).mapInArrow(run, schema)


def rank_documents(docs: DataFrame, model: RelevanceModel, top_n: int, key: str = "doc_id") -> DataFrame:
    """The ``top_n`` most relevant documents; equal scores (nine digits) go to the lower id."""
    scored = score_documents(docs, model).withColumn("_down", -F.round("score", SCORE_DIGITS))
    return take_first(scored, ["_down", key], top_n).drop("_down")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _without_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` segments of an absolute path worked off, never above the root."""
    segments = F.split(path, "/")
    is_dot = F.element_at(segments, -1).isin(".", "..")

    def step(done: Column, segment: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.array_append(done, segment))

    start = F.slice(segments, 1, 1)
    rest = F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0)))
    joined = F.array_join(F.aggregate(rest, start, step), "/")
    folded = F.when(is_dot, F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def normalized_url(url: Column) -> Column:
    """Without fragment and dot segments, with scheme and host in lower case."""

    def normal(bare: Column) -> Column:
        site = F.regexp_extract(bare, SITE, 1)
        return F.concat(F.lower(site), let(F.substr(bare, F.length(site) + 1), of_rest))

    def of_rest(rest: Column) -> Column:
        path = let(F.regexp_replace(rest, r"\?.*$", ""), _without_dot_segments)
        return F.concat(path, F.regexp_extract(rest, r"(\?.*)$", 1))

    return let(without_fragment(F.trim(url)), normal)


def _resolved(href: Column, base: Column) -> Column:
    """``href`` as a whole URL; the base is a whole URL without fragment."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, SITE, 1)
    path = F.regexp_replace(base, r"\?.*$", "")
    # Everything up to the last slash of the path; a bare site has the root as its folder.
    folder = F.when(F.length(path) == F.length(site), F.concat(site, F.lit("/"))).otherwise(
        F.regexp_extract(path, r"^(.*/)", 1)
    )
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(folder, href))
    )


def _address(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, URL_EDGE, ""), URL_BREAK, "")


def extract_outlinks(pages: DataFrame) -> DataFrame:
    """``(page_id, target_url)``: all distinct link targets of each page as whole URLs.

    Links are the ``href`` of ``a`` and ``area`` tags, quoted either way or not at all, with their character
    references replaced; the first ``base`` tag with one says what they are relative to, else the page's
    URL. Comments, scripts, styles, text areas and titles hold no links, nor do values of other
    attributes. Targets that are no web address are left out.
    """
    own = without_fragment(F.trim("url"))
    markup = pages.select("page_id", own.alias("own"), without_raw_text(F.col("html")).alias("markup"))
    tags = markup.select("page_id", "own", start_tags(F.col("markup"), "a|area|base").alias("tags"))
    hrefs = F.transform("tags", lambda t: F.struct(t.rlike(r"(?i)^<base[\s/]").alias("base"), _address(attribute(t, "href")).alias("href")))
    found = tags.select("page_id", "own", F.filter(hrefs, lambda h: h["href"].isNotNull()).alias("hrefs"))
    bases = F.filter("hrefs", lambda h: h["base"])
    targets = F.array_distinct(F.transform(F.filter("hrefs", lambda h: ~h["base"]), lambda h: h["href"]))
    first = let(F.get(bases, F.lit(0))["href"], lambda b: _resolved(without_fragment(b), F.col("own")))
    rows = found.select("page_id", F.coalesce(first, "own").alias("base"), F.explode(targets).alias("href"))
    whole = let(without_fragment(F.col("href")), lambda h: _resolved(h, F.col("base")))
    links = rows.select("page_id", normalized_url(whole).alias("target_url"))
    return links.filter(F.col("target_url").rlike("^https?://")).distinct()


def page_urls(pages: DataFrame) -> DataFrame:
    """One page per normalised URL; of pages with the same URL the lowest id."""
    return pages.groupBy(normalized_url(F.col("url")).alias("target_url")).agg(F.min("page_id").alias("target_id"))


def link_pairs(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``(page_id, target_id)``: pages with the known pages they link to, without self links."""
    # Written, so that the join shuffles both sides and the links to a very popular URL are split.
    known = materialize(page_urls(pages), "page-urls")
    joined = links.join(known, "target_url").filter(F.col("page_id") != F.col("target_id"))
    return joined.select("page_id", "target_id").distinct()


def dangling_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links to URLs that are not among the pages."""
    return links.join(materialize(page_urls(pages), "page-urls"), "target_url", "left_anti").select("page_id", "target_url")


def pairs_to_interactions(pairs: DataFrame) -> DataFrame:
    """Each pair as a pseudo-user with two interactions: the page at time 0, its target at time 1."""
    numbered = global_rank(pairs, ["page_id", "target_id"], "_rank")
    steps = F.array(
        F.struct(F.col("page_id").alias("item_id"), F.lit(0).cast("long").alias("timestamp")),
        F.struct(F.col("target_id").alias("item_id"), F.lit(1).cast("long").alias("timestamp")),
    )
    rows = numbered.select((F.col("_rank") + 1).alias("user_id"), F.explode(steps).alias("step"))
    return rows.select("step.item_id", "user_id", "step.timestamp")


def docs_to_item_info(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as items: the text as description on one line, empty title and tag."""
    one_line = F.replace(F.col(text), F.lit("\n"), F.lit("\\n"))
    items = docs.select(F.col(key).alias("item_id"), one_line.alias("description"))
    return add_constant_columns(items, {"title": "", "tag": ""})


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed, blanks joined."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def curate(pairs: DataFrame, item_vecs: DataFrame, threshold: float) -> DataFrame:
    """Score each linked pair and keep those of at least ``threshold``.

    Pairs become pseudo-users; the score is the cosine of the page with its held-out target.
    ``item_vecs`` is ``(item_id, vec)`` over the pages.
    """
    histories = user_histories(pairs_to_interactions(pairs), ["timestamp"])
    examples = eval_examples(histories, "test", 1).select("user_id", F.col("history")[0].alias("page_id"), "target")
    seen = eval_history(histories, "test")
    scored = target_scores(examples, mean_user_vectors(seen, item_vecs), item_vecs, seen)
    kept = filter_by_relevance(examples, scored.select("user_id", "score"), threshold)
    return kept.select("user_id", "page_id", F.col("target").alias("target_id"), "score")
