"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, by pivots.

Jaccard distance is a metric, but unrelated documents all lie at distance one, where document pivots
can't tell them apart. So the first pivots are single shingles: a document within reach of another
keeps at least one of its first few shingles in any fixed order, and is a member of the region of
each of those. Inside a region its centre is the pivot, the set of the shingles that most members
have. With the number of differing shingles as the metric, a member's distance to the centre is the
size of its difference from it, and the triangle inequality bounds the distance of two members from
both sides: those near the centre link without a look at them, and any other link needs a common
part of both differences. So members go on to the regions of their differing shingles, each with
fewer than about half of the members, as the centre has what most have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.components import least_labels
from seqloom.llm.words import WordHashes, window_hashes
from seqloom.operators.joins import heavy_join
from seqloom.session import discard, materialize, passing_tables

SHINGLE, PERCENT = 5, 80
# The order of shingles takes frequent ones last, and of the others those of frequent words. Both are
# counted in a sample of about so many documents, and so many of each at most are kept: this decides
# about speed, never about the result.
SAMPLE_DOCS, SAMPLE_ENTRIES = 20_000, 200_000
# What the sample missed shows in the first prefixes: of one class in CROWD_SHARE (of all, if they are few) the shingles are
# counted, and those estimated to be in more than CROWDED prefixes are taken last, too; so often at most, and again only if
# more than one class in CROWD_STOP had one.
CROWDED, CROWD_SHARE, CROWD_ROUNDS, CROWD_STOP = 64, 8, 2, 20
# A region of so few members is joined directly; a larger one gets a centre and is joined again by what differs from it.
SMALL_REGION = 256
CENTRE_MEMBERS = 15  # about so many members, by a hash of their keys, decide on a centre; this is about speed alone
DIRECT_PAIRS = 40_000  # so few pairs are measured at once, more in rounds
# So many classes at most are sent to all tasks to fetch their texts, some 10 MB; more are joined by id.
BROADCAST_ROWS = 250_000
BROADCAST_IDS = 2_000_000  # bare ids, some 100 MB
BROADCAST_BYTES = 32 << 20
_ROWS = 512


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size, self.known = size, WordHashes()

    def words(self, text: str | None) -> np.ndarray:
        return self.known.of((text or "").encode().lower().split())  # on bytes, both treat ASCII alone

    def runs(self, words: np.ndarray) -> np.ndarray:
        return window_hashes(words, min(self.size, len(words))) if len(words) else words

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.runs(self.words(text)))


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def _lookup(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Counts of hashes from a table of sorted hashes and their counts; 0 for others."""
    found, counts = table
    if not len(found):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
    return np.where(found[place] == hashes, counts[place], 0)


def _table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of ``hash``, ``count`` the most frequent hashes, sorted, and their counts."""
    rows = counts.orderBy(F.desc("count"), "hash").limit(SAMPLE_ENTRIES).select("hash", "count").toArrow()
    found = rows["hash"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["count"].to_numpy()[order]


def _frequent(docs: DataFrame, size: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Tables of the shingles and of the words found three times or more in the sample, and the sample's share."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(size)
        for batch in batches:
            for text in batch.column("text"):
                words = of.words(text.as_py())
                for kind, found in enumerate((np.unique(of.runs(words)), words)):
                    arrays = [pa.array(np.full(len(found), kind, np.int32)), pa.array(found.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["kind", "hash"])

    counts = sample.select("text").mapInArrow(hashes, "kind int, hash long").groupBy("kind", "hash").count()
    counts = materialize(counts.filter("count > 2"), "sample-counts")
    return [_table(counts.filter(F.col("kind") == kind)) for kind in (0, 1)], share


def _parity(shingles: np.ndarray) -> bytes:
    """One bit per slot, whether an odd number of shingles falls there; a power of two of slots, about as
    many as shingles. Two sets differ in as many shingles at least as their bits differ."""
    slots = 1 << max(6, (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _close(percent: int):
    """Pairs whose parities don't rule out a link. The wider one is folded: its halves' sum is the parity
    of the lower slots."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, a, b in zip(batch.column("total").to_pylist(), batch.column("pa"), batch.column("pb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (a, b))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                differ = int(np.bitwise_count(x ^ y).sum())
                keep.append(differ * (100 + percent) <= total * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return prune


SUMMARY = "doc_id long, digest binary, n int, rare int, prefix array<long>, parity binary"


def _summaries(size: int, percent: int, shared):
    names = ["doc_id", "digest", "n", "rare", "prefix", "parity"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (frequent, frequent_words) = Shingler(size), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch, rows = whole.slice(at, _ROWS), []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    words = of.words(text.as_py())
                    shingles, place = np.unique(of.runs(words), return_index=True)
                    n = len(shingles)
                    often = _lookup(frequent, shingles)
                    common = np.concatenate([[0.0], np.log2(1 + _lookup(frequent_words, words)).cumsum()])
                    common = common[np.minimum(place + size, len(words))] - common[place]
                    length = n - -(-percent * n // 100) + 1
                    prefix = shingles[np.lexsort((shingles, np.rint(common * 4), often))[:length]]
                    rare = int((often == 0).sum())
                    rows.append((doc, _digest(shingles), n, rare, prefix.view(np.int64), _parity(shingles)))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return summarize


def _holders(shared):
    """Classes whose prefix holds a shingle of the table."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            ends = np.diff(prefix.offsets.to_numpy()).cumsum()
            met = np.concatenate([[0], (_lookup(shared.value, prefix.flatten().to_numpy().view(np.uint64)) > 0).cumsum()])
            yield batch.select(["key", "digest", "first_id"]).filter(pa.array(np.diff(met[ends], prepend=0) > 0))

    return hold


def _uncrowded(read: DataFrame, reps: DataFrame, size: int, percent: int, tables: list, share: float) -> DataFrame:
    """``key``, ``n``, ``rare``, ``prefix`` of all classes in an order that takes the shingles of crowded regions last.

    A passage that many unlike texts quote is rare in a sample and of rare words, so it would be in all their prefixes:
    regions that grow with the corpus and hold no link. Any order of all shingles finds all links, and a prefix without
    a shingle that goes to the end stays as it is, so only the others' texts are read again.
    """
    spark, (frequent, words) = read.sparkSession, tables
    prefixes, total = reps.select("key", "digest", "first_id", "n", "rare", "prefix"), reps.count()
    part = CROWD_SHARE if total > SAMPLE_DOCS else 1
    for _ in range(CROWD_ROUNDS):
        drawn = prefixes.filter(F.pmod(F.xxhash64("digest"), F.lit(part)) == 0)
        counts = drawn.select(F.explode("prefix").alias("hash")).groupBy("hash").count()
        found, often = _table(counts.filter(F.col("count") * part > CROWDED))
        new = _lookup(frequent, found) == 0
        if not new.any():
            break
        # In units of the sample, less than what it counts but more than nothing.
        found, often = found[new], often[new] * part * share
        holds = _holders(spark.sparkContext.broadcast((found, np.ones(len(found), np.int64))))
        crowded = prefixes.select("key", "digest", "first_id", "prefix").mapInArrow(holds, "key long, digest binary, first_id long")
        crowded = materialize(crowded, "crowded-classes")
        met = crowded.count()
        hint = F.broadcast if met <= BROADCAST_IDS else lambda table: table
        both = np.concatenate([frequent[0], found])
        order = np.argsort(both)
        frequent = both[order], np.concatenate([frequent[1], often])[order]
        again = read.join(hint(crowded.select(F.col("first_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
        again = again.mapInArrow(_summaries(size, percent, spark.sparkContext.broadcast([frequent, words])), SUMMARY)
        again = again.filter("digest is not null").select("digest", "n", "rare", "prefix").dropDuplicates(["digest"])
        again = materialize(crowded.join(again, "digest").select(prefixes.columns), "uncrowded-classes")
        prefixes = prefixes.join(hint(crowded.select("key")), "key", "left_anti").unionByName(again)
        if met * CROWD_STOP < total:
            break
    return prefixes.select("key", "n", "rare", "prefix")


def _sets(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(size)
        for batch in batches:
            for key, digest, text in zip(*(batch.column(n) for n in ("key", "digest", "text"))):
                shingles = of(text.as_py())
                if _digest(shingles) == digest.as_py():  # else another text under the same id
                    arrays = [pa.array([key.as_py()], pa.int64()), pa.array([shingles.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "shingles"])

    return build


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, either = [], []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both.append(int((y[at] == x).sum()))
            either.append(len(x) + len(y) - both[-1])
        arrays = [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "both", "either"])


class _Measure:
    """Exact distances of pairs of classes, from the texts of their first documents."""

    def __init__(self, read: DataFrame, classes: DataFrame, size: int, percent: int):
        self.read, self.classes, self.size, self.percent = read, classes, size, percent

    def sets(self, keys: DataFrame) -> DataFrame:
        """``key``, ``shingles`` of the given keys."""
        wanted = keys.join(self.classes.select("key", "digest", F.col("first_id").alias("doc_id")), "key")
        wanted = materialize(wanted, "wanted-sets")
        few = wanted.count() <= BROADCAST_ROWS
        met = self.read.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "digest", "text")
        sets = met.mapInArrow(_sets(self.size), "key long, shingles binary").dropDuplicates(["key"])
        return materialize(sets, "sets")

    def may_link(self, pairs: DataFrame) -> DataFrame:
        """Without the pairs that can't link by the parities of their sets."""
        side = lambda x: self.classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "pa", "pb")
        return met.mapInArrow(_close(self.percent), "a long, b long")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Pairs (``a``, ``b``) with their distance and whether they link."""
        pairs = materialize(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        named = lambda k, s: sets.select(F.col("key").alias(k), F.col("shingles").alias(s))
        # Pivots are few: their sets go to all tasks if they are small together, so that the others' sets
        # aren't sent once for each of their pivots.
        seconds = named("b", "sb").join(pairs.select("b").distinct(), "b")
        small = (seconds.agg(F.sum(F.octet_length("sb"))).first()[0] or 0) <= BROADCAST_BYTES
        met = pairs.join(named("a", "sa"), "a").join(F.broadcast(seconds) if small else seconds, "b")
        met = met.select("a", "b", "sa", "sb")
        counted = met.mapInArrow(_shared, "a long, b long, both long, either long")
        linked = 100 * F.col("both") >= self.percent * F.col("either")
        counted = counted.select("a", "b", (1 - F.col("both") / F.col("either")).alias("distance"), linked.alias("linked"))
        return materialize(counted, "measured")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes allow a link, and so do the places of the common shingle: of the first one in both, the
    shingles from there on must suffice."""
    col = lambda side, name: F.col(f"{side}.{name}")
    na, nb = col(a, "n"), col(b, "n")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    left = F.least(na - col(a, "at"), nb - col(b, "at"))
    return sizes & ((100 + percent) * left >= percent * (na + nb))


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``key``, ``component`` for every set that has a link."""
    ends = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    label = F.struct(F.col("first_id").alias("id"), F.col("key").alias("node"))
    nodes = reps.join(ends, "key").select(F.col("key").alias("node"), label.alias("label"))
    return least_labels(nodes, links).select(F.col("node").alias("key"), F.col("label").alias("component"))


def _members_of_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for region, shingles in zip(batch.column("region"), batch.column("shingles")):
            found = np.frombuffer(shingles.as_buffer(), np.int64)
            arrays = [pa.array(np.full(len(found), region.as_py(), np.int64)), pa.array(found)]
            yield pa.RecordBatch.from_arrays(arrays, ["region", "shingle"])


def _differences(percent: int):
    """Sizes of the differences from the centres, and of each the longest prefix that any partner may need."""
    up, down = 100 + percent, 100 - percent

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prefixes = [], []
            for n, shingles, centre in zip(*(batch.column(c) for c in ("n", "shingles", "centre"))):
                near = np.array([] if not centre.is_valid else centre.values.to_numpy(zero_copy_only=False), np.int64)
                mine = np.frombuffer(shingles.as_buffer(), np.int64)
                # What the centre hasn't comes first: it is rarer than what a member lacks.
                more, less = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((mine, near), (near, mine)))
                size, slack = len(more) + len(less), up * (len(more) + len(less)) - down * n.as_py()
                common = max(1, -(-(2 * slack + (-200 * down * n.as_py() // percent)) // (2 * up)))
                sizes.append(size)
                prefixes.append(np.concatenate([np.sort(more), np.sort(less)])[: max(0, size - common + 1)])
            arrays = [*(batch.column(c) for c in ("region", "key", "n")), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["region", "key", "n", "size", "differ"])

    return differ


def _recentre(large: DataFrame, measure: _Measure, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round over large regions: links that the centres prove, and the members' next regions.

    With H for the number of shingles that two sets of n and m don't share, they link if and only if
    (100 + percent) * H <= (100 - percent) * (n + m). The slack of a member, (100 + percent) * size of its
    difference - (100 - percent) * n, puts the triangle inequality in two lines: two members link if their
    slacks sum to zero at most, and otherwise, if they link, their differences have at least the
    (2 * (100 + percent))th part of that sum in common. The member of least slack is the core. Members inside
    link with it; any open link has an end outside, so it needs a common part, and a prefix of both differences
    in one order holds a shingle of it. A member outside may need a longer prefix to meet one inside: the
    further part is ``wide`` and meets none outside.
    """
    up, down = 100 + percent, 100 - percent
    # Regions of the same members give the same links: one of them goes on.
    same = large.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("sum"))
    same = same.groupBy("members", "sum").agg(F.min("region").alias("region")).select("region", "members")
    rows = materialize(large.join(same, "region").select("region", "key", "n", "members"), "region-members")
    sets = measure.sets(rows.select("key").distinct())

    draw = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) * F.col("members")
    sampled = rows.filter(draw < F.lit(CENTRE_MEMBERS << 20))
    drawn = sampled.groupBy("region").agg(F.count(F.lit(1)).alias("drawn"))
    held = sampled.join(sets, "key").select("region", "shingles").mapInArrow(_members_of_centre, "region long, shingle long")
    held = held.groupBy("region", "shingle").count().join(drawn, "region").filter("2 * count > drawn")
    centres = materialize(held.groupBy("region").agg(F.collect_list("shingle").alias("centre")), "centres")
    small = (centres.agg(F.sum(8 * F.size("centre"))).first()[0] or 0) <= BROADCAST_BYTES
    met = rows.join(sets, "key")
    met = met.join(F.broadcast(centres), "region", "left") if small else heavy_join(met, centres, "region", ["key"], "left")
    met = met.select("region", "key", "n", "shingles", "centre")
    met = met.mapInArrow(_differences(percent), "region long, key long, n int, size int, differ array<long>")
    met = materialize(met.withColumn("slack", (up * F.col("size") - down * F.col("n")).cast("long")), "differences")

    cores = met.groupBy("region").agg(F.min(F.struct("slack", "key")).alias("core"))
    met = heavy_join(met, materialize(cores, "cores"), "region", ["key"])
    met = met.withColumn("inside", F.col("slack") + F.col("core.slack") <= 0)
    links = met.filter("inside and key <> core.key").select(F.col("key").alias("a"), F.col("core.key").alias("b"))
    links = materialize(links.distinct(), "core-links")

    # The least slack of a partner: by the regions' members, and by the distance between both.
    by_distance = F.col("slack") - F.ceil(F.lit(200 * down) * F.col("n") / percent)
    least_outside = F.greatest("core.slack", 1 - F.col("core.slack"))
    common = lambda least: F.greatest(F.lit(1), F.ceil((F.col("slack") + F.greatest(least, by_distance)) / (2 * up)))
    met = met.withColumn("narrow", F.col("size") - common(least_outside) + 1)
    met = met.withColumn("length", F.when(F.col("inside"), F.col("narrow")).otherwise(F.col("size") - common(F.col("core.slack")) + 1))
    prefix = F.slice("differ", 1, F.greatest(F.lit(0), F.col("length")).cast("int"))
    met = met.select("region", "key", "n", "size", "slack", "inside", "narrow", F.posexplode(prefix).alias("at", "shingle"))
    region = F.xxhash64("region", "shingle").alias("region")
    return links, met.select(region, "key", "n", "size", "slack", "inside", (F.col("at") >= F.col("narrow")).alias("wide"), "at")


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``class_id`` (smallest id with the same set) and ``component_id``
    (smallest id that links reach).

    Two documents link when the distinct word shingles of both are at least ``percent`` percent of
    those of either. A text of fewer words is one shingle of all its words; a null or empty one has
    none, links with nothing and is a component of its own. Words are lower-cased in A-Z.

    1. Equal sets become one class, so copies cost nothing further.
    2. Classes meet in the regions of their rarest shingles: as many as a link can't all miss.
    3. Each region's pivot is the member with the fewest rare shingles, as the original of a family
       of edited copies is. All members are measured against it, exactly.
    4. Members that now share a component are settled. What is left of a region is joined directly
       if it has few members, else its centre settles those around it, and the others are joined
       again in the regions of their differences, of about half the members at most.

    Links inside a component that is known already aren't measured. Shingles are 64-bit hashes, sets
    are told apart by 128 bits. Rows without an id have their count, null class and component, and
    link with nothing. Repeated rows are copies. Ids are whole numbers; other columns are not read.
    An empty table gives an empty one.
    """
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with passing_tables(docs.sparkSession) as kept:
        every, named = _components(read, shingle, percent, kept)
    rows = every.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    of_class = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), of_class.alias("class_id"), own.alias("component_id"))


def _components(
    read: DataFrame, shingle: int, percent: int, kept: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``n``, ``digest`` of every row, and ``digest``, ``class_id``, ``component`` of every class; both are kept."""
    spark = read.sparkSession
    tables, share = _frequent(read, shingle)
    order = spark.sparkContext.broadcast(tables)
    summaries = materialize(read.mapInArrow(_summaries(shingle, percent, order), SUMMARY), "shingle-sets")
    every = kept(summaries.select("doc_id", "n", "digest"), "documents")
    first = lambda c: F.any_value(c).alias(c)
    reps = summaries.filter("doc_id is not null and digest is not null").groupBy("digest")
    reps = reps.agg(F.min("doc_id").alias("first_id"), first("n"), first("rare"), first("prefix"), first("parity"))
    reps = materialize(reps.withColumn("key", F.monotonically_increasing_id()), "classes")
    discard(summaries)
    measure = _Measure(read, reps, shingle, percent)

    index = _uncrowded(read, reps, shingle, percent, tables, share)
    index = index.select("key", "n", "rare", F.posexplode("prefix").alias("at", "region"))
    of_region = Window.partitionBy("region")
    # A member whose neighbours by size are too small and too large has no partner in the region.
    by_size = of_region.orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (
        100 * F.col("n") >= percent * F.lead("n").over(by_size)
    )
    members = index.withColumn("fits", F.coalesce(fits, F.lit(False))).filter("fits").drop("fits")
    pivot = F.min(F.struct("rare", "key", "n", "at")).over(of_region)
    members = materialize(members.withColumn("pivot", pivot), "members")

    side = members.select("region", "pivot", F.struct("key", "n", "at").alias("x"))
    pairs = side.filter(F.col("x.key") != F.col("pivot.key")).filter(_may_link("x", "pivot", percent))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("pivot.key").alias("b")).distinct()
    measured = measure(measure.may_link(pairs))
    links = measured.filter("linked").select("a", "b")
    labels = materialize(_labels(reps, links), "components")

    # The first regions are those of an empty centre: a set is its own difference.
    plain = {"size": F.col("n"), "slack": 2 * percent * F.col("n").cast("long"), "inside": F.lit(False), "wide": F.lit(False)}
    left = members.withColumns(plain).select("region", "key", "n", *plain, "at")
    done = [links]
    while True:
        small, large = _open_regions(left, labels, percent)
        large = _together(large) if len(done) == 1 else large
        found, labels = _connect(measure, reps, measure.may_link(_direct(small, percent)), labels, _all(done))
        done.append(found)
        if large.isEmpty():
            break
        links, left = _recentre(large, measure, percent)
        done.append(links)
        left = materialize(left, "members")
        labels = materialize(_labels(reps, _all(done)), "components")
    named = reps.select("key", "digest", "first_id").join(labels, "key", "left")
    named = named.select("digest", F.col("first_id").alias("class_id"), F.coalesce("component.id", "first_id").alias("component"))
    return every, kept(named, "class-components")


def _connect(
    measure: _Measure, reps: DataFrame, pairs: DataFrame, labels: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Links among ``pairs`` that join components, and the components then.

    While there are many pairs, each class measures one of its own per round, and pairs whose ends have
    come together meanwhile are settled: a family of copies costs about one pair for each member.
    """
    found = links.limit(0)
    pairs = materialize(pairs, "open-pairs")
    while True:
        many = pairs.count() > DIRECT_PAIRS
        chosen = pairs.groupBy("a").agg(F.min("b").alias("b")) if many else pairs
        measured = measure(chosen)
        found = materialize(found.unionByName(measured.filter("linked").select("a", "b")), "found-links")
        labels = materialize(_labels(reps, links.unionByName(found)), "components")
        if not many:
            return found, labels
        of = lambda end: labels.select(F.col("key").alias(end), F.col("component.node").alias(f"of_{end}"))
        left = pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti")
        left = left.join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = F.coalesce(F.col("of_a") != F.col("of_b"), F.lit(True))
        pairs = materialize(left.filter(apart).select("a", "b"), "open-pairs")


def _all(links: list[DataFrame]) -> DataFrame:
    whole = links[0]
    for more in links[1:]:
        whole = whole.unionByName(more)
    return whole


def _open_regions(left: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members, with their component's node as ``mine``, of regions that still hold two components or more and a
    member outside: those to join directly, and those to give a centre."""
    mine = left.join(labels.select("key", F.col("component.node").alias("node")), "key", "left")
    mine = materialize(mine.withColumn("mine", F.coalesce("node", "key")).drop("node"), "placed-members")
    regions = _live(mine, F.min(F.when(F.col("inside"), F.col("slack"))).alias("of_inside"),
                    F.min(F.when(~F.col("inside"), F.col("slack"))).alias("of_outside"),
                    F.min(F.when(~(F.col("inside") | F.col("wide")), F.col("slack"))).alias("of_narrow"))
    mine = heavy_join(mine, materialize(regions, "live-regions"), "region", ["key"])
    # Of the shingles that a pair shares in both prefixes, the first is at a place from which on enough can be in common.
    partner = F.when(F.col("inside"), F.col("of_outside")).when(F.col("wide"), F.col("of_inside"))
    partner = partner.otherwise(F.least("of_inside", "of_narrow"))
    enough = 2 * (100 + percent) * (F.col("size") - F.col("at")) >= F.col("slack") + partner
    mine = materialize(mine.filter(enough).select(*left.columns, "mine"), "placed-members")
    regions = materialize(_live(mine, F.count(F.lit(1)).alias("members")), "live-regions")
    mine = materialize(heavy_join(mine, regions, "region", ["key"]), "open-members")
    few = F.col("members") <= SMALL_REGION
    return mine.filter(few).drop("members"), mine.filter(~few).select("region", "key", "n").distinct()


def _together(large: DataFrame) -> DataFrame:
    """Large first regions whose members of least hash are the same as one region. A family is in a region for each shingle
    of its prefixes, of nearly the same members each time."""
    home = large.groupBy("region").agg(F.min(F.xxhash64("key")).alias("home"))
    met = heavy_join(large, materialize(home, "homes"), "region", ["key"])
    return materialize(met.select(F.col("home").alias("region"), "key", "n").distinct(), "joint-regions")


def _live(members: DataFrame, *more: Column) -> DataFrame:
    """Regions of two components or more with a member outside."""
    of = members.groupBy("region").agg(F.min("mine").alias("least"), F.max("mine").alias("most"), F.every("inside").alias("settled"), *more)
    return of.filter("least <> most and not settled").drop("least", "most", "settled")


def _direct(small: DataFrame, percent: int) -> DataFrame:
    """Pairs of a small region that lie in different components and may link: by their sizes, by the sizes of their
    differences (the triangle inequality), and by what can be in common from the place of the shared shingle on."""
    up, down = 100 + percent, 100 - percent
    side = lambda x: small.select("region", F.struct("key", "n", "size", "slack", "inside", "wide", "at", "mine").alias(x))
    x, y = (lambda name: F.col(f"x.{name}")), (lambda name: F.col(f"y.{name}"))
    both = x("n") + y("n")
    near = (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & (up * F.abs(x("size") - y("size")) <= down * both)
    left = F.least(x("size") - x("at"), y("size") - y("at"))
    enough = 2 * up * left >= x("slack") + y("slack")
    roles = (x("inside") != y("inside")) | ~(x("inside") | x("wide") | y("wide"))
    apart = (x("key") < y("key")) & (x("mine") != y("mine"))
    met = side("x").join(side("y"), "region").filter(apart & roles & near & enough)
    return met.select(x("key").alias("a"), y("key").alias("b")).distinct()
