"""Resampling, spelling variants and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from seqloom.llm import bpe, queries, resample, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
UPPER = re.compile("[A-Z]")
lowered = lambda s: UPPER.sub(lambda m: m[0].lower(), s)


def texts():
    draw = random.Random(5)
    found = [None, "", " ", "a", "Zz9_9 é-É", "<|endoftext|>", "'s 'll  x\n\n y \t", "q" * 5000 + " " + "é" * 40, "\x00\x7f", "中" * 100]
    found += ["".join(draw.choice("abcXYZ09é中 _-\n'") for _ in range(draw.randint(0, 400))) for _ in range(60)]
    return found


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1], None, None, None)] + [(12, TEXTS[12], "x", 1, "y")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, weight long, word string").repartition(3)


def reference_encoding():
    ranks = bpe.read_ranks(open(RANKS).read())
    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_the_ids_of_the_library(docs):
    library = reference_encoding()
    coded = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert set(coded.columns) == {"doc_id", "text", "ids", "weight", "word", "n_tokens", "decoded"}
    rows = coded.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([*range(len(TEXTS)), None, 12, 12])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(r["text"] or "") and len(ids) == r["n_tokens"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(docs.limit(0), RANKS).collect() == []
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS), RANKS).collect() == []


def test_bpe_merges_of_pieces():
    library = reference_encoding()
    merger, rule = bpe.Merger(bpe.Vocabulary(bpe.read_ranks(open(RANKS).read()))), re.compile(bpe.splitter())
    draw = random.Random(3)
    some = [t.decode("utf-8", "ignore") for t in draw.sample(sorted(library._mergeable_ranks), 600)]
    cases = ["".join(draw.choices(some, k=8)) for _ in range(300)]
    cases += ["".join(map(chr, draw.choices(range(0x20, 0xD800), k=30))) for _ in range(300)]
    cases += ["".join(map(chr, draw.choices(range(0x10000, 0x110000), k=30))) for _ in range(100)]
    cases += ["".join(draw.choices(alphabet, k=60)) for alphabet in ("ab", "aA ", "=-", "01 ", "  \n") for _ in range(60)]
    for s in cases:
        assert [i for piece in rule.findall(s) for i in merger.ids(piece)] == library.encode_ordinary(s)
    for s in ("a" * 200_000, "ab" * 50_000, " " * 50_000):  # one piece each; time in proportion
        assert merger.ids(s) == library.encode_ordinary(s)


def test_bpe_of_a_vocabulary_with_ties():
    # "aaa" from "aa" and "a": in "aaaa" the left pair goes first.
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aaa": 3, b"ab": 4, b"aab": 5}
    library = tiktoken.Encoding("small", pat_str="[ab]+", mergeable_ranks=ranks, special_tokens={})
    merger = bpe.Merger(bpe.Vocabulary(ranks))
    for n in range(1, 11):
        for code in range(2**n):
            s = "".join("ab"[code >> k & 1] for k in range(n))
            assert merger.ids(s) == library.encode_ordinary(s), s


def test_bpe_query(spark):
    library, sf = reference_encoding(), "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert tuple(got[r["doc_id"]])[1:] == want


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("depth", [2, 32])
def test_word_hashes(depth):
    hasher = resample.WordHasher(depth)
    more = ["a" * n + "B" * (n // 2) for n in range(70)] + ["x" * 300_000]
    for part in (pa.array(TEXTS + more), pa.array(TEXTS + more).slice(4, 60), pa.array([None], pa.string()), pa.array([], pa.string())):
        got = []
        for _, data, bounds in resample._slices(part):
            starts, ends = hasher.spans(data, bounds)
            found, cuts = hasher.hashes(data, starts, ends), np.searchsorted(starts, bounds)
            got += [found[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert got == [[zlib.crc32(w) for w in WORD.findall(lowered(t or "").encode())] for t in part.to_pylist()]


@pytest.mark.parametrize("buckets", [50, 70_000])
def test_importance_resampling(docs, buckets):
    spark = docs.sparkSession
    wanted = ["abc é zz9", None, "abc", "中"]
    target = spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string")
    features = lambda t: [zlib.crc32(w) % buckets for w in WORD.findall(lowered(t or "").encode())]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1])] + [(12, TEXTS[12])] * 2
    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in wanted for b in features(x))
    whole_s, whole_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    scored = []
    for i, x in rows:
        found = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in found)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in scored if r[1] >= 5), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: 30 * len(order) // 100]
    want = Counter((*r, k + 1) for k, r in enumerate(drawn))
    want += Counter((*r, None) for r in (Counter(scored) - Counter(drawn)).elements())
    got = resample.importance_resample(docs, target, buckets, percent=30, min_words=5, seed="7").collect()
    assert Counter(map(tuple, got)) == want and len(drawn) > 5


def test_importance_resampling_of_empty_tables(docs):
    nothing = docs.limit(0)
    assert resample.importance_resample(nothing, docs).collect() == []
    assert resample.importance_resample(docs, nothing).filter("rank is not null").count() > 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(known, factor):
    near = {w: [v for v in known if one_edit(w, v)] for w in known}
    best = {w: min(vs, key=lambda v: (-known[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if known[v] >= factor * known[w]}
    want = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        want.add((w, form.get(w), root, n, len(near[w]), known[form[w]] if w in form else None))
    return want


@pytest.mark.parametrize("group, tile", [(4096, 64), (3, 2)])
def test_spelling_variants(spark, monkeypatch, group, tile):
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    draw, known = random.Random(9), {}
    for _ in range(25):
        word = "".join(draw.choices("abéÿ", k=draw.randint(6, 11)))
        known[word] = 10 ** draw.randint(0, 4)
        for _ in range(10):
            k, how = draw.randrange(len(word) + 1), draw.randrange(3)
            other = word[:k] + (draw.choice("abéÿ") if how else "") + word[k + (how != 1) :]
            known.setdefault(other, draw.choice([2, 2, 5, 50]))
            word = other if draw.random() < 0.3 else word
    known |= {"a" * 7: 3, "a" * 8: 30, "a" * 9: 300, "a" * 10: 3000, "z" * 40_000: 2, "z" * 39_999: 20}
    rows = [*known.items(), (None, 4), ("aaaaaaab", 1), ("aaaaaaab", 1)]
    known["aaaaaaab"] = 2
    table = spark.createDataFrame([(*r, "x") for r in rows], "word string, n long, length string")
    got = spelling.spelling_variants(table.repartition(4)).collect()
    want = brute_variants(known, 10)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len({r[2] for r in want}) < len(want) - 10 and any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling.spelling_variants(table.limit(0)).collect() == []


def test_noisy_words(spark, docs):
    found, more = Counter(), ["Vièlement viÈlement", "abcdefg" * 3 + " ABCDEFGH x", "straße größere Größere ×÷", None]
    rows = [(i, (t or "") + " " + (more[i % 4] or "")) for i, t in enumerate(TEXTS * 20)] + [(None, "nothing nothing"), (1, None)]
    for i, t in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            found[word] += len(word) >= 7
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(spelling.vocabulary(spelling.noisy_words(table)).collect())
    assert got == {w: n for w, n in found.items() if n > 1} and "vièlement" in got and "straße" not in got
    assert spelling.noisy_words(docs.limit(0)).collect() == []
    assert spelling.noisy_words(table, None, 8).filter("length(word) < 8").isEmpty()
