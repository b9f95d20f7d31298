"""The training-data operators against brute force, on texts with nulls, blanks, copies and ties."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import chat, jaccard, lines, mixing, neighbours, packing, quality, queries, secrets, substrings, warc
from seqloom.session import job_scratch, materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __words string, n_removed string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts():
    draw = random.Random(4)
    words = ["the", "of", "and", *("".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(400))]
    body = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = body(70)
    texts = [None, "", "  \n\t ", "one", "one two", "One  two", "<|endoftext|> a<s>\n\n b", "token: secret: abcdefghijklmnop"]
    texts += [body(120) + "\n" + passage + "\n" + body(40) for _ in range(4)]
    family = body(300).split()
    for _ in range(12):
        copy = list(family)
        for at in draw.sample(range(300), draw.randint(0, 8)):
            copy[at] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [body(80)] * 3 + [body(3000) + "\nx y\nx y\nx y\nx y\nz"]
    texts += ["same line here\nand another one\n" + body(60), "same line here \nand another one\n" + body(60)]
    texts += ["key AKIA" + "B7" * 9 + "é api_key='abcdefghijkl' " + "0f" * 10, "a b c d a b c d # $ |"]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", [None, "b", "a", "é"][i % 4], len(t or ""), "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[-1], None, None, None, None, None), rows[9], rows[9]]
    return materialize(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    wanted = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    for ranks in (None, queries.TOKENIZER[1]):
        packed = packing.pack(docs, path, ranks, window=64).collect()
        assert sorted(r["sequence_id"] for r in packed) == list(range(len(packed)))
        assert all(r["n_tokens"] == 64 for r in packed if r["sequence_id"] < len(packed) - 1)
        tokens = Counter()
        for r in packed:
            ids, at = np.frombuffer(bytes(r["ids"]), "<u4").tolist(), 0
            assert len(ids) == 64 or len(ids) == r["n_tokens"] == 1 << (len(ids).bit_length() - 1)
            for p in r["pieces"]:
                assert p["offset"] == at
                at += p["length"]
                name = p["doc_id"]
                if name is not None:
                    assert ids[p["offset"] : at] == wanted[name][p["start"] : p["start"] + p["length"]]
                    assert p["doc_tokens"] == len(wanted[name])
                tokens[name] += p["length"]
            assert at == r["n_tokens"]
        assert all(tokens[i] == len(w) * (3 if i == 9 else 1) for i, w in wanted.items())
    piece = packing.piece_digests(packing.pack(docs, path, window=64)).filter("doc_id = 11 and start = 0").first()
    first = np.array(wanted[11][: piece["length"]], "<u4").tobytes()
    assert piece["ids_crc32"] == zlib.crc32(first)
    assert packing.pack(empty, path).collect() == []


def test_line_dedup(docs, empty):
    got = {}
    for r in lines.line_dedup(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    first, kept = {}, {}
    for i, t in enumerate(TEXTS):
        rows = (t or "").split("\n")
        full = [k for k, x in enumerate(rows) if x.strip(" \t\n\x0b\x0c\r")]
        keys, gone = [rows[k].strip(" \t\n\x0b\x0c\r") for k in full], set()
        for k in range(len(full) - 1):
            place = first.setdefault((keys[k], keys[k + 1]), (i, k))
            if place[0] < i or place[1] + 2 <= k:
                gone |= {full[k], full[k + 1]}
        kept[i] = None if t is None else "\n".join(x for k, x in enumerate(rows) if k not in gone)
        assert {(r["text"], r["n_lines"], r["n_removed"]) for r in got[i]} == {(kept[i], len(full), len(gone))}
    assert len(got[9]) == 3 and got[None][0]["text"] == TEXTS[-1]
    assert any(kept[i] != t for i, t in enumerate(TEXTS))
    assert lines.line_dedup(empty).collect() == []


def test_line_dedup_of_long_single_lines(spark, docs, empty):
    texts = [*TEXTS, "x" * 60, "a\n" + "x" * 60 + " \nb", "y" * 59, "y" * 59, "p q r s t u v w x", "p q r s t u v w x"]
    texts += ["a b c d e f g h i j\n1\na b c d e f g h i j\n2", "3\n a b c d e f g h i j", "a b c d e f g h i j"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(lines.line_dedup(table, long_line=lines.LONG_LINE))
    first, total = {}, 0
    for i, t in enumerate(texts):
        rows = (t or "").split("\n")
        full = [k for k, x in enumerate(rows) if WORD.search(x)]
        keys, gone = [rows[k].strip(" \t\n\x0b\x0c\r") for k in full], set()
        for size in (1, 2):
            for k in range(len(full) - size + 1):
                if size == 1 and len(WORD.findall(keys[k])) < 10 and len(keys[k]) < 60:
                    continue
                place = first.setdefault(tuple(keys[k : k + size]), (i, k))
                if place[0] < i or place[1] + size <= k:
                    gone |= set(full[k : k + size])
        kept = None if t is None else "\n".join(x for k, x in enumerate(rows) if k not in gone)
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == (kept, len(full), len(gone))
        total += len(gone)
    n = len(TEXTS)
    assert [got[n + k]["n_removed"] for k in range(9)] == [0, 1, 0, 0, 0, 0, 1, 1, 1] and total > 5
    passage = TEXTS[8].split("\n")[1]
    staged = corpus_pipeline.line_dedup(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert {r["doc_id"] for r in staged.filter(staged["text"].contains(passage)).collect()} == {8}
    assert lines.line_dedup(empty, long_line=lines.LONG_LINE).collect() == []


@pytest.mark.parametrize("size", [1, 3, 5])
@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_line_dedup_of_other_sizes_and_clashing_names(spark, monkeypatch, size, bound):
    monkeypatch.setattr(lines, "BROADCAST_RUNS", bound)
    draw, names = random.Random(size), ["row", "key", "cut", "runs", "n_lines"]
    texts = ["\n".join(draw.choice("ab") for _ in range(draw.randint(0, 14))) for _ in range(40)]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(n + ' string' for n in names)}").repartition(3)
    got = by_id(lines.line_dedup(table, min_lines=size))
    first, total = {}, 0
    for i, t in enumerate(texts):
        rows_of, gone = [x for x in t.split("\n") if x], set()
        for k in range(len(rows_of) - size + 1):
            place = first.setdefault(tuple(rows_of[k : k + size]), (i, k))
            if place[0] < i or place[1] + size <= k:
                gone |= set(range(k, k + size))
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert [got[i][n] for n in names[:4]] == [f"{n}{i}" for n in names[:4]] and got[i]["n_removed"] == len(gone)
        total += len(gone)
    assert total > 20


def test_winnowing_selects_few_lines():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    chosen = lines._selected(hashes, 9)
    assert all(chosen[i] - i in range(9) and hashes[chosen[i]] == hashes[i : i + 9].min() for i in range(len(chosen)))
    assert len(set(chosen.tolist())) < 2.4 * 10_000 / 10
    assert lines._selected(np.zeros(5, np.uint64), 3).tolist() == [2, 3, 4]  # of equal ones the last


def test_secret_scan(docs, empty):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    got = by_id(secrets.scan_secrets(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [tuple(s) for s in got[i]["base"]] == [(k, a, b) for a, _, k, b in sorted(spans)]
    assert secrets.scan_secrets(empty).collect() == []


def test_randomness_battery(spark):
    draw = random.Random(2)
    alphabet = secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/"
    tokens = ["".join(draw.choices(alphabet, k=40)) for _ in range(50)]
    plain = ["thequickbrownfoxjumpsoverthelazydogandruns", "m" * 40, "mn" * 25, "AAAABBBBCCCCDDDDEEEEFFFFGGGGHHHH"]
    rows = [(i, f"é {t} end") for i, t in enumerate(tokens + plain)]
    got = by_id(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(len(got[i]["spans"]) == 1 for i in range(50)) >= 45
    assert all(tuple(s) == ("random_base64", 2, 42) for i in range(50) for s in got[i]["spans"])
    assert not any(got[i]["spans"] for i in range(50, 54))


def test_random_tokens_inside_longer_runs(spark):
    draw = random.Random(6)
    alnum = secrets.UPPER + secrets.LOWER + secrets.DIGITS
    letters = lambda more, n=40: "A" + "".join(draw.choices(alnum + more, k=n - 2)) + "9"
    shapes = [("com/my-app/v1_x/", letters("")), ("my_key-", letters("+/")), ("path/to/", letters("-_")), ("some/plain/words/", letters(""))]
    rows = []
    for _ in range(40):
        for head, _ in shapes:
            token = letters({"my_key-": "+/", "path/to/": "-_"}.get(head, ""))
            rows.append((len(rows), f"see {head}{token} end", 4 + len(head), 4 + len(head) + len(token)))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    words = [(1000 + i, w) for i, w in enumerate(["m" * 38 + "/b-c", "-" * 500, "a/" * 500 + "-_"])]
    got = by_id(secrets.scan_secrets(table.union(spark.createDataFrame(words, "doc_id long, text string"))))
    met = Counter()
    for i, text, start, end in rows:
        covers = [s for s in got[i]["spans"] if s["start"] <= start + 1 and s["end"] >= end - 1]
        met[i % 4] += bool(covers)
        assert all(4 <= s["start"] < s["end"] <= end for s in got[i]["spans"])
    assert all(met[k] >= 34 for k in range(4)), met
    assert not got[1000]["spans"] and not got[1001]["spans"] and not got[1002]["spans"]


def test_secret_scan_of_a_very_long_token(spark):
    draw = random.Random(7)
    token = "".join(draw.choices(secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/", k=400_000))
    table = spark.createDataFrame([(1, f"data {token} end"), (2, "x" * 100_000)], "doc_id long, text string")
    start = time.monotonic()
    got = by_id(secrets.scan_secrets(table))
    assert [tuple(s) for s in got[1]["spans"]] == [("random_base64", 5, 400_005)] and not got[2]["spans"]
    assert time.monotonic() - start < 60  # a scan for each character takes several minutes


def brute_components(size, percent):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[a] < least[b]:
                    least[b], changed = least[a], True
    return {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize("limits", [None, (2, 3, 3)])
def test_jaccard_join(docs, empty, monkeypatch, limits):
    if limits:
        for name, value in zip(("SMALL_REGION", "CENTRE_MEMBERS", "DIRECT_PAIRS"), limits):
            monkeypatch.setattr(jaccard, name, value)
    rows = jaccard.jaccard_components(docs, 3, 90).collect()
    assert len(rows) == len(TEXTS) + 3
    want = brute_components(3, 90)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert [(r["class_id"], r["component_id"]) for r in rows if r["doc_id"] is None] == [(None, None)]
    if not limits:
        assert jaccard.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("size,percent,members", [(3, 90, 8), (5, 80, 32)])
def test_jaccard_join_of_a_family(spark, monkeypatch, size, percent, members):
    """A family of edited copies, some of them families of their own, against all pairs; centres are at work."""
    draw = random.Random(size)
    vocabulary = [f"w{k}" for k in range(3000)]
    root = draw.choices(vocabulary, k=200)
    texts = []
    for k in range(400):
        copy = list(root if k % 5 or k < 20 else texts[k // 5].split())
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = [] if k % 2 else [draw.choice(vocabulary[: 3000 if k % 3 else 20])]
        texts.append(" ".join(copy))
    texts += [" ".join(draw.choices(vocabulary, k=150)) for _ in range(40)]
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            both = len(x & sets[b])
            if label[a] != label[b] and 100 * both >= percent * (len(x) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    rounds = []
    recentre = jaccard._recentre
    monkeypatch.setattr(jaccard, "_recentre", lambda *args: rounds.append(1) or recentre(*args))
    monkeypatch.setattr(jaccard, "SMALL_REGION", members)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, percent)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label))
    assert 1 < len(set(label)) - 40 < 390 and 1 <= len(rounds) <= 12


def quoting_texts(draw):
    """Texts of unlike words that quote one passage, the last a near copy of the first."""
    words = lambda k: [f"w{draw.randrange(10**6)}" for _ in range(k)]
    passage = words(12)
    texts = [" ".join(words(draw.randint(10, 60)) + passage + words(draw.randint(10, 60))) for _ in range(300)]
    return [*texts, f"{texts[0]} more"]


def test_jaccard_join_of_a_passage_in_many_texts(spark, monkeypatch):
    """The passage that a small sample misses is taken last: no region holds all texts, and the near copy is found."""
    texts = quoting_texts(random.Random(3))
    rounds, recentre = [], jaccard._recentre
    monkeypatch.setattr(jaccard, "_recentre", lambda *args: rounds.append(1) or recentre(*args))
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(jaccard, "SMALL_REGION", 64)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{k: k for k in range(300)}, 300: 0}
    assert not rounds


def test_jaccard_join_takes_a_family_as_one_region(spark, monkeypatch):
    """The regions of all shingles of a family are joined as a few, and only what the result reads stays on disk."""
    draw = random.Random(4)
    root = [f"w{k}" for k in range(200)]
    texts = [" ".join(f"x{draw.randrange(10**6)}" if draw.random() < 0.04 else w for w in root) for _ in range(120)]
    given, recentre = [], jaccard._recentre
    monkeypatch.setattr(jaccard, "_recentre", lambda large, *args: given.append(large.count()) or recentre(large, *args))
    monkeypatch.setattr(jaccard, "SMALL_REGION", 16)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 1)
    folder = Path(job_scratch(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 80)
    got = {r["doc_id"]: r["component_id"] for r in got.collect()}
    kept = {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before}
    assert kept == {"documents", "class-components"}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label, changed = list(range(120)), True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if label[a] < label[b] and 100 * len(x & y) >= 80 * len(x | y):
                    label[b], changed = label[a], True
    assert got == dict(enumerate(label))
    assert given and given[0] <= 5 * 120


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs, (5, 2, 1)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in rows) == sorted([*map(size, TEXTS), size(TEXTS[-1]), *[size(TEXTS[9])] * 2])
    totals, taken, targets, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, share = dict(zip(order, (5, 2, 1, 5))), {}
    while len(share) < len(order):
        free = [s for s in order if s not in share]
        level = (sum(totals.values()) - sum(share.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * totals[s]]
        share |= {s: 3 * totals[s] for s in over} if over else {s: level * weight[s] for s in free}
    assert targets == pytest.approx(share)
    assert all(r["copies"] <= 3 for r in rows)
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 for s in order)
    again = mixing.mix_sources(docs.repartition(5), (5, 2, 1)).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in again) == Counter((r["doc_id"], r["copies"]) for r in rows)
    mixed = mixing.mix_sources(docs, (5, 2, 1))
    assert mixing.repeat_copies(docs, mixed).count() == sum(r["copies"] for r in rows)
    clashing = docs.withColumnsRenamed({"__words": "__u", "n_removed": "__copies"})
    repeated = mixing.repeat_copies(clashing, mixed)
    assert repeated.columns == clashing.columns
    assert repeated.filter("doc_id is not null and (__u <> 'x' or __copies <> 'y')").isEmpty() and repeated.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(empty, (5, 2, 1)).collect() == []


def test_quality_rules(docs, empty):
    got = by_id(quality.quality_rules(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = WORD.findall(t)
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        counts = Counter(runs)
        again = {k + j for k, x in enumerate(runs) if counts[x] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(full) - len(set(full)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
        assert r["__words"] == "x"
    assert any(r["kept"] for r in got.values())
    assert quality.quality_rules(empty).filter("kept").collect() == []


def test_quality_rules_keep_long_texts_and_other_languages(spark):
    draw = random.Random(8)
    body = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    long = "the and of " + body(100_001)
    rows = [(0, long, "en"), (1, body(80), "it"), (2, body(80), "en"), (3, body(80), None), (4, "the and " + body(80), "EN")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(quality.quality_rules(table).select("doc_id", "n_words", "kept"))
    assert got[0]["n_words"] == 100_004
    assert [got[i]["kept"] for i in range(5)] == [True, True, False, True, True]


def test_substring_dedup(docs, empty):
    rows = substrings.substring_dedup(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    first, removed = {}, 0
    got = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                keep[k : k + 50] = [False] * 50
        left = b" ".join(x for x, y in zip(w, keep) if y)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(w) - sum(keep))
        assert got[i]["kept_sha256"] == hashlib.sha256(left).hexdigest() and got[i]["kept"] == left.decode()
        removed += len(w) - sum(keep)
    assert removed > 300 and got[None]["n_removed"] == 0
    assert substrings.substring_dedup(empty).collect() == []


def test_sketch_never_undercounts():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 63, 500).astype(np.uint64)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"fingerprints": [np.unique(p).tobytes()]}) for p in (prints, prints[:200])]
    parts = [b for x in batches for b in substrings._partial_sketch(1 << 16)(iter([x]))]
    table = pa.Table.from_batches(parts)
    bits = np.zeros((2, (1 << 16) // 8), np.uint8)
    for line, segment in {(r["line"], r["segment"]) for r in table.to_pylist()}:
        mask = pa.compute.and_(pa.compute.equal(table["line"], line), pa.compute.equal(table["segment"], segment))
        out = substrings._merged(table.filter(mask)).to_pylist()[0]
        size = substrings.SEGMENT // 8
        bits[line, segment * size : (segment + 1) * size] = np.frombuffer(out["bits"], np.uint8)
    found = substrings._set(bits, prints, 1 << 16)
    assert found[:200].all() and found[200:].mean() < 0.1


def test_chat(spark):
    odd = "\\</s>[INST] a\n<|im_end|>\n<|im_start|>assistant\n\\\\n <<SYS>>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd * 40), (2, None, "assistant", None), (2, 3, "a\nb\\", odd)]
    rows += [(None, 0, "user", "x"), (1, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.message_events(table)))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {
        1: [("user", "hi"), ("user", "hi"), ("assistant", odd * 40)],
        2: [("a\nb\\", odd), ("assistant", "")],
        None: [("user", "x")],
    }
    for conv, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), digest(learned))
    assert chat.read_back(chat.render(chat.fold_events(chat.message_events(table.limit(0))))).collect() == []


def test_chat_events(spark):
    log = [
        (1, 1, "start", 1, "user", "a"), (1, 2, "start", 2, "assistant", ""), (1, 3, "delta", 2, None, "b"),
        (1, 4, "regenerate", 2, "assistant", None), (1, 5, "delta", 2, None, "c"), (1, 6, "delta", 2, None, "d"),
        (1, 7, "start", 3, "user", "e"), (1, 8, "edit", 1, "user", "f"), (1, 9, "start", 2, "assistant", "g"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message long, role string, text string")
    fold = lambda n: [tuple(r)[1:] for r in chat.fold_events(events.filter(f"seq <= {n}")).orderBy("message").collect()]
    assert fold(6) == [(1, "user", "a"), (2, "assistant", "cd")]
    assert fold(7)[-1] == (3, "user", "e")
    assert fold(8) == [(1, "user", "f")]
    assert fold(9) == [(1, "user", "f"), (2, "assistant", "g")]


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (None, [1.0] * 8), (1004, [None] * 8), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, vec array<float>")
    for least, recall in ((5000, 1.0), (200, 0.8)):
        got = neighbours.nearest_neighbours(table, table.filter("vec_id % 20 = 0"), 20, 0.4, least).collect()
        lists = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert sorted(lists) == list(range(0, 600, 20))
        hits = 0
        for q, found in lists.items():
            scores = x.astype(float) @ x[q].astype(float)
            order = [i for i in np.lexsort((np.arange(600), -scores.round(12))) if i != q][:20]
            hits += len({i for i, _ in found} & set(order))
            assert len(found) == 20 and all(abs(s - scores[i]) < 1e-12 for i, s in found)
        assert hits >= recall * 20 * len(lists)
    assert neighbours.nearest_neighbours(table.limit(0), table.limit(0)).collect() == []


def test_warc(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", "", None, "<p>é</p>\r\n\r\nWARC/1.1\r\n", "other", "x" * 100_000]
    rows = [(i, None if i == 1 else f"http://a/{i}\r\nX: y", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.mode("overwrite").parquet(at := f"{queries.scratch_path(spark, 'pages')}/pages.parquet")
    got = {tuple(r) for r in queries.op10_warc(spark, at.removesuffix("/pages.parquet")).collect()}
    groups = {}
    for i, h in enumerate(html):
        groups.setdefault((h or "").encode(), []).append(i)
    want = set()
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for i in ids:
            last = i == max(ids)
            want.add((i, len(body), digest, "response" if last else "revisit", None if last else max(ids)))
    assert got == want
    payloads, headers = warc.store(pages, warc.make_records(pages))
    assert payloads.count() == len(groups) and headers.count() == len(html)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_warc_of_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    rows = [(7, "u", "a", "x"), (7, "u", "a", "x"), (None, "u", "a", None), (3, None, "a", "x"), (None, None, None, "x"), (4, "v", "bb", "x")]
    at = f"{queries.scratch_path(spark, 'odd-pages')}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3).write.parquet(at)
    pages = spark.read.parquet(at)
    records = warc.make_records(pages)
    payloads, headers = warc.store(pages, records)
    assert sorted(r["payload"] for r in payloads.collect()) == ["", "a", "bb"]
    texts = [r["record"] for r in warc.reconstruct(payloads, headers).collect()]
    kinds = Counter((re.search("WARC-Type: (.*)\r", t)[1], t.split("\r\n\r\n", 1)[1]) for t in texts)
    assert kinds == {("response", "a"): 3, ("revisit", ""): 1, ("response", ""): 1, ("response", "bb"): 1}
    sized = warc.make_records(pages, min_bytes=2)
    assert sized.filter("refers_to is not null").count() == 0
    nothing = pages.limit(0)
    assert [t.count() for t in warc.store(nothing, warc.make_records(nothing))] == [0, 0]
    with pytest.raises(ValueError):
        warc.store(pages.filter("page_id = 4"), records)


def test_pipeline(spark, docs):
    kept, tables = docs.select("doc_id", "text", "lang", "source", "n_chars"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, ""), "stage")
        tables.append(kept)
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    left = [[r["doc_id"] for r in t.select("doc_id").collect()] for t in tables]
    assert {9, 10, 11} <= set(left[0]) and not {0, 1, 2, 3} & set(left[0])
    family = range(12, 24)
    parts = {i: c for i, (_, c) in brute_components(5, 80).items() if i in family}
    assert {i for i in left[2] if i in family} <= set(family) and len([i for i in left[2] if i in family]) <= len(set(parts.values()))
    assert left[2].count(9) == 1
    assert set(left[3]) <= set(left[2]) and set(left[4]) == set(left[3])
