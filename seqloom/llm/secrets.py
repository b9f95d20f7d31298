"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

All work is in built-in functions. Spans are ``kind``, ``start``, ``end`` in code points, the end
exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.arrays import let
from seqloom.session import materialize

SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Pattern:
    """Matches whose ``group`` has at least ``least`` characters; shorter ones use up their text."""

    kind: str
    regex: str
    group: int
    least: int


PATTERNS = (
    Pattern("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 18),
    Pattern("hex", r"[0-9a-f]{16,}", 0, 16),
)

# The alphabets in the order of their digits, the first that fits a token counts.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("random_hex", DIGITS + "abcdef"),
    ("random_hex", DIGITS + "ABCDEF"),
    ("random_base32", UPPER + "234567"),
    ("random_base64", UPPER + LOWER + DIGITS + "+/"),
    ("random_base64", UPPER + LOWER + DIGITS + "-_"),
)
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
# Parts of a run that fit one alphabet; a separator in the class must occur, so no part is tested twice.
STRETCHES = ((r"[A-Za-z0-9+/]{24,}", "[+/]"), (r"[A-Za-z0-9_-]{24,}", "[_-]"), (r"[A-Za-z0-9]{24,}", ""))
PLAIN_HEAD = r"^(?:[A-Za-z]*+[0-9]{0,4}+[+/_-]){1,64}"  # words, with few digits behind, before a separator
PLAIN_TAIL = r"(?:[+/_-][A-Za-z]*+[0-9]{0,4}+){1,64}$"
LEAST = 24
LONGEST_BAND = 8  # bands are powers of two of the length; longer tokens share the last one
BINS = 8  # of the alphabet in the chi-squared test
STEPS = 16  # steps of the p-value per factor of two
MAX_STEP = 1024
LEVEL, LEVEL_LENGTH, MAX_LEVEL = 0.05, 64, 0.25  # false-discovery level at that length; more for shorter tokens
_BLOCK = 256


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that the work stays near linear."""

    def scan(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
        return F.aggregate(values, start, step, lambda a: a["out"])

    def blocks(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(
            scan(sums),
            lambda offsets: F.flatten(
                F.transform(parts, lambda p, b: F.transform(scan(p), lambda x: x + F.get(offsets, b)))
            ),
        )

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(_BLOCK))
    return let(F.transform(starts, lambda s: F.slice(lengths, s, _BLOCK)), blocks)


def _spans(body: Column, regex: str, found: Column) -> Column:
    """Start, end and text of all matches, from the pieces between them."""

    def placed(gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            _before(steps),
            lambda base: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(base, i) + F.length(F.get(gaps, i))).alias("start"),
                    (F.get(base, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
                    m.alias("token"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return F.when(F.size(found) > 0, let(F.split(body, regex, -1), placed)).otherwise(empty)


def _base(body: Column, pattern: Pattern) -> Column:
    long_enough = lambda s: F.length(F.regexp_extract(s["token"], pattern.regex, pattern.group)) >= pattern.least
    spans = let(F.regexp_extract_all(body, F.lit(pattern.regex), F.lit(0)), lambda f: _spans(body, pattern.regex, f))
    return F.transform(
        F.filter(spans, long_enough), lambda s: F.struct(F.lit(pattern.kind).alias("kind"), s["start"], s["end"])
    )


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution by the logistic approximation, which holds its
    logarithm up to large values."""
    a = F.abs(z)
    return F.least(F.lit(1.0), 2 / (1 + F.exp(F.least(1.5976 * a + 0.070565 * a * a * a, F.lit(700.0)))))


def _p_value(digits: Column, size: Column) -> Column:
    """Least of three p-values under the hypothesis of independent uniform digits, times three."""
    n = F.size(digits).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    bins = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda b: F.size(F.filter(digits, lambda d: F.floor(d * BINS / size) == b)).cast("double"),
    )
    chi = total(F.transform(bins, lambda o: (o - n / BINS) * (o - n / BINS) / (n / BINS)))
    k = float(BINS - 1)
    cube = F.pow(chi / k, F.lit(1.0 / 3)) - (1 - 2 / (9 * k))
    z = cube / (2 / (9 * k)) ** 0.5
    uniform = F.when(z > 0, _normal_tail(z) / 2).otherwise(1.0)

    high = F.transform(digits, lambda d: d * 2 >= size)
    n1 = total(F.transform(high, lambda h: h.cast("double")))
    n2 = n - n1
    changes = lambda x: F.transform(x, lambda h, i: F.when((i > 0) & (h != F.get(x, i - 1)), 1.0).otherwise(0.0))
    runs = 1 + total(let(high, changes))
    mean = 2 * n1 * n2 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    in_runs = F.when(spread > 0, _normal_tail((runs - mean) / F.sqrt(spread))).otherwise(0.0)

    middle = (size - 1) / 2
    moved = F.transform(digits, lambda d: d - middle)
    around = total(F.transform(moved, lambda x: x * x))
    along = total(let(moved, lambda m: F.transform(m, lambda x, i: F.coalesce(x * F.get(m, i + 1), F.lit(0.0)))))
    serial = F.when(around > 0, _normal_tail((along / around) * F.sqrt(n))).otherwise(0.0)
    return F.least(F.lit(1.0), 3 * F.least(uniform, in_runs, serial))


def _parts(run: Column) -> Column:
    """Stretches of one alphabet in a run, and those with separators also without the plain words at their ends."""

    def place(start: Column, token: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), (start + F.length(token)).cast("int").alias("end"), token.alias("token"))

    def trimmed(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["token"], PLAIN_HEAD, 0))
        left = F.length(s["token"]) - head - F.length(F.regexp_extract(s["token"], PLAIN_TAIL, 0))
        return place(s["start"] + head, F.substr(s["token"], head + 1, F.greatest(left, F.lit(0))))

    def stretches(regex: str, separator: str) -> Column:
        found = F.regexp_extract_all(run["token"], F.lit(regex), F.lit(0))
        spans = let(found, lambda f: _spans(run["token"], regex, f))
        spans = F.transform(spans, lambda s: place(run["start"] + s["start"], s["token"]))
        if not separator:
            return spans
        spans = F.filter(spans, lambda s: s["token"].rlike(separator))

        def with_inner(whole: Column) -> Column:
            inner = F.zip_with(whole, F.transform(whole, trimmed), lambda s, t: F.when(t["end"] - t["start"] < s["end"] - s["start"], t))
            is_new = lambda t: t["token"].rlike(separator) & (F.length(t["token"]) >= LEAST)
            return F.concat(whole, F.filter(inner, lambda t: F.coalesce(is_new(t), F.lit(False))))

        return let(spans, with_inner)

    return F.concat(*[stretches(*s) for s in STRETCHES])


def _outermost(spans: Column) -> Column:
    """Spans that lie in no other one of them; of equal ones the first."""
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(-1).alias("reach"), none.alias("out"))

    def add(a: Column, s: Column) -> Column:
        grown = F.struct(s["end"].alias("reach"), F.concat(a["out"], F.array(F.struct(s["kind"], s["start"], s["end"]))).alias("out"))
        return F.when(s["end"] > a["reach"], grown).otherwise(a)

    keyed = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"], s["end"]))
    return F.when(F.size(spans) < 2, spans.cast(SPAN)).otherwise(F.aggregate(F.array_sort(keyed), start, add, lambda a: a["out"]))


def _candidates(body: Column) -> Column:
    """Parts of tokens that fit an alphabet, with their band and the step of their p-value."""

    def judged(span: Column) -> Column:
        token = span["token"]
        which = F.lit(None).cast("int")
        for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
            in_class = f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]+$"
            which = F.when(token.rlike(in_class), i).otherwise(which)

        def scored(e: Column) -> Column:
            letters = F.get(F.array(*[F.lit(a) for _, a in ENCODINGS]), e)
            # Split once: a character by its number would be looked for from the start of the token.
            place = lambda c: (F.call_function("locate", c, letters) - 1).cast("double")
            digits = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), place)
            p = let(digits, lambda d: _p_value(d, F.length(letters).cast("double")))
            step = F.least(F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(MAX_STEP)).cast("int")
            return F.struct(
                F.get(F.array(*[F.lit(k) for k, _ in ENCODINGS]), e).alias("kind"),
                span["start"],
                span["end"],
                F.least(F.floor(F.log2(F.length(token))), F.lit(LONGEST_BAND)).cast("int").alias("band"),
                F.when(e.isNotNull(), step).otherwise(MAX_STEP + 1).alias("step"),
            )

        return let(which, scored)

    runs = let(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda f: _spans(body, TOKEN, f))
    spans = F.flatten(F.transform(runs, _parts))
    return F.filter(F.transform(spans, judged), lambda c: c["step"] <= MAX_STEP)


def rejected_steps(candidates: DataFrame) -> DataFrame:
    """Per band the least step at which Benjamini and Hochberg's procedure rejects randomness.

    Counts per band and step are at most LONGEST_BAND x MAX_STEP rows, whatever the corpus.
    """
    counts = candidates.groupBy("band", "step").agg(F.count(F.lit(1)).alias("rows"))
    by_band = Window.partitionBy("band")
    from_low = by_band.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    level = F.least(F.lit(LEVEL) * LEVEL_LENGTH / F.pow(F.lit(2.0), F.col("band")), F.lit(MAX_LEVEL))
    ranked = counts.withColumns({"below": F.sum("rows").over(from_low), "all": F.sum("rows").over(by_band)})
    p = F.pow(F.lit(2.0), -F.col("step") / STEPS)
    return ranked.filter(p <= level * F.col("below") / F.col("all")).groupBy("band").agg(F.min("step").alias("least"))


def scan_secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every document, ``base`` (spans of PATTERNS) and ``spans`` (with the method's).

    A run of 24 or more of ``A-Za-z0-9+/_-`` is tested in parts: its stretches of the standard alphabet, of
    the one with ``-`` and ``_``, and of letters and digits, the first two also without the plain words at
    their ends. So a token joined to a path or a name is met both with and without it; of spans in one
    another the outermost counts. Shorter tokens are left to PATTERNS: below 24 digits (three for each
    bin) the tests cannot tell random digits from long words. A part is taken for a secret unless a chi-squared test
    of its digits, a runs test or a test of serial correlation shows that it isn't random. Which
    p-values count as such follows from the false-discovery rate within tokens of like length over
    the whole table; short tokens, for which the tests have less power, have a higher level. A token
    that overlaps a base span adds nothing.

    Null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an
    empty table. Columns outside ``keep`` are not read, so their names cannot clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], body.alias("body"))
    found = read.select(
        *names,
        F.array_sort(
            F.flatten(F.array(*[_base(F.col("body"), p) for p in PATTERNS])), _by_start
        ).alias("base"),
        _candidates(F.col("body")).alias("tokens"),
    )
    found = materialize(found, "secret-tokens")
    steps = rejected_steps(found.select(F.explode("tokens").alias("t")).select("t.*")).collect()
    least = F.lit(MAX_STEP + 1)
    band = lambda t: _chosen(t["band"], {r["band"]: r["least"] for r in steps}, least)
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = F.filter("tokens", lambda t: (t["step"] < band(t)) & apart(t))
    random = F.transform(random, lambda t: F.struct(t["kind"], t["start"], t["end"]))
    both = F.array_sort(F.concat("base", let(random, _outermost)), _by_start)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "base", both.alias("spans"))


def _chosen(band: Column, least: dict[int, int], otherwise: Column) -> Column:
    for b, s in least.items():
        otherwise = F.when(band == b, s).otherwise(otherwise)
    return otherwise


def _by_start(a: Column, b: Column) -> Column:
    """By start, then in the order of the kinds."""
    order = F.array(*[F.lit(k) for k in dict.fromkeys([*(p.kind for p in PATTERNS), *(k for k, _ in ENCODINGS)])])
    place = lambda s: s["start"].cast("long") * 16 + F.array_position(order, s["kind"])
    return F.signum(place(a) - place(b)).cast("int")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
