"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.arrays import let
from seqloom.llm.words import SPACE, WORD, free_names, words_of

# Fixed values.
SYMBOLS = "[#*$%&|<>]"
STOP_WORDS = (
    "the be to of and that have with in is it for on was "
    "de la le et les des une en que los el un por con "
    "der die und das den von zu ist nicht ein"
).split()
STOP_LANGS = ("en", "fr", "es", "de")  # the languages of these words


@dataclass(frozen=True)
class Rule:
    """A document fails when the measure is below ``low`` or above ``high``."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=50),
    Rule("repeat_share", high=0.5),
    Rule("mean_word_chars", low=2.5, high=12.0),
    Rule("symbol_share", high=0.1),
    Rule("no_letter_share", high=0.2),
    Rule("upper_share", high=0.4),
    Rule("stop_words", low=2),
    Rule("dup_line_share", high=0.5),
    Rule("bullet_line_share", high=0.9),
    Rule("ellipsis_line_share", high=0.3),
)
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_share", high=0.5))

_IN_WORD = rf"(?<!{WORD[:-1]})"
_WORD_END = rf"(?!{WORD[:-1]})"


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first included."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def covered(at: Column) -> Column:
        gap = lambda p, k: F.when(k + 1 < F.size(at), F.least(F.get(at, k + 1) - p, F.lit(3))).otherwise(3)
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda total, g: total + g)

    def twins(ordered: Column, key) -> Column:
        same = lambda x, k: (key(F.get(ordered, k - 1)) == key(x)) | (key(F.get(ordered, k + 1)) == key(x))
        return F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False)))

    def places(hashes: Column) -> Column:
        # First by one number of hash and place, which sorts fast but has fewer hash bits; then the
        # few that have a twin there by the whole hash.
        bits = F.ceil(F.log2(F.size(hashes) + 1)).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        near = let(packed, lambda p: twins(p, lambda x: F.call_function("shiftright", x, bits)))
        pairs = F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))
        pairs = F.array_sort(F.transform(pairs, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
        found = F.transform(let(pairs, lambda p: twins(p, lambda x: x["h"])), lambda x: x["i"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(found), covered)).otherwise(0)

    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(hashes, places)).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _verdict(rules: Sequence[Rule], measures: dict[str, Column]) -> Column:
    verdict = F.lit(True)
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= rule.high, F.lit(True))
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, lang: str = "lang") -> DataFrame:
    """Every document with its counts, ``base_failed`` and the verdict ``kept`` of the threshold table.

    The rule on stop words applies where the column ``lang`` names one of STOP_LANGS; without that, or
    in another language, the ratios alone decide.

    The rows stay as they are: repeated rows and ties are judged one by one, null and empty texts
    have no words and fail, an empty table gives an empty table. Other columns pass through; one
    that has the name of a result column is replaced. Three-word windows are compared by 64-bit
    hashes inside one text. Nothing is shuffled.
    """
    words_name, lines_name = free_names(docs.columns, "__words", "__lines")
    body, found = F.coalesce(F.col(text), F.lit("")), F.col(words_name)
    spelled = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    counted = docs.withColumn(words_name, words_of(F.col(text))).withColumn(lines_name, lines)
    counts = {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines_name).cast("long"),
        "n_dup_lines": (F.size(lines_name) - F.size(F.array_distinct(lines_name))).cast("long"),
        "n_repeat_words": _repeated_words(found).cast("long"),
        "n_stop_words": F.size(F.array_intersect(found, F.array(*map(F.lit, spelled)))).cast("long"),
        "n_no_letter": F.regexp_count(body, F.lit(rf"{_IN_WORD}[^\p{{L}}\x20\x09-\x0D]+{_WORD_END}")).cast("long"),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines_name, lambda x: x.rlike(rf"^{SPACE}*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines_name, lambda x: x.rlike(rf"(\.\.\.|…){SPACE}*$"))).cast("long"),
    }
    # One generated row for each document: a filter on the verdict stays above it, so that no count is
    # worked out once for the filter and once for the result.
    row = F.inline(F.array(F.struct(*[c.alias(name) for name, c in counts.items()])))
    counted = counted.drop(*counts).select("*", row).drop(words_name, lines_name)
    n, lines = F.col("n_words"), F.col("n_lines")
    known = F.coalesce(F.lower(F.col(lang)).isin(*STOP_LANGS), F.lit(False)) if lang in docs.columns else F.lit(False)
    measures = {
        "n_words": n,
        "repeat_share": _share(F.col("n_repeat_words"), n),
        "mean_word_chars": _share(F.col("word_chars"), n),
        "symbol_share": _share(F.col("n_symbols"), n),
        "no_letter_share": _share(F.col("n_no_letter"), n),
        "upper_share": _share(F.col("n_upper"), F.col("word_chars")),
        # Null, which no rule fails, where the list says nothing about the language.
        "stop_words": F.when(known, F.col("n_stop_words")),
        "dup_line_share": _share(F.col("n_dup_lines"), lines),
        "bullet_line_share": _share(F.col("n_bullet_lines"), lines),
        "ellipsis_line_share": _share(F.col("n_ellipsis_lines"), lines),
    }
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & _verdict(rules, measures))
