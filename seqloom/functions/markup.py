"""Column functions over HTML: tags, attributes and character references, without a parser per row."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.arrays import let

# What is no markup although it may look so: comments and the content of raw-text elements, to the end of the
# text where nothing closes them.
RAW_TEXT = (
    r"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style|\z)"
    r"|<textarea(?:[\s/][^>]*)?>.*?(?:</textarea|\z)|<title(?:[\s/][^>]*)?>.*?(?:</title|\z)"
)
# A start tag; a quoted value may hold any character. Possessive, so long tags cost no stack.
TAG = r"""<[A-Za-z][^\s/>]*+(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>"""
# An attribute with a value in double quotes, single quotes or none.
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
# A character reference, or text up to the next one.
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"
# The names of HTML 4, from the standard library, and the apostrophe's.
NAMED = {**name2codepoint, "apos": 39}
REPLACEMENT = 0xFFFD


def without_raw_text(html: Column) -> Column:
    """HTML without comments and the content of scripts, styles, text areas and titles."""
    return F.regexp_replace(html, RAW_TEXT, " ")


def start_tags(html: Column, names: str) -> Column:
    """The start tags of the given names (joined by ``|``), in order. A tag inside a quoted value is none."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^<(?:{names})[\s/]"))


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, its references replaced; null without one."""
    found = F.filter(
        F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]+", ""), F.lit(ATTRIBUTE), F.lit(0)),
        lambda a: a.rlike(rf"(?i)^{name}\s*="),
    )
    def value(raw: Column) -> Column:
        inside = F.substr(raw, F.lit(2), F.length(raw) - 2)
        return unescaped(F.when(raw.rlike("""^["']"""), inside).otherwise(raw))

    return let(F.regexp_replace(F.get(found, F.lit(0)), rf"(?i)^{name}\s*=\s*", ""), value)


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    bad = code.isNull() | (code < 1) | (code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF))
    sure = F.when(bad, REPLACEMENT).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(sure), 8, "0")), "UTF-32")


def _code_point(name: Column, names: Column) -> Column:
    """The code point of a reference without ``&`` and ``;``: -1 for a number that is too large, null for an
    unknown name."""
    digits = F.regexp_replace(name, "^#[xX]?0*", "")
    number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
    # Twelve digits hold every code point; longer numbers have none, and neither has zero.
    sure = F.when(F.length(digits).between(1, 12), number).otherwise(-1)
    return F.when(name.startswith("#"), sure).otherwise(F.element_at(names, name).cast("long"))


def unescaped(text: Column) -> Column:
    """Text with its character references replaced, each once: numeric ones, and named ones that HTML 4 knows
    (with their semicolon). Others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def replaced(part: Column) -> Column:
        code = _code_point(F.substr(part, F.lit(2), F.length(part) - 2), names)
        known = let(code, lambda c: F.when(c.isNull(), part).otherwise(_character(c)))
        return F.when(part.rlike("^&[^&]+;$"), known).otherwise(part)

    def joined(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, replaced), "")).otherwise(text)

    return let(text, joined)
