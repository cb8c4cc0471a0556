"""Columns over text: words, lines, ratios; Unicode-safe in the JVM.

A word is what stands between white space as Unicode has it; lines end as in universal
newlines.  Java's own ``\\s`` and ``\\R`` miss some of these, so the classes are spelled out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of white space and of line ends.
SPACE_POINTS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_POINTS}]"
NOT_SPACE = f"[^{SPACE_POINTS}]"
#: The same for the JVM, where one look at a character's type tells most of them; and as characters.
JVM_SPACE, JVM_NOT_SPACE = r"(?U)[\s\x{1c}-\x{1f}]", r"(?U)[^\s\x{1c}-\x{1f}]"
SPACE_CHARACTERS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
LINE_END = r"\x{0d}\x{0a}|[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Characters that end lines, but the line feed.
ODD_LINE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
DEVANAGARI = (0x0900, 0x097F)

# Signs that count as symbols, and phrases of page frames.
SYMBOL_CLASS = r"[#*\x{2022}~|>%$\^&=+_<\[\]{}\\/]"
FRAME_PHRASES = [
    "click here", "read more", "subscribe", "sign up", "log in", "loading...", "all rights reserved", "terms of service", "privacy policy",
    "cookie policy", "advertisement", "please enable javascript", "follow us on", "©", "अधिक वाचा", "येथे क्लिक करा", "सर्व हक्क राखीव", "सदस्यता घ्या",
]


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it, within lambdas too."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def not_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, JVM_SPACE + "+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(JVM_NOT_SPACE + "+"))


def lines(text: Column) -> Column:
    """The lines of a text; a last line end opens no further line, and empty text has none."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(JVM_NOT_SPACE), F.lit(False))


def script_ratio(text: Column, first: int = DEVANAGARI[0], last: int = DEVANAGARI[1]) -> Column:
    """Share of the characters that are not white space in a range of code points; 0 without any."""
    # Runs are taken out, so that there is a match a word and not one a character.
    outside = F.length(F.regexp_replace(text, rf"[\x{{{first:x}}}-\x{{{last:x}}}]+", ""))
    solid = F.length(F.regexp_replace(text, JVM_SPACE + "+", ""))
    return F.coalesce((F.length(text) - outside) / F.nullif(solid, F.lit(0)), F.lit(0.0))


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL_CLASS))


def symbol_ratio(text: Column) -> Column:
    """Symbols a word; a text of no words counts as one."""
    return symbol_count(text) / F.greatest(F.lit(1), word_count(text))


def stripped_lines(text: Column) -> Column:
    """The lines of a text that hold more than white space, stripped."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != "")


def repeated_line_ratio(text: Column) -> Column:
    """Share of the stripped non-empty lines that occur more than once; 0 for fewer than two lines.

    Lines that all differ are told by one pass; otherwise sorting brings equal lines together,
    so the work is n log n in the lines of a text."""
    def share(kept: Column) -> Column:
        n = F.size(kept)
        alone = F.size(F.filter(kept, lambda x, i: ((i == 0) | (F.get(kept, i - 1) != x)) & ((i == n - 1) | (F.get(kept, i + 1) != x))))
        return (n - alone) / n

    def ratio(own: Column) -> Column:
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0.0)).otherwise(let(F.array_sort(own), share))

    return let(stripped_lines(text), ratio)


def _any_phrase(low: Column, phrases: list[str] | None) -> Column:
    hit = F.lit(False)
    for p in phrases if phrases is not None else FRAME_PHRASES:
        hit = hit | low.contains(p)
    return hit


def has_frame_phrase(line: Column, phrases: list[str] | None = None) -> Column:
    return let(F.lower(strip(line)), lambda low: _any_phrase(low, phrases))


def frame_line_ratio(text: Column, phrases: list[str] | None = None) -> Column:
    """Share of all lines, blank ones too, that hold a phrase of the list; 0 without lines."""
    return framed(text, phrases).getField("ratio")


def without_frame_lines(text: Column, phrases: list[str] | None = None) -> Column:
    """The other lines, joined by line feeds; empty text stays."""
    return framed(text, phrases).getField("rest")


def framed(text: Column, phrases: list[str] | None = None) -> Column:
    """``struct<ratio, rest>``: the share of lines that hold a phrase of the list, and the other lines.

    Texts that hold no phrase at all, told by a search of the whole text, are not cut into lines."""
    def of_parts(own: Column, rest: Column) -> Column:
        return F.struct(((F.size(own) - F.size(rest)) / F.size(own)).alias("ratio"), F.array_join(rest, "\n").alias("rest"))

    def cut(own: Column) -> Column:
        return let(F.filter(own, lambda x: ~has_frame_phrase(x, phrases)), lambda rest: of_parts(own, rest))

    odd = reduce(or_, [text.contains(c) for c in ODD_LINE_ENDS])
    even = F.when(odd, F.regexp_replace(text, LINE_END, "\n")).otherwise(text)
    plain = F.struct(F.lit(0.0).alias("ratio"), let(even, lambda x: F.when(x.endswith("\n"), F.left(x, F.length(x) - 1)).otherwise(x)).alias("rest"))
    return F.when(let(F.lower(text), lambda low: _any_phrase(low, phrases)), let(lines(text), cut)).otherwise(plain)


def shingles(text: Column, n: int = 5) -> Column:
    """The set of runs of ``n`` words; of fewer words, the one run of all."""
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - n))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))

    return let(words(text), runs)


def nfc(text: Column) -> Column:
    """Canonical composition.  Spark has no function for it: an Arrow batch goes through Python, ASCII text as it is."""

    @F.pandas_udf("string")
    def compose(s):
        return s.str.normalize("NFC")

    return F.when(text.rlike(r"[^\x{00}-\x{7f}]"), compose(text)).otherwise(text)
