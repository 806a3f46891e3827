"""Text functions: blanks, normal form, keys, similarity. All JVM-side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.constants import (
    BLANKS,
    HEADER_JUNK,
    SEPARATORS,
    SIMILARITY_LABELS,
    SIMILARITY_OTHER,
)

HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
COMMON_LIMIT = 0x500  # Latin, Greek and Cyrillic lie below


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.trim(col(c), F.lit(BLANKS))


def is_missing(c: Column | str) -> Column:
    """Null, blank, or the text ``nan`` in any case."""
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin("", "nan")


def is_null_text(c: Column | str) -> Column:
    """Null or the text ``nan``; a blank text counts as present."""
    return F.coalesce(F.lower(strip(c)), F.lit("nan")) == "nan"


def char_class(chars: str | list[int]) -> str:
    """Regex class of the given code points, written as ranges."""
    points = sorted({ord(c) if isinstance(c, str) else c for c in chars})
    parts, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            parts.append(f"\\x{{{start:x}}}" + (f"-\\x{{{p:x}}}" if p > start else ""))
            start = None
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Per-character folding derived from the Unicode database.

    A character folds to its NFKD form without combining characters, with
    separators and C1 controls as blanks. Returns the one-to-one pairs for
    ``translate`` (dropped characters last, without a counterpart) and the
    characters that fold to several. Hangul syllables follow an arithmetic rule.
    """
    single, dropped, several = {}, [], {}
    for point in range(0x80, 0x110000):
        ch = chr(point)
        if HANGUL_FIRST <= point <= HANGUL_LAST or 0xD800 <= point <= 0xDFFF:
            continue
        if not (
            0x80 <= point <= 0x9F
            or unicodedata.decomposition(ch)
            or unicodedata.combining(ch)
            or ch in SEPARATORS
            or ch in BLANKS
        ):
            continue
        folded = "".join(
            " " if f in SEPARATORS or f in BLANKS or "\x80" <= f <= "\x9f" else f
            for f in unicodedata.normalize("NFKD", ch)
            if not unicodedata.combining(f)
        )
        if folded == ch:
            continue
        if not folded:
            dropped.append(ch)
        elif len(folded) == 1:
            single[ch] = folded
        else:
            several[ch] = folded
    for ch in SEPARATORS:
        if ch < "\x80":
            single[ch] = " "
    match = "".join(single) + "".join(dropped)
    return match, "".join(single.values()), several


def _jamo(c: Column) -> Column:
    """Conjoining letters of a Hangul syllable, by the Unicode formula."""
    s = F.ascii(c) - HANGUL_FIRST

    def letter(point: Column) -> Column:
        return F.decode(F.unhex(F.hex(point.cast("int"))), "UTF-16BE")

    lead = letter(F.floor(s / 588) + 0x1100)
    vowel = letter(F.floor((s % 588) / 28) + 0x1161)
    tail = F.when(s % 28 > 0, letter(s % 28 + 0x11A7)).otherwise("")
    return F.concat(lead, vowel, tail)


def _expand(c: Column) -> Column:
    """Characters that fold to several; evaluated only where one occurs."""
    several = _folding()[2]
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in several.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))

    def one(ch: Column) -> Column:
        return (
            F.when(ch < " ", ch)
            .when(ch.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)), _jamo(ch))
            .otherwise(F.coalesce(F.try_element_at(table, ch), ch))
        )

    # A short class settles common scripts; the long one is slow to match.
    simple = [p for p in range(COMMON_LIMIT) if chr(p) not in several]
    uncommon = "[^" + char_class(simple)[1:]
    pattern = char_class(
        [ord(k) for k in several] + list(range(HANGUL_FIRST, HANGUL_LAST + 1))
    )
    spelled = F.array_join(F.transform(F.split(c, ""), one), "")
    return F.when(c.rlike(uncommon) & c.rlike(pattern), spelled).otherwise(c)


def normalize_text(c: Column | str) -> Column:
    """Lower case, accents dropped, separators to blanks, blanks collapsed.

    Byte length equal to character length means ASCII, which takes a short
    branch; ``when`` evaluates only the branch taken.
    """
    c = F.lower(col(c))
    gaps = char_class("".join(ch for ch in SEPARATORS + BLANKS if ch < "\x80")) + "+"
    match, replace, _ = _folding()
    degree = F.regexp_replace(
        F.regexp_replace(c, f"[°º]([^{char_class(BLANKS)[1:-1]}])", "o $1"),
        "[°º]",
        "o",
    )
    marked = F.contains(c, F.lit("°")) | F.contains(c, F.lit("º"))
    folded = _expand(F.translate(F.when(marked, degree).otherwise(c), match, replace))
    text = F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)
    return F.trim(F.regexp_replace(text, gaps, " "))


def name_key(first: Column, last: Column) -> Column:
    """Lookup key from two names in normal form."""
    return F.concat(last, F.lit("|"), first)


def similarity_label(distance: Column, longest: Column) -> Column:
    ratio = distance / longest
    label = F.when(distance == 0, "identical").when(longest == 0, "empty")
    for bound, text in SIMILARITY_LABELS:
        label = label.when(ratio <= bound, text)
    return label.otherwise(SIMILARITY_OTHER)


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """Edit distance of two normal forms and its label."""
    a, b = col(a), col(b)
    distance = F.levenshtein(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.struct(
        distance.alias("distance"),
        similarity_label(distance, longest).alias("label"),
    )


def clean_header(c: Column | str) -> Column:
    """Strip byte order mark, zero-width characters and blanks from the ends."""
    return strip(F.trim(col(c), F.lit(HEADER_JUNK + " ")))
