"""Value functions: parsing, range test, number text. All JVM-side."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.constants import ABSENT_TOKENS
from rollcall.functions.text import col, strip

DIGITS = r"[0-9]+(?:_[0-9]+)*"
DECIMAL = rf"(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?"
WORD = "(?i:inf|infinity|nan)"
NUMBER = rf"^[+-]?(?:{DECIMAL}|{WORD})$"
SPLITTER = 134217729.0  # 2^27 + 1: halves a double's significand exactly


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    """Decimal digits of every script and their ASCII counterparts."""
    found = [
        chr(p) for p in range(0x80, 0x110000) if unicodedata.category(chr(p)) == "Nd"
    ]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def absent_tokens(extra: Iterable[str] = ()) -> list[str]:
    """Built-in and extra tokens in compared form."""
    return sorted({*ABSENT_TOKENS, *(t.upper().strip() for t in extra)})


def is_absent_token(c: Column | str, extra: Iterable[str] = ()) -> Column:
    return strip(F.upper(col(c))).isin(absent_tokens(extra))


def ascii_digits(s: Column) -> Column:
    """Decimal digits of other scripts as ASCII ones."""
    foreign, plain = _digit_table()
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(
        F.translate(s, foreign, plain)
    )


def number_of(s: Column) -> Column:
    """Double for trimmed text in the documented syntax, else null.

    The gate comes first because a cast alone also takes suffixes like ``15d``.
    """
    plain = F.regexp_replace(s, "_|^[+-](?=[nN])", "")
    return F.when(s.rlike(NUMBER), plain.try_cast("double"))


def parse_number(c: Column | str) -> Column:
    return number_of(ascii_digits(strip(c)))


def cell_number(cell: Column | str) -> Column:
    """The number of a cell, whose decimal mark may be a comma."""
    return parse_number(F.replace(col(cell), F.lit(","), F.lit(".")))


def is_blank(cell: Column | str) -> Column:
    return F.lower(col(cell)).isin("", "nan")


def claimed(blank: Column, absent: Column, number: Column) -> Column:
    """The value that a cell claims; neither a blank nor an absence has one."""
    return F.when(~blank & ~absent, number)


def issue_of(blank: Column, absent: Column, value: Column) -> Column:
    return F.when(blank, "value_empty").when(~absent & value.isNull(), "value_unparsed")


def parse_value(c: Column | str, extra: Iterable[str] = ()) -> Column:
    """Struct of value, absence and issue for one raw cell, by the rules of ``with_value``.

    A null cell gives nothing at all; a blank one is an issue.
    """
    s = strip(c)
    blank = is_blank(s)
    absent = F.coalesce(~blank & is_absent_token(s, extra), F.lit(False))
    value = claimed(blank, absent, cell_number(s))
    return F.struct(
        value.alias("value"),
        absent.alias("is_absent"),
        F.when(s.isNotNull(), issue_of(blank, absent, value)).alias("issue"),
    )


def out_of_range(v: Column | str, low: float | None, high: float | None) -> Column:
    """``above``, ``below`` or null; NaN is in range, as it compares false."""
    v = col(v)
    direction = F.lit(None).cast("string")
    if low is not None:
        direction = F.when(v < F.lit(float(low)), "below").otherwise(direction)
    if high is not None:
        direction = F.when(v > F.lit(float(high)), "above").otherwise(direction)
    return F.when(~F.isnan(v), direction)


def bound_of(direction: Column, low: float | None, high: float | None) -> Column:
    """The bound that a direction points beyond."""
    bound = F.lit(None).cast("double")
    if high is not None:
        bound = F.when(direction == "above", F.lit(float(high))).otherwise(bound)
    if low is not None:
        bound = F.when(direction == "below", F.lit(float(low))).otherwise(bound)
    return bound


def clamp(v: Column | str, low: float | None, high: float | None) -> Column:
    """Struct of the clamped value and the direction; the upper bound goes first."""
    v = col(v)
    direction = out_of_range(v, low, high)
    return F.struct(clamped(v, direction, low, high).alias("value"), direction.alias("direction"))


def clamped(v: Column, direction: Column, low: float | None, high: float | None) -> Column:
    """The bound that a value lies beyond, or the value."""
    return F.coalesce(bound_of(direction, low, high), v)


def _halves(x: Column) -> tuple[Column, Column]:
    c = x * F.lit(SPLITTER)
    high = c - (c - x)
    return high, x - high


def _exact_product(a: Column, b: Column) -> tuple[Column, Column]:
    """Rounded product and its rounding error."""
    p = a * b
    ah, al = _halves(a)
    bh, bl = _halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _tie_side(v: Column, n: Column, k: Column) -> Column:
    """Sign of ``v - n / 10^k`` without rounding."""
    t = F.pow(F.lit(10.0), F.abs(k))
    p, err = _exact_product(v, t)
    q, miss = _exact_product(n, t)
    return F.when(k >= 0, (p - n) + err).otherwise((v - q) - miss)


def format_g(v: Column | str) -> Column:
    """Six significant digits without trailing zeros.

    ``format_string`` rounds the shortest text of a double half up. Where that
    text has seven digits and ends in 5, the double lies above, below or on the
    tie; the exact side decides, and an exact tie goes to the even digit.
    """
    v = col(v)
    size = F.abs(v)
    seven = F.format_string("%.6e", size)
    digits = F.replace(F.substring_index(seven, "e", 1), F.lit("."), F.lit("")).try_cast("bigint")
    power = F.substring_index(seven, "e", -1).try_cast("int")
    k = F.lit(6) - power
    risky = (seven.try_cast("double") == size) & (digits % 10 == 5) & k.between(-22, 22)
    side = _tie_side(size, digits.cast("double"), k.cast("double"))
    even_down = F.floor(digits / 10) % 2 == 0
    down = (side < 0) | ((side == 0) & even_down)
    moved = F.when(down, digits - 5).otherwise(digits + 5)
    scale = F.pow(F.lit(10.0), F.abs(k).cast("double"))
    near = moved.cast("double")
    near = F.when(k >= 0, near / scale).otherwise(near * scale)
    shown = F.when(F.coalesce(risky, F.lit(False)), F.signum(v) * near).otherwise(v)
    text = F.format_string("%g", shown)
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(?=e|$)", "$1")
    text = F.regexp_replace(text, r"\.(?=e|$)", "")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), "nan")
        .when(v == float("inf"), "inf")
        .when(v == float("-inf"), "-inf")
        .otherwise(text)
    )
