"""UTF-7 as built-in expressions: shift sequences are base64 of UTF-16BE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT = "[A-Za-z0-9+/]"
# Eight digits are three whole units; two or four bits left over must be zero, so the last
# digit of a sequence is a multiple of 4 or 16.
BODY = f"(?:{DIGIT}{{8}})*+(?:{DIGIT}{{5}}[AQgw]|{DIGIT}{{2}}[AEIMQUYcgkosw048])?"
# A plus sign before neither a digit nor a minus sign is an error, but at the end of a line.
LINE = rf"(?s)\A(?:[^+\x{{80}}-\x{{ff}}]++|\+-|\+(?={DIGIT}|\z){BODY}(?!{DIGIT})-?)*+\z"
SECTIONS = rf"(?s)\+{DIGIT}*+-?|[^+]++"
# Hex digits of UTF-16BE without half a surrogate pair.
PAIRED = "^(?:[0-9A-CEF][0-9A-F]{3}|D[0-7][0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+$"


def decode_utf7(raw: Column) -> Column:
    """Text of one line of bytes; null where they are no UTF-7 or hold half a surrogate pair."""
    line = F.decode(raw, "ISO-8859-1")
    sections = F.regexp_extract_all(line, F.lit(SECTIONS), F.lit(0))

    def section(s: Column) -> Column:
        body = F.rtrim(F.substring(s, F.lit(2), F.length(s)), F.lit("-"))
        full = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
        units = F.unbase64(full)
        return (
            F.when(~s.startswith("+"), s)
            .when(s == "+-", F.lit("+"))
            .when(F.hex(units).rlike(PAIRED), F.decode(units, "UTF-16BE"))
        )

    texts = F.when(line.rlike(LINE), F.transform(sections, section))
    return F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(texts, ""))
