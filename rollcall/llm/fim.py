"""Fill-in-middle transformation of documents (operator 11).

One fullmatch of ``(unit)*`` with the regex library keeps every repetition of its
group, so ``match.ends(1)`` lists the end of each unit: its length is the number of
units and two of its entries are the cuts. The repetition is possessive: a text is
always matched in one go, nothing is kept for backtracking. Draws come from a digest
of the row's id, so a task that runs again cuts alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow, slices


@dataclass(frozen=True)
class Rules:
    """How texts are cut: unit, shares in percent, the salt of the draws and the marks."""

    unit: str = "[A-Za-z]+|[^A-Za-z]"
    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: int | None, salt: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the digest of an id; a null id counts as no digits."""
    h = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform_text(units: regex.Pattern, text: str, key: int | None, rules: Rules) -> tuple:
    """``n, form, prefix, middle, output`` of one text; lengths are null where it stays plain."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError(f"the units {rules.unit!r} do not cover every text")
    ends = [0, *match.ends(1)]
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(key, rules.salt)
    if not text or h3 % 100 >= 100 - rules.plain_percent or any(m in text for m in rules.marks):
        return n, "plain", None, None, text
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[: ends[p]], text[ends[p] : ends[m]], text[ends[m] :]
    if h4 % 100 < rules.spm_percent:
        form, out = "spm", (rules.suffix, suffix, rules.prefix, prefix, rules.middle, middle)
    else:
        form, out = "psm", (rules.prefix, prefix, rules.suffix, suffix, rules.middle, middle)
    return n, form, len(prefix), len(middle), "".join(out)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: one row per input row.

    Null texts count as empty; empty texts and those that hold a mark stay plain.
    Equal ids draw alike, a null id draws as one without digits. Extra columns are
    dropped; an empty table gives an empty result. Texts of any length are cut whole;
    work memory grows with the units of one text.
    """
    src = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({rules.unit})*+")
        for whole in batches:
            for b in slices(whole, "text"):
                ids = b.column("doc_id")
                rows = [
                    transform_text(units, t or "", i, rules)
                    for i, t in zip(ids.to_pylist(), b.column("text").to_pylist(), strict=True)
                ]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.record_batch(
                    [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, rules: Rules = Rules()) -> Column:
    """The exact text that an output of ``transform`` was made from.

    No mark starts inside a text or across its edge, as texts that hold one stay
    plain and no mark begins with what another ends in: the cuts are unambiguous.
    """
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in rules.marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
