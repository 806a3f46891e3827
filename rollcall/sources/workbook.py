"""Workbooks (.xlsx, .ods) as lines.

A sheet is the unit of work. A first pass over the files cuts each workbook into
archives that hold one sheet each, without parsing cells; these are dealt over
the tasks by file and sheet, and parsed there row by row. The helpers below only
turn sheet XML into rows of strings.
"""

from __future__ import annotations

import io
import re
import shutil
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rollcall.sources.inputs import literal, plain_path

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
# Number formats that show dates by their built-in id. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
BATCH_ROWS = 5000
SCHEMA = (
    "plain string, sheet_ord int, sheet string, row_idx bigint, cells array<string>, error string"
)
UNITS = "plain string, sheet_ord int, sheet string, unit binary, error string"
# Parts of an archive that every sheet of it needs.
COMMON = ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml"]
TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
Row = list[str | None]


def number_text(value: str) -> str:
    """Whole numbers as they stand or without a fraction, others in shortest form."""
    if value.lstrip("-").isdigit():
        return value
    x = float(value)
    return str(int(x)) if x.is_integer() and abs(x) < 1e16 else str(x)


def date_text(value: str) -> str:
    """Date, or time of day below one; days that no calendar has stay numbers."""
    try:
        days = float(value)
        at = datetime(1899, 12, 30) + timedelta(milliseconds=round(days * 86_400_000))
    except (OverflowError, ValueError):
        return number_text(value)
    return str(at.time()) if 0 <= days < 1 else str(at)


def time_text(value: str) -> str:
    """A duration such as PT13H30M00S as a time of day, or as it stands."""
    m = re.fullmatch(r"PT(\d+)H(\d+)M(\d+)(?:[.,](\d+))?S", value)
    if not m or int(m[1]) > 23:
        return value
    return f"{int(m[1]):02}:{int(m[2]):02}:{int(m[3]):02}" + (f".{m[4]:0<6}" if m[4] and int(m[4]) else "")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): f.get("formatCode", "").split(";")[0].lower()
        for f in root.iter(f"{MAIN}numFmt")
    }
    found = set()
    for i, xf in enumerate(root.findall(f"{MAIN}cellXfs/{MAIN}xf")):
        fmt = int(xf.get("numFmtId", "0"))
        code = "".join(p for n, p in enumerate(custom.get(fmt, "").split('"')) if n % 2 == 0)
        if fmt in DATE_FORMATS or any(c in code for c in "dmyh"):
            found.add(i)
    return found


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _xlsx_cell(c: ET.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or None
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n":
        if int(c.get("s", "0")) in dates:
            return date_text(v.text)
        return number_text(v.text)
    return v.text


def _xlsx_paths(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets and their members in the archive."""
    targets = {
        r.get("Id"): r.get("Target")
        for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")
    }
    found = []
    for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[sheet.get(f"{REL}id")]
        found.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def xlsx_units(data: bytes) -> Iterator[tuple[str, bytes]]:
    """For each sheet its name and an archive that holds it and what all sheets share."""
    book = zipfile.ZipFile(io.BytesIO(data))
    paths = _xlsx_paths(book)
    if len(paths) == 1:
        yield paths[0][0], data
        return
    common = [m for m in COMMON if m in book.namelist()]
    for name, path in paths:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as one:
            for member in [*common, path]:
                with book.open(member) as src, one.open(member, "w") as dst:
                    shutil.copyfileobj(src, dst)
        yield name, out.getvalue()


def xlsx_sheets(data: bytes) -> Iterator[tuple[str, Iterator[Row]]]:
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for _, si in ET.iterparse(book.open("xl/sharedStrings.xml")):
            if si.tag == f"{MAIN}si":
                # Phonetic hints are not part of the text.
                parts = [*si.findall(f"{MAIN}t"), *si.findall(f"{MAIN}r/{MAIN}t")]
                shared.append("".join(t.text or "" for t in parts))
                si.clear()
    dates = _date_styles(book)
    def rows(path: str) -> Iterator[Row]:
        at = 0
        for _, el in ET.iterparse(book.open(path)):
            if el.tag != f"{MAIN}row":
                continue
            here = int(el.get("r", at + 1)) - 1
            for _ in range(here - at):
                yield []
            out: Row = []
            for c in el.findall(f"{MAIN}c"):
                place = _column(c.get("r", "")) if c.get("r") else len(out)
                out += [None] * (place - len(out))
                out.append(_xlsx_cell(c, shared, dates))
            yield out
            at = here + 1
            el.clear()

    for name, path in _xlsx_paths(book):
        yield name, rows(path)


def _ods_cell(c: ET.Element) -> str | None:
    kind = c.get(f"{OFFICE}value-type")
    if kind in ("float", "percentage", "currency"):
        return number_text(c.get(f"{OFFICE}value"))
    if kind == "boolean":
        return "True" if c.get(f"{OFFICE}boolean-value") == "true" else "False"
    if kind == "date":
        return str(datetime.fromisoformat(c.get(f"{OFFICE}date-value")))
    if kind == "time":
        return time_text(c.get(f"{OFFICE}time-value"))
    if kind is None:
        return None
    return "\n".join("".join(_ods_text(p)) for p in c.findall(f"{TEXT}p")) or None


def _ods_text(p: ET.Element) -> Iterator[str]:
    yield p.text or ""
    for child in p:
        if child.tag == f"{TEXT}s":
            yield " " * int(child.get(f"{TEXT}c", "1"))
        else:
            yield from _ods_text(child)
        yield child.tail or ""


def ods_units(data: bytes) -> Iterator[tuple[str, bytes]]:
    """For each sheet its name and an archive with that table alone.

    The document is cut at the tables, tables inside cells excepted; the start
    tags around a table come along, as they declare the prefixes.
    """
    xml = zipfile.ZipFile(io.BytesIO(data)).read("content.xml")
    around: list[int] = []
    spans: list[tuple[str, list[int], int, int]] = []
    inside: list[tuple[str | None, int]] = []
    table, name = (f"{TABLE[1:-1]} {n}" for n in ("table", "name"))
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag == table:
            inside.append((attributes.get(name), parser.CurrentByteIndex))
        elif not inside:
            around.append(parser.CurrentByteIndex)

    def end(tag: str) -> None:
        if tag == table:
            title, at = inside.pop()
            if not inside:
                opened = TAG.match(xml, at)
                alone = opened[0].endswith(b"/>")
                last = opened if alone else TAG.match(xml, parser.CurrentByteIndex)
                spans.append((title, list(around), at, last.end()))
        elif not inside:
            around.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(xml, True)
    for title, outer, at, stop in spans:
        tags = [TAG.match(xml, o)[0] for o in outer]
        closing = b"".join(b"</" + re.match(rb"<([^\s>/]+)", t)[1] + b">" for t in reversed(tags))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as one:
            one.writestr("content.xml", b"".join(tags) + xml[at:stop] + closing)
        yield title, out.getvalue()


def ods_rows(unit: bytes) -> Iterator[Row]:
    """Rows of the one sheet of a unit; each is let go once it was handed on."""
    book = zipfile.ZipFile(io.BytesIO(unit))
    depth = blank = 0
    for event, el in ET.iterparse(book.open("content.xml"), ("start", "end")):
        if el.tag == f"{TABLE}table":
            depth += 1 if event == "start" else -1
        if event == "start" or depth != 1 or el.tag != f"{TABLE}table-row":
            continue
        out: Row = []
        gap = 0
        for c in el:
            if c.tag not in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                continue
            times, cell = int(c.get(f"{TABLE}number-columns-repeated", "1")), _ods_cell(c)
            if cell is None:
                gap += times
                continue
            out += [None] * gap + [cell] * times
            gap = 0
        times = int(el.get(f"{TABLE}number-rows-repeated", "1"))
        el.clear()
        if not out:
            blank += times
            continue
        for _ in range(blank):
            yield []
        blank = 0
        for _ in range(times):
            yield list(out)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["plain", "sheet_ord", "sheet", "unit", "error"]
    for batch in batches:
        for plain, content in zip(batch["plain"], batch["content"]):
            try:
                units = xlsx_units(content) if plain.lower().endswith(".xlsx") else ods_units(content)
                for number, (name, unit) in enumerate(units):
                    yield pd.DataFrame([(plain, number, name, unit, None)], columns=columns)
            except Exception as err:  # noqa: BLE001 - whatever a damaged file raises, the run goes on
                yield pd.DataFrame([(plain, None, None, None, f"{type(err).__name__}: {err}")], columns=columns)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["plain", "sheet_ord", "sheet", "row_idx", "cells", "error"]
    for batch in batches:
        for plain, number, name, unit, error in batch.itertuples(index=False):
            if unit is None:
                yield pd.DataFrame([(plain, None, None, None, None, error)], columns=columns)
                continue
            number, rows = int(number), []
            try:
                if plain.lower().endswith(".xlsx"):
                    _, lines = next(islice(xlsx_sheets(unit), number, None))
                else:
                    lines = ods_rows(unit)
                empty, held = True, 0
                for at, cells in enumerate(lines):
                    if all(c is None for c in cells):
                        held += 1  # trailing blank rows do not count
                        continue
                    rows += [(plain, number, name, at - k, [], None) for k in range(held, 0, -1)]
                    rows.append((plain, number, name, at, cells, None))
                    empty, held = False, 0
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if empty:
                    rows.append((plain, number, name, 0, [], None))
            except Exception as err:  # noqa: BLE001 - whatever a damaged file raises, the run goes on
                rows.append((plain, None, None, None, None, f"{type(err).__name__}: {err}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def scan_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of every sheet, and a row with ``error`` for an unreadable file or sheet.

    Rows read before the error come too; the caller drops that file's. A workbook's
    sheets are dealt over the tasks; what they share is copied to each of them.
    """
    files = spark.read.format("binaryFile").load([literal(p) for p in paths])
    units = files.select(plain_path("path").alias("plain"), "content").mapInPandas(_cut, UNITS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(tasks, "plain", "sheet_ord").mapInPandas(_read, SCHEMA)
