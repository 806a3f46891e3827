"""Writes table rows as messy files, for the checks of the scans.

Each file holds a bounded range of keys, so their number grows with the data.
"""

from __future__ import annotations

import csv
import io
import math
import posixpath
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.sources.staging import new_folder

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def csv_bytes(rows: list[list[str]], delimiter: str, encoding: str) -> bytes:
    if encoding == "raw":  # cells as they stand, quotes and all
        return "".join(delimiter.join(c or "" for c in r) + "\n" for r in rows).encode()
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\r\n").writerows(rows)
    return out.getvalue().encode(encoding)


def _xlsx_cell(value: str | None) -> str:
    if value is None:
        return "<c/>"
    try:
        # No workbook stores NaN or infinity as a number.
        number = math.isfinite(float(value)) and (not value.startswith("0") or value.startswith("0."))
    except ValueError:
        number = False
    if number:
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'


def xlsx_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        listed = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)
        )
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(
            f'<Relationship Id="r{i}" Type="{REL}/worksheet" Target="worksheets/s{i}.xml"/>'
            for i in range(1, len(names) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        for i, n in enumerate(names, 1):
            rows = "".join("<row>" + "".join(map(_xlsx_cell, r)) + "</row>" for r in sheets[n])
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def ods_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    ns = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))

    def cell(v: str | None) -> str:
        if v is None:
            return "<table:table-cell/>"
        return f'<table:table-cell office:value-type="string"><text:p>{escape(v)}</text:p></table:table-cell>'

    tables = "".join(
        f'<table:table table:name="{escape(n)}">'
        + "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in rows)
        + "</table:table>"
        for n, rows in sheets.items()
    )
    body = f"<office:document-content {ns}><office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", body)
    return out.getvalue()


def write_files(rows: DataFrame, head: list[list[str]], folder: str) -> int:
    """Write one file per name; columns file, sheet, encoding, delimiter, key, cells.

    The extension picks the format; '.bad.xlsx' holds no archive.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iloc[0]
        # A lone sheet, as most files have, needs neither a sort by two columns nor groups.
        one = pdf["sheet"].notna().all() and pdf["sheet"].nunique() == 1
        pdf = pdf.sort_values("key", kind="stable") if one else pdf.sort_values(["sheet", "key"])
        parts = [(pdf["sheet"].iloc[0], pdf)] if one else pdf.groupby("sheet", sort=True)
        sheets = {
            s: [*head, *([None if c is None else str(c) for c in r] for r in part["cells"].tolist())] for s, part in parts
        }
        if name.endswith(".bad.xlsx"):
            data = b"not an archive"
        elif name.endswith(".xlsx"):
            data = xlsx_bytes({**sheets, "Infos": [["Foo", "Bar"], ["x", "y"]]} if "" not in sheets else sheets)
        elif name.endswith(".ods"):
            data = ods_bytes({**sheets, "Infos": [["Foo", "Bar"], ["x", "y"]]} if "" not in sheets else sheets)
        else:
            data = csv_bytes(sheets[""], pdf["delimiter"].iloc[0], pdf["encoding"].iloc[0])
        target, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        target.create_dir(base, recursive=True)
        with target.open_output_stream(posixpath.join(base, name)) as out:
            out.write(data)
        return pd.DataFrame({"file": [name], "n": [len(pdf)]})

    done = rows.groupBy("file").applyInPandas(write, "file string, n bigint")
    return done.agg(F.sum("n")).first()[0]


def new_inputs(spark, name: str) -> str:
    return new_folder(spark, name)
