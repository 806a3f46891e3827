import io
import zipfile

from pyspark.sql import functions as F

from rollcall.checks.files import ods_bytes, xlsx_bytes
from rollcall.sources import workbook
from rollcall.sources.workbook import ods_rows, ods_units, scan_workbooks, xlsx_sheets, xlsx_units


def test_sheets_of_one_workbook_are_units_of_work(spark, tmp_path):
    sheets = {f"S{i:02d}": [["id", "t"], *([f"r{i}-{k}", "x & <y>"] for k in range(i % 4))] for i in range(50)}
    (tmp_path / "many.xlsx").write_bytes(xlsx_bytes(sheets))
    (tmp_path / "many.ods").write_bytes(ods_bytes(sheets))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = scan_workbooks(spark, [str(tmp_path / n) for n in ("many.xlsx", "many.ods")])
        got = rows.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name in ("many.xlsx", "many.ods"):
        of_file = [r for r in got if r.plain.endswith(name)]
        seen = {}
        for r in sorted(of_file, key=lambda r: (r.sheet_ord, r.row_idx)):
            assert r.error is None and r.sheet == f"S{r.sheet_ord:02d}"
            seen.setdefault(r.sheet, []).append(list(r.cells))
        assert seen == sheets
        # Two sheets may hash to one of the 200 tasks, never all of a file.
        assert len({r.task for r in of_file}) >= 35
        assert len({(r.sheet_ord, r.task) for r in of_file}) == 50


def test_units_hold_one_sheet_and_what_sheets_share():
    sheets = {"A": [["a", "1"]], "B": [["b", "2"]]}
    units = dict(xlsx_units(xlsx_bytes(sheets)))
    assert list(units) == ["A", "B"]
    for i, name in enumerate(units):
        inside = zipfile.ZipFile(io.BytesIO(units[name])).namelist()
        assert [m for m in inside if "worksheets" in m] == [f"xl/worksheets/s{i + 1}.xml"]
        title, rows = list(xlsx_sheets(units[name]))[i]
        assert (title, list(rows)) == (name, sheets[name])
    whole = xlsx_bytes({"A": [["a"]]})
    assert list(xlsx_units(whole)) == [("A", whole)]


def document(body, head=""):
    ns = " ".join(f"xmlns:{p}='{u[1:-1]}'" for p, u in (("t", workbook.TABLE), ("x", workbook.TEXT)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<?xml version='1.0'?>{head}<o:d xmlns:o='{workbook.OFFICE[1:-1]}' a='>'><o:b {ns}>{body}</o:b></o:d>")
    return out.getvalue()


def cell(text):
    return f"<t:table-cell o:value-type='string'><x:p>{text}</x:p></t:table-cell>"


def test_tables_are_cut_with_their_prefixes():
    inner = f"<t:table-row><t:table-cell o:value-type='string'><x:p>out</x:p><t:table t:name='in'><t:table-row>{cell('deep')}</t:table-row></t:table></t:table-cell></t:table-row>"
    body = (f"<t:table t:name='é 1'><t:table-header-rows><t:table-row>{cell('h')}</t:table-row></t:table-header-rows>"
            f"<t:table-row t:number-rows-repeated='2'><t:table-cell/></t:table-row><t:table-row>{cell('x &lt; y')}</t:table-row></t:table>"
            f"<t:table t:name='none'/><t:table t:name='nested'>{inner}</t:table>")
    units = list(ods_units(document(body, "<!-- <t:table> -->")))
    assert [(n, list(ods_rows(u))) for n, u in units] == [
        ("é 1", [["h"], [], [], ["x < y"]]), ("none", []), ("nested", [["out"]])]
    assert list(ods_units(document(""))) == []
