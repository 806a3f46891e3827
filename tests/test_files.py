import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

import rollcall
from rollcall.checks.files import ods_bytes, xlsx_bytes
from rollcall.operators.decisions import Decisions
from rollcall.operators.lookup import Limits
from rollcall.operators.schema import resolve_sheets
from rollcall.plans import reconcile as plan
from rollcall.plans.from_files import observe_files, roster_from_file, scan
from rollcall.plans.reconcile import Params
from rollcall.sources import staging, workbook
from rollcall.sources.delimited import numbered_words, scan_delimited
from rollcall.sources.inputs import list_inputs
from rollcall.sources.sink import write_result

ROSTER = [["Numéro étudiant", "Prénom", "Nom de famille", "Email"]] + [
    [f"{i:05d}", f, n, f"{f}@x.org".lower()]
    for i, (f, n) in enumerate(
        [
            ("Tomas", "Keller"), ("Irene", "Vogel"), ("Hugo", "Sandoval"), ("Clara", "Nyman"),
            ("Rafael Amado", "Quiroga"), ("Zélie", "Forêt"), ("Ivo", "Lund"), ("Ivo", "Lund"),
            ("Rosa", "Brand"), ("Brand", "Rosa"), ("Mila", "Stone"), ("Otto", "Frost"),
        ],
        1,
    )
]
HEAD = ["Numéro étudiant", "Prénom", "Nom", "Note"]


def put(folder, name, rows, sep=",", encoding="utf-8"):
    with open(folder / name, "w", encoding=encoding, newline="") as f:
        csv.writer(f, delimiter=sep).writerows(rows)


def book(folder, name, sheets):
    make = xlsx_bytes if name.endswith(".xlsx") else ods_bytes
    (folder / name).write_bytes(make(sheets))


def run(spark, folder, files, **kw):
    put(folder, "roster.csv", ROSTER)
    return rollcall.reconcile_files(spark, str(folder / "roster.csv"), base=str(folder), files=files, **kw)


def outcome(result):
    return {
        r.id: ("ABS" if r.is_absent else r.value, r.source)
        for r in result.consolidated.collect()
        if r.is_absent or r.value is not None
    }


def codes(result):
    return {(r.file, r.code) for r in result.issues.collect()}


def test_rows_are_resolved_by_each_tier(spark, tmp_path):
    put(tmp_path, "ids.csv", [HEAD, ["00001", "Tomas", "Kellar", "15,5"], ["00005", "Rafael", "Amado Quiroga", "12"],
                              ["99999", "Unknown", "Person", "3"], ["99998", "Irene", "Vogel", "ABS"], ["00003", "", "", "x"]], ";")
    put(tmp_path, "names.csv", [["Prénom", "Nom", "Note"], ["Nyman", "Clara", "21"], ["Ivo", "Lund", "9"],
                                ["Rosa", "Brand", "8"], ["", "", "7"], ["HUGO", "sandoval", "16"], ["Tomas", "Keller", "1"]])
    put(tmp_path, "full.csv", [["Nom étu", "TOTAL"], ["Forêt Zélie", "14"], ["Rosa Brand", "2"], ["", "3"], ["Not Known", "4"]])
    got = run(spark, tmp_path, ["ids.csv", "names.csv", "full.csv"], params=Params(max_value=20))
    assert outcome(got) == {
        "00001": (15.5, "ids.csv"), "00005": (12.0, "ids.csv"), "00002": ("ABS", "ids.csv"),
        "00004": (21.0, "names.csv"), "00009": (8.0, "names.csv"), "00003": (16.0, "names.csv"),
        "00006": (14.0, "full.csv"),
    }
    assert codes(got) == {
        ("ids.csv", "name_mismatch_proceed"), ("ids.csv", "id_unknown_try_name"), ("ids.csv", "name_unknown"),
        ("ids.csv", "value_unparsed"), ("names.csv", "name_swapped"), ("names.csv", "name_ambiguous"),
        ("names.csv", "name_missing"), ("names.csv", "duplicate_claim"), ("names.csv", "kept_undecided"),
        ("full.csv", "full_ambiguous"), ("full.csv", "full_missing"), ("full.csv", "full_unknown"),
    }
    report = {r.file: (r.matched, r.assigned, r.absent, r.skipped) for r in got.file_report.collect()}
    assert report == {"ids.csv": (4, 2, 1, False), "names.csv": (4, 3, 0, False), "full.csv": (1, 1, 0, False)}
    kinds = {(r.kind, r.subject) for r in got.pending.collect()}
    assert {("name", "00001"), ("token", "x"), ("clamp", "above")} <= kinds
    assert got.totals.first().asDict() == {"total": 12, "valued": 6, "absent": 1, "none": 5}
    assert [r.id for r in got.unclaimed.orderBy("roster_ord").collect()] == ["00007", "00008", "00010", "00011", "00012"]


def test_saved_answers_settle_a_run(spark, tmp_path):
    put(tmp_path, "a.csv", [HEAD, ["00001", "Tomas", "Kellar", "21"], ["00002", "Hugo", "Sandoval", "15"], ["00003", "Hugo", "Sandoval", "—"]])
    put(tmp_path, "b.csv", [["Numero", "Numero etudiant", "Note /23", "Note /20"], ["1", "00004", "18", "14"]])
    book(tmp_path, "c.xlsx", {
        "DC-1": [HEAD[:2] + ["Note /23", "Note /20"], ["00006", "Zélie", "18", "13"]],
        "DC-2": [HEAD[:2] + ["Note /23", "Note /20"], ["00011", "Mila", "17", "12"]],
        "Later": [HEAD[:2] + ["Note"], ["00012", "Otto", "1"]],
    })
    table = spark.createDataFrame
    decisions = Decisions(
        column_choices=table(
            [("b.csv", "", "id", "Numero etudiant"), ("b.csv", "", "value", "Note /20"),
             ("c.xlsx", "DC-1", "value", "Note /20"), ("c.xlsx", "", "value", "Note /23")],
            "file string, sheet string, role string, column string"),
        sheet_selection=table([("c.xlsx", "DC-1"), ("c.xlsx", "DC-2")], "file string, sheet string"),
        name_decisions=table([("a.csv", "00001", True), ("a.csv", "00002", False)], "file string, id string, answer boolean"),
        absent_tokens=table([("—",)], "token string"),
        clamp_choices=table([("a.csv", "", "above", True)], "file string, sheet string, direction string, answer boolean"),
    )
    got = run(spark, tmp_path, ["a.csv", "b.csv", "c.xlsx"], decisions=decisions, params=Params(max_value=20))
    # DC-2 has no answer of its own, and the file-level one does not apply to it.
    assert outcome(got) == {
        "00001": (20.0, "a.csv"), "00003": ("ABS", "a.csv"), "00004": (14.0, "b.csv"), "00006": (13.0, "c.xlsx"),
    }
    found = codes(got)
    assert {("a.csv", "name_mismatch_confirmed_before"), ("a.csv", "name_mismatch_rejected"), ("a.csv", "clamped_saved"),
            ("b.csv", "override_used"), ("b.csv", "value_override_used"), ("c.xlsx", "saved_sheets_used"),
            ("c.xlsx", "sheet_no_value_column"), ("c.xlsx", "value_ambiguous_prefix")} <= found
    assert [(r.kind, r.sheet) for r in got.pending.collect()] == [("column", "DC-2")]


def test_answers_fold_back(spark, tmp_path):
    put(tmp_path, "a.csv", [HEAD, ["00001", "Tomas", "Kellar", "21"], ["00002", "Hugo", "Sandoval", "15"], ["00003", "Hugo", "Sandoval", "—"]])
    put(tmp_path, "b.csv", [["Numero", "Numero etudiant", "Note /23", "Note /20"], ["1", "00004", "18", "14"]])
    book(tmp_path, "c.xlsx", {s: [HEAD, [i, n, "", "3"]] for s, i, n in (("S1", "00006", "Zélie"), ("S2", "00011", "Mila"))})
    files, decisions = ["a.csv", "b.csv", "c.xlsx"], Decisions()
    said = {"id": "Numero etudiant", "value": "Note /20", "00001": "true", "00002": "false", "—": "true", "above": "true", "": "S2"}
    for _ in range(3):
        got = run(spark, tmp_path, files, decisions=decisions, params=Params(max_value=20))
        asked = got.pending.collect()
        if not asked:
            break
        rows = [(r.kind, r.file, r.sheet, r.subject, said.get(r.subject, "true")) for r in asked]
        decisions = decisions.with_answers(spark.createDataFrame(rows, "kind string, file string, sheet string, subject string, answer string"))
    assert not asked
    assert outcome(got) == {"00001": (20.0, "a.csv"), "00003": ("ABS", "a.csv"), "00004": (14.0, "b.csv"), "00011": (3.0, "c.xlsx")}


def test_scans_of_many_encodings_and_layouts(spark, tmp_path):
    (tmp_path / "cp1252 ü.csv").write_bytes("Code d’élève;Note\n00001;15\n".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes(b"Pr\xe9nom,Note\n\x81,15\n")
    (tmp_path / "utf7.csv").write_bytes("Prénom,Nom\nZélie,Forêt\n".encode("utf-7"))
    (tmp_path / "plus.csv").write_bytes("Prénom,Note\nAda+Linus,15\n".encode())
    (tmp_path / "bom.tsv").write_bytes('﻿"A"\tB\r\n\r\n1\t"x ""y""\tz"\r\n'.encode())
    (tmp_path / "breaks.csv").write_bytes(b'"Note\n/20",ID\n15,"a\nb"\n16,c\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "data.json").write_text("{}")
    names = sorted(p.name for p in tmp_path.iterdir() if p.is_file())
    inputs = list_inputs(spark, str(tmp_path), names + ["gone.csv"])
    lines, errors = scan(spark, inputs)
    got = {}
    for r in lines.orderBy("row_idx").collect():
        got.setdefault(r.plain.rsplit("/", 1)[1], []).append(list(r.cells))
    assert got == {
        "cp1252 ü.csv": [["Code d’élève", "Note"], ["00001", "15"]],
        "latin.csv": [["Prénom", "Note"], ["\x81", "15"]],
        "utf7.csv": [["Prénom", "Nom"], ["Zélie", "Forêt"]],
        "plus.csv": [["Prénom", "Note"], ["Ada+Linus", "15"]],
        "bom.tsv": [["A", "B"], ["1", 'x "y"\tz']],
        "breaks.csv": [["Note\n/20", "ID"], ["15", "a\nb"], ["16", "c"]],
    }
    assert {r.plain.rsplit("/", 1)[1] for r in errors.collect()} == {"empty.csv", "bad.xlsx", "data.json", "gone.csv"}


def test_one_file_in_many_splits_keeps_its_order(spark, tmp_path):
    rows = [["ID", "Note", "t"]] + [[str(i), str(i % 20), f'q"{i}' if i % 50 else f"a\nb{i}"] for i in range(4000)]
    put(tmp_path, "long.csv", rows)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        lines, _ = scan(spark, list_inputs(spark, str(tmp_path), ["long.csv"]))
        got = [list(r.cells) for r in lines.orderBy("row_idx").collect()]
    finally:
        spark.conf.set(key, before)
    assert got == rows


def scanned(spark, folder, names, split="134217728"):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        lines, _ = scan(spark, list_inputs(spark, str(folder), names))
        got = {}
        for r in lines.orderBy("row_idx").collect():
            got.setdefault(r.plain.rsplit("/", 1)[1], []).append((r.row_idx, list(r.cells)))
    finally:
        spark.conf.set(key, before)
    return got


def test_quotes_lose_nothing(spark, tmp_path):
    want = {}

    def add(name, data, rows):
        (tmp_path / name).write_bytes(data)
        want[name] = list(enumerate(rows))

    x, y = "x" * 70000, "y" * 70000
    add("big.csv", f'a,b\n"{x}\n{y}","{x}\n\nq"\n1,2\n'.encode(), [["a", "b"], [f"{x}\n{y}", f"{x}\n\nq"], ["1", "2"]])
    add("stray.csv", b'id,a,b\n0,"x",5" disk\n' + b"1,p,q\n" * 99, [["id", "a", "b"], ["0", "x", '5" disk']] + [["1", "p", "q"]] * 99)
    add("never.csv", b'id,a\n1,"never\n2,b\n4,d\n', [["id", "a"], ["1", '"never'], ["2", "b"], ["4", "d"]])
    add("bom.csv", "\ufeff\"A\nB\",C\n1,\"a\n\nb\"\n\n \n2,c".encode(), [["A\nB", "C"], ["1", "a\n\nb"], ["2", "c"]])
    add("after.csv", b'a,b\n"abc"def,1\n"x,y","q""r"\n', [["a", "b"], ["abcdef", "1"], ["x,y", 'q"r']])
    add("titles.csv", b"t, u\n" * 14 + b"a;b\n" * 30, [["t, u"]] * 14 + [["a", "b"]] * 30)
    rng = random.Random(3)
    for k in range(8):
        mark = ",;\t|"[k % 4]
        rows = [["h1", "h2", "h3"]] + [
            ["".join(rng.choice(["a", '"', mark, "\n", "\n\n", "é", " x"]) for _ in range(rng.randint(1, 6))) for _ in range(3)]
            for _ in range(60)
        ]
        rows = [[c or "e" for c in r] for r in rows]
        put(tmp_path, f"r{k}.csv", rows, mark, ("utf-8", "utf-8-sig", "cp1252")[k % 3])
        want[f"r{k}.csv"] = list(enumerate(rows))
    for split in ("134217728", "4096"):
        assert scanned(spark, tmp_path, sorted(want), split) == want


def test_header_after_long_records_is_found(spark, tmp_path):
    put(tmp_path, "a.csv", [["Title"], ["\n".join("note" for _ in range(14))], HEAD, ["00001", "Tomas", "Keller", "12"]])
    assert outcome(run(spark, tmp_path, ["a.csv"])) == {"00001": (12.0, "a.csv")}


def test_odd_names_are_listed_and_read(spark, tmp_path):
    names = ["notes [1].csv", "notes {a}.csv", "what?*.csv", "100%25 a+b.csv", "é ü.csv"]
    for n in [*names, "_grades.csv", ".dot.csv"]:
        put(tmp_path, n, [["A", "B"], [n, "1"]])
    assert {k: v[1][1][0] for k, v in scanned(spark, tmp_path, names).items()} == {n: n for n in names}
    inputs = list_inputs(spark, str(tmp_path), [names[0]], ".")
    assert [r.file for r in inputs.orderBy("file_ord").collect()] == [names[0], *sorted(set(names + ["_grades.csv", ".dot.csv"]) - {names[0]}, key=str.encode)]
    _, errors = scan(spark, inputs)
    assert {r.plain.rsplit("/", 1)[1] for r in errors.collect()} == {"_grades.csv", ".dot.csv"}


def damaged(data, name):
    """The archive with a broken stream in one member."""
    out, at = bytearray(data), data.index(name.encode()) + len(name) + 4
    out[at : at + 12] = b"\xff" * 12
    return bytes(out)


def test_bad_workbooks_count_for_nothing_and_end_nothing(spark, tmp_path):
    good = {"S": [HEAD, ["12345678901234567", "Tomas", "Keller", "12"]], "T": [HEAD, ["2", "a", "b", "3"]]}
    for ext in ("xlsx", "ods"):
        (tmp_path / f"good.{ext}").write_bytes(book(tmp_path, f"good.{ext}", good) or (tmp_path / f"good.{ext}").read_bytes())
    data = (tmp_path / "good.xlsx").read_bytes()
    (tmp_path / "flate.xlsx").write_bytes(damaged(data, "xl/worksheets/s2.xml"))
    (tmp_path / "cut.ods").write_bytes((tmp_path / "good.ods").read_bytes()[:300])
    names = ["good.xlsx", "good.ods", "flate.xlsx", "cut.ods"]
    lines, errors = scan(spark, list_inputs(spark, str(tmp_path), names))
    assert {r.plain.rsplit("/", 1)[1] for r in errors.collect()} == {"flate.xlsx", "cut.ods"}
    got = {(r.plain.rsplit("/", 1)[1], r.cells[0]) for r in lines.where("sheet = 'S' and row_idx = 1").collect()}
    assert got == {("good.xlsx", "12345678901234567"), ("good.ods", "12345678901234567")}


def test_workbook_cells():
    assert [workbook.number_text(v) for v in ("12345678901234567", "-3", "1.0", "2.50", "1e3")] == ["12345678901234567", "-3", "1", "2.5", "1000"]
    assert [workbook.date_text(v) for v in ("44197", "0.5625", "99999999", "44197.5")] == ["2021-01-01 00:00:00", "13:30:00", "99999999", "2021-01-01 12:00:00"]
    assert [workbook.time_text(v) for v in ("PT13H30M00S", "PT30H00M00S")] == ["13:30:00", "PT30H00M00S"]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_folder(Session())


def test_empty_folder_is_an_issue(spark, tmp_path):
    (tmp_path / "none").mkdir()
    put(tmp_path, "roster.csv", ROSTER)
    got = rollcall.reconcile_files(spark, str(tmp_path / "roster.csv"), base=str(tmp_path), folder="none")
    assert codes(got) == {("", "no_input_files")}


def test_listing(spark, tmp_path):
    for name in ("b.csv", "a.XLSX", "c.txt.bak", "d.ods"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.csv").write_text("x")
    got = list_inputs(spark, str(tmp_path), ["d.ods", "./d.ods", "zz.csv"], ".").orderBy("file_ord").collect()
    assert [(r.file_ord, r.file, r.length) for r in got] == [(0, "d.ods", 1), (1, "zz.csv", None), (2, "a.XLSX", 1), (3, "b.csv", 1)]
    with pytest.raises(ValueError):
        list_inputs(spark, str(tmp_path), None, "nowhere")


def test_roster_rules(spark, tmp_path):
    put(tmp_path, "r.csv", [["Liste"], ["Numero", "Prenom", "Nom"], ["S1", "Tomas", "Keller"], ["", "No", "Id"], ["S1", "Irene", "Vogel"]])
    rows = roster_from_file(spark, str(tmp_path / "r.csv"))
    assert [(r.id, r.first_name, r.email) for r in rows.orderBy("ord").collect()] == [("S1", "Tomas", None), (None, "No", None), ("S1", "Irene", None)]
    put(tmp_path, "no_id.csv", [["Prénom", "Nom"], ["Tomas", "Keller"]])
    with pytest.raises(ValueError, match="lacks"):
        roster_from_file(spark, str(tmp_path / "no_id.csv"))


def test_result_file(spark, tmp_path):
    put(tmp_path, "a.csv", [HEAD, ["00001", "Tomas", "Keller", "15.0"], ["00002", "Irene", "Vogel", "ABS"], ["00003", "Hugo", "Sandoval", "15.5"]])
    book(tmp_path, "b.ods", {"": [HEAD, ["00004", "Clara", "Nyman", "13.5"]]})
    got = run(spark, tmp_path, ["a.csv", "b.ods"])
    write_result(got.consolidated, str(tmp_path / "out"), "Partiel", single_file=True)
    (path,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    with open(path, encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == ["Numéro d'identification", "Adresse de courriel", "Prénom", "Nom de famille", "Partiel"]
    assert [r["Partiel"] for r in rows][:5] == ["15", "", "15.5", "13.5", ""]
    assert [r["Numéro d'identification"] for r in rows] == [r[0] for r in ROSTER[1:]]


def test_staged_run_gives_the_same(spark, tmp_path):
    put(tmp_path, "a.csv", [HEAD, ["00001", "Tomas", "Keller", "15"], ["00001", "Tomas", "Keller", "16"]])
    one = run(spark, tmp_path, ["a.csv"])
    two = run(spark, tmp_path, ["a.csv"], stage_rows=True)
    assert outcome(one) == outcome(two) == {"00001": (15.0, "a.csv")}
    assert codes(one) == codes(two) == {("a.csv", "duplicate_claim")}
    assert two.issues.where(F.col("code") == "duplicate_claim").first().detail["earlier_source"] == "a.csv"


def test_no_inputs_is_an_issue(spark, tmp_path):
    got = run(spark, tmp_path, [])
    assert codes(got) == {("", "no_input_files")}
    assert got.totals.first().none == 12


def by_hand(text, delimiter):
    """Number of lines that each record takes, by walking through the characters."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()

    def ends_inside(line, inside):
        at_start, i = not inside, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"' and at_start:
                inside = True
            at_start = not inside and c == delimiter
            i += 1
        return inside

    last = max((i for i, x in enumerate(lines) if not ends_inside(x, True)), default=-1)
    inside, out = False, []
    for i, x in enumerate(lines):
        if inside:
            out[-1].append(x)
        elif x.strip():
            out.append([x])
        else:
            continue
        inside = ends_inside(x, inside) and (inside or i < last)
    return ["\n".join(r) for r in out]


def test_masks_of_lines_join_records_as_by_hand(spark, tmp_path):
    rng = random.Random(11)
    want = {}
    for k in range(6):
        # Blank lines, stray quotes, long runs inside and outside, across words of 64 lines and splits.
        pool = ["a;b", "", 'x;"y', 'z";w', '"q";"r"', 'm;5" n', '"";p', '"o'] + ["c;d"] * (4, 60, 300)[k % 3]
        text = "".join(rng.choice(pool) + "\n" for _ in range(700)) + "a;b;c\n" * 400
        (tmp_path / f"m{k}.csv").write_bytes(text.encode())
        want[f"m{k}.csv"] = by_hand(text, ";")
    (tmp_path / "shut.csv").write_bytes(b'a;"b\n' + b"c;d\n" * 500 + b'e";f\n' + b"g;h\n" * 500)
    want["shut.csv"] = ['a;"b\n' + "c;d\n" * 500 + 'e";f'] + ["g;h"] * 500
    for split in ("134217728", "700"):
        got = scanned(spark, tmp_path, sorted(want), split)
        assert {f: len(r) for f, r in got.items()} == {f: len(r) for f, r in want.items()}
        for f, rows in got.items():
            assert [i for i, _ in rows] == list(range(len(rows)))
            cells = [";".join(c) for _, c in rows]
            assert [c.replace('"', "") for c in cells] == [w.replace('"', "") for w in want[f]]


def test_only_lines_of_open_records_are_grouped(spark, tmp_path):
    body = "".join(f"{i};{i % 20}\n" for i in range(30000))
    (tmp_path / "one.csv").write_bytes(f'id;"No\nte"\n{body}'.encode())
    inputs = list_inputs(spark, str(tmp_path), ["one.csv"])
    lines, errors = scan(spark, inputs)
    assert lines.count() == 30001 and errors.isEmpty()
    plan = lines.select("cells")
    plan.collect()
    sent = exchanged(plan._jdf.queryExecution().executedPlan())
    assert sent and sum(sent) < 2000


def test_lines_and_heads_are_looked_at_once(spark, tmp_path):
    put(tmp_path, "a.csv", [["Relevé\n\n", "", "", ""], HEAD, *([f"{i:05d}", "x\n\n\"y", "z", str(i)] for i in range(90))])
    put(tmp_path, "b.csv", [HEAD, *([f"{i:05d}", "x", "z", str(i)] for i in range(90, 99))], sep=";")
    limits = Limits(broadcast_bytes=0, hot_rows=20)
    seen = observe_files(spark, list_inputs(spark, str(tmp_path), folder="."), limits=limits)
    got = {(r.id_raw, r.first_raw, r.value_raw) for r in seen.observations.collect()}
    assert got == {(f"{i:05d}", 'x\n\n"y' if i < 90 else "x", str(i)) for i in range(99)}
    # Cells are split once, and headers looked for once; neither reads the lines again.
    made = lambda df: {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in df.inputFiles()}
    assert "cells" in made(seen.lines) and not {"lines", "words"} & made(seen.lines)
    resolved = resolve_sheets(seen.lines, limits=limits)
    assert "headers" in made(resolved) and "cells" not in made(resolved)
    # So are the masks of lines, which several aggregates read.
    lines = spark.createDataFrame(
        [("f", 0, i, False, '"a' if i % 5 == 0 else 'b"' if i % 5 == 1 else "c", ",") for i in range(200)],
        "plain string, block bigint, n bigint, blank boolean, text string, delimiter string",
    )
    words = numbered_words(lines, False)
    assert made(words) == {"masks"} and words.agg(F.sum(F.bit_count("inside"))).first()[0] == 40


def test_keys_of_a_large_roster_are_counted_over_written_cells(spark, tmp_path, monkeypatch):
    rows = [[f"{i:05d}", f, n, str(i)] for i, (_, f, n, _) in enumerate(ROSTER[1:], 1)]
    put(tmp_path, "a.csv", [HEAD, *rows[:5]])
    book(tmp_path, "b.ods", {"S": [HEAD, *rows[4:]]})
    read = []
    counted = plan.heavy_keys
    monkeypatch.setattr(plan, "heavy_keys", lambda df, *rest: (read.append(df), counted(df, *rest))[1])
    got = outcome(run(spark, tmp_path, ["a.csv", "b.ods"], limits=Limits(broadcast_bytes=0, hot_rows=20)))
    assert got == {f"{i:05d}": (float(i), "a.csv" if i < 6 else "b.ods") for i in range(1, 13)}
    # Lines are decoded and split once, not again to count keys.
    made = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in read[0].inputFiles()}
    assert "cells" in made and "lines" not in made


def exchanged(node):
    """Bytes that each shuffle of an executed plan wrote."""
    name, out = node.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return exchanged(node.executedPlan())
    if name.endswith("QueryStage"):
        return exchanged(node.plan())
    if name == "Exchange":
        out.append(node.metrics().apply("shuffleBytesWritten").value())
    children = node.children()
    for i in range(children.size()):
        out += exchanged(children.apply(i))
    return out


def test_a_record_over_the_bound_is_reported(spark, tmp_path):
    (tmp_path / "long.csv").write_bytes(b'id;note\n1;"' + b"x\n" * 3000 + b'";2\n')
    (tmp_path / "good.csv").write_bytes(b'id;note\n1;"a\nb"\n2;c\n')
    paths = [str(tmp_path / n) for n in ("long.csv", "good.csv")]
    cells, errors = scan_delimited(spark, paths, record_bytes=1000)
    assert [r.plain.rsplit("/", 1)[1] for r in errors.collect()] == ["long.csv"]
    assert sorted((r.row_idx, list(r.cells)) for r in cells.collect()) == [
        (0, ["id", "note"]), (1, ["1", "a\nb"]), (2, ["2", "c"])
    ]
    assert scan_delimited(spark, paths)[1].isEmpty()
