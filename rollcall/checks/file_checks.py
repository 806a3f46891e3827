"""Checks of listing, scans, the run from files, and the result file."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.checks import fixtures as fx
from rollcall.checks import match_checks as mc
from rollcall.checks.files import new_inputs, write_files
from rollcall.checks.registry import check
from rollcall.operators.decisions import Decisions
from rollcall.operators.lookup import Limits
from rollcall.operators.ordinals import running_start
from rollcall.plans import from_files as ff
from rollcall.plans.reconcile import Params, reconcile
from rollcall.sources.inputs import list_inputs
from rollcall.sources.sink import write_result
from rollcall.sources.staging import stage

HEAD = ["N°étudiant", "Prénom", "Nom", "Note"]
TITLE = ["Relevé de l'épreuve", "", "", ""]

# Chunks of 40 keys: encoding and delimiter change from chunk to chunk.
CUSTOMERS = """
select 'c' || lpad(cast(cast(floor(c_custkey / 40) as bigint) as string), 8, '0') || '.csv' as file,
  cast(floor(c_custkey / 40) as bigint) as chunk, c_custkey as key,
  cast(c_custkey as string) as id, replace(c_name, 'Customer', 'Élève d''été') as first_name,
  c_mktsegment || ', "x"; y' || ' | z' as last_name,
  replace(cast(cast(c_acctbal as decimal(12,2)) as string), '.', ',') as val
from customer
"""


@check("scan_csv_roundtrip", f"select file, key, id, first_name, last_name, val from ({CUSTOMERS})")
def scan_csv_roundtrip(spark, sf):
    fx.register(spark, sf, "customer")
    rows = spark.sql(CUSTOMERS).withColumns(
        {
            "sheet": F.lit(""),
            "encoding": F.expr("element_at(array('utf-8', 'utf-8-sig', 'cp1252', 'latin-1', 'utf-7'), cast(chunk % 5 as int) + 1)"),
            "delimiter": F.expr("element_at(array(',', ';', '\t', '|'), cast(chunk % 4 as int) + 1)"),
            "cells": F.array("id", "first_name", "last_name", "val"),
        }
    ).select("file", "sheet", "encoding", "delimiter", "key", "cells")
    folder = new_inputs(spark, "customers")
    write_files(rows, [TITLE, HEAD], folder)
    lines, errors = ff.scan(spark, list_inputs(spark, "/", folder=folder))
    name = F.regexp_extract("plain", "([^/]+)$", 1)
    cell = lambda i: F.get("cells", F.lit(i))
    return lines.where("row_idx >= 2").select(
        name.alias("file"), cell(0).cast("bigint").alias("key"), cell(0).alias("id"),
        cell(1).alias("first_name"), cell(2).alias("last_name"), cell(3).alias("val"),
    )


# Cells with breaks, blank lines, quotes and delimiters, and records of over 131,072 characters.
QUOTED = """
select 'q' || lpad(cast(cast(floor(c_custkey / 40) as bigint) as string), 8, '0') || '.csv' as file,
  cast(floor(c_custkey / 40) as bigint) as chunk, c_custkey as key, cast(c_custkey as string) as id,
  c_name || chr(10) || chr(10) || '"' || c_mktsegment || '",;|' as first_name,
  case when c_custkey % 40 = 7 then repeat(c_mktsegment || ' ', 15000) || chr(10) || 'end' else c_mktsegment || '" ' end as last_name,
  cast(c_custkey % 20 as string) as val
from customer
"""


@check("scan_quoted_breaks", f"select file, key, id, first_name, last_name, val from ({QUOTED})")
def scan_quoted_breaks(spark, sf):
    lines, _ = ff.scan(spark, list_inputs(spark, "/", folder=_quoted(spark, sf)))
    cell = lambda i: F.get("cells", F.lit(i))
    return lines.where("row_idx >= 2").select(
        F.regexp_extract("plain", "([^/]+)$", 1).alias("file"), cell(0).cast("bigint").alias("key"),
        cell(0).alias("id"), cell(1).alias("first_name"), cell(2).alias("last_name"), cell(3).alias("val"),
    )


def _quoted(spark, sf):
    fx.register(spark, sf, "customer")
    rows = spark.sql(QUOTED).select(
        "file", F.lit("").alias("sheet"), F.lit("utf-8").alias("encoding"),
        F.expr("element_at(array(',', ';', '\t', '|'), cast(chunk % 4 as int) + 1)").alias("delimiter"),
        "key", F.array("id", "first_name", "last_name", "val").alias("cells"),
    )
    folder = new_inputs(spark, "quoted")
    write_files(rows, [["Titre" + "\n" * 12, "", "", ""], HEAD], folder)
    return folder


@check("scan_shuffled", f"select file, key, id, first_name, last_name, val from ({QUOTED})")
def scan_shuffled(spark, sf):
    """Records with breaks, with no table of files, splits or sheets small enough to broadcast."""
    limits = Limits(broadcast_bytes=0, hot_rows=20)
    inputs = list_inputs(spark, "/", folder=_quoted(spark, sf))
    return ff.observe_files(spark, inputs, limits=limits).observations.select(
        "file", F.col("id_raw").cast("bigint").alias("key"), F.col("id_raw").alias("id"),
        F.col("first_raw").alias("first_name"), F.col("last_raw").alias("last_name"), F.col("value_raw").alias("val"),
    )


# Texts that mean null, fixed values, and some that look like them.
NULLISH = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NO_NULLS = ["none", "NAN", "Null", "N.A.", "0"]
NULL_CELLS = f"""
select 'n' || lpad(cast(cast(floor(c_custkey / 300) as bigint) as string), 8, '0') ||
    case cast(floor(c_custkey / 300) as bigint) % 3 when 0 then '.csv' when 1 then '.xlsx' else '.ods' end as file,
  c_custkey as key, 'C' || cast(c_custkey as string) as id,
  case cast(c_custkey % {len(NULLISH + NO_NULLS)} as int)
    {" ".join(f"when {i} then '{t}'" for i, t in enumerate(NULLISH + NO_NULLS))} end as first_name,
  c_name as last_name,
  case when c_custkey % 5 = 0 then 'NULL' else cast(c_custkey % 20 as string) end as val
from customer
"""


@check(
    "null_tokens",
    f"""
    select file, key, id, case when key % {len(NULLISH + NO_NULLS)} >= {len(NULLISH)} then first_name end as first_name,
      last_name, case when val <> 'NULL' then val end as val from ({NULL_CELLS})
    """,
)
def null_tokens(spark, sf):
    """Cells that mean null, from files of each kind."""
    fx.register(spark, sf, "customer")
    rows = spark.sql(NULL_CELLS).select(
        "file", F.lit("").alias("sheet"), F.lit("utf-8").alias("encoding"), F.lit(";").alias("delimiter"), "key",
        F.array("id", "first_name", "last_name", "val").alias("cells"),
    )
    folder = new_inputs(spark, "nulls")
    write_files(rows, [HEAD], folder)
    return ff.observe_files(spark, list_inputs(spark, "/", folder=folder)).observations.select(
        "file", F.substring("id_raw", 2, 20).cast("bigint").alias("key"), F.col("id_raw").alias("id"),
        F.col("first_raw").alias("first_name"), F.col("last_raw").alias("last_name"), F.col("value_raw").alias("val"),
    )


ORDERS = """
select 'o' || lpad(cast(cast(floor(o_orderkey / 2000) as bigint) as string), 8, '0') || '{0}' as file,
  o_orderpriority as sheet, o_orderkey as key, 'R' || cast(o_orderkey as string) as id,
  o_orderstatus as first_name, 'N' || cast(o_custkey as string) as last_name,
  cast(cast(o_totalprice as decimal(12,1)) + 0.5 as string) as val
from orders
"""


def _workbooks(spark, sf, ext):
    fx.register(spark, sf, "orders")
    rows = spark.sql(ORDERS.format(ext)).select(
        "file", "sheet", F.lit("").alias("encoding"), F.lit("").alias("delimiter"), "key",
        F.array("id", "first_name", "last_name", "val").alias("cells"),
    )
    folder = new_inputs(spark, "orders")
    write_files(rows, [TITLE, HEAD], folder)
    seen = ff.observe_files(spark, list_inputs(spark, "/", folder=folder))
    return seen.observations.select(
        "file", "sheet", F.col("id_raw").alias("id"), F.col("first_raw").alias("first_name"),
        F.col("last_raw").alias("last_name"), F.col("value_raw").cast("double").alias("val"),
    )


WORKBOOK_SQL = "select file, sheet, id, first_name, last_name, cast(val as double) as val from ({0})"


@check("scan_xlsx_roundtrip", WORKBOOK_SQL.format(ORDERS.format(".xlsx")))
def scan_xlsx_roundtrip(spark, sf):
    return _workbooks(spark, sf, ".xlsx")


@check("scan_ods_roundtrip", WORKBOOK_SQL.format(ORDERS.format(".ods")))
def scan_ods_roundtrip(spark, sf):
    return _workbooks(spark, sf, ".ods")


SUPPLIERS = """
select 's' || lpad(cast(cast(floor(s_suppkey / 10) as bigint) as string), 8, '0') ||
    case when floor(s_suppkey / 10) % 4 = 0 then '.bad.xlsx' when floor(s_suppkey / 10) % 4 = 1 then '.json'
         when floor(s_suppkey / 10) % 4 = 2 then '.TXT' else '.csv' end as file,
  s_suppkey as key, cast(s_suppkey as string) as id, s_name as name, cast(s_acctbal as string) as val
from supplier
"""


def _suppliers(spark, sf):
    fx.register(spark, sf, "supplier")
    rows = spark.sql(SUPPLIERS).select(
        "file", F.lit("").alias("sheet"), F.lit("utf-8").alias("encoding"), F.lit(";").alias("delimiter"), "key",
        F.array("id", "name", "name", "val").alias("cells"),
    )
    folder = new_inputs(spark, "suppliers")
    write_files(rows, [HEAD], folder)
    return folder


@check(
    "list_inputs",
    f"""
    with f as (select distinct file, regexp_extract(lower(file), '(\\.[a-z]*)$', 1) as ext from ({SUPPLIERS}))
    select row_number() over (order by file) - 1 as file_ord, file, ext from f where ext <> '.json'
    """,
)
def listing(spark, sf):
    inputs = list_inputs(spark, "/", folder=_suppliers(spark, sf))
    return inputs.select(F.col("file_ord").cast("bigint").alias("file_ord"), "file", "ext")


@check(
    "scan_bad_file",
    f"""
    select file, case when file like '%.bad.xlsx' or file like '%.json' then 0 else count(*) end as n,
      file like '%.bad.xlsx' or file like '%.json' as unreadable from ({SUPPLIERS}) group by file
    """,
)
def scan_bad_file(spark, sf):
    folder = _suppliers(spark, sf)
    names = [r.path for r in spark.read.format("binaryFile").load(f"{folder}/*").select("path").collect()]
    inputs = list_inputs(spark, "/", files=names)
    seen = ff.observe_files(spark, inputs)
    rows = seen.observations.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n"))
    bad = seen.issues.where("code = 'unreadable'").select("file", F.lit(True).alias("bad")).distinct()
    return (
        inputs.join(rows, "file_ord", "left").join(bad, "file", "left")
        .select("file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("bad", F.lit(False)).alias("unreadable"))
    )


# The flagship's rows as files of 1000 order keys each, in five formats. Names
# sort as the rows do, so the first claims are the same.
CHUNK = "lpad(cast(cast(floor(o1 / 1000) as bigint) as string), 8, '0')"
STYLE = "cast(floor(o1 / 1000) as bigint) % 5"
FILE_NAME = f"""file || '-' || {CHUNK} || case {STYLE} when 0 then '.csv' when 1 then '.txt'
  when 2 then '.tsv' when 3 then '.xlsx' else '.ods' end"""

FROM_FILES = mc.PAIR + f""",
v as (select *, {FILE_NAME} as source_file, trim(coalesce(value_raw, '')) as s,
    upper(trim(value_raw)) in ('ABS') as gone from matched),
w as (select v.*, case when not gone then try_cast(replace(s, ',', '.') as double) end as num from v),
z as (select *, row_number() over (partition by member order by file, o1, o2, o3, o4) as rn
    from w where member is not null and (num is not null or gone)),
result as (select r.id, r.email, r.first_name, r.last_name, z.num as value, coalesce(z.gone, false) as is_absent,
    z.source_file as source from roster r left join z on z.member = r.id and z.rn = 1)
"""


@check("reconcile_from_files", FROM_FILES + "select * from result")
def reconcile_from_files(spark, sf):
    roster = fx.roster(spark, sf)
    rows = spark.sql(f"select *, {FILE_NAME} as name, {STYLE} as style from ({fx.OBSERVATIONS})")
    folder = new_inputs(spark, "observations")
    files = rows.select(
        F.col("name").alias("file"), F.lit("").alias("sheet"),
        F.expr("element_at(array('utf-8', 'cp1252', 'utf-7', '', ''), cast(style as int) + 1)").alias("encoding"),
        F.expr("element_at(array(';', ',', '\t', '', ''), cast(style as int) + 1)").alias("delimiter"),
        F.concat_ws(".", *(F.lpad(F.col(c).cast("string"), 12, "0") for c in ("o1", "o2", "o3", "o4"))).alias("key"),
        F.array("id_raw", "first_raw", "last_raw", "value_raw").alias("cells"),
    )
    write_files(files, [TITLE, HEAD], folder)
    inputs = list_inputs(spark, "/", folder=folder)
    seen = ff.observe_files(spark, inputs)
    run = reconcile(roster, seen.observations, inputs.select("file_ord", "file"), params=Params())
    return run.consolidated.drop("roster_ord")


@check(
    "sink_roundtrip",
    mc.RESULT + """select id as "Numéro d'identification", email as "Adresse de courriel", first_name as "Prénom",
      last_name as "Nom de famille", case when value is not null and not is_absent then format('{:g}', value) end as "Partiel"
    from result""",
)
def sink_roundtrip(spark, sf):
    folder = new_inputs(spark, "result")
    write_result(mc._run(spark, sf).consolidated, folder, "Partiel")
    return spark.read.csv(folder, header=True, escape='"')




@check(
    "sink_order",
    mc.RESULT + """select row_number() over (order by roster_ord) - 1 as position, id from result""",
)
def sink_order(spark, sf):
    """Place of each member in the parts of the result file, read in the order of their names."""
    folder = new_inputs(spark, "result")
    write_result(mc._run(spark, sf).consolidated, folder)
    rows = spark.read.csv(folder, header=True, escape='"')
    rows = rows.select(
        F.col(rows.columns[0]).alias("id"), F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.lit(1).alias("one"),
    )
    placed = running_start(stage(rows, "written"), ["part", "block", "n"], "one", "position")
    return placed.select("position", "id")


MIXED = f"f as (select distinct file, regexp_extract(lower(file), '(\\.[a-z]*)$', 1) as ext from ({SUPPLIERS}))"


@check(
    "list_inputs_mixed",
    f"""
    with {MIXED}, given as (
      select file, ext, false as missing, row_number() over (order by file desc) as nth from f where ext in ('.json', '.csv')
      union all select 'gone.csv', '.csv', true, 0),
    placed as (
      select 0 as part, nth, file, ext, missing from given
      union all select 1, row_number() over (order by file), file, ext, false from f where ext not in ('.json', '.csv'))
    select row_number() over (order by part, nth) - 1 as file_ord, file, ext, missing from placed
    """,
)
def list_inputs_mixed(spark, sf):
    """Files named one by one, some twice, one missing, one of an unread kind, then the rest of their folder."""
    folder = _suppliers(spark, sf)
    names = [r.path for r in spark.read.format("binaryFile").load(f"{folder}/*").select("path").collect()]
    named = sorted((n for n in names if n.endswith((".json", ".csv"))), reverse=True)
    inputs = list_inputs(spark, folder, ["gone.csv", *named, "./gone.csv", *named[:1]], ".")
    return inputs.select(
        F.col("file_ord").cast("bigint").alias("file_ord"), "file", "ext", F.col("length").isNull().alias("missing")
    )


# Quotes inside cells, which open nothing; after them, in odd chunks, one at the start of a cell that no line closes.
STRAY = """
select 'y' || lpad(cast(cast(floor(c_custkey / 40) as bigint) as string), 8, '0') || '.csv' as file, c_custkey as key,
  cast(c_custkey as string) as id, c_mktsegment || case when c_custkey % 40 < 37 then ' 5" disk' else '' end as first_name,
  case when c_custkey % 80 = 77 then '"' else '' end || c_name as last_name, cast(c_custkey % 20 as string) as val
from customer
"""


@check("scan_stray_quote", f"select file, key, id, first_name, last_name, val from ({STRAY})")
def scan_stray_quote(spark, sf):
    fx.register(spark, sf, "customer")
    rows = spark.sql(STRAY).select(
        "file", F.lit("").alias("sheet"), F.lit("raw").alias("encoding"), F.lit(";").alias("delimiter"), "key",
        F.array("id", "first_name", "last_name", "val").alias("cells"),
    )
    folder = new_inputs(spark, "stray")
    write_files(rows, [HEAD], folder)
    lines, _ = ff.scan(spark, list_inputs(spark, "/", folder=folder))
    cell = lambda i: F.get("cells", F.lit(i))
    return lines.where("row_idx >= 1").select(
        F.regexp_extract("plain", "([^/]+)$", 1).alias("file"), cell(0).cast("bigint").alias("key"),
        cell(0).alias("id"), cell(1).alias("first_name"), cell(2).alias("last_name"), cell(3).alias("val"),
    )


# Two suppliers to a file; each file shows one way in which a file or sheet may be settled or fail.
PROBLEMS = {
    "plain": (".csv", [""], HEAD, []),
    "ids": (".txt", [""], ["Numero", "Numero etudiant", "Nom", "Note"], ["ambiguous_role", "first_match_used"]),
    "prefix": (".csv", [""], [*HEAD[:3], "Note /20"], ["value_by_prefix"]),
    "prefixes": (".tsv", [""], [HEAD[0], HEAD[2], "Note /20", "Note /23"], ["value_ambiguous_prefix", "sheet_no_value_column"]),
    "content": (".csv", [""], [*HEAD[:3], "Partiel"], ["value_by_content"]),
    "none": (".csv", [""], [*HEAD[:2], "Sujet", "Salle"], ["value_none", "sheet_no_value_column"]),
    "unkeyed": (".csv", [""], ["Foo", "Bar", "Baz", "Note"], ["sheet_no_key_column"]),
    "empty": (".csv", [""], HEAD, ["empty_sheet"]),
    "books": (".xlsx", ["A", "B"], HEAD, ["sheet_processing"]),
    "chosen": (".ods", ["A", "B"], HEAD, ["sheet_processing"]),
    "refused": (".xlsx", ["A", "B"], HEAD, []),
    "useless": (".ods", ["A", "B"], ["Foo", "Bar", "Baz", "Bat"], []),
    "damaged": (".bad.xlsx", [""], HEAD, []),
}
OF_FILE = {"books": "all_sheets_used", "chosen": "saved_sheets_used", "refused": "saved_sheets_used,no_sheet_selected",
           "useless": "no_valid_sheet", "damaged": "unreadable"}
KINDS = list(PROBLEMS)
PICKED = " ".join(f"when {i} then '{k}{PROBLEMS[k][0]}'" for i, k in enumerate(KINDS))
PROBLEM_ROWS = f"""
select 'p' || lpad(cast(cast(floor(s_suppkey / 2) as bigint) as string), 8, '0') || '-' ||
    case cast(floor(s_suppkey / 2) as bigint) % {len(KINDS)} {PICKED} end as file,
  cast(floor(s_suppkey / 2) as bigint) % {len(KINDS)} as kind, s_suppkey as key, s_name as name from supplier
"""


def _told(kind: int, sheet: str, codes: list[str]) -> list[str]:
    return [f"({kind}, '{sheet}', '{c}')" for c in codes]


TOLD = ", ".join(
    v for i, k in enumerate(KINDS)
    for v in [*_told(i, "", [c for c in OF_FILE.get(k, "").split(",") if c]),
              *(w for s in PROBLEMS[k][1] if not (k == "chosen" and s == "B") for w in _told(i, s, PROBLEMS[k][3]))]
)


@check(
    "issues_files",
    f"""
    select distinct file, sheet, code, case when code in ('saved_sheets_used') then 'dim'
        when code in ('all_sheets_used', 'no_valid_sheet', 'first_match_used', 'value_by_prefix', 'value_by_content', 'value_none',
          'sheet_processing') then 'info' else 'warn' end as severity
    from ({PROBLEM_ROWS}) p join (values {TOLD}) t(kind, sheet, code) on p.kind = t.kind
    """,
)
def issues_files(spark, sf):
    """Issue codes of files and of sheets, each kind of file in turn."""
    fx.register(spark, sf, "supplier")
    made = spark.sql(PROBLEM_ROWS)
    text = lambda values: F.array(*(F.lit(v) for v in values))
    heads, sheets = F.lit(None), F.lit(None)
    for i, k in enumerate(KINDS):
        heads = F.when(F.col("kind") == i, text(PROBLEMS[k][2])).otherwise(heads)
        sheets = F.when(F.col("kind") == i, text(PROBLEMS[k][1])).otherwise(sheets)
    first = made.groupBy("file", "kind").agg(F.lit(-1).cast("bigint").alias("key")).withColumn("cells", heads)
    number = (F.col("key") % 20).cast("string")
    body = made.where(F.col("kind") != KINDS.index("empty")).select(
        "file", "kind", F.col("key").cast("bigint").alias("key"),
        F.when(F.col("kind") == KINDS.index("none"), F.array(F.lit("i"), "name", "name", "name"))
        .otherwise(F.array(F.col("key").cast("string"), "name", "name", number)).alias("cells"),
    )
    rows = first.unionByName(body).select(
        "file", F.explode(sheets).alias("sheet"), F.lit("utf-8").alias("encoding"), F.lit(";").alias("delimiter"),
        "key", "cells",
    )
    folder = new_inputs(spark, "problems")
    write_files(rows, [], folder)
    choice = F.when(F.col("kind") == KINDS.index("chosen"), "A")
    answered = made.where(F.col("kind").isin(KINDS.index("chosen"), KINDS.index("refused")))
    answers = Decisions(sheet_selection=answered.select("file", choice.alias("sheet")).distinct())
    inputs = list_inputs(spark, "/", folder=folder)
    return ff.observe_files(spark, inputs, answers).issues.select("file", "sheet", "code", "severity")


# A whole run with a workbook as roster: nations are the members, so each has a large share of all rows.
NATIONS = """
select cast(n_nationkey as string) as id, n_name as first_name, r_name as last_name,
  'n' || cast(n_nationkey as string) || '@example.org' as email, n_nationkey as ord
from nation join region on n_regionkey = r_regionkey
"""
VOTES = f"""
select 'v' || lpad(cast(cast(floor(c_custkey / 500) as bigint) as string), 8, '0') ||
    case cast(floor(c_custkey / 500) as bigint) % 3 when 0 then '.csv' when 1 then '.xlsx' else '.ods' end as file,
  cast(floor(c_custkey / 500) as bigint) as chunk, c_custkey as key,
  case when c_custkey % 5 = 0 then null when c_custkey % 37 = 0 then 'X' || n.id else n.id end as id_raw,
  case when c_custkey % 7 = 0 then 'Autre' when c_custkey % 10 = 5 then n.last_name else n.first_name end as first_raw,
  case when c_custkey % 10 = 5 and c_custkey % 7 <> 0 then n.first_name else n.last_name end as last_raw,
  case when c_custkey % 3 = 0 then '' when c_custkey % 11 = 3 then 'ABS' when c_custkey % 17 = 2 then '15/20'
    when c_custkey % 19 = 4 then 'Malade' else cast(c_custkey * 7 % 30 - 3 as string) || ',5' end as value_raw
from customer join ({NATIONS}) n on n.id = cast(c_nationkey as string)
"""
RUN_SQL = f"""
with roster as ({NATIONS}), v as (select * from ({VOTES})),
matched as (
  select v.*, case
    when r.id is not null and first_raw = r.first_name and last_raw = r.last_name then r.id
    when r.id is not null and first_raw = r.last_name and last_raw = r.first_name then r.id
    when r.id is not null then case when cast(r.id as int) % 3 = 0 then null else r.id end
    else coalesce(a.id, b.id) end as member
  from v left join roster r on r.id = v.id_raw
    left join roster a on a.first_name = first_raw and a.last_name = last_raw
    left join roster b on b.first_name = last_raw and b.last_name = first_raw),
valued as (select *, value_raw in ('ABS', 'Malade') as gone, try_cast(replace(value_raw, ',', '.') as double) as num from matched),
clamped as (select *, case when num > 20 and chunk % 2 = 0 then 20.0 else num end as val from valued),
firsts as (select *, row_number() over (partition by member order by file, key) as rn
  from clamped where member is not null and (num is not null or gone))
select r.id, r.email, r.first_name, r.last_name, case when not f.gone then f.val end as value,
  coalesce(f.gone, false) as is_absent, f.file as source
from roster r left join firsts f on f.member = r.id and f.rn = 1
"""


@check("run_from_workbook", RUN_SQL)
def run_from_workbook(spark, sf):
    """Roster, files, saved answers and bounds, all from files, in one call."""
    fx.register(spark, sf, "nation", "region", "customer")
    members, votes = spark.sql(NATIONS), spark.sql(VOTES)
    made = lambda df, file, sheet, key, cells: df.select(
        file.alias("file"), F.lit(sheet).alias("sheet"), F.lit("utf-8").alias("encoding"), F.lit(";").alias("delimiter"),
        key.cast("bigint").alias("key"), F.array(*cells).alias("cells"),
    )
    base, folder = new_inputs(spark, "roster"), new_inputs(spark, "votes")
    listed = made(members, F.lit("roster.xlsx"), "Liste", F.col("ord"), ["id", "first_name", "last_name", "email"])
    write_files(listed, [["Liste de l'année", "", "", ""], ["Numero", "Prénom", "Nom", "Courriel"]], base)
    cells = ["id_raw", "first_raw", "last_raw", "value_raw"]
    write_files(made(votes, F.col("file"), "", F.col("key"), cells), [TITLE, HEAD], folder)
    decisions = Decisions(
        name_decisions=votes.join(members.select("id"), F.col("id_raw") == F.col("id")).where("try_cast(id as int) % 3 = 0")
        .select("file", "id", F.lit(False).alias("answer")).distinct(),
        absent_tokens=members.groupBy().agg(F.lit("Malade").alias("token")),
        clamp_choices=votes.where("chunk % 2 = 0").select(
            "file", F.lit("").alias("sheet"), F.lit("above").alias("direction"), F.lit(True).alias("answer")).distinct(),
    )
    run = ff.reconcile_files(
        spark, f"{base}/roster.xlsx", folder=folder, decisions=decisions, params=Params(min_value=-5, max_value=20)
    )
    return run.consolidated.drop("roster_ord")
