"""Checks of header repair and column roles, on lines made of table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.checks import fixtures as fx
from rollcall.checks.registry import check
from rollcall.operators import decisions as dec
from rollcall.operators import schema as sc
from rollcall.operators.lookup import Limits

# Every file holds one whole table: two title lines, a header line, the data.
# row_idx numbers the lines of a file from 0 as its key columns do.
PARTS = {
    # file, sheet, header line, title lines above it, table, key, cells
    ("supplier.csv", ""): (
        ["Numéro", "Prénom", "Nom", "Note /20", "Note /23"], 0, "supplier", "s_suppkey",
        ["cast(s_suppkey as string)", "s_name", "cast(s_nationkey as string)",
         "cast(s_acctbal as string)", "cast(s_nationkey as string)"]),
    ("customer.csv", ""): (
        ["N°étudiant", " NOM ÉTU ", "Q1", "Total", "note"], 2, "customer", "c_custkey",
        ["cast(c_custkey as string)", "c_name", "cast(c_nationkey as string)",
         "cast(c_acctbal as string)", "c_mktsegment"]),
    ("part.xlsx", "DC-1"): (
        ["NIP", "Student ID", "Prénom", "Nom de famille", "Notes sur 23"], 0, "part", "p_partkey",
        ["cast(p_partkey as string)", "p_brand", "p_name", "p_type", "cast(p_size as string)"]),
    ("part.xlsx", "DC-2"): (
        ["Identifiant", "q3", "taille", "Email", "type"], 1, "part", "p_partkey",
        ["cast(p_partkey as string)", "cast(p_size as string)",
         "case when p_size > 25 then 'ABS' else cast(p_size as string) end",
         "cast(p_retailprice as string)", "p_type"]),
    ("part.xlsx", "Infos"): (
        ["Foo", "Baz", "x", "y", "z"], 0, "part", "p_partkey",
        ["p_name", "p_brand", "p_type", "p_brand", "p_name"]),
    ("events.csv", ""): (
        ["étudiant", "a", "b", "c", "d"], 0, "events", "event_id",
        ["cast(user_id as string)", "event_type", "cast(value as string)",
         "case when event_type = 'error' then '' else cast(event_id as string) end", "props"]),
    ("nation.csv", ""): (
        ["Foo", "Bar", "Baz", "note", "Note"], 0, "nation", "n_nationkey",
        ["n_name", "cast(n_nationkey as string)", "n_name", "'12'", "'13'"]),
    ("region.csv", ""): (
        ["Foo", "Bar", "Baz", "x", "grade"], 0, "region", "r_regionkey",
        ["r_name", "cast(r_regionkey as string)", "r_name", "'a'", "'13'"]),
}
FILE_ORDER = ["supplier.csv", "customer.csv", "part.xlsx", "events.csv", "nation.csv", "region.csv"]
TITLES = [["Relevé", "", "", "", ""], ["", "Prénom", "", "", ""]]
WIDTH = 5


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql() -> str:
    """Lines with cells c0..c4, in SQL that Spark and DuckDB share."""
    selects = []
    for i, ((file, sheet), (header, above, table, key, cells)) in enumerate(PARTS.items()):
        place = f"{FILE_ORDER.index(file)} as file_ord, {_quote(file)} as file, {i} as sheet_ord, {_quote(sheet)} as sheet"
        head = [*TITLES[:above], header]
        for n, line in enumerate(head):
            cols = ", ".join(f"{_quote(c)} as c{j}" for j, c in enumerate(line))
            selects.append(f"select {place}, cast({n} as bigint) as row_idx, {cols}")
        cols = ", ".join(f"{c} as c{j}" for j, c in enumerate(cells))
        selects.append(f"select {place}, cast({key} as bigint) + {len(head)} as row_idx, {cols} from {table}")
    return " union all ".join(selects)


LINES = _lines_sql()
CELLS = [f"c{j}" for j in range(WIDTH)]


def lines(spark, sf):
    fx.register(spark, sf, *{p[2] for p in PARTS.values()})
    wide = spark.sql(LINES)
    return wide.select(*sc.SHEET, "row_idx", F.array(*CELLS).alias("cells"))


NORM = r"trim(regexp_replace(replace(replace(strip_accents(lower({0})), '°', 'o '), 'º', 'o '), '[-_''\s]+', ' ', 'g'))"
ALIASES = ", ".join(_quote(a) for a in sc.ALL_ALIASES)
ROLE_LIST = {r: ", ".join(_quote(a) for a in v) for r, v in sc.ALIASES.items()}
# Long form of the lines: one row per cell, with its normal form.
LONG = f"""
with lines as ({LINES}),
cells as (
  {" union all ".join(f"select file_ord, file, sheet_ord, sheet, row_idx, {j} as idx, c{j} as cell from lines" for j in range(WIDTH))}),
norm as (select *, {NORM.format('cell')} as norm from cells),
hits as (select file_ord, file, sheet_ord, sheet, row_idx,
    count(case when norm in ({ALIASES}) then 1 end) as hits
    from norm where row_idx <= 11 group by all),
first as (select * from hits where row_idx = 0),
best as (select *, row_number() over (partition by sheet_ord order by hits desc, row_idx) as rk
    from hits where row_idx between 1 and 10),
heads as (select f.file_ord, f.file, f.sheet_ord, f.sheet,
    case when f.hits >= 2 then 0 when b.hits > f.hits then b.row_idx else 0 end as header_row,
    case when f.hits >= 2 then f.hits when b.hits > f.hits then b.hits else f.hits end as hits
    from first f join best b on b.sheet_ord = f.sheet_ord and b.rk = 1),
marked as (select h.*, count(*) over (partition by file_ord) = 1 or hits >= 2 as kept from heads h),
sheets as (select *, count(case when kept then 1 end) over (partition by file_ord) > 1 as is_multi from marked),
cols as (select h.file_ord, h.file, h.sheet_ord, h.sheet, h.header_row, n.idx, trim(n.cell) as name, n.norm
    from sheets h join norm n on n.sheet_ord = h.sheet_ord and n.row_idx = h.header_row)
"""


@check("alias_hits", LONG + "select file, sheet, row_idx, hits from hits")
def alias_hits(spark, sf):
    return sc.head_lines(lines(spark, sf)).select("file", "sheet", "row_idx", "hits")


@check("header_row", LONG + "select file, sheet, header_row, hits from heads")
def header_row(spark, sf):
    return sc.find_headers(lines(spark, sf)).select("file", "sheet", "header_row", "hits")


@check(
    "promote_header",
    LONG + """select c.file, c.sheet, n.row_idx - c.header_row - 1 as row_idx,
      string_agg(c.name || '=' || coalesce(n.cell, ''), ';' order by c.idx) as cells
    from cols c join norm n on n.sheet_ord = c.sheet_ord and n.idx = c.idx and n.row_idx > c.header_row
    group by 1, 2, 3""",
)
def promote_header(spark, sf):
    rows = lines(spark, sf)
    heads = sc.find_headers(rows).select("sheet_ord", "header_row", "names")
    joined = rows.join(F.broadcast(heads), "sheet_ord").where("row_idx > header_row")
    named = F.zip_with("names", "cells", lambda n, c: F.concat(n, F.lit("="), F.coalesce(c, F.lit(""))))
    return joined.select(
        "file", "sheet", (F.col("row_idx") - F.col("header_row") - 1).alias("row_idx"),
        F.array_join(named, ";").alias("cells"),
    )


@check("sheet_filter", LONG + "select file, sheet, kept, is_multi from sheets")
def sheet_filter(spark, sf):
    return sc.select_sheets(sc.find_headers(lines(spark, sf))).select("file", "sheet", "kept", "is_multi")


@check(
    "role_columns",
    LONG + " union all ".join(
        f"select file, sheet, '{r}' as role, string_agg(name, ';' order by idx) as names, min(idx) as first_idx "
        f"from cols where norm in ({a}) group by 1, 2" for r, a in ROLE_LIST.items()
    ),
)
def role_columns(spark, sf):
    sheets = sc.with_columns_listed(sc.select_sheets(sc.find_headers(lines(spark, sf))))
    per_role = F.array(*(F.struct(F.lit(r).alias("role"), sc.role_matches(r).alias("found")) for r in sc.ALIASES))
    return (
        sheets.select("file", "sheet", F.inline(per_role))
        .where(F.size("found") > 0)
        .select("file", "sheet", "role", F.array_join("found.name", ";").alias("names"),
                F.get("found", F.lit(0))["idx"].alias("first_idx"))
    )


ROLES = LONG + f""",
key_cols as (select sheet_ord, {", ".join(f"min(case when norm in ({ROLE_LIST[r]}) then idx end) as at_{r}" for r in sc.KEY_ROLES)}
    from cols group by 1),
free as (select c.* from cols c join key_cols k on k.sheet_ord = c.sheet_ord
    where c.idx not in (coalesce(at_id, -1), coalesce(at_first_name, -1), coalesce(at_last_name, -1), coalesce(at_full_name, -1))),
tiers as (select sheet_ord,
    count(case when norm in ({ROLE_LIST['value']}) then 1 end) as n_exact,
    min(case when norm in ({ROLE_LIST['value']}) then idx end) as exact_idx,
    count(case when norm in ('total', 'total general') then 1 end) as n_total,
    min(case when norm in ('total', 'total general') then idx end) as total_idx,
    count(case when regexp_matches(norm, '^({"|".join(sc.ALIASES["value"])}) ') then 1 end) as n_prefix,
    min(case when regexp_matches(norm, '^({"|".join(sc.ALIASES["value"])}) ') then idx end) as prefix_idx
    from free group by 1),
profile as (select f.sheet_ord, f.idx, f.norm, count(nullif(n.cell, '')) as filled,
    count(case when upper(trim(n.cell)) = 'ABS' or try_cast(replace(trim(n.cell), ',', '.') as double) between 0 and 25 then 1 end) as valid
    from free f join norm n on n.sheet_ord = f.sheet_ord and n.idx = f.idx and n.row_idx > f.header_row group by all),
content as (select p.sheet_ord, count(*) as n_content, min(p.idx) as content_idx from profile p
    join tiers t on t.sheet_ord = p.sheet_ord and n_exact = 0 and n_prefix = 0
    where filled > 0 and valid >= greatest(1, floor(0.5 * filled)) and not regexp_matches(p.norm, '^q[0-9]+$') group by 1),
settled as (select s.*, k.*, t.*, coalesce(n_content, 0) as n_content,
    case when n_total > 0 then total_idx when n_exact = 1 then exact_idx when n_exact > 1 then null
         when n_prefix = 1 then prefix_idx when n_prefix > 1 then null
         when n_content = 1 then content_idx end as at_value
    from sheets s join key_cols k on k.sheet_ord = s.sheet_ord join tiers t on t.sheet_ord = s.sheet_ord
    left join content c on c.sheet_ord = s.sheet_ord where kept),
usable as (select *, at_value is not null and
    (at_id is not null or at_full_name is not null or (at_first_name is not null and at_last_name is not null)) as usable
    from settled)
"""


def _resolved(spark, sf, **kw):
    return sc.resolve_sheets(lines(spark, sf), **kw).where("selected")


@check(
    "role_resolution",
    ROLES + "select file, sheet, at_id, at_first_name, at_last_name, at_full_name from settled",
)
def role_resolution(spark, sf):
    return _resolved(spark, sf).select(
        "file", "sheet", *(F.col(f"col_{r}")["idx"].alias(f"at_{r}") for r in sc.KEY_ROLES)
    )


@check("value_exact", ROLES + "select file, sheet, n_exact, n_total, case when n_total > 0 then total_idx when n_exact = 1 then exact_idx end as at_value from settled where n_exact > 0")
def value_exact(spark, sf):
    df = _resolved(spark, sf).where(F.size("exact") > 0)
    return df.select(
        "file", "sheet", F.size("exact").cast("bigint").alias("n_exact"),
        F.size("totals").cast("bigint").alias("n_total"), F.col("by_name")["idx"].alias("at_value"),
    )


@check("value_prefix", ROLES + "select file, sheet, n_prefix, case when n_prefix = 1 then prefix_idx end as at_value from settled where n_exact = 0 and n_prefix > 0")
def value_prefix(spark, sf):
    df = _resolved(spark, sf).where("n_prefixed > 0")
    return df.select(
        "file", "sheet", F.col("n_prefixed").cast("bigint").alias("n_prefix"), F.col("by_name")["idx"].alias("at_value")
    )


@check("column_profile", ROLES + "select sheet_ord, idx, filled, valid, filled > 0 and valid >= greatest(1, floor(0.5 * filled)) as passes from profile where sheet_ord in (select sheet_ord from sheets where kept)")
def column_profile(spark, sf):
    rows = lines(spark, sf)
    sheets = sc.resolve_sheets(rows).where("selected")
    return sc.column_profile(rows, sheets, small=True).select(
        "sheet_ord", "idx", "filled", "valid", sc.passes_profile().alias("passes")
    )


@check("value_content", ROLES + "select file, sheet, n_content, at_value from settled where n_exact = 0 and n_prefix = 0")
def value_content(spark, sf):
    return _resolved(spark, sf).where("needs_content").select(
        "file", "sheet", F.col("n_content").cast("bigint").alias("n_content"), F.col("col_value")["idx"].alias("at_value")
    )


@check("sheet_rejects", ROLES + """
    select file, sheet, usable, at_value is null as no_value, at_value is not null and not usable as no_key from usable""")
def sheet_rejects(spark, sf):
    return _resolved(spark, sf).select(
        "file", "sheet", "usable",
        F.array_contains("codes", "sheet_no_value_column").alias("no_value"),
        F.array_contains("codes", "sheet_no_key_column").alias("no_key"),
    )


PROJECT = ROLES + """,
pick as (select n.sheet_ord, n.row_idx, u.file, u.sheet, u.header_row,
    max(case when n.idx = at_id then cell end) as id_raw,
    max(case when n.idx = at_first_name then cell end) as first_raw,
    max(case when n.idx = at_last_name then cell end) as last_raw,
    max(case when n.idx = at_full_name then cell end) as full_raw,
    max(case when n.idx = at_value then cell end) as value_raw
    from usable u join norm n on n.sheet_ord = u.sheet_ord and n.row_idx > u.header_row
    where u.usable group by all)
select file, sheet_ord, row_idx - header_row - 1 as row_idx, nullif(id_raw, '') as id_raw, nullif(first_raw, '') as first_raw,
    nullif(last_raw, '') as last_raw, nullif(full_raw, '') as full_raw, nullif(value_raw, '') as value_raw from pick
"""


@check("project_observations", PROJECT)
def project_observations(spark, sf):
    rows = lines(spark, sf)
    return sc.project_observations(rows, sc.resolve_sheets(rows), small=True).select(
        "file", "sheet_ord", "row_idx", "id_raw", "first_raw", "last_raw", "full_raw", "value_raw"
    )


@check("project_shuffled", PROJECT)
def project_shuffled(spark, sf):
    """The same with no table small enough to broadcast and every sheet dealt by its count of lines."""
    limits = Limits(broadcast_bytes=0, hot_rows=20)
    rows = lines(spark, sf)
    return sc.project_observations(rows, sc.resolve_sheets(rows, limits=limits), limits=limits).select(
        "file", "sheet_ord", "row_idx", "id_raw", "first_raw", "last_raw", "full_raw", "value_raw"
    )


# Answers stated per table: choices for a flat file and for one sheet of a
# workbook; a file-level key for the workbook, which must not apply.
CHOICES = """
select file, sheet, role, name as column from (
  select 'supplier.csv' as file, '' as sheet, 'value' as role, 'Note /23' as name from region
  union select 'customer.csv', '', 'value', 'gone' from region
  union select 'part.xlsx', 'DC-1', 'id', 'Student ID' from region
  union select 'part.xlsx', '', 'value', 'NIP' from region)
"""


@check("column_override", ROLES + """
    select file, sheet, case when file = 'part.xlsx' and sheet = 'DC-1' then 1 else at_id end as at_id,
      case when file = 'supplier.csv' then 4 else at_value end as at_value,
      file = 'supplier.csv' as value_saved, file = 'customer.csv' as value_missing from usable""")
def column_override(spark, sf):
    fx.register(spark, sf, "region")
    df = _resolved(spark, sf, column_choices=spark.sql(CHOICES))
    return df.select(
        "file", "sheet", F.col("col_id")["idx"].alias("at_id"), F.col("col_value")["idx"].alias("at_value"),
        F.array_contains("codes", "value_override_used").alias("value_saved"),
        F.array_contains("codes", "value_override_missing").alias("value_missing"),
    )


SELECTION = """
select file, sheet from (select 'part.xlsx' as file, 'DC-2' as sheet from region
  union select 'part.xlsx', 'Infos' from region
  union select 'supplier.csv', 'none such' from region)
"""


@check("sheet_selection", LONG + """
    select file, sheet, kept and (not is_multi or sheet = 'DC-2') as selected,
      file in ('part.xlsx', 'supplier.csv') as has_selection from sheets""")
def sheet_selection(spark, sf):
    fx.register(spark, sf, "region")
    sheets = sc.select_sheets(sc.find_headers(lines(spark, sf)), spark.sql(SELECTION))
    return sheets.select("file", "sheet", "selected", "has_selection")


@check("pending_columns", ROLES + """
    select file, case when is_multi then sheet else '' end as sheet, 'value' as subject,
      case when n_exact > 1 then n_exact when n_prefix > 1 then n_prefix else n_content end as n
    from usable where at_value is null and (n_exact > 1 or n_prefix > 1 or n_content > 1)
    union all
    select c.file, case when s.is_multi then c.sheet else '' end, 'id', count(*) from cols c
      join settled s on s.sheet_ord = c.sheet_ord where c.norm in (""" + ROLE_LIST["id"] + """)
      group by all having count(*) > 1""")
def pending_columns(spark, sf):
    return dec.pending_columns(_resolved(spark, sf)).select("file", "sheet", "subject", "n")


@check("pending_sheets", LONG + """
    select file, count(*) as n, 'sheets' as kind from sheets where kept and is_multi group by 1""")
def pending_sheets(spark, sf):
    return dec.pending_sheets(_resolved(spark, sf)).select("file", "n", "kind")
