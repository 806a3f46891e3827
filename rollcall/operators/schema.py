"""Header repair and column roles.

``lines``: file_ord, file, sheet_ord, sheet, row_idx, cells. One record per
line with its cells as an array; row_idx counts from 0, which is the first
line. Headers and roles are worked out on the few head lines of each sheet,
so the lines themselves are only projected and never pivoted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.constants import (
    ALIASES,
    ALL_ALIASES,
    CONTENT_RANGE,
    CONTENT_SHARE,
    HEADER_SEARCH_ROWS,
    NULL_TOKENS,
    QUESTION_PATTERN,
    TOTAL_HEADERS,
)
from rollcall.functions.text import clean_header, normalize_text, strip
from rollcall.functions.values import is_absent_token, parse_number
from rollcall.operators.lookup import Limits, is_small, joint_key, lookup, salts
from rollcall.sources.staging import stage

SHEET = ["file_ord", "file", "sheet_ord", "sheet"]
KEY_ROLES = ["id", "first_name", "last_name", "full_name"]


def null_text(c: Column) -> Column:
    """Null where a cell holds one of the texts that mean null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def first_line_names(cells: Column | str) -> Column:
    """Names from a first line: blanks numbered, repeats suffixed, then cleaned."""

    def name(c: Column, i: Column) -> Column:
        earlier = F.filter(F.slice(cells, F.lit(1), i), lambda e: e == c)
        return (
            F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string")))
            .when(F.size(earlier) > 0, F.concat(c, F.lit("."), F.size(earlier).cast("string")))
            .otherwise(c)
        )

    return F.transform(F.transform(cells, name), clean_header)


def promoted_names(cells: Column | str) -> Column:
    """Names from a later line: null cells become empty, repeats stay."""
    return F.transform(
        cells, lambda c: clean_header(F.coalesce(null_text(strip(c)), F.lit("")))
    )


def normal_forms(names: Column | str) -> Column:
    return F.transform(names, normalize_text)


def alias_hits(norms: Column | str) -> Column:
    """How many normal forms are an alias of any role; each cell counts once."""
    return F.size(F.filter(norms, lambda n: n.isin(ALL_ALIASES)))


def head_lines(lines: DataFrame) -> DataFrame:
    """First lines of each sheet with their names as a header and alias hits.

    One line more than the search needs, to tell whether data follow it.
    """
    head = lines.where(F.col("row_idx") <= HEADER_SEARCH_ROWS + 1)
    first = F.col("row_idx") == 0
    names = F.when(first, first_line_names("cells")).otherwise(promoted_names("cells"))
    named = head.select(*SHEET, "row_idx", names.alias("names"))
    formed = named.withColumn("norms", normal_forms("names"))
    return formed.withColumn("hits", alias_hits("norms").cast("bigint"))


def find_headers(lines: DataFrame) -> DataFrame:
    """Header line per sheet, with its names, normal forms, hits, and has_data.

    Two hits in the first line settle it; else the line with most hits among
    the next ten wins if it beats the first, the earliest on ties.
    """
    found = F.struct("row_idx", "hits", "names", "norms")
    searched = F.col("row_idx").between(1, HEADER_SEARCH_ROWS)
    per_sheet = head_lines(lines).groupBy(*SHEET).agg(
        F.max(F.when(F.col("row_idx") == 0, F.col("hits"))).alias("first_hits"),
        F.max(F.when(searched, F.struct("hits", -F.col("row_idx")))).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("row_idx", found))).alias("heads"),
        F.max("row_idx").alias("last_head"),
    )
    row = F.when(F.col("first_hits") >= 2, F.lit(0)).when(
        F.col("best.hits") > F.col("first_hits"), -F.col("best")["col2"]
    ).otherwise(F.lit(0))
    chosen = per_sheet.withColumn("header_row", row.cast("bigint"))
    chosen = chosen.withColumn(
        "head", F.element_at("heads", F.col("header_row").cast(per_sheet.schema["last_head"].dataType))
    )
    return chosen.select(
        *SHEET, "header_row", "head.names", "head.norms", "head.hits",
        (F.col("last_head") > F.col("header_row")).alias("has_data"),
    )


def select_sheets(headers: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Which sheets of each file count.

    A lone sheet is always kept; of several, those with data and two alias
    hits. A saved selection applies to files that keep several.
    """
    of_file = Window.partitionBy("file_ord")
    several = F.count(F.lit(1)).over(of_file) > 1
    sheets = headers.withColumn("several", several).withColumn(
        "kept", ~F.col("several") | (F.col("has_data") & (F.col("hits") >= 2))
    )
    sheets = sheets.withColumn("n_kept", F.count_if("kept").over(of_file))
    sheets = sheets.withColumn("is_multi", F.col("n_kept") > 1).drop("several")
    if selection is None:
        chosen = sheets.withColumn("has_selection", F.lit(False)).withColumn(
            "selected", F.col("kept")
        )
    else:
        wanted = selection.groupBy("file").agg(
            F.collect_set("sheet").alias("wanted"), F.lit(True).alias("has_selection")
        )
        use = F.col("has_selection") & F.col("is_multi")
        chosen = (
            sheets.join(wanted, "file", "left")
            .withColumn("has_selection", F.coalesce("has_selection", F.lit(False)))
            .withColumn(
                "selected",
                F.col("kept") & (~use | F.coalesce(F.array_contains("wanted", F.col("sheet")), F.lit(False))),
            )
            .drop("wanted")
        )
    return chosen.withColumn(
        "choice_sheet", F.when(F.col("is_multi"), F.col("sheet")).otherwise(F.lit(""))
    )


def role_matches(role: str) -> Column:
    """Columns of a role in column order, as structs of idx, name and norm."""
    return F.filter("cols", lambda c: c["norm"].isin(ALIASES[role]))


def _first_named(cols: Column, name: Column) -> Column:
    return F.get(F.filter(cols, lambda c: c["name"] == name), F.lit(0))


def with_columns_listed(sheets: DataFrame) -> DataFrame:
    cols = F.transform(
        F.arrays_zip("names", "norms"),
        lambda c, i: F.struct(i.alias("idx"), c["names"].alias("name"), c["norms"].alias("norm")),
    )
    return sheets.withColumn("cols", cols)


def with_choices(sheets: DataFrame, choices: DataFrame | None) -> DataFrame:
    """Saved column per role; ``said_<role>`` tells that the role was answered."""
    roles = [*KEY_ROLES, "value"]
    if choices is None:
        return sheets.withColumns(
            {f"choice_{r}": F.lit(None).cast("string") for r in roles}
            | {f"said_{r}": F.lit(False) for r in roles}
        )
    per_sheet = choices.groupBy("file", F.col("sheet").alias("choice_sheet")).agg(
        *(F.max(F.when(F.col("role") == r, F.col("column"))).alias(f"choice_{r}") for r in roles),
        *((F.count_if(F.col("role") == r) > 0).alias(f"said_{r}") for r in roles),
    )
    joined = sheets.join(per_sheet, ["file", "choice_sheet"], "left")
    return joined.withColumns({f"said_{r}": F.coalesce(f"said_{r}", F.lit(False)) for r in roles})


def with_key_roles(sheets: DataFrame) -> DataFrame:
    """Column of each key role: saved choice if present, else the first match."""
    for role in KEY_ROLES:
        sheets = sheets.withColumns(
            {
                f"all_{role}": role_matches(role),
                f"saved_{role}": _first_named(F.col("cols"), F.col(f"choice_{role}")),
            }
        )
        declined = F.col(f"said_{role}") & F.col(f"choice_{role}").isNull()
        many = F.size(f"all_{role}") > 1
        found = F.when(
            ~(declined & many), F.get(F.col(f"all_{role}"), F.lit(0))
        )
        sheets = sheets.withColumns(
            {
                f"col_{role}": F.coalesce(f"saved_{role}", found),
                f"open_{role}": F.col(f"saved_{role}").isNull() & many & ~F.col(f"said_{role}"),
            }
        )
    return sheets


def with_value_candidates(sheets: DataFrame) -> DataFrame:
    """Value column by saved choice, exact alias or prefix; else content is needed."""
    taken = F.array_compact(F.array(*(F.col(f"col_{r}")["name"] for r in KEY_ROLES)))
    sheets = sheets.withColumn("taken", taken).withColumn(
        "free", F.filter("cols", lambda c: ~F.array_contains("taken", c["name"]))
    )
    sheets = sheets.withColumn(
        "exact", F.filter("free", lambda c: c["norm"].isin(ALIASES["value"]))
    ).withColumn("totals", F.filter("exact", lambda c: c["norm"].isin(TOTAL_HEADERS)))
    pattern = "^(" + "|".join(ALIASES["value"]) + ") "
    prefixed = F.filter("free", lambda c: c["norm"].rlike(pattern))
    sheets = sheets.withColumns(
        {
            "prefixed": F.when(F.size("exact") == 0, prefixed).otherwise(F.slice("free", 1, 0)),
            "saved_value": _first_named(F.col("cols"), F.col("choice_value")),
        }
    )
    names = F.array_distinct(F.transform("prefixed", lambda c: c["name"]))
    first = lambda c: F.get(F.col(c), F.lit(0))
    return sheets.withColumns(
        {
            "by_name": F.coalesce(
                "saved_value",
                F.when(F.size("totals") > 0, first("totals"))
                .when(F.size("exact") == 1, first("exact"))
                .when(F.size(names) == 1, first("prefixed")),
            ),
            "n_prefixed": F.size(names),
            "needs_content": F.col("saved_value").isNull()
            & (F.size("exact") == 0)
            & (F.size("prefixed") == 0)
            & F.col("selected")
            & F.col("has_data"),
        }
    )


def sheet_key(of: str = "file_ord") -> Column:
    """One text for a sheet."""
    return joint_key(F.col(of).cast("string"), F.col("sheet_ord").cast("string"))


def with_sheet(
    lines: DataFrame, sheets: DataFrame, small: bool, sizes: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Lines of the given sheets with what these say, one row per sheet.

    If that is not small, a sheet of many lines is dealt over as many places as its
    count asks for. ``sizes`` has file_ord, sheet_ord, n_rows; otherwise lines are counted.
    """
    if small:
        return lines.join(F.broadcast(sheets), ["file_ord", "sheet_ord"])
    if sizes is None:
        sizes = lines.groupBy("file_ord", "sheet_ord").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = sizes.select(sheet_key().alias("sheet_key"), "n_rows")
    hot = stage(salts(counts, "sheet_key", "n_rows", limits), "hot_sheets")
    told = sheets.withColumns({"sheet_key": sheet_key(), "is_told": F.lit(True)}).drop("file_ord", "sheet_ord")
    keyed = lines.withColumn("sheet_key", sheet_key())
    rows = lookup(keyed, told, "sheet_key", spread=F.col("row_idx"), small=False, hot=hot, limits=limits)
    return rows.where("is_told").drop("sheet_key", "is_told")


def looks_like_value(c: Column) -> Column:
    """An absence token, or a number in the fixed content range."""
    s = F.replace(strip(c), F.lit(","), F.lit("."))
    blank = F.lower(s).isin("", "nan")
    return ~blank & (
        is_absent_token(s) | F.coalesce(parse_number(s).between(*CONTENT_RANGE), F.lit(False))
    )


def column_profile(
    lines: DataFrame,
    sheets: DataFrame,
    small: bool,
    columns: str = "free",
    sizes: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Non-null and value-like cells per column of the given sheets.

    Only the asked columns are unfolded, and counts combine before the shuffle.
    """
    asked = sheets.select(
        "file_ord", "sheet_ord", "header_row", F.transform(columns, lambda c: c["idx"]).alias("wanted")
    )
    cells = (
        with_sheet(lines, asked, small, sizes, limits)
        .where(F.col("row_idx") > F.col("header_row"))
        .select("file_ord", "sheet_ord", "cells", F.explode("wanted").alias("idx"))
        .select("file_ord", "sheet_ord", "idx", null_text(F.get("cells", F.col("idx"))).alias("cell"))
    )
    return cells.groupBy("file_ord", "sheet_ord", "idx").agg(
        F.count("cell").alias("filled"),
        F.count_if(F.col("cell").isNotNull() & looks_like_value(F.col("cell"))).alias("valid"),
    )


def passes_profile() -> Column:
    """At least one value-like cell and at least half, rounded down."""
    need = F.greatest(F.lit(1), F.floor(F.col("filled") * CONTENT_SHARE))
    return (F.col("filled") > 0) & (F.col("valid") >= need)


def content_columns() -> Column:
    """Free columns that content may settle: sub-scores are left out."""
    return F.filter("free", lambda c: ~c["norm"].rlike(QUESTION_PATTERN))


def with_content(
    lines: DataFrame, sheets: DataFrame, sizes: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Candidates by content for the sheets whose headers did not settle it."""
    asked = sheets.where("needs_content").withColumn("content_cols", content_columns())
    # Measured as it is sent: with the columns to look at.
    asked = stage(asked.select("file_ord", "sheet_ord", "header_row", "content_cols"), "content_sheets")
    passed = (
        column_profile(lines, asked, is_small(asked, limits), "content_cols", sizes, limits)
        .where(passes_profile())
        .groupBy("file_ord", "sheet_ord")
        .agg(F.array_sort(F.collect_list("idx")).alias("by_content"))
    )
    return sheets.join(passed, ["file_ord", "sheet_ord"], "left")


def without_content(sheets: DataFrame) -> DataFrame:
    """For runs in which no sheet needs its content looked at."""
    return sheets.withColumn("by_content", F.lit(None).cast("array<int>"))


def settle(sheets: DataFrame) -> DataFrame:
    """Final value column, usability of each sheet, open roles and issue codes."""
    contents = F.coalesce(F.size("by_content"), F.lit(0))
    by_content = F.when(contents == 1, F.get("cols", F.get("by_content", F.lit(0))))
    sheets = sheets.withColumn("n_content", F.greatest(contents, F.lit(0))).withColumn(
        "col_value", F.coalesce("by_name", by_content)
    )
    exact_open = (F.size("exact") > 1) & (F.size("totals") == 0)
    sheets = sheets.withColumn(
        "open_value",
        F.col("col_value").isNull()
        & ~F.col("said_value")
        & (exact_open | (F.col("n_prefixed") > 1) | (F.col("n_content") > 1)),
    )
    has_id = F.col("col_id").isNotNull()
    has_name = F.col("col_first_name").isNotNull() & F.col("col_last_name").isNotNull()
    has_full = F.col("col_full_name").isNotNull()
    live = F.col("selected") & F.col("has_data")
    keyed = has_id | has_name | has_full
    names = lambda c: F.transform(c, lambda x: x["name"])
    value_names = (
        F.when(exact_open, names("exact"))
        .when(F.col("n_prefixed") > 1, names("prefixed"))
        .otherwise(F.transform("by_content", lambda i: F.get("cols", i)["name"]))
    )
    open_roles = F.array_compact(
        F.array(
            *(
                F.when(
                    live & F.col(f"open_{r}"),
                    F.struct(F.lit(r).alias("role"), names(f"all_{r}").alias("names")),
                )
                for r in KEY_ROLES
            ),
            F.when(
                live & F.col("open_value"),
                F.struct(F.lit("value").alias("role"), value_names.alias("names")),
            ),
        )
    )
    return sheets.withColumns(
        {
            "has_id": has_id,
            "has_name": has_name,
            "has_full": has_full,
            "usable": live & F.col("col_value").isNotNull() & keyed,
            "open_roles": open_roles,
        }
    ).withColumn("codes", sheet_codes())


def sheet_codes() -> Column:
    """Issue codes of one sheet, in the order they arise."""
    live = F.col("selected") & F.col("has_data")
    codes: list[Column] = [F.when(F.col("selected") & ~F.col("has_data"), F.lit("empty_sheet"))]
    for r in KEY_ROLES:
        saved, chosen = F.col(f"saved_{r}").isNotNull(), F.col(f"choice_{r}").isNotNull()
        many = ~saved & (F.size(f"all_{r}") > 1)
        declined = F.col(f"said_{r}") & ~chosen
        codes += [
            F.when(live & saved, F.lit("override_used")),
            F.when(live & chosen & ~saved, F.lit("override_missing")),
            F.when(live & many, F.lit("ambiguous_role")),
            F.when(live & many & ~declined, F.lit("first_match_used")),
        ]
    saved, chosen = F.col("saved_value").isNotNull(), F.col("choice_value").isNotNull()
    searched = live & ~saved & (F.size("exact") == 0)
    by_content = searched & (F.col("n_prefixed") == 0)
    no_value = live & F.col("col_value").isNull()
    keyed = F.col("has_id") | F.col("has_name") | F.col("has_full")
    codes += [
        F.when(live & saved, F.lit("value_override_used")),
        F.when(live & chosen & ~saved, F.lit("value_override_missing")),
        F.when(searched & (F.col("n_prefixed") == 1), F.lit("value_by_prefix")),
        F.when(searched & (F.col("n_prefixed") > 1), F.lit("value_ambiguous_prefix")),
        F.when(by_content & (F.col("n_content") == 1), F.lit("value_by_content")),
        F.when(by_content & (F.col("n_content") > 1), F.lit("value_ambiguous_content")),
        F.when(by_content & (F.col("n_content") == 0), F.lit("value_none")),
        F.when(no_value, F.lit("sheet_no_value_column")),
        F.when(live & ~no_value & ~keyed, F.lit("sheet_no_key_column")),
        F.when(F.col("usable") & (F.col("sheet") != ""), F.lit("sheet_processing")),
    ]
    return F.array_compact(F.array(*codes))


def resolve_sheets(
    lines: DataFrame,
    *,
    column_choices: DataFrame | None = None,
    sheet_selection: DataFrame | None = None,
    headers: DataFrame | None = None,
    sizes: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per sheet: header line, column of each role, flags and codes.

    ``sizes``: file_ord, sheet_ord, n_rows of each sheet, where the caller knows them.
    """
    # Asked for its content first and then settled: the head lines, which may be long, are looked at once.
    headers = stage(find_headers(lines), "headers") if headers is None else headers
    sheets = select_sheets(headers, sheet_selection)
    sheets = with_choices(with_columns_listed(sheets), column_choices)
    sheets = with_value_candidates(with_key_roles(sheets))
    if sheets.where("needs_content").isEmpty():
        return settle(without_content(sheets))
    return settle(with_content(lines, sheets, sizes, limits))


def project_observations(
    lines: DataFrame,
    sheets: DataFrame,
    small: bool | None = None,
    sizes: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Observations of the usable sheets: fixed columns picked from each line.

    The sheet table joins by broadcast where it is small, which is measured unless the
    caller says so; the lines are not grouped or pivoted.
    """
    picked = sheets.where("usable").select(
        "file_ord", "sheet_ord", "header_row", "has_id", "has_name", "has_full", "choice_sheet",
        *(F.col(f"col_{r}")["idx"].alias(f"at_{r}") for r in [*KEY_ROLES, "value"]),
    )
    small = is_small(picked, limits) if small is None else small
    rows = with_sheet(lines, picked, small, sizes, limits).where(F.col("row_idx") > F.col("header_row"))
    cell = lambda role: null_text(F.get("cells", F.col(f"at_{role}")))
    keep = [c for c in lines.columns if c not in (*SHEET, "row_idx", "cells")]
    return rows.select(
        "file_ord", "file", "sheet_ord", F.col("choice_sheet").alias("sheet"),
        (F.col("row_idx") - F.col("header_row") - 1).alias("row_idx"), *keep,
        cell("id").alias("id_raw"), cell("first_name").alias("first_raw"),
        cell("last_name").alias("last_raw"), cell("full_name").alias("full_raw"),
        cell("value").alias("value_raw"), "has_id", "has_name", "has_full",
    )
