"""From files to observations, and the whole run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.constants import DELIMITED_EXTENSIONS, WORKBOOK_EXTENSIONS
from rollcall.operators.decisions import Decisions
from rollcall.operators.lookup import Limits, is_small, joint_key, lookup, salts
from rollcall.operators.ordinals import running_start
from rollcall.operators.report import severity
from rollcall.operators.schema import (
    find_headers,
    null_text,
    project_observations,
    resolve_sheets,
    role_matches,
    with_columns_listed,
)
from rollcall.plans.reconcile import Params, Reconciliation, reconcile
from rollcall.sources.delimited import scan_delimited
from rollcall.sources.inputs import list_inputs
from rollcall.sources.staging import stage
from rollcall.sources.workbook import scan_workbooks

EMPTY_LINES = "plain string, sheet_ord int, sheet string, row_idx bigint, cells array<string>"


@dataclass
class Observed:
    """What the scan of a set of inputs gives."""

    inputs: DataFrame
    lines: DataFrame
    sheets: DataFrame
    observations: DataFrame
    issues: DataFrame


def scan(
    spark: SparkSession, inputs: DataFrame, limits: Limits = Limits(), written: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Lines of all inputs, and (plain, error) for those that cannot be read.

    The paths come from the driver's own listing, which Spark needs anyway. With ``written``
    the cells of delimited files are written once, for callers that read lines more than once;
    those of workbooks always are.
    """
    known = F.col("ext").isin(DELIMITED_EXTENSIONS + WORKBOOK_EXTENSIONS)
    hidden = F.col("file").rlike("^[_.]")
    there = (F.coalesce(F.col("length"), F.lit(0)) > 0) & ~hidden
    paths = inputs.where(known & there).select("path", "ext").collect()
    text = [r.path for r in paths if r.ext in DELIMITED_EXTENSIONS]
    books = [r.path for r in paths if r.ext in WORKBOOK_EXTENSIONS]
    lines = spark.createDataFrame([], EMPTY_LINES)
    errors = inputs.where(~(known & there)).select(
        "plain",
        F.when(~known, "unsupported extension")
        .when(F.col("length").isNull(), "no such file")
        .when(hidden, "Spark reads no file whose name begins with _ or .")
        .otherwise("no data in the file").alias("error"),
    )
    if text:
        cells, too_long = scan_delimited(spark, text, limits)
        cells = stage(cells, "cells") if written else cells
        lines = lines.unionByName(
            cells.select("plain", F.lit(0).alias("sheet_ord"), F.lit("").alias("sheet"), "row_idx", "cells")
        )
        errors = errors.unionByName(too_long)
    if books:
        rows = stage(scan_workbooks(spark, books), "workbooks")
        failed = rows.where("error is not null").select("plain", "error")
        # A file that fails half-way counts for nothing.
        whole = rows.where("error is null").drop("error").join(failed.select("plain"), "plain", "left_anti")
        lines = lines.unionByName(whole.select(*lines.columns))
        errors = errors.unionByName(failed)
    return lines, errors


def sheet_bases(lines: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per sheet the number of its lines and of those in all sheets before it."""
    sizes = lines.groupBy("plain", "sheet_ord").agg((F.max("row_idx") + 1).alias("n_rows"))
    placed = sizes.join(inputs.select("plain", "file_ord", "file"), "plain")
    return stage(running_start(placed, ["file_ord", "sheet_ord"], "n_rows", "base"), "sheet_bases")


def ordered(
    lines: DataFrame, inputs: DataFrame, limits: Limits = Limits(), bases: DataFrame | None = None
) -> DataFrame:
    """Lines with their file and ``ord``, one number for (file, sheet, line).

    Each sheet gets the range after the sheets before it, from the highest
    line number of every sheet, summed range by range. Where the table of sheets is
    too large to send, a sheet of many lines is dealt over several places.
    """
    bases = sheet_bases(lines, inputs) if bases is None else bases
    if is_small(bases, limits):
        placed = lines.join(F.broadcast(bases.drop("n_rows")), ["plain", "sheet_ord"])
    else:
        key = joint_key(F.col("plain"), F.col("sheet_ord").cast("string"))
        keyed = bases.withColumn("place", key)
        hot = stage(salts(keyed, "place", "n_rows", limits), "hot_places")
        placed = lookup(
            lines.withColumn("place", key), keyed.drop("plain", "sheet_ord", "n_rows"), "place",
            spread=F.col("row_idx"), small=False, hot=hot, limits=limits,
        ).where("base is not null")
    return placed.select(
        "file_ord", "file", "sheet_ord", "sheet", "row_idx", "cells",
        (F.col("base") + F.col("row_idx")).alias("ord"),
    )


def _issue(df: DataFrame, code, detail) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(
        "file",
        (F.col("sheet") if "sheet" in df.columns else F.lit("")).alias("sheet"),
        F.lit(None).cast("bigint").alias("ord"),
        F.lit(None).cast("string").alias("id"),
        code.alias("code"),
        severity(code).alias("severity"),
        detail.alias("detail"),
    )


def file_issues(inputs: DataFrame, errors: DataFrame, sheets: DataFrame) -> DataFrame:
    """Issues of files and sheets."""
    none = F.create_map().cast("map<string,string>")
    unreadable = _issue(
        errors.join(inputs.select("plain", "file"), "plain"),
        "unreadable", F.create_map(F.lit("error"), F.col("error")),
    )
    per_file = sheets.groupBy("file_ord", "file").agg(
        F.count_if("kept").alias("n_kept"), F.count_if("selected").alias("n_selected"),
        F.bool_or("is_multi").alias("multi"), F.bool_or("has_selection").alias("chosen"),
    )
    code = F.array_compact(
        F.array(
            F.when(F.col("n_kept") == 0, "no_valid_sheet"),
            F.when(F.col("multi") & F.col("chosen"), "saved_sheets_used"),
            F.when(F.col("multi") & ~F.col("chosen"), "all_sheets_used"),
            F.when((F.col("n_kept") > 0) & (F.col("n_selected") == 0), "no_sheet_selected"),
        )
    )
    of_files = _issue(per_file.withColumn("code", F.explode(code)).drop("sheet"), F.col("code"), none)
    of_sheets = _issue(
        sheets.where("selected").select("file", "sheet", F.explode("codes").alias("code")),
        F.col("code"), none,
    )
    return unreadable.unionByName(of_files).unionByName(of_sheets)


def observe_files(
    spark: SparkSession,
    inputs: DataFrame,
    decisions: Decisions = Decisions(),
    limits: Limits = Limits(),
) -> Observed:
    """Scan inputs, settle each sheet's header and columns, pick observations."""
    lines, errors = scan(spark, inputs, limits, written=True)
    bases = sheet_bases(lines, inputs)
    lines = ordered(lines, inputs, limits, bases)
    sheets = resolve_sheets(
        lines, column_choices=decisions.column_choices,
        sheet_selection=decisions.sheet_selection, sizes=bases, limits=limits,
    )
    sheets = stage(sheets, "sheets")
    observations = project_observations(lines, sheets, sizes=bases, limits=limits)
    return Observed(inputs, lines, sheets, observations, file_issues(inputs, errors, sheets))


def roster_from_file(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Roster rows of one file: first sheet, first matching columns."""
    inputs = list_inputs(spark, "/", [path])
    lines, errors = scan(spark, inputs, limits, written=True)
    failed = errors.first()
    if failed is not None:
        raise ValueError(f"cannot read roster '{path}': {failed.error}")
    lines = ordered(lines.where("sheet_ord = 0"), inputs, limits)
    roles = ["id", "first_name", "last_name", "email"]
    sheet = with_columns_listed(find_headers(lines)).select(
        "file_ord", "header_row", "names",
        *(F.get(role_matches(r), F.lit(0))["idx"].alias(f"at_{r}") for r in roles),
    )
    found = sheet.first()
    missing = [r for r in roles[:3] if found[f"at_{r}"] is None]
    if missing:
        raise ValueError(f"roster lacks column(s) {missing}; found {found.names}")
    rows = lines.join(F.broadcast(sheet), "file_ord").where("row_idx > header_row")
    return rows.select(
        *(null_text(F.get("cells", F.col(f"at_{r}"))).alias(r) for r in roles), "ord"
    )


def reconcile_files(
    spark: SparkSession,
    roster_path: str,
    *,
    base: str = "/",
    files: list[str] | None = None,
    folder: str | None = None,
    decisions: Decisions = Decisions(),
    params: Params = Params(),
    limits: Limits = Limits(),
    stage_rows: bool = True,
) -> Reconciliation:
    """The whole run: list, scan, settle columns, match, first claims, report."""
    inputs = stage(list_inputs(spark, base, files, folder), "inputs")
    seen = observe_files(spark, inputs, decisions, limits)
    run = reconcile(
        roster_from_file(spark, roster_path, limits),
        seen.observations,
        inputs.select("file_ord", "file"),
        decisions=decisions, params=params, limits=limits, stage_rows=stage_rows,
    )
    issues = [seen.issues]
    if inputs.isEmpty():
        none = spark.createDataFrame([("",)], "file string")
        issues.append(_issue(none, "no_input_files", F.create_map().cast("map<string,string>")))
    return replace(run, sheets=seen.sheets, early_issues=issues)


__all__ = ["Observed", "observe_files", "ordered", "reconcile_files", "roster_from_file", "scan"]
