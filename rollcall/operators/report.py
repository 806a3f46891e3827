"""Counts per file, totals, members without a claim, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.constants import SEVERITY
from rollcall.operators.lookup import COUNT, Limits, lookup, salts


def claims_per_file(claims: DataFrame, rows: Column, limits: Limits) -> DataFrame:
    """Salts of files that very many members, or rows of members, have their claim from."""
    counts = claims.groupBy("source_ord").agg(F.sum(rows).alias(COUNT))
    return salts(counts, "source_ord", COUNT, limits)


def consolidated(
    members: DataFrame, claims: DataFrame, files: DataFrame, small: bool = True, limits: Limits = Limits()
) -> DataFrame:
    """Every roster member with its claim, if any; ``small`` says so of the files."""
    named = lookup(
        claims,
        files.select(F.col("file_ord").alias("source_ord"), F.col("file").alias("source")),
        "source_ord", spread=F.col("member"), small=small,
        hot=None if small else claims_per_file(claims, F.lit(1), limits), limits=limits,
    ).select(
        F.col("member").alias("id"), "value",
        F.col("is_absent").alias("claimed_absent"), "source",
    )
    return members.join(named, "id", "left").select(
        "id", "email", "first_name", "last_name", "value",
        F.coalesce("claimed_absent", F.lit(False)).alias("is_absent"),
        "source", F.col("ord").alias("roster_ord"),
    )


def file_report(files: DataFrame, matched: DataFrame, claims: DataFrame) -> DataFrame:
    """Matched rows, assigned values, absences per file; files without rows too.

    Each member has one first claim, so values and absences are counted over
    the claim table and never over the observations again.
    """
    rows = (
        matched.where(F.col("member").isNotNull())
        .groupBy("file_ord")
        .agg(F.count(F.lit(1)).alias("matched"))
    )
    won = claims.groupBy(F.col("source_ord").alias("file_ord")).agg(
        F.count_if(~F.col("is_absent")).alias("assigned"),
        F.count_if("is_absent").alias("absent"),
    )
    counts = [
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        for c in ("matched", "assigned", "absent")
    ]
    return (
        files.join(rows, "file_ord", "left")
        .join(won, "file_ord", "left")
        .select("file_ord", "file", *counts)
        .withColumn("skipped", F.col("matched") == 0)
    )


def totals(result: DataFrame) -> DataFrame:
    """One row of roster totals."""
    graded = F.count_if(F.col("value").isNotNull() & ~F.col("is_absent"))
    absent = F.count_if("is_absent")
    return result.agg(
        F.count(F.lit(1)).alias("total"),
        graded.alias("valued"),
        absent.alias("absent"),
        (F.count(F.lit(1)) - graded - absent).alias("none"),
    )


def file_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(~F.col("skipped")).alias("files_ok"),
        F.count_if("skipped").alias("files_skipped"),
    )


def unclaimed(result: DataFrame) -> DataFrame:
    """Members without any claim; sort by roster_ord to list them."""
    return result.where(F.col("value").isNull() & ~F.col("is_absent")).select(
        "id", "first_name", "last_name", "roster_ord"
    )


def severity(code: Column) -> Column:
    """Severity of an issue code."""
    out = F.when(code.isin([c for c, s in SEVERITY.items() if s == "warn"]), "warn")
    return out.when(
        code.isin([c for c, s in SEVERITY.items() if s == "dim"]), "dim"
    ).otherwise("info")


def row_issue_codes() -> Column:
    """Issue codes of one observation, after its claim state is known."""
    settled = F.col("member").isNotNull() & ~F.col("is_duplicate")
    clamp_code = (
        F.when(F.col("clamp_answer"), "clamped_saved")
        .when(~F.col("clamp_answer"), "kept_by_choice")
        .otherwise("kept_undecided")
    )
    own = F.array(
        F.when(F.col("member").isNotNull() & F.col("is_duplicate"), "duplicate_claim"),
        F.when(settled, F.col("value_issue")),
        F.when(settled & F.col("direction").isNotNull(), clamp_code),
    )
    return F.concat("match_issues", F.array_compact(own))


def row_issues(
    stated: DataFrame, files: DataFrame, claims: DataFrame, small: bool = True, limits: Limits = Limits(),
    details: bool = True,
) -> DataFrame:
    """One row per issue of an observation, with the details that explain it.

    ``small`` says so of the files. Without ``details`` the rows have no other cell than the value.
    """
    cells = {"id": "id_key", "first": "first_raw", "last": "last_raw", "full": "full_raw"} if details else {}
    cells["value"] = "value_raw"
    cells |= {"roster_name": "roster_name"} if details else {}
    told = [c for name, cell in cells.items() for c in (F.lit(name), F.col(cell))]
    told += [F.lit("earlier_source"), F.when(F.col("is_duplicate"), F.col("earlier"))]
    detail = F.map_filter(F.create_map(*told), lambda k, v: v.isNotNull())
    earlier = files.select(
        F.col("file_ord").alias("source_ord"), F.col("file").alias("earlier")
    )
    found = stated.withColumn("codes", row_issue_codes()).where(F.size("codes") > 0)
    # Most rows have no earlier claim and one file may have made most: never one task each.
    hot = None if small else claims_per_file(claims, F.col("n_rows"), limits)
    found = lookup(found, earlier, "source_ord", spread=F.col("ord"), small=small, hot=hot, limits=limits)
    return found.select(
        "file", "sheet", "ord", F.col("member").alias("id"),
        detail.alias("detail"), F.explode("codes").alias("code"),
    ).select("file", "sheet", "ord", "id", "code", severity(F.col("code")).alias("severity"), "detail")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"))
