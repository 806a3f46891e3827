"""Values of matched observations and the first claim per member."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import strip
from rollcall.functions.values import (
    absent_tokens,
    cell_number,
    clamped,
    claimed,
    is_blank,
    issue_of,
    out_of_range,
)
from rollcall.operators.lookup import HeavyKeys, Limits, joint_key, lookup, salts


def with_cell(df: DataFrame) -> DataFrame:
    """The trimmed value cell and its number."""
    return df.withColumn("cell", strip(F.coalesce("value_raw", F.lit("")))).withColumn("cell_number", cell_number("cell"))


def with_value_forms(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """What ``value_keys`` reads: the value cell and the side of the bounds that its number lies on."""
    return with_cell(df).withColumn("cell_side", out_of_range("cell_number", low, high))


def value_keys(tokens: bool, clamps: bool) -> dict[str, Column]:
    """Keys of the lookups of saved answers that shuffle, over ``with_value_forms`` of the observations.

    Texts known otherwise and values that a saved token explains only make counts higher.
    """
    keys = {"token": F.upper("cell")} if tokens else {}
    return keys | ({"clamp": joint_key("file", "sheet", "cell_side")} if clamps else {})


def with_value(
    df: DataFrame,
    *,
    low: float | None = None,
    high: float | None = None,
    tokens: Iterable[str] = (),
    token_table: DataFrame | None = None,
    clamp_choices: DataFrame | None = None,
    tokens_small: bool = False,
    clamps_small: bool = False,
    limits: Limits = Limits(),
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Parse value_raw and clamp it where a decision says so.

    A null cell of a file counts as an empty one. Adds value, is_absent,
    value_issue, token_answer, direction, clamp_answer and parsed_value (before
    clamping). ``token_table`` may have a column ``answer``: a text that was
    refused as an absence stays unparsed, but is no open question again.
    Each step is a column of its own: an expression that several others use
    would otherwise be repeated in each of them.
    """
    df = with_cell(df).withColumns(
        {
            "cell_token": F.upper("cell"),
            "cell_blank": is_blank("cell"),
        }
    )
    df = df.withColumn("token_known", F.col("cell_token").isin(absent_tokens(tokens)))
    if token_table is None:
        df = df.withColumn("token_answer", F.lit(None).cast("boolean"))
    else:
        answer = F.col("answer") if "answer" in token_table.columns else F.lit(True)
        saved = token_table.groupBy(strip(F.upper("token")).alias("token_key")).agg(
            F.bool_or(answer).alias("token_answer")
        )
        asked = F.when(~F.col("cell_blank") & ~F.col("token_known"), F.col("cell_token"))
        df = lookup(
            df.withColumn("token_key", asked), saved, "token_key",
            spread=F.col("ord"), small=tokens_small, hot=heavy and heavy.of("token", "token_key"), limits=limits,
        )
        df = df.withColumn(
            "token_known", F.col("token_known") | F.coalesce("token_answer", F.lit(False))
        )
    is_absent = ~F.col("cell_blank") & F.col("token_known")
    df = df.withColumn("is_absent", is_absent)
    blank, absent = F.col("cell_blank"), F.col("is_absent")
    df = df.withColumn("parsed_value", claimed(blank, absent, F.col("cell_number")))
    issue = issue_of(blank, absent, F.col("parsed_value"))
    df = df.withColumns(
        {"value_issue": issue, "direction": out_of_range("parsed_value", low, high)}
    )
    df = df.drop(
        "cell", "cell_number", "cell_token", "cell_blank", "token_known", "token_key"
    )
    if clamp_choices is None:
        df = df.withColumn("clamp_answer", F.lit(None).cast("boolean"))
    else:
        answers = clamp_choices.groupBy(
            joint_key("file", "sheet", "direction").alias("clamp_key")
        ).agg(F.bool_or("answer").alias("clamp_answer"))
        df = lookup(
            df.withColumn("clamp_key", joint_key("file", "sheet", "direction")),
            answers.where("clamp_key is not null"), "clamp_key",
            spread=F.col("ord"), small=clamps_small, hot=heavy and heavy.of("clamp", "clamp_key"), limits=limits,
        ).drop("clamp_key")
    use = F.coalesce("clamp_answer", F.lit(False))
    value = F.col("parsed_value")
    return df.withColumn("value", F.when(use, clamped(value, F.col("direction"), low, high)).otherwise(value))


def first_claims(matched: DataFrame) -> DataFrame:
    """First value or absence per member in claim order.

    Combined before the shuffle: a member with a third of all rows sends one
    row per task. With a numeric ``ord`` every buffer is fixed-width, so this
    is a hash aggregate. Rows that claim nothing have a null order, which the
    aggregates skip; a filter here would be pushed below the lookups together
    with a second copy of all parsing.
    """
    claims = F.col("member").isNotNull() & (F.col("value").isNotNull() | F.col("is_absent"))
    at = F.col("claim_ord")
    return (
        matched.select(
            "member", "value", "is_absent", "file_ord",
            F.when(claims, F.col("ord")).alias("claim_ord"),
        )
        .groupBy("member")
        .agg(
            F.min_by("value", at).alias("value"),
            F.min_by("is_absent", at).alias("is_absent"),
            F.min_by("file_ord", at).alias("source_ord"),
            F.min(at).alias("first_ord"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .where(F.col("first_ord").isNotNull())
    )


def with_claim_state(
    matched: DataFrame, claims: DataFrame, *, small: bool, limits: Limits = Limits()
) -> DataFrame:
    """Mark matched rows that come after the first claim of their member.

    The claim table has one row per member, so this is a lookup; a window per
    member would sort a hot member's rows in one task.
    """
    first = claims.select("member", "first_ord", "source_ord")
    hot = None if small else salts(claims, "member", "n_rows", limits)
    joined = lookup(
        matched, first, "member", spread=F.col("ord"), small=small, hot=hot, limits=limits
    )
    later = F.coalesce(F.col("ord") > F.col("first_ord"), F.lit(False))
    return joined.withColumn("is_duplicate", later)
