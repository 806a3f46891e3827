"""The result file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import constants as c
from rollcall.functions.values import format_g


def output_table(
    result: DataFrame, value_name: str = c.OUTPUT_VALUE, id_name: str = c.OUTPUT_ID
) -> DataFrame:
    """One row per member in roster order; absence and no claim give empty text."""
    shown = F.when(~F.col("is_absent"), format_g("value"))
    return result.orderBy("roster_ord").select(
        F.col("id").alias(id_name),
        F.col("email").alias(c.OUTPUT_EMAIL),
        F.col("first_name").alias(c.OUTPUT_FIRST),
        F.col("last_name").alias(c.OUTPUT_LAST),
        F.coalesce(shown, F.lit("")).alias(value_name),
    )


def write_result(
    result: DataFrame,
    path: str,
    value_name: str = c.OUTPUT_VALUE,
    id_name: str = c.OUTPUT_ID,
    single_file: bool = False,
) -> None:
    """Write the result as CSV; parts are in roster order.

    ``single_file`` sends all members through one task, for small rosters only.
    """
    table = output_table(result, value_name, id_name)
    table = table.coalesce(1) if single_file else table
    table.write.options(
        header=True, emptyValue="", nullValue="", escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
