"""Numbers in a total order of all rows, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.sources.staging import stage

RANGE, OFFSET = "__range", "__offset"


def running_start(df: DataFrame, order: list[str], amount: str, out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``, the sum of ``amount`` over the rows before this one in ``order``.

    Two levels: rows are dealt into ranges of the order and written with the number
    of their range, sums run within each range, and each range gets the total of
    those before it. Only these totals, one number per range, pass the driver. The
    columns of ``order`` tell rows apart; a null amount counts as 0.
    """
    spark = df.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges come from a sample, so they are fixed in a table before anything is derived.
    dealt = stage(df.repartitionByRange(count, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    totals = dict(dealt.groupBy(RANGE).agg(F.sum(amount).alias("total")).collect())
    known = sorted(totals)
    sums = accumulate((totals[r] or 0 for r in known), initial=0)
    offsets = spark.createDataFrame(list(zip(known, sums)), f"{RANGE} int, {OFFSET} bigint")
    before = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn(out, F.coalesce(F.sum(amount).over(before), F.lit(0)))
    placed = within.join(F.broadcast(offsets), RANGE)
    return placed.withColumn(out, (F.col(out) + F.col(OFFSET)).cast("bigint")).select(*df.columns, out)
