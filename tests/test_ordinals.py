import numpy as np
from pyspark.sql import functions as F

from rollcall.operators.ordinals import running_start
from rollcall.plans.from_files import ordered
from rollcall.sources.inputs import list_inputs


def test_sums_run_over_all_ranges(spark):
    sheets = spark.range(100_000).select(
        (F.col("id") * 7919 % 100_003).alias("a"), F.pmod(F.col("id") * 31, F.lit(17)).alias("n"), F.lit("x").alias("kept")
    )
    for ranges in (1, 7):
        got = running_start(sheets, ["a"], "n", "start", ranges).toPandas().sort_values("a")
        assert list(got.columns) == ["a", "n", "kept", "start"] and len(got) == 100_000
        assert (got["start"].to_numpy() == np.concatenate([[0], got["n"].cumsum()[:-1]])).all()


def test_empty_null_and_few_rows(spark):
    rows = [(1, 0, 5), (1, 1, None), (0, 9, 2)]
    df = spark.createDataFrame(rows, "f int, s int, n bigint")
    got = running_start(df, ["f", "s"], "n", "at", 50).orderBy("f", "s").collect()
    assert [(r.f, r.s, r.at) for r in got] == [(0, 9, 0), (1, 0, 2), (1, 1, 7)]
    assert running_start(df.limit(0), ["f", "s"], "n", "at").collect() == []


def test_lines_of_100_000_files_get_their_place(spark):
    n = 100_000
    inputs = spark.range(n).select(
        F.col("id").cast("int").alias("file_ord"), F.concat(F.lit("/d/f"), (n - F.col("id")).cast("string")).alias("plain"),
        F.concat(F.lit("f"), (n - F.col("id")).cast("string")).alias("file"),
    )
    lines = inputs.select(
        "plain", F.lit(0).alias("sheet_ord"), F.lit("").alias("sheet"),
        F.explode(F.sequence(F.lit(0).cast("long"), (F.col("file_ord") % 3).cast("long"))).alias("row_idx"),
        F.array(F.lit("c")).alias("cells"),
    )
    placed = ordered(lines, inputs)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the places are read from a table
    got = placed.select("file_ord", "row_idx", "ord").toPandas().sort_values(["file_ord", "row_idx"])
    assert (got["ord"].to_numpy() == np.arange(len(got))).all()


def test_many_files_of_one_folder_take_one_listing(spark, tmp_path):
    names = [f"n{i:03d}.csv" for i in range(40)]
    for n in names[:-1]:
        (tmp_path / n).write_text(n)
    (tmp_path / "sub.csv").mkdir()
    few = list_inputs(spark, str(tmp_path), names[-3:] + ["sub.csv"])
    assert [r.length for r in few.orderBy("file_ord").collect()] == [8, 8, None, None]
    many = list_inputs(spark, str(tmp_path), names + ["sub.csv", names[0], "gone/x.csv"])
    assert [(r.file, r.length) for r in many.orderBy("file_ord").collect()] == [
        *((n, 8) for n in names[:-1]), (names[-1], None), ("sub.csv", None), ("x.csv", None)]
