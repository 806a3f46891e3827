"""Versioned answers and runs that are repeated until nothing is open."""

import pytest
from pyspark.sql import functions as F

from rollcall import Params, reconcile
from rollcall.operators import answers as ans

ANSWERED = "kind string, file string, sheet string, subject string, answer string"
ROWS = "file_ord int, file string, sheet string, ord bigint, id_raw string, first_raw string, last_raw string, full_raw string, value_raw string"


def test_last_version_of_a_question_counts_whole(spark):
    log = ans.no_answers(spark)
    assert log.count() == 0 and ans.current(log).count() == 0
    first = spark.createDataFrame(
        [("sheets", "a", "", "", "one"), ("sheets", "a", "", "", "two"), ("name", "a", "", "7", "true"),
         ("column", "a", "one", "id", None), ("name", "a", "", "7", "true")], ANSWERED)
    log = ans.record(log, first)
    log = ans.record(log, spark.createDataFrame([("sheets", "a", "", "", "three"), ("name", "b", "", "7", "false")], ANSWERED))
    log = ans.record(log, spark.createDataFrame([("sheets", "a", "", "", None)], ANSWERED))
    rows = lambda df: sorted((r.version, r.kind, r.file, r.answer or "") for r in df.collect())
    assert rows(ans.current(log, 1)) == [(1, "column", "a", ""), (1, "name", "a", "true"), (1, "sheets", "a", "one"), (1, "sheets", "a", "two")]
    assert rows(ans.current(log, 2)) == [(1, "column", "a", ""), (1, "name", "a", "true"), (2, "name", "b", "false"), (2, "sheets", "a", "three")]
    assert rows(ans.current(log)) == [(1, "column", "a", ""), (1, "name", "a", "true"), (2, "name", "b", "false"), (3, "sheets", "a", "")]
    saved = ans.decisions_of(ans.current(log))
    assert [tuple(r) for r in saved.sheet_selection.collect()] == [("a", None)]
    assert sorted(tuple(r) for r in saved.name_decisions.collect()) == [("a", "7", True), ("b", "7", False)]


@pytest.fixture(scope="module")
def tables(spark):
    roster = spark.createDataFrame(
        [("1", "Ada", "Byron", "", 1), ("2", "Max", "Frisch", "", 2), ("3", "Ida", "Noddack", "", 3)],
        "id string, first_name string, last_name string, email string, ord bigint")
    rows = spark.createDataFrame(
        [(0, "a", "", 1, "1", "Bob", "Other", None, "12"),  # refused: the next row's text is asked then
         (0, "a", "", 2, "1", "Ada", "Byron", None, "ill"),  # absent: the next row is a duplicate
         (0, "a", "", 3, "1", "Ada", "Byron", None, "99"),
         (1, "b", "", 4, "2", "Max", "Frisch", None, "n/a"),  # refused: the next row's value is asked then
         (1, "b", "", 5, "2", "Max", "Frisch", None, "50"),
         (1, "b", "", 6, "3", "Ida", "Noddack", None, None)], ROWS)
    flags = {"has_id": F.lit(True), "has_name": F.lit(True), "has_full": F.lit(False)}
    return roster, rows.withColumns(flags)


def runner(tables):
    return lambda d: reconcile(*tables, decisions=d, params=Params(max_value=20))


def test_replay_asks_until_nothing_is_open(spark, tables):
    rule = (F.when(F.col("kind") == "name", "false").when(F.col("subject") == "ill", "true")
            .when(F.col("kind") == "token", "false").otherwise("true"))
    done = ans.replay(runner(tables), ans.no_answers(spark), lambda q: q.withColumn("answer", rule))
    assert done.open.isEmpty() and done.rounds == 3
    log = sorted((r.version, r.kind, r.subject, r.answer) for r in done.log.collect())
    # Round 2 asks of file a's 99 too: it is a claim as long as "ill" is no absence.
    assert log == [(1, "clamp", "above", "true"), (1, "name", "1", "false"), (1, "token", "n/a", "false"),
                   (2, "clamp", "above", "true"), (2, "token", "ill", "true")]
    got = {r.id: (r.value, r.is_absent) for r in done.run.consolidated.collect()}
    assert got == {"1": (None, True), "2": (20.0, False), "3": (None, False)}
    # The log alone gives the same again, without a question.
    again = ans.replay(runner(tables), done.log, lambda q: q.withColumn("answer", F.lit("true")))
    assert again.rounds == 1 and again.log.count() == 5
    assert {r.id: (r.value, r.is_absent) for r in again.run.consolidated.collect()} == got


def test_unattended_answers_change_no_result(spark, tables):
    plain = runner(tables)(ans.decisions_of(ans.no_answers(spark))).consolidated.collect()
    done = ans.replay(runner(tables), ans.no_answers(spark), lambda q: q.withColumn("answer", ans.unattended()))
    assert sorted(done.run.consolidated.collect()) == sorted(plain) and done.open.isEmpty()


def test_nobody_answers(spark, tables):
    done = ans.replay(runner(tables), ans.no_answers(spark), lambda q: q.withColumn("answer", F.lit("")).limit(0))
    assert done.rounds == 1 and done.open.count() == 3 and done.log.count() == 0


def test_rounds_are_bounded(spark, tables):
    with pytest.raises(RuntimeError):
        ans.replay(runner(tables), ans.no_answers(spark), lambda q: q.withColumn("answer", F.lit("false")), rounds=1)
