"""Answers to open questions as one keyed, versioned table, and runs repeated until nothing is open.

A log holds every answer ever given: version, kind, file, sheet, subject, answer.
The question is (kind, file, sheet, subject); its answers of the highest version
count, all of them, as a file's sheets are several rows. Nothing is overwritten, so
a run can be repeated as of any version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.decisions import Decisions
from rollcall.plans.reconcile import Reconciliation
from rollcall.sources.staging import stage

QUESTION = ["kind", "file", "sheet", "subject"]
SCHEMA = "version bigint, kind string, file string, sheet string, subject string, answer string"


def no_answers(spark: SparkSession) -> DataFrame:
    return spark.sql("select " + ", ".join(
        f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in SCHEMA.split(", ")
    )).where("false")


def record(log: DataFrame, answered: DataFrame) -> DataFrame:
    """The log with rows of ``pending`` plus a column ``answer`` as its next version.

    A column's answer is its name, or null to decline; a sheets' answer the name of a
    sheet, one row per sheet kept, or null for none; the others are 'true' or 'false'.
    Repeated rows count once.
    """
    last = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    new = answered.select(*QUESTION, F.col("answer").cast("string").alias("answer")).distinct()
    new = new.crossJoin(F.broadcast(last))  # one row
    return log.unionByName(new.select((F.col("last") + 1).alias("version"), *QUESTION, "answer"))


def current(log: DataFrame, version: int | None = None) -> DataFrame:
    """The answers that count, as of a version: one row per question and answer.

    Two aggregates, combined before the shuffle; a question's answers of one version
    are as many as a workbook has sheets at most.
    """
    seen = log if version is None else log.where(F.col("version") <= version)
    sets = seen.groupBy(*QUESTION, "version").agg(F.collect_set(F.struct("answer")).alias("answers"))
    last = sets.groupBy(*QUESTION).agg(F.max("version").alias("version"), F.max_by("answers", "version").alias("answers"))
    return last.select("version", *QUESTION, F.inline("answers"))


def decisions_of(answers: DataFrame) -> Decisions:
    """Typed tables of the current answers. Refused texts are kept as refused."""
    of = lambda kind: answers.where(F.col("kind") == kind)
    yes = F.coalesce(F.col("answer") == "true", F.lit(False)).alias("answer")
    subject = F.col("subject")
    return Decisions(
        column_choices=of("column").select("file", "sheet", subject.alias("role"), F.col("answer").alias("column")),
        sheet_selection=of("sheets").select("file", F.col("answer").alias("sheet")),
        name_decisions=of("name").select("file", subject.alias("id"), yes),
        absent_tokens=of("token").select(subject.alias("token"), yes),
        clamp_choices=of("clamp").select("file", "sheet", subject.alias("direction"), yes),
    )


@dataclass
class Replay:
    """A run that asks nothing new: its results, all answers and what stays open."""

    run: Reconciliation
    log: DataFrame
    open: DataFrame
    rounds: int


def replay(
    run: Callable[[Decisions], Reconciliation],
    log: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    rounds: int = 100,
) -> Replay:
    """Run with the answers of a log, answer what is open, and run again until nothing new is.

    ``answer`` gets open questions and returns those it settles, with a column
    ``answer`` (several rows for several sheets). New answers move claims, which opens
    other questions, so one round is rarely enough; every round settles at least one
    question for good, and ``rounds`` bounds them. A question that was answered and is
    open still, like a column that does not exist, is not asked twice: it stays in
    ``open``. Each round's log is a written table.
    """
    for done in range(1, rounds + 1):
        answers = stage(current(log), "answers")
        result = run(decisions_of(answers))
        found = stage(result.pending, "pending")
        asked = answers.select(*QUESTION).distinct()
        same = [F.col(f"q.{c}").eqNullSafe(F.col(f"a.{c}")) for c in QUESTION]
        fresh = found.alias("q").join(asked.alias("a"), same, "left_anti")
        settled = stage(answer(fresh), "answered")
        if settled.isEmpty():
            return Replay(result, log, found, done)
        log = stage(record(log, settled), "log")
    raise RuntimeError(f"questions were still coming up after {rounds} rounds")


def unattended() -> Column:
    """The answer to a question that a run without anybody takes by default: the same
    person, no absence, no clamping. Ambiguous columns and sheets have none."""
    return F.when(F.col("kind") == "name", "true").when(F.col("kind").isin("token", "clamp"), "false")
