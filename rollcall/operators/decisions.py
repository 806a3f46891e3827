"""Answers joined in, and open questions handed out, as tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import name_similarity, strip


@dataclass(frozen=True)
class Decisions:
    """Saved answers; any table may be left out.

    column_choices(file, sheet, role, column): ``sheet`` is '' for files with
    one sheet; a null column declines an ambiguous role.
    sheet_selection(file, sheet): a null sheet selects none of the file.
    name_decisions(file, id, answer), absent_tokens(token), with a column ``answer``
    where texts were refused too, clamp_choices(file, sheet, direction, answer).
    """

    column_choices: DataFrame | None = None
    sheet_selection: DataFrame | None = None
    name_decisions: DataFrame | None = None
    absent_tokens: DataFrame | None = None
    clamp_choices: DataFrame | None = None

    def with_answers(self, answered: DataFrame) -> Decisions:
        """These answers and new ones: rows of ``pending`` with a text column ``answer``.

        A column's answer is its name, or null to decline; a sheets' answer is the
        name of a sheet, one row per sheet kept, or null for none; names and
        clamping and tokens are 'true' or 'false'. A new answer takes the place of an
        old one to the same question; others stay. ``operators.answers`` keeps them
        all, by version.
        """
        old_tokens = self.absent_tokens
        if old_tokens is not None and "answer" not in old_tokens.columns:
            old_tokens = old_tokens.select("token", F.lit(True).alias("answer"))
        of = lambda kind: answered.where(F.col("kind") == kind)
        yes = F.coalesce(F.col("answer") == "true", F.lit(False))
        subject = F.col("subject")
        columns = of("column").select("file", "sheet", subject.alias("role"), F.col("answer").alias("column"))
        sheets = of("sheets").select("file", F.col("answer").alias("sheet"))
        names = of("name").select("file", subject.alias("id"), yes.alias("answer"))
        tokens = of("token").select(subject.alias("token"), yes.alias("answer"))
        clamps = of("clamp").select("file", "sheet", subject.alias("direction"), yes.alias("answer"))
        return Decisions(
            _merged(self.column_choices, columns, ["file", "sheet", "role"]),
            _merged(self.sheet_selection, sheets, ["file"]),
            _merged(self.name_decisions, names, ["file", "id"]),
            _merged(old_tokens, tokens, ["token"]),
            _merged(self.clamp_choices, clamps, ["file", "sheet", "direction"]),
        )


def _merged(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    new = new.distinct()
    return new if old is None else old.join(new, keys, "left_anti").select(*new.columns).unionByName(new)


def pending_columns(sheets: DataFrame) -> DataFrame:
    """Roles with several candidate columns and no saved choice."""
    questions = sheets.select("file", "choice_sheet", F.explode("open_roles").alias("q"))
    return questions.select(
        F.lit("column").alias("kind"),
        "file",
        F.col("choice_sheet").alias("sheet"),
        F.col("q.role").alias("subject"),
        F.size("q.names").cast("bigint").alias("n"),
        F.create_map(F.lit("candidates"), F.to_json("q.names")).alias("evidence"),
    )


def pending_sheets(sheets: DataFrame) -> DataFrame:
    """Files with several sheets and no saved selection."""
    asked = sheets.where(F.col("kept") & F.col("is_multi") & ~F.col("has_selection"))
    found = asked.groupBy("file_ord", "file").agg(
        F.array_sort(F.collect_list(F.struct("sheet_ord", "sheet"))).alias("found")
    )
    return found.select(
        F.lit("sheets").alias("kind"),
        "file",
        F.lit("").alias("sheet"),
        F.lit("").alias("subject"),
        F.size("found").cast("bigint").alias("n"),
        F.create_map(F.lit("candidates"), F.to_json("found.sheet")).alias("evidence"),
    )


def _question(kind: str, when: Column, *, file="", sheet="", subject: Column, names=(None, None),
              seen: Column | None = None, value: Column | None = None) -> Column:
    text = lambda c: F.lit(c).cast("string") if c is None or c == "" else F.col(c)
    unseen = F.when(F.lit(False), F.col("ord"))
    return F.when(when, F.struct(
        F.lit(kind).alias("kind"), text(file).alias("file"), text(sheet).alias("sheet"),
        subject.alias("subject"), F.lit(names[0]).cast("string").alias("roster_name") if names[0] is None
        else names[0].alias("roster_name"),
        F.lit(None).cast("string").alias("seen_name") if names[1] is None else names[1].alias("seen_name"),
        (unseen if seen is None else seen).alias("at"),
        (F.lit(None).cast("double") if value is None else value).alias("number"),
    ))


def _may_ask(kind: str) -> Column:
    """Whether a row asks something of a kind, unless an earlier claim settles it."""
    if kind == "name":
        return F.col("mismatch") & F.col("same_person").isNull()
    if kind == "token":
        return F.col("member").isNotNull() & (F.col("value_issue") == "value_unparsed") & F.col("token_answer").isNull()
    return F.col("member").isNotNull() & F.col("direction").isNotNull() & F.col("clamp_answer").isNull()


def _questions_of_row(kind: str) -> Column:
    """What one row asks of a kind, or null."""
    if kind == "name":
        return _question(
            kind, _may_ask(kind), file="file", subject=F.col("id_key"),
            names=(F.col("roster_name"), F.concat_ws(" ", "first_norm", "last_norm")),
        )
    asks = _may_ask(kind) & ~F.col("is_duplicate")
    if kind == "token":
        return _question(kind, asks, subject=strip("value_raw"), seen=F.col("ord"))
    return _question(kind, asks, file="file", sheet="sheet", subject=F.col("direction"), value=F.col("parsed_value"))


def row_questions(rows: DataFrame, *kinds: str) -> DataFrame:
    """Open questions of the rows: one pass for all kinds, one aggregate, combined before the shuffle.

    Rows that cannot ask are left out first, on columns of the written rows, so that
    they need not meet the claims.
    """
    rows = rows.where(reduce(or_, map(_may_ask, kinds)))
    each = F.filter(F.array(*map(_questions_of_row, kinds)), lambda q: q.isNotNull())
    keys = ["kind", "file", "sheet", "subject", "roster_name", "seen_name"]
    return rows.select(F.inline(each)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"),
        F.min("number").alias("lowest"), F.max("number").alias("highest"),
    )


def name_questions(matched: DataFrame) -> DataFrame:
    """Contradicting names without an answer, with distance and label."""
    asked = row_questions(matched, "name").withColumn("s", name_similarity("roster_name", "seen_name"))
    return asked.select(
        "file", F.col("subject").alias("id"), "roster_name", "seen_name", "n", "s.distance", "s.label"
    )


def token_questions(stated: DataFrame) -> DataFrame:
    """Distinct unparsed texts without an answer, with the first place of each."""
    return row_questions(stated, "token").select(F.col("subject").alias("token"), "n", "first_seen")


def clamp_questions(stated: DataFrame) -> DataFrame:
    """Out-of-range claims without an answer, per sheet and direction."""
    return row_questions(stated, "clamp").select(
        "file", "sheet", F.col("subject").alias("direction"), "n", "lowest", "highest"
    )


def _evidence() -> Column:
    similar = name_similarity("roster_name", "seen_name")
    name = F.create_map(
        F.lit("roster_name"), F.col("roster_name"), F.lit("seen_name"), F.col("seen_name"),
        F.lit("distance"), similar["distance"].cast("string"), F.lit("label"), similar["label"],
    )
    token = F.create_map(F.lit("first_seen"), F.to_json(F.struct("first_seen")))
    clamp = F.create_map(
        F.lit("lowest"), F.col("lowest").cast("string"), F.lit("highest"), F.col("highest").cast("string")
    )
    return F.when(F.col("kind") == "name", name).when(F.col("kind") == "token", token).otherwise(clamp)


def pending(stated: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Everything undecided: kind, file, sheet, subject, n, evidence."""
    found = row_questions(stated, "name", "token", "clamp").select(
        "kind", "file", "sheet", "subject", "n", _evidence().alias("evidence")
    )
    if sheets is not None:
        found = found.unionByName(pending_columns(sheets)).unionByName(pending_sheets(sheets))
    return found
