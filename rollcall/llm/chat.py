"""Chat formatting with loss flags (operator 10), built-in functions only.

A template declares how each role opens and closes, which roles are learnt, and
the transitions of a finite-state machine over roles. Every turn becomes three
segments (open, text, close); the segments of a conversation in a row are its
formatted text, and the flags beside them are its loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.tables import narrow

#: Escapes: the mark itself, the start of a control string, a line break in a role.
_ESCAPES = (("\\", "\\s"), ("<|", "<\\p"))
_BREAK = ("\n", "\\n")


@dataclass(frozen=True)
class Template:
    """A declarative chat template.

    ``start`` and ``end`` enclose a turn, ``after`` follows the role's name and
    ``end`` of a turn is followed by ``between``. ``learnt`` roles have their
    texts under the loss mask. ``moves`` holds, for each state, the roles that may
    follow; the state after a role is the role itself.
    """

    start: str = "<|im_start|>"
    after: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    learnt: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


CHAT = Template()


def escape(text: Column, role: bool = False) -> Column:
    """A text in which no control string can occur; ``unescape`` gives it back."""
    for plain, coded in (*_ESCAPES, _BREAK) if role else _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, coded in reversed((*_ESCAPES, _BREAK) if role else _ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, valid, first_bad, segments, formatted``, one row per conversation.

    ``segments`` is an array of ``(turn, text, loss)`` and ``formatted`` its texts
    in a row. ``valid`` tells whether the machine accepts the order of roles and
    ``first_bad`` the position of the first turn that it refuses; such
    conversations are formatted all the same. Null roles and texts are empty; null
    turns come first; turns with one number go by role, then text; repeated rows
    are turns of their own; null ids form one conversation. One formatted
    conversation has to fit a row.
    """
    src = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    held = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # array_sort puts null fields last, so nulls are marked to come first.
    held = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"),
                    held["role"].alias("role"), held["text"].alias("text"))
    chats = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(held)).alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        turn = i.cast("long")
        learnt = t["role"].isin(*template.learnt) if template.learnt else F.lit(False)

        def segment(text: Column, loss: Column) -> Column:
            return F.struct(turn.alias("turn"), text.alias("text"), loss.alias("loss"))

        opened = F.concat(F.lit(template.start), escape(t["role"], role=True), F.lit(template.after))
        return F.array(
            segment(opened, F.lit(False)),
            segment(escape(t["text"]), learnt),
            segment(F.lit(template.end + template.between), F.lit(False)),
        )

    allowed = [(state, role) for state, roles in template.moves.items() for role in roles]

    def move(s: Column, t: Column) -> Column:
        fits = F.lit(False)
        for state, role in allowed:
            fits = fits | ((s["state"] == state) & (t["role"] == role))
        return F.struct(
            t["role"].alias("state"),
            (s["at"] + 1).alias("at"),
            F.when(s["bad"].isNull() & ~fits, s["at"]).otherwise(s["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("bad"))
    out = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", begin, move)["bad"].alias("first_bad"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.select(
        "conv_id", "n_turns", F.col("first_bad").isNull().alias("valid"), "first_bad", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    cut = F.filter(F.split(formatted, _quoted(template.start), -1), lambda p, i: i > 0)
    close = len(template.end + template.between)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.after)
        body = F.substring(p, at + len(template.after), F.length(p))
        return F.struct(
            unescape(F.substring(p, F.lit(1), at - 1), role=True).alias("role"),
            unescape(F.substring(body, F.lit(1), F.length(body) - close)).alias("text"),
        )

    return F.transform(cut, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
