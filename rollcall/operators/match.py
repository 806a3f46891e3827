"""Resolving observations to roster members.

Expected columns of an observation: file_ord, file, sheet, ord, id_raw,
first_raw, last_raw, full_raw, and the flags has_id, has_name, has_full that
say which columns its sheet offers. ``ord`` is the total order of claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import (
    is_missing,
    is_null_text,
    name_key,
    normalize_text,
    strip,
)
from rollcall.operators.lookup import HeavyKeys, Limits, heavy_keys, joint_key, lookup
from rollcall.operators.roster import Roster
from rollcall.sources.staging import stage


def id_key() -> Column:
    return F.when(F.col("has_id") & ~is_missing("id_raw"), strip("id_raw"))


def with_id_hit(
    obs: DataFrame, roster: Roster, limits: Limits = Limits(), heavy: HeavyKeys | None = None
) -> DataFrame:
    """Id lookup: id_key is null where the id is missing, roster_name where unknown."""
    return _known_id(obs.withColumn("id_key", id_key()), roster, limits, heavy)


def _known_id(df: DataFrame, roster: Roster, limits: Limits, heavy: HeavyKeys | None) -> DataFrame:
    return lookup(
        df, roster.ids, "id_key", spread=F.col("ord"),
        small=roster.small, hot=heavy and heavy.of("id", "id_key"), limits=limits,
    )


def with_name_forms(df: DataFrame) -> DataFrame:
    """Normal forms of both name cells, where both are present."""
    present = F.col("has_name") & ~is_null_text("first_raw") & ~is_null_text("last_raw")
    return df.withColumn("name_present", present).withColumns(
        {
            "first_norm": F.when(F.col("name_present"), normalize_text("first_raw")),
            "last_norm": F.when(F.col("name_present"), normalize_text("last_raw")),
        }
    )


def with_name_check(df: DataFrame) -> DataFrame:
    """Whether the name cells contradict the id hit.

    Only the whole name counts, so another split into first and last passes.
    """
    return _compared(with_name_forms(df))


def _compared(df: DataFrame) -> DataFrame:
    seen = F.concat_ws(" ", "first_norm", "last_norm")
    differs = F.col("roster_name").isNotNull() & F.col("name_present")
    return df.withColumn("mismatch", differs & (seen != F.col("roster_name")))


def _without_details(obs: DataFrame) -> DataFrame:
    """Keys and forms of the cells instead of the cells, which only details of issues show."""
    df = with_name_forms(obs.withColumn("id_key", id_key())).drop("id_raw", "first_raw", "last_raw")
    merged = ~F.col("has_name") & F.col("has_full")
    return df.withColumn("full_raw", F.when(merged, F.col("full_raw")))


def _names_where(df: DataFrame, asked: Column) -> DataFrame:
    """Name forms only on rows that still need them."""
    return df.withColumns({c: F.when(asked, F.col(c)) for c in ("first_norm", "last_norm")})


def with_name_decision(
    df: DataFrame, decisions: DataFrame | None, small: bool, limits: Limits = Limits(),
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Saved answer for a contradicting name; null where nobody answered."""
    if decisions is None:
        return df.withColumn("same_person", F.lit(None).cast("boolean"))
    answers = decisions.groupBy(joint_key("file", "id").alias("pair")).agg(
        F.bool_and("answer").alias("same_person")
    )
    pair = F.when(F.col("mismatch"), joint_key("file", "id_key"))
    return lookup(
        df.withColumn("pair", pair), answers.where("pair is not null"), "pair",
        spread=F.col("ord"), small=small, hot=heavy and heavy.of("pair", "pair"), limits=limits,
    ).drop("pair")


def row_name_key() -> Column:
    """Key of a row's name: first and last if the sheet has both, else merged."""
    pair = F.concat(F.lit("n:"), name_key(F.col("first_norm"), F.col("last_norm")))
    merged = F.concat(F.lit("f:"), normalize_text("full_raw"))
    use_full = ~F.col("has_name") & F.col("has_full") & ~is_missing("full_raw")
    return F.when(F.col("name_present"), pair).when(use_full, merged)


def match_keys(roster: Roster, pairs: bool) -> dict[str, Column]:
    """Keys of the lookups that shuffle, over ``with_name_forms`` of the observations.

    Rows that an id settles, and pairs whose names agree, only make counts higher.
    """
    keys = {} if roster.small else {"id": id_key(), "name": row_name_key()}
    return keys | ({"pair": joint_key(F.col("file"), id_key())} if pairs else {})


def with_name_hit(
    df: DataFrame, roster: Roster, limits: Limits = Limits(), heavy: HeavyKeys | None = None
) -> DataFrame:
    """Name lookup for rows the id did not settle.

    One join serves both reading orders and merged names, because the key
    table holds each member under every form. A sheet with first and last name
    never falls back to a merged name.
    """
    key = F.when(F.col("roster_name").isNull(), row_name_key())
    return _known_name(df.withColumn("name_key", key), roster, limits, heavy)


def _known_name(df: DataFrame, roster: Roster, limits: Limits, heavy: HeavyKeys | None) -> DataFrame:
    return lookup(
        df, roster.names, "name_key",
        spread=F.col("ord"), small=roster.small, hot=heavy and heavy.of("name", "name_key"), limits=limits,
    )


def _outcome() -> dict[str, Column]:
    hit = F.col("roster_name").isNotNull()
    direct = F.coalesce("n_direct", F.lit(0))
    swapped = F.coalesce("n_swapped", F.lit(0))
    by_pair = F.col("has_name") & F.col("name_present")
    by_full = ~F.col("has_name") & F.col("has_full")
    rejected = F.col("mismatch") & ~F.coalesce("same_person", F.lit(True))
    one = ~hit & (direct == 1)
    turned = ~hit & by_pair & (direct == 0) & (swapped == 1)
    unknown_id = ~hit & F.col("id_key").isNotNull()
    no_match = (direct == 0) & ~turned

    tier = (
        F.when(hit & ~rejected, "id")
        .when(one & by_pair, "name")
        .when(turned, "swapped")
        .when(one & by_full, "full")
    )
    member = (
        F.when(hit & ~rejected, F.col("id_key"))
        .when(one, F.col("direct_id"))
        .when(turned, F.col("swapped_id"))
    )
    mismatch_code = (
        F.when(F.col("same_person"), "name_mismatch_confirmed_before")
        .when(~F.col("same_person"), "name_mismatch_rejected")
        .otherwise("name_mismatch_proceed")
    )
    id_code = (
        F.when(F.col("has_name"), "id_unknown_try_name")
        .when(F.col("has_full"), "id_unknown_try_full")
        .otherwise("id_unknown_skip")
    )
    pair_code = (
        F.when(~F.col("name_present"), "name_missing")
        .when(turned, "name_swapped")
        .when(direct > 1, "name_ambiguous")
        .when(no_match, "name_unknown")
    )
    full_code = (
        F.when(is_missing("full_raw"), "full_missing")
        .when(direct > 1, "full_ambiguous")
        .when(direct == 0, "full_unknown")
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("mismatch"), mismatch_code),
            F.when(unknown_id, id_code),
            F.when(~hit & F.col("has_name"), pair_code),
            F.when(~hit & by_full, full_code),
        )
    )
    return {"member": member, "tier": tier, "match_issues": codes}


def found_rows(
    obs: DataFrame, roster: Roster, limits: Limits = Limits(), heavy: HeavyKeys | None = None,
    details: bool = True,
) -> list[DataFrame]:
    """Observations with their id and name hits, which no answer changes.

    One table if the roster is small. Otherwise rows with a known id and the others
    apart: id hits are written by id, so that only rows with a question left go through
    another shuffle and the rows of a member stay together for the claims. Without
    ``details`` no cell is carried that only the details of issues show, and names only
    as far as they are compared.
    """
    if details:
        df = with_name_check(with_id_hit(obs, roster, limits, heavy))
    else:
        df = _compared(_known_id(_without_details(obs), roster, limits, heavy))
    known = F.col("roster_name").isNotNull()
    if roster.small:
        hits = with_name_hit(df, roster, limits, heavy)
        return [hits if details else _names_where(hits, F.col("mismatch")).drop("name_key")]
    if details:
        df = stage(df, "id_hits")
        return [df.where(known), with_name_hit(df.where(~known), roster, limits, heavy)]
    df = stage(_names_where(df, ~known | F.col("mismatch")), "id_hits")
    others = df.where(~known).withColumn("name_key", row_name_key()).drop("first_norm", "last_norm", "roster_name")
    return [df.where(known), _known_name(others, roster, limits, heavy).drop("name_key")]


def settled_parts(
    found: list[DataFrame], name_decisions: DataFrame | None, decisions_small: bool,
    limits: Limits = Limits(), heavy: HeavyKeys | None = None,
) -> list[DataFrame]:
    """``found_rows`` with the saved answers. Only known ids contradict names.

    Of a large roster the first part reads written rows as they are, the others are joined.
    """
    hits, others = found[0], found[1:]
    if not others or name_decisions is None or decisions_small:
        return [with_name_decision(hits, name_decisions, decisions_small, limits, heavy), *others]
    differs = F.coalesce("mismatch", F.lit(False))
    asked = with_name_decision(hits.where(differs), name_decisions, decisions_small, limits, heavy)
    return [with_name_decision(hits.where(~differs), None, False), asked, *others]


def outcome(parts: list[DataFrame]) -> DataFrame:
    """All parts with ``member``, ``tier`` and ``match_issues``."""
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df.withColumns(_outcome())


def settled_rows(
    found: list[DataFrame], name_decisions: DataFrame | None, decisions_small: bool,
    limits: Limits = Limits(), heavy: HeavyKeys | None = None,
) -> DataFrame:
    """``found_rows`` with the saved answers and the outcome."""
    return outcome(settled_parts(found, name_decisions, decisions_small, limits, heavy))


def match(
    obs: DataFrame,
    roster: Roster,
    *,
    name_decisions: DataFrame | None = None,
    decisions_small: bool = False,
    limits: Limits = Limits(),
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Observations with ``member``, ``tier`` and ``match_issues``.

    ``heavy`` comes from a caller that counted the keys of more lookups at once.
    """
    if heavy is None:
        pairs = name_decisions is not None and not decisions_small
        heavy = heavy_keys(with_name_forms(obs), match_keys(roster, pairs), limits)
    return settled_rows(found_rows(obs, roster, limits, heavy), name_decisions, decisions_small, limits, heavy)
