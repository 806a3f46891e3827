"""The roster and its lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import is_missing, name_key, normalize_text, strip
from rollcall.operators.lookup import Limits, is_small, lookup, salts
from rollcall.sources.staging import stage


@dataclass(frozen=True)
class Roster:
    """Members in roster order with the tables rows are matched against.

    ``ids``: id_key, roster_name. ``names``: name_key with the number of
    members and one id for the key as written and for the swapped key; keys
    start with ``n:`` for first and last name and ``f:`` for a merged name.
    ``small`` tells that the tables were measured and may be broadcast.
    """

    members: DataFrame
    ids: DataFrame
    names: DataFrame
    small: bool


def present_rows(rows: DataFrame) -> DataFrame:
    """Roster rows that have an id, trimmed; nothing is dropped for its names."""
    return rows.where(~is_missing("id")).select(
        strip("id").alias("id"),
        *(
            F.coalesce(strip(c), F.lit("")).alias(c)
            for c in ("first_name", "last_name", "email")
        ),
        "ord",
    )


def dedup_members(rows: DataFrame) -> DataFrame:
    """First row per id in roster order; ``copies`` counts all of them.

    An aggregate combines before the shuffle, so an id with very many rows
    costs one row per task, where a window would gather them all.
    """
    first = F.min_by(F.struct("first_name", "last_name", "email"), "ord")
    return (
        present_rows(rows)
        .groupBy("id")
        .agg(first.alias("f"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("copies"))
        .select("id", "f.*", "ord", "copies")
    )


def duplicate_rows(
    rows: DataFrame, members: DataFrame, small: bool, limits: Limits = Limits()
) -> DataFrame:
    """Dropped roster rows, one issue each."""
    kept = members.where("copies > 1").select("id", F.col("ord").alias("kept_ord"))
    hot = None if small else salts(members, "id", "copies", limits)
    joined = lookup(
        present_rows(rows), kept, "id",
        spread=F.col("ord"), small=small, hot=hot, limits=limits,
    )
    return joined.where(F.col("ord") > F.col("kept_ord")).select(
        "id", "first_name", "last_name", "ord", F.lit("dup_roster_id").alias("code")
    )


def name_forms(members: DataFrame) -> DataFrame:
    """Normal form of both names; a merged name is their trimmed concatenation."""
    return members.select(
        "id",
        normalize_text("first_name").alias("first"),
        normalize_text("last_name").alias("last"),
    )


def name_keys(forms: DataFrame) -> DataFrame:
    """One row per first-and-last-name key with both reading orders."""
    both = F.array(
        F.struct(name_key(F.col("first"), F.col("last")).alias("key"), F.lit(False).alias("swapped")),
        F.struct(name_key(F.col("last"), F.col("first")).alias("key"), F.lit(True).alias("swapped")),
    )
    return _count_keys(forms.select("id", F.inline(both)))


def full_name_keys(forms: DataFrame) -> DataFrame:
    """One row per merged name, written either way round."""
    both = F.array_distinct(
        F.array(
            F.trim(F.concat_ws(" ", "first", "last")),
            F.trim(F.concat_ws(" ", "last", "first")),
        )
    )
    keys = forms.select("id", F.explode(both).alias("key"), F.lit(False).alias("swapped"))
    return _count_keys(keys.where("key <> ''"))


def _count_keys(keys: DataFrame) -> DataFrame:
    def side(swapped: bool) -> list:
        here = F.col("swapped") == swapped
        label = "swapped" if swapped else "direct"
        return [
            F.count_if(here).alias(f"n_{label}"),
            F.min(F.when(here, F.col("id"))).alias(f"{label}_id"),
        ]

    return keys.groupBy("key").agg(*side(False), *side(True))


def index_roster(
    rows: DataFrame, limits: Limits = Limits(), small: bool | None = None
) -> Roster:
    """Deduplicate the roster and derive its lookup tables.

    The members are written once, as ids, names and results all read them. Their
    size is measured unless the caller states it. Keys repeat each name a few
    times, hence the factor on the measured bytes.
    """
    members = stage(dedup_members(rows), "members")
    if small is None:
        small = is_small(members.drop("ord"), Limits(broadcast_bytes=limits.broadcast_bytes // 4))
    forms = name_forms(members)
    ids = forms.select(
        F.col("id").alias("id_key"), F.concat_ws(" ", "first", "last").alias("roster_name")
    )
    names = (
        name_keys(forms)
        .withColumn("key", F.concat(F.lit("n:"), "key"))
        .unionByName(full_name_keys(forms).withColumn("key", F.concat(F.lit("f:"), "key")))
        .withColumnRenamed("key", "name_key")
    )
    return Roster(members, ids, names, small)
