"""Left join to a table that is unique per key, chosen by measured size.

A table proven small is broadcast. Any other goes through a shuffle in which
rows that cannot match are spread out and a key of very many rows is dealt over
as many places as its count asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.sources.staging import stage

SALTS, SALT, COUNT = "__salts", "__salt", "__count"
BUCKETS = 4096
#: A table of so many rows is no work to count by its keys, and in a larger one all hashes reach
#: a bound of ``FEW_ROWS / BUCKETS`` rows: below it their counts rule out nothing.
FEW_ROWS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Bounds that steer joins; they never change a result.

    ``hot_rows``: rows of one key that go to one place of a shuffle.
    """

    broadcast_bytes: int = 128 * 1024 * 1024
    hot_rows: int = 2_000_000
    null_spread: int = 1 << 20


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of the size of a row in memory."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + 32 + F.coalesce(
                F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)
            )
        else:
            size = size + 8
    return size.cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Size of a table in memory, by one aggregate."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def is_small(df: DataFrame, limits: Limits) -> bool:
    return measured_bytes(df) <= limits.broadcast_bytes


def which_small(tables: list[DataFrame | None], limits: Limits) -> list[bool]:
    """Whether each of several tables is small, measured in one job; a missing one is."""
    sizes = None
    for i, df in enumerate(tables):
        if df is not None:
            one = df.agg(F.lit(i).alias("i"), F.sum(row_bytes(df)).alias("size"))
            sizes = one if sizes is None else sizes.unionByName(one)
    found = {} if sizes is None else {r["i"]: r["size"] or 0 for r in sizes.collect()}
    return [found.get(i, 0) <= limits.broadcast_bytes for i in range(len(tables))]


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread a source that the caller knows to be thin, such as a file of one row
    group, which one task would otherwise carry through every lookup."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def joint_key(*columns: str | Column) -> Column:
    """One text for several: equal only where all are; null where one is."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def salts(counts: DataFrame, key: str, count: str, limits: Limits = Limits()) -> DataFrame:
    """``key, __salts``: places of each key that has more rows than one place takes."""
    n = F.col(count)
    return counts.where(n > limits.hot_rows).select(
        key, F.ceil(n / F.lit(limits.hot_rows)).cast("bigint").alias(SALTS)
    )


@dataclass(frozen=True)
class HeavyKeys:
    """Keys of many rows for several lookups, counted in one pass over the rows.

    There are at most rows / ``hot_rows`` of them. ``counts`` is a written table
    of kind, key and count, checked to be small enough to broadcast.
    """

    counts: DataFrame | None
    limits: Limits

    def of(self, kind: str, name: str) -> DataFrame | None:
        """The salts of one lookup, whose key column is ``name``."""
        if self.counts is None:
            return None
        own = self.counts.where(F.col("kind") == kind).withColumnRenamed("key", name)
        return salts(own, name, COUNT, self.limits)


def heavy_keys(df: DataFrame, keys: dict[str, Column], limits: Limits = Limits()) -> HeavyKeys:
    """Count the keys of all lookups that shuffle, one ``kind`` each, in one aggregate.

    Counted over the rows as given, so pass a plan without lookups in it. A count
    that is too high only means more places. Hashes of the keys are counted first,
    some numbers per task whatever the rows; a heavy key makes the count of its hash
    high, so only keys of such hashes are shuffled to be counted themselves. Where few
    rows make a key heavy, the hashes tell nothing and the keys are counted at once.
    """
    if not keys:
        return HeavyKeys(None, limits)
    # Keys are columns first: within a function of arrays each would be interpreted, and its parts repeated.
    keyed = df.select(*(c.cast("string").alias(kind) for kind, c in keys.items()))
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key")) for kind in keys))
    asked = keyed.select(F.inline(each)).where("key is not null")
    heavy = F.col(COUNT) > limits.hot_rows
    if limits.hot_rows * BUCKETS > FEW_ROWS:
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
        buckets = asked.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias(COUNT)).where(heavy)
        buckets = stage(buckets.drop(COUNT), "heavy_buckets")
        if buckets.isEmpty():
            none = f"select cast(null as string) kind, cast(null as string) key, 0L {COUNT} where false"
            return HeavyKeys(df.sparkSession.sql(none), limits)
        asked = asked.join(F.broadcast(buckets), ["kind", "bucket"], "left_semi")  # at most BUCKETS rows per kind
    found = asked.groupBy("kind", "key").agg(F.count(F.lit(1)).alias(COUNT))
    found = stage(found.where(heavy), "heavy_keys")
    # Far more keys than a broadcast should hold: only keys of more rows get places of their own.
    least, room = limits.hot_rows, max(limits.broadcast_bytes, Limits.broadcast_bytes)
    while measured_bytes(found) > room:
        least *= 2
        found = found.where(F.col(COUNT) > least)
    return HeavyKeys(found, limits)


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    spread: Column,
    small: bool,
    hot: DataFrame | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Add the columns of ``right`` (at most one row per key) to ``left``.

    A small ``right`` is broadcast. Otherwise rows with a null key, which match
    nothing, are spread over the tasks, and rows of a key in ``hot`` over the
    places it has there (``salts``), to each of which that key's row of
    ``right`` is copied. ``spread`` identifies a row of ``left``; salts derive
    from it, so a task that runs again sends its rows to the same places. Which
    keys are salted steers only the distribution: every row is kept and looked up.
    """
    if small:
        return left.join(F.broadcast(right), key, "left")

    place = F.xxhash64(spread)
    salt = F.when(F.col(key).isNull(), F.pmod(place, F.lit(limits.null_spread)))
    if hot is None:
        right = right.withColumn(SALT, F.lit(0).cast("bigint"))
        salted = left.withColumn(SALT, salt.otherwise(F.lit(0)))
        return salted.join(right, [key, SALT], "left").drop(SALT)

    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        SALT,
        salt.when(F.col(SALTS).isNotNull(), F.pmod(place, F.col(SALTS))).otherwise(F.lit(0)),
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(SALTS), F.lit(1)) - 1)
    copied = right.join(F.broadcast(hot), key, "left").withColumn(SALT, F.explode(copies)).drop(SALTS)
    return salted.drop(SALTS).join(copied, [key, SALT], "left").drop(SALT)
