"""Inputs derived from the given tables, in SQL that Spark and DuckDB share.

Every fixture covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Members: many share first and last name, none lacks an id.
ROSTER = """
select cast(p_partkey as string) as id, split_part(p_name, ' ', 1) as first_name,
  split_part(p_name, ' ', 2) || '-' || cast(cast(floor(p_partkey / 5) as bigint) as string) as last_name,
  'p' || cast(p_partkey as string) || '@example.org' as email, p_partkey as ord
from part
"""

# Rows with missing and unknown ids, swapped and misspelt names, commas,
# absences, blanks and unparsable texts. Some members never get a value.
OBSERVATIONS = """
select l_returnflag || l_linestatus as file, '' as sheet,
  l_orderkey as o1, l_linenumber as o2, l_partkey as o3, l_suppkey as o4,
  case when l_orderkey % 5 = 0 then null
       when l_orderkey % 7 = 0 then 'X' || r.id else r.id end as id_raw,
  case when l_orderkey % 3 = 0 then r.last_name
       when l_orderkey % 11 = 0 then replace(r.first_name, 'a', 'e')
       else r.first_name end as first_raw,
  case when l_orderkey % 3 = 0 then r.first_name else r.last_name end as last_raw,
  case when l_orderkey % 13 = 0 then r.last_name || ' ' || r.first_name
       when l_orderkey % 17 = 0 then '' else r.first_name || ' ' || r.last_name end as full_raw,
  case when l_partkey % 10 = 3 then ''
       when l_suppkey % 17 = 0 then 'ABS' when l_suppkey % 19 = 0 then ''
       when l_suppkey % 23 = 0 then '15/20' when l_suppkey % 29 = 0 then 'non rendu'
       when l_linenumber % 2 = 0
         then replace(cast(cast(l_quantity as decimal(6,1)) as string), '.', ',')
       else cast(cast(l_quantity as decimal(6,1)) as string) end as value_raw
from lineitem join roster r on r.id = cast(l_partkey as string)
"""

# Position of each file in the run.
FILES = """
select file, cast(row_number() over (order by file) - 1 as int) as file_ord
from (select distinct l_returnflag || l_linestatus as file from lineitem)
"""

# Saved answers: same person only for some ids; clamping for some files only.
NAME_DECISIONS = """
select distinct l_returnflag || l_linestatus as file, cast(l_partkey as string) as id,
  l_partkey % 2 = 0 as answer
from lineitem where l_partkey % 3 < 2
"""
CLAMP_CHOICES = """
select distinct l_returnflag || l_linestatus as file, '' as sheet, 'above' as direction,
  l_linestatus = 'F' as answer
from lineitem where l_returnflag <> 'N' or l_linestatus = 'F'
"""
ABSENT_TOKENS = """
select distinct case when r_regionkey % 2 = 0 then 'Non Rendu' else ' non rendu ' end as token
from region
"""

# A roster with many rows per id: the first in order counts.
LONG_ROSTER = """
select case when l_linenumber = 1 and l_quantity < 3 then ' ' else ' ' || cast(l_partkey as string) || ' ' end as id,
  l_returnflag || cast(l_suppkey as string) as first_name, l_linestatus as last_name,
  cast(null as string) as email, l_orderkey as o1, l_linenumber as o2, l_suppkey as o3,
  l_partkey as o4, l_returnflag || l_linestatus as o5
from lineitem
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the given tables as views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "part", "lineitem")
    df = spark.sql(ROSTER)
    df.createOrReplaceTempView("roster")
    return df


def files(spark: SparkSession) -> DataFrame:
    df = spark.sql(FILES)
    df.createOrReplaceTempView("files")
    return df


def observations(
    spark: SparkSession, *, has_id: bool = True, has_name: bool = True, has_full: bool = False,
    sql: str = OBSERVATIONS,
) -> DataFrame:
    """Observations over ``roster``; the flags say which columns a sheet offers.

    There are as many files as pairs of flags, so the rows are not shuffled by file.
    Members are joined by their number, not by its text: the same rows, without a text in each.
    """
    spark.sql(sql.replace("r.id = cast(l_partkey as string)", "r.ord = l_partkey")).createOrReplaceTempView(
        "raw_observations"
    )
    files(spark)
    return spark.sql(
        f"""
        select /*+ broadcast(f) */ f.file_ord, o.*, struct(f.file_ord, o1, o2, o3, o4) as ord,
          {has_id} as has_id, {has_name} as has_name, {has_full} as has_full
        from raw_observations o join files f on o.file = f.file
        """
    )
