"""Checks of text and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.checks import fixtures as fx
from rollcall.checks.registry import check
from rollcall.functions import text, values
from rollcall.operators.claims import with_value

# Normal form in DuckDB for text without compatibility characters.
NORM = r"trim(regexp_replace(strip_accents(lower({0})), '[-_''`´‐‑‒–—―‘’‚‛′‵\s]+', ' ', 'g'))"

TEXTS = """
select 'd' || cast(doc_id as string) as k, text as t from documents
union all
select 'c' || cast(conv_id as string) || '.' || cast(turn as string) as k, text as t
from conversations
"""


@check("normalize_text", f"select k, {NORM.format('t')} as norm from ({TEXTS})")
def normalize(spark, sf):
    fx.register(spark, sf, "documents", "conversations")
    return spark.sql(TEXTS).select("k", text.normalize_text("t").alias("norm"))


# Raw cells of every kind: numbers with both marks, words, tokens, blanks, nulls.
CELLS = """
select 'l' as src, l_orderkey as a, l_linenumber as b, l_partkey as c, l_suppkey as d,
  case when l_suppkey % 11 = 0 then null when l_suppkey % 13 = 0 then '   '
       when l_suppkey % 17 = 0 then ' abs ' when l_suppkey % 19 = 0 then 'NaN'
       when l_suppkey % 23 = 0 then 'défaillant' when l_suppkey % 29 = 0 then '15/20'
       when l_suppkey % 31 = 0 then cast(l_linenumber as string) || 'd'
       when l_linenumber % 2 = 0 then replace(cast(cast(l_extendedprice as decimal(12,2)) as string), '.', ',')
       else ' ' || cast(cast(l_quantity as decimal(6,1)) as string) end as raw
from lineitem
union all
select 'c', c_custkey, 0, 0, 0, replace(cast(cast(c_acctbal as decimal(12,2)) as string), '.', ',') from customer
union all
select 'n', c_custkey, 0, 0, 0, c_name from customer
"""


@check(
    "parse_value",
    f"""
    with cells as ({CELLS}),
    t as (select *, trim(raw) as s from cells),
    u as (select *, lower(s) in ('', 'nan') as blank,
            upper(s) in ('ABS','ABSENCE','ABSENT','ABJ','ABI','DEF','DEFAILLANT','DÉFAILLANT') as gone,
            try_cast(replace(s, ',', '.') as double) as num from t)
    select src, a, b, c, d, raw,
      case when not blank and not gone then num end as value,
      coalesce(gone, false) as is_absent,
      case when raw is null then null when blank then 'value_empty'
           when not gone and num is null then 'value_unparsed' end as issue
    from u
    """,
)
def parse(spark, sf):
    fx.register(spark, sf, "lineitem", "customer")
    parsed = values.parse_value("raw").alias("p")
    return spark.sql(CELLS).select("*", parsed).select(
        "src", "a", "b", "c", "d", "raw", "p.value", "p.is_absent", "p.issue"
    )


@check(
    "clamp",
    """
    select o_orderkey as k,
      case when v > 20000 then 20000.0 when v < 5000 then 5000.0 else v end as value,
      case when v > 20000 then 'above' when v < 5000 then 'below' end as direction
    from (select o_orderkey, o_totalprice as v from orders)
    """,
)
def clamp(spark, sf):
    fx.register(spark, sf, "orders")
    c = values.clamp("o_totalprice", 5000, 20000).alias("c")
    return spark.table("orders").select(F.col("o_orderkey").alias("k"), c).select(
        "k", "c.value", "c.direction"
    )


NUMBERS = """
select 'o' as src, o_orderkey as k, o_totalprice as v from orders
union all select 'c', c_custkey, c_acctbal from customer
union all select 's', s_suppkey, s_acctbal / 1000000 from supplier
union all select 'p', p_partkey, p_retailprice * 1000 from part
union all select 'e', event_id, value from events
"""


@check("format_g", f"select src, k, format('{{:g}}', v) as txt from ({NUMBERS})")
def format_g(spark, sf):
    fx.register(spark, sf, "orders", "customer", "supplier", "part", "events")
    return spark.sql(NUMBERS).select("src", "k", values.format_g("v").alias("txt"))


@check(
    "missing_cells",
    f"""
    select src, a, b, c, d,
      coalesce(lower(trim(raw)), '') in ('', 'nan') as missing,
      coalesce(lower(trim(raw)), 'nan') = 'nan' as null_text,
      coalesce(upper(trim(raw)) in ('ABS','ABSENCE','ABSENT','ABJ','ABI','DEF','DEFAILLANT','DÉFAILLANT','NAN'), false) as absent
    from ({CELLS})
    """,
)
def missing_cells(spark, sf):
    fx.register(spark, sf, "lineitem", "customer")
    absent = F.coalesce(values.is_absent_token("raw", ["nan"]), F.lit(False))
    return spark.sql(CELLS).select(
        "src", "a", "b", "c", "d",
        text.is_missing("raw").alias("missing"),
        text.is_null_text("raw").alias("null_text"),
        absent.alias("absent"),
    )


@check(
    "name_similarity",
    """
    with p as (
      select p_partkey as k, lower(p_name) as a, lower(p_type || ' ' || p_brand) as b from part
      union all
      select -1 - s_suppkey, lower(s_name), replace(lower(s_name), '00', '0') from supplier),
    d as (select k, levenshtein(a, b) as distance, greatest(length(a), length(b)) as longest from p)
    select k, cast(distance as int) as distance,
      case when distance = 0 then 'identical' when longest = 0 then 'empty'
           when distance / longest <= 0.15 then 'very similar (likely typo)'
           when distance / longest <= 0.35 then 'somewhat similar'
           else 'very different (possibly wrong student)' end as label
    from d
    """,
)
def name_similarity(spark, sf):
    fx.register(spark, sf, "part", "supplier")
    pairs = spark.sql(
        """
        select p_partkey as k, lower(p_name) as a, lower(p_type || ' ' || p_brand) as b from part
        union all
        select -1 - s_suppkey, lower(s_name), replace(lower(s_name), '00', '0') from supplier
        """
    )
    s = text.name_similarity("a", "b").alias("s")
    return pairs.select("k", s).select("k", "s.distance", "s.label")


@check(
    "extra_absent_tokens",
    f"""
    with cells as ({CELLS}),
    t as (select *, trim(raw) as s from cells),
    u as (select *, lower(coalesce(s, '')) in ('', 'nan') as blank,
            upper(s) in ('ABS','ABSENCE','ABSENT','ABJ','ABI','DEF','DEFAILLANT','DÉFAILLANT','15/20','17.0') as gone,
            try_cast(replace(s, ',', '.') as double) as num from t)
    select src, a, b, c, d,
      case when not blank and not gone then num end as value,
      coalesce(gone, false) as is_absent,
      case when blank then 'value_empty' when not gone and num is null then 'value_unparsed' end as issue
    from u
    """,
)
def extra_absent_tokens(spark, sf):
    fx.register(spark, sf, "lineitem", "customer", "region")
    tokens = spark.sql("select '15/20' as token from region union select ' 17.0 ' from region")
    cells = spark.sql(CELLS).withColumnRenamed("raw", "value_raw").withColumn(
        "ord", F.struct("src", "a", "b", "c", "d")
    )
    return with_value(cells, token_table=tokens, tokens_small=True).select(
        "src", "a", "b", "c", "d", "value", "is_absent", F.col("value_issue").alias("issue")
    )
