"""Checks of the roster, matching, claims and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.checks import fixtures as fx
from rollcall.checks.registry import check
from rollcall.functions.text import is_missing
from rollcall.operators import answers as ans
from rollcall.operators import decisions as dec
from rollcall.operators import report
from rollcall.operators.lookup import Limits
from rollcall.operators.match import match, with_id_hit, with_name_check
from rollcall.operators.roster import (
    dedup_members,
    duplicate_rows,
    full_name_keys,
    index_roster,
    name_forms,
    name_keys,
)
from rollcall.plans.reconcile import Params, look_up, reconcile
from rollcall.sources.staging import stage

# Normal form in DuckDB for the ASCII names of the fixture.
N = r"trim(regexp_replace(lower({0}), '[-_''\s]+', ' ', 'g'))"
R_FIRST, R_LAST = N.format("first_name"), N.format("last_name")


def _long_roster(spark, sf):
    fx.register(spark, sf, "lineitem")
    return spark.sql(fx.LONG_ROSTER).withColumn("ord", F.struct("o1", "o2", "o3", "o4", "o5"))


LONG = f"""
with rows as (select *, trim(id) as sid from ({fx.LONG_ROSTER})),
ranked as (select sid as id, first_name, last_name, '' as email, o1, o2, o3, o4, o5,
  row_number() over (partition by sid order by o1, o2, o3, o4, o5) as rn,
  count(*) over (partition by sid) as copies from rows where sid <> '')
"""


@check(
    "roster_dedup",
    LONG + "select id, first_name, last_name, email, o1, o2, o3, copies from ranked where rn = 1",
)
def roster_dedup(spark, sf):
    return dedup_members(_long_roster(spark, sf)).select(
        "id", "first_name", "last_name", "email", "ord.o1", "ord.o2", "ord.o3", "copies"
    )


@check(
    "roster_duplicates",
    LONG + "select id, first_name, last_name, o1, o2, o3, o4, 'dup_roster_id' as code from ranked where rn > 1",
)
def roster_duplicates(spark, sf):
    rows = _long_roster(spark, sf)
    return duplicate_rows(rows, dedup_members(rows), small=False).select(
        "id", "first_name", "last_name", "ord.o1", "ord.o2", "ord.o3", "ord.o4", "code"
    )


@check(
    "roster_missing_id",
    f"""
    select case when trim(id) = '' then 'missing' else 'present' end as state, count(*) as n
    from ({fx.LONG_ROSTER}) group by 1
    """,
)
def roster_missing_id(spark, sf):
    state = F.when(is_missing("id"), "missing").otherwise("present")
    return _long_roster(spark, sf).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _forms(spark, sf):
    return name_forms(dedup_members(fx.roster(spark, sf)))


@check(
    "name_keys",
    f"""
    with r as (select id, {R_FIRST} as f, {R_LAST} as l from ({fx.ROSTER})),
    k as (select l || '|' || f as key, id as d, null as s from r
          union all select f || '|' || l, null, id from r)
    select key, count(d) as n_direct, min(d) as direct_id, count(s) as n_swapped, min(s) as swapped_id
    from k group by key
    """,
)
def roster_name_keys(spark, sf):
    return name_keys(_forms(spark, sf))


@check(
    "full_name_keys",
    f"""
    with r as (select id, {R_FIRST} || ' ' || {R_LAST} as fl, {R_LAST} || ' ' || {R_FIRST} as lf
               from ({fx.ROSTER})),
    k as (select fl as key, id from r union select lf, id from r)
    select key, count(*) as n, min(id) as id from k where key <> '' group by key
    """,
)
def roster_full_name_keys(spark, sf):
    return full_name_keys(_forms(spark, sf)).select(
        "key", F.col("n_direct").alias("n"), F.col("direct_id").alias("id")
    )


# Row-by-row resolution in SQL, with one subquery per tier.
BASE = f"""
with roster as ({fx.ROSTER}),
raw_observations as ({fx.OBSERVATIONS}),
files as ({fx.FILES}),
observations as (select f.file_ord, o.* from raw_observations o join files f on o.file = f.file),
rn as (select *, {R_FIRST} as rf, {R_LAST} as rl from roster),
pair as (select rl || '|' || rf as key, count(*) as n, min(id) as id from rn group by 1),
merged as (select key, count(*) as n, min(id) as id from (
    select rf || ' ' || rl as key, id from rn union select rl || ' ' || rf, id from rn) group by 1),
o1 as (select o.*, case when lower(trim(coalesce(id_raw, ''))) in ('', 'nan') then null else trim(id_raw) end as id_key,
    {N.format('first_raw')} as f, {N.format('last_raw')} as l, {N.format('full_raw')} as full_norm
    from observations o)
"""
PAIR = BASE + """,
name_decisions as (""" + fx.NAME_DECISIONS + """),
o2 as (select o1.*, r.id as hit, r.rf || ' ' || r.rl as roster_name,
    r.id is not null and r.rf || ' ' || r.rl <> f || ' ' || l as mismatch
    from o1 left join rn r on r.id = o1.id_key),
m as (select o2.*, a.n as n1, a.id as i1, b.n as n2, b.id as i2 from o2
    left join pair a on a.key = l || '|' || f left join pair b on b.key = f || '|' || l),
matched as (select *,
    case when hit is not null then hit when n1 = 1 then i1 when n1 is null and n2 = 1 then i2 end as member,
    case when hit is not null then 'id' when n1 = 1 then 'name' when n1 is null and n2 = 1 then 'swapped' end as tier
    from m)
"""
KEYS = "file, o1, o2, o3, o4"


def _pair_match(spark, sf):
    index = index_roster(fx.roster(spark, sf))
    # Id hits are written, so cells that these sheets do not offer or that no match reads are left out first.
    obs = fx.observations(spark).drop("sheet", "value_raw").withColumn("full_raw", F.lit(None).cast("string"))
    return match(obs, index)


@check("match_id", PAIR + f"select {KEYS}, id_key, hit from matched")
def match_id(spark, sf):
    index = index_roster(fx.roster(spark, sf))
    hit = F.when(F.col("roster_name").isNotNull(), F.col("id_key")).alias("hit")
    return with_id_hit(fx.observations(spark), index).select(*KEYS.split(", "), "id_key", hit)


@check(
    "name_crosscheck",
    PAIR + f"select {KEYS}, hit as id, roster_name, f || ' ' || l as seen_name from matched where mismatch",
)
def name_crosscheck(spark, sf):
    index = index_roster(fx.roster(spark, sf))
    df = with_name_check(with_id_hit(fx.observations(spark), index))
    return df.where("mismatch").select(
        *KEYS.split(", "), F.col("id_key").alias("id"), "roster_name",
        F.concat_ws(" ", "first_norm", "last_norm").alias("seen_name"),
    )


@check("match_rows", PAIR + f"select {KEYS}, member, tier from matched")
def match_rows(spark, sf):
    return _pair_match(spark, sf).select(*KEYS.split(", "), "member", "tier")


@check("match_name", PAIR + f"select {KEYS}, member from matched where tier = 'name'")
def match_name(spark, sf):
    return _pair_match(spark, sf).where("tier = 'name'").select(*KEYS.split(", "), "member")


@check("match_swapped", PAIR + f"select {KEYS}, member from matched where tier = 'swapped'")
def match_swapped(spark, sf):
    return _pair_match(spark, sf).where("tier = 'swapped'").select(*KEYS.split(", "), "member")


@check(
    "match_ambiguous",
    PAIR + f"select {KEYS}, n1 as candidates from matched where member is null and n1 > 1",
)
def match_ambiguous(spark, sf):
    df = _pair_match(spark, sf).where(F.array_contains("match_issues", "name_ambiguous"))
    return df.select(*KEYS.split(", "), F.col("n_direct").alias("candidates"))


@check(
    "match_unknown",
    PAIR + f"""select {KEYS}, id_key is not null as had_id from matched
    where member is null and n1 is null""",
)
def match_unknown(spark, sf):
    df = _pair_match(spark, sf).where(F.array_contains("match_issues", "name_unknown"))
    return df.select(*KEYS.split(", "), F.col("id_key").isNotNull().alias("had_id"))


@check(
    "match_full_name",
    BASE + f"""
    select {KEYS}, case when r.id is not null then r.id when m.n = 1 then m.id end as member,
      case when r.id is not null then 'id' when m.n = 1 then 'full' end as tier,
      case when r.id is null and trim(full_raw) = '' then 'full_missing'
           when r.id is null and m.n is null then 'full_unknown'
           when r.id is null and m.n > 1 then 'full_ambiguous' end as code
    from o1 left join roster r on r.id = id_key
      left join merged m on m.key = full_norm and full_norm <> ''
    """,
)
def match_full_name(spark, sf):
    index = index_roster(fx.roster(spark, sf))
    df = match(fx.observations(spark, has_name=False, has_full=True), index)
    code = F.element_at(F.filter("match_issues", lambda c: c.startswith("full_")), 1)
    return df.select(
        *KEYS.split(", "), "member", "tier",
        F.when(F.size(F.filter("match_issues", lambda c: c.startswith("full_"))) > 0, code).alias("code"),
    )


@check(
    "match_id_only",
    BASE + f"""
    select {KEYS}, r.id as member, id_key is not null and r.id is null as skipped
    from o1 left join roster r on r.id = id_key
    """,
)
def match_id_only(spark, sf):
    index = index_roster(fx.roster(spark, sf))
    df = match(fx.observations(spark, has_name=False), index)
    return df.select(
        *KEYS.split(", "), "member",
        F.array_contains("match_issues", "id_unknown_skip").alias("skipped"),
    )


# Answers applied, values parsed, first claim per member found by a window.
DECIDED = PAIR + """,
clamp_choices as (""" + fx.CLAMP_CHOICES + """),
d as (select m.*, n.answer as same_person, trim(coalesce(value_raw, '')) as s,
    case when m.mismatch and n.answer = false then null else m.member end as who
    from matched m left join name_decisions n on m.mismatch and n.file = m.file and n.id = m.id_key),
v as (select *, lower(s) in ('', 'nan') as blank,
    upper(s) in ('ABS','ABSENCE','ABSENT','ABJ','ABI','DEF','DEFAILLANT','DÉFAILLANT','NON RENDU') as gone
    from d),
w as (select v.*, case when not blank and not gone then try_cast(replace(s, ',', '.') as double) end as num from v),
x as (select w.*, c.answer as clamp_answer, case when num > 20 then 'above' when num < 2 then 'below' end as direction
    from w left join clamp_choices c on c.file = w.file and c.sheet = w.sheet
      and c.direction = case when num > 20 then 'above' when num < 2 then 'below' end),
y as (select *, case when clamp_answer and direction = 'above' then 20.0
      when clamp_answer and direction = 'below' then 2.0 else num end as value,
    who is not null and (num is not null or gone) as claim from x),
z as (select *, count(case when claim then 1 end) over (partition by who order by file_ord, o1, o2, o3, o4
      rows between unbounded preceding and 1 preceding) as earlier,
    first_value(case when claim then file end ignore nulls) over (partition by who order by file_ord, o1, o2, o3, o4
      rows between unbounded preceding and 1 preceding) as earlier_source from y),
firsts as (select who, value, gone, file from z where claim and earlier = 0)
"""


# The same keys where only the order is carried.
PLACE = ["file", "ord.o1", "ord.o2", "ord.o3", "ord.o4"]


def _run(spark, sf, **kw):
    """No query of a run reads details of issues, so the cells that only they show are left out."""
    roster = fx.roster(spark, sf)
    obs = fx.observations(spark).drop("o1", "o2", "o3", "o4")
    obs.createOrReplaceTempView("observations")
    fx.register(spark, sf, "region")
    return reconcile(
        roster, obs, fx.files(spark),
        decisions=dec.Decisions(
            # Measured and looked up in: made once.
            name_decisions=stage(spark.sql(fx.NAME_DECISIONS), "answers"),
            absent_tokens=spark.sql(fx.ABSENT_TOKENS),
            clamp_choices=spark.sql(fx.CLAMP_CHOICES),
        ),
        params=Params(min_value=2, max_value=20),
        # The given tables are files of one row group.
        thin=True,
        details=False,
        **kw,
    )


RESULT = DECIDED + """,
result as (select r.id, r.email, r.first_name, r.last_name, f.value, coalesce(f.gone, false) as is_absent,
    f.file as source, r.ord as roster_ord from roster r left join firsts f on f.who = r.id)
"""


@check("reconcile", RESULT + "select * from result")
def reconcile_all(spark, sf):
    return _run(spark, sf).consolidated


@check("reconcile_shuffled", RESULT + "select * from result")
def reconcile_shuffled(spark, sf):
    """The same with no table small enough to broadcast and every key hot."""
    limits = Limits(broadcast_bytes=0, hot_rows=20)
    return _run(spark, sf, limits=limits).consolidated


@check("first_claim", DECIDED + "select who as member, value, gone as is_absent, file as source from firsts")
def first_claim(spark, sf):
    run = _run(spark, sf)
    names = run.files.select(F.col("file_ord").alias("source_ord"), F.col("file").alias("source"))
    return run.claims.join(names, "source_ord").select("member", "value", "is_absent", "source")


@check(
    "duplicate_claims",
    DECIDED + f"select {KEYS}, who as member, earlier_source from z where who is not null and earlier > 0",
)
def duplicate_claims(spark, sf):
    run = _run(spark, sf)
    names = run.files.select(F.col("file_ord").alias("source_ord"), F.col("file").alias("earlier_source"))
    return (
        run.stated.where("member is not null and is_duplicate")
        .join(names, "source_ord")
        .select(*PLACE, "member", "earlier_source")
    )


REPORT = DECIDED + """,
report as (select f.file_ord, f.file,
    (select count(*) from z where z.file = f.file and who is not null) as matched,
    (select count(*) from firsts where firsts.file = f.file and not gone) as assigned,
    (select count(*) from firsts where firsts.file = f.file and gone) as absent
    from files f)
"""


@check("file_report", REPORT + "select *, matched = 0 as skipped from report")
def file_report(spark, sf):
    return _run(spark, sf).file_report


@check(
    "file_totals",
    REPORT + """select count(case when matched > 0 then 1 end) as files_ok,
    count(case when matched = 0 then 1 end) as files_skipped from report""",
)
def file_totals(spark, sf):
    return report.file_totals(_run(spark, sf).file_report)


@check(
    "totals",
    RESULT + """select count(*) as total,
    count(case when value is not null and not is_absent then 1 end) as valued,
    count(case when is_absent then 1 end) as absent,
    count(case when value is null and not is_absent then 1 end) as none from result""",
)
def totals(spark, sf):
    return _run(spark, sf).totals


@check(
    "unclaimed",
    RESULT + "select id, first_name, last_name, roster_ord from result where value is null and not is_absent",
)
def unclaimed(spark, sf):
    return _run(spark, sf).unclaimed


ISSUES = DECIDED + f""",
issues as (
  select {KEYS}, 'name_mismatch_' || case when same_person then 'confirmed_before'
      when not same_person then 'rejected' else 'proceed' end as code from z where mismatch
  union all select {KEYS}, 'id_unknown_try_name' from z where id_key is not null and hit is null
  union all select {KEYS}, 'name_swapped' from z where tier = 'swapped'
  union all select {KEYS}, 'name_ambiguous' from z where hit is null and n1 > 1
  union all select {KEYS}, 'name_unknown' from z where hit is null and member is null and n1 is null
  union all select {KEYS}, 'duplicate_claim' from z where who is not null and earlier > 0
  union all select {KEYS}, 'value_empty' from z where who is not null and earlier = 0 and blank
  union all select {KEYS}, 'value_unparsed' from z
    where who is not null and earlier = 0 and not blank and not gone and num is null
  union all select {KEYS}, case when clamp_answer then 'clamped_saved'
      when not clamp_answer then 'kept_by_choice' else 'kept_undecided' end from z
    where who is not null and earlier = 0 and direction is not null)
"""
SEVERITY = """case when code in ('name_mismatch_confirmed_before', 'clamped_saved') then 'dim'
  when code in ('name_mismatch_proceed', 'name_swapped', 'value_empty', 'kept_by_choice', 'kept_undecided') then 'info'
  else 'warn' end"""


@check("issues", ISSUES + f"select {KEYS}, code, {SEVERITY} as severity from issues")
def issues(spark, sf):
    return _run(spark, sf).issues.select(
        "file", "ord.o1", "ord.o2", "ord.o3", "ord.o4", "code", "severity"
    )


@check("issues_shuffled", ISSUES + f"select {KEYS}, code, {SEVERITY} as severity from issues")
def issues_shuffled(spark, sf):
    """The same with no table small enough to broadcast and every frequent key salted by its count."""
    limits = Limits(broadcast_bytes=0, hot_rows=20)
    return _run(spark, sf, limits=limits).issues.select(
        "file", "ord.o1", "ord.o2", "ord.o3", "ord.o4", "code", "severity"
    )


@check(
    "issues_full_name",
    BASE + f""",
    told as (
      select {KEYS}, case when id_key is not null then 'id_unknown_try_full' end as by_id,
        case when trim(full_raw) = '' then 'full_missing' when m.n is null then 'full_unknown'
             when m.n > 1 then 'full_ambiguous' end as by_name
      from o1 left join roster r on r.id = id_key
        left join merged m on m.key = full_norm and full_norm <> ''
      where r.id is null)
    select {KEYS}, by_id as code, 'warn' as severity from told where by_id is not null
    union all select {KEYS}, by_name, 'warn' from told where by_name is not null
    """,
)
def issues_full_name(spark, sf):
    """Issues of rows whose sheet has ids and merged names only."""
    roster = fx.roster(spark, sf)
    obs = fx.observations(spark, has_name=False, has_full=True).drop("o1", "o2", "o3", "o4")
    run = reconcile(roster, obs, fx.files(spark), thin=True, details=False)
    told = F.col("code").startswith("full_") | (F.col("code") == "id_unknown_try_full")
    return run.issues.where(told).select("file", "ord.o1", "ord.o2", "ord.o3", "ord.o4", "code", "severity")


@check("issue_counts", ISSUES + "select file, code, count(*) as n from issues group by 1, 2")
def issue_counts(spark, sf):
    return report.issue_counts(_run(spark, sf).issues)


@check(
    "name_decisions",
    DECIDED + f"select {KEYS}, who as member, same_person from z where mismatch",
)
def name_decisions(spark, sf):
    return _run(spark, sf).matched.where("mismatch").select(*PLACE, "member", "same_person")


@check(
    "clamp_decisions",
    DECIDED + f"select {KEYS}, num, direction, clamp_answer, value from z where direction is not null",
)
def clamp_decisions(spark, sf):
    return _run(spark, sf).matched.where("direction is not null").select(
        *PLACE, F.col("parsed_value").alias("num"), "direction", "clamp_answer", "value"
    )


@check(
    "pending_names",
    DECIDED + """
    , asked as (select file, id_key as id, roster_name, f || ' ' || l as seen_name, count(*) as n
      from z where mismatch and same_person is null group by all),
    scored as (select *, levenshtein(roster_name, seen_name) as distance,
      greatest(length(roster_name), length(seen_name)) as longest from asked)
    select file, id, roster_name, seen_name, n, cast(distance as int) as distance,
      case when distance / longest <= 0.15 then 'very similar (likely typo)'
           when distance / longest <= 0.35 then 'somewhat similar'
           else 'very different (possibly wrong student)' end as label
    from scored""",
)
def pending_names(spark, sf):
    return dec.name_questions(_run(spark, sf).matched)


@check(
    "pending_tokens",
    DECIDED + """
    select s as token, count(*) as n from z
    where who is not null and earlier = 0 and not blank and not gone and num is null group by 1""",
)
def pending_tokens(spark, sf):
    return dec.token_questions(_run(spark, sf).stated).select("token", "n")


@check(
    "pending_clamps",
    DECIDED + """
    select file, sheet, direction, count(*) as n, min(num) as lowest, max(num) as highest from z
    where who is not null and earlier = 0 and direction is not null and clamp_answer is null group by all""",
)
def pending_clamps(spark, sf):
    return dec.clamp_questions(_run(spark, sf).stated)


@check(
    "pending_decisions",
    DECIDED + """
    select 'name' as kind, file, '' as sheet, id_key as subject, count(*) as n from z
      where mismatch and same_person is null group by file, id_key, roster_name, f || ' ' || l
    union all select 'token', '', '', s, count(*) from z
      where who is not null and earlier = 0 and not blank and not gone and num is null group by s
    union all select 'clamp', file, sheet, direction, count(*) from z
      where who is not null and earlier = 0 and direction is not null and clamp_answer is null group by all""",
)
def pending_decisions(spark, sf):
    return _run(spark, sf).pending.drop("evidence")


# Every question answered by a rule on the question alone, so that the answers hold
# whatever round asks: ids by their number, one text refused, clamping by file.
REPLAY_OBSERVATIONS = fx.OBSERVATIONS.replace(
    "'15/20'", "case when l_linenumber % 2 = 0 then ' Malade' else '15/20' end"
)
REPLAY_RESULT = (
    RESULT.replace(fx.OBSERVATIONS, REPLAY_OBSERVATIONS)
    .replace(fx.NAME_DECISIONS, """select distinct file, trim(id_raw) as id, try_cast(id_raw as bigint) % 3 <> 0 as answer
      from raw_observations where try_cast(id_raw as bigint) is not null""")
    .replace(fx.CLAMP_CHOICES, """select distinct file, '' as sheet, d as direction, file like '%F' or d = 'below' as answer
      from raw_observations cross join (select unnest(['above', 'below']) as d)""")
    .replace("'NON RENDU')", "'NON RENDU', 'MALADE')")
)


@check("decisions_replay", REPLAY_RESULT + "select *, cast(0 as bigint) as n_open from result")
def decisions_replay(spark, sf):
    """Starts without any answer, answers all that is open and runs again until nothing is."""
    roster = fx.roster(spark, sf)
    obs = fx.observations(spark, sql=REPLAY_OBSERVATIONS)
    rule = (
        F.when(F.col("kind") == "name", F.col("subject").cast("bigint") % 3 != 0)
        .when(F.col("kind") == "token", F.upper("subject").isin("MALADE", "NON RENDU"))
        .otherwise(F.col("file").endswith("F") | (F.col("subject") == "below"))
    )

    lookups = look_up(roster, obs, thin=True)

    def run(decisions):
        return reconcile(
            roster, obs, fx.files(spark), decisions=decisions, params=Params(min_value=2, max_value=20),
            lookups=lookups,
        )

    done = ans.replay(run, ans.no_answers(spark), lambda q: q.withColumn("answer", rule.cast("string")))
    left = done.open.agg(F.count(F.lit(1)).alias("n_open"))
    return done.run.consolidated.crossJoin(F.broadcast(left))
