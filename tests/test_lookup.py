import pytest
from pyspark.sql import functions as F

from rollcall.operators import lookup as lookup_module
from rollcall.operators.claims import first_claims, with_claim_state
from rollcall.operators.decisions import Decisions
from rollcall.operators.lookup import SALTS, Limits, heavy_keys, is_small, joint_key, lookup
from rollcall.operators.match import found_rows, settled_rows
from rollcall.operators.roster import index_roster
from rollcall.plans.reconcile import Params, reconcile
from rollcall.sources.staging import stage

TINY = Limits(broadcast_bytes=0, hot_rows=50, null_spread=7)


@pytest.fixture(scope="module")
def sides(spark):
    # A third of the rows hold one key and a third none.
    left = spark.range(3000).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 100)).alias("key"),
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("unused", 4)], "key string, v int")
    return left, right


def test_salted_lookup_equals_broadcast(sides):
    left, right = sides
    want = sorted(lookup(left, right, "key", spread=F.col("ord"), small=True).collect(), key=str)
    plain = lookup(left, right, "key", spread=F.col("ord"), small=False, limits=TINY)
    hot = heavy_keys(left, {"k": F.col("key")}, TINY).of("k", "key")
    salted = lookup(left, right, "key", spread=F.col("ord"), small=False, hot=hot, limits=TINY)
    assert len(want) == 3000
    for got in (plain, salted):
        rows = got.select("key", "ord", "v").collect()
        assert sorted(rows, key=str) == want


def test_salts_follow_the_counts(sides):
    keys = {"a": F.col("key"), "b": joint_key(F.lit("x"), F.col("key"))}
    heavy = heavy_keys(sides[0], keys, TINY)
    # 1,000 rows of one key, at most 50 in one place; all others have ten rows each.
    assert [(r["key"], r[SALTS]) for r in heavy.of("a", "key").collect()] == [("hot", 20)]
    assert [(r["key"], r[SALTS]) for r in heavy.of("b", "key").collect()] == [("1:x3:hot", 20)]
    assert heavy.of("c", "key").count() == 0
    assert heavy_keys(sides[0], keys, Limits()).of("a", "key").count() == 0
    assert heavy_keys(sides[0], {}, TINY).of("a", "key") is None


def test_five_thousand_hot_keys_are_dealt_evenly(spark):
    # 5,000 keys of 60 rows and one that holds a third of all rows; five rows of a key to a place.
    limits = Limits(broadcast_bytes=0, hot_rows=5)
    left = spark.range(450_000).select(
        F.col("id").alias("ord"), F.when(F.col("id") < 150_000, "hot").otherwise((F.col("id") % 5000).cast("string")).alias("key")
    )
    right = left.select("key").distinct().withColumn("v", F.length("key"))
    hot = heavy_keys(left, {"k": F.col("key")}, limits).of("k", "key")
    assert hot.count() == 5001
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup(left, right, "key", spread=F.col("ord"), small=False, hot=hot, limits=limits)
        rows = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert out.where("v is null").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(rows) == 450_000 and len(rows) == 40
    assert rows[-1] <= 2 * rows[20]


def test_size_is_measured(sides):
    assert is_small(sides[1], Limits())
    assert not is_small(sides[1], TINY)


def test_first_claims_are_a_hash_aggregate_and_exact(spark):
    rows = spark.createDataFrame(
        [
            ("a", None, False, 0, 1), ("a", 5.0, False, 0, 2), ("a", 6.0, False, 1, 3),
            ("b", None, True, 1, 4), ("b", 7.0, False, 1, 5), (None, 9.0, False, 0, 6), ("c", None, False, 0, 7),
        ],
        "member string, value double, is_absent boolean, file_ord int, ord bigint",
    )
    claims = first_claims(rows)
    got = {r.member: (r.value, r.is_absent, r.source_ord, r.first_ord) for r in claims.collect()}
    assert got == {"a": (5.0, False, 0, 2), "b": (None, True, 1, 4)}
    assert "SortAggregate" not in claims._jdf.queryExecution().executedPlan().toString()
    for small in (True, False):
        state = with_claim_state(rows, claims, small=small, limits=TINY)
        assert sorted(r.ord for r in state.where("is_duplicate").collect()) == [3, 5]


def test_only_keys_of_heavy_hashes_are_counted_themselves(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    limits = Limits(broadcast_bytes=0, hot_rows=4000)
    heavy = heavy_keys(rows, {"k": F.col("key")}, limits)
    assert [(r["key"], r[SALTS]) for r in heavy.of("k", "key").collect()] == [("hot", 2)]
    # Neither key is heavy: no table of counts is made, which would shuffle every key.
    few = heavy_keys(rows, {"k": F.col("key")}, Limits(broadcast_bytes=0, hot_rows=6000))
    assert few.of("k", "key").count() == 0
    assert not few.counts.inputFiles()


def test_keys_are_counted_at_once_where_few_rows_make_them_heavy(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lookup_module, "stage", lambda df, name: (written.append((name, df)), stage(df, name))[1])
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 300).cast("string")).alias("key"))
    heavy = heavy_keys(rows, {"a": F.col("key"), "b": F.upper(F.col("key"))}, Limits(broadcast_bytes=0, hot_rows=40))
    got = heavy.of("b", "key").collect()
    assert len(got) == 200 and {r[SALTS] for r in got} == {3}
    # All hashes would be heavy, so they are not counted, and no key is computed within a function of arrays.
    assert [name for name, _ in written] == ["heavy_keys"]
    assert "lambda" not in written[0][1]._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_written_once_where_their_files_are_counted(spark):
    members = spark.createDataFrame(
        [(str(i), f"f{i}", f"l{i}", "", i) for i in range(9)], "id string, first_name string, last_name string, email string, ord bigint"
    )
    obs = spark.createDataFrame(
        [(i % 2, f"file{i % 2}", "", i, str(i % 7), None, None, None, str(i), True, False, False) for i in range(20)],
        "file_ord int, file string, sheet string, ord bigint, id_raw string, first_raw string, last_raw string, full_raw string, "
        "value_raw string, has_id boolean, has_name boolean, has_full boolean",
    )
    run = reconcile(members, obs, limits=Limits(broadcast_bytes=0, hot_rows=2))
    assert not run.files_small
    got = {r.id: (r.value, r.source) for r in run.consolidated.collect()}
    assert got == {str(i): (float(i), f"file{i % 2}") if i < 7 else (None, None) for i in range(9)}
    assert {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in run.consolidated.inputFiles()} == {"members", "claims"}


def test_settled_rows_are_not_shuffled_again(spark):
    roster = index_roster(
        spark.createDataFrame(
            [(str(i), f"f{i}", f"l{i}", "", i) for i in range(50)], "id string, first_name string, last_name string, email string, ord bigint"
        ),
        TINY,
    )
    assert not roster.small
    n = F.col("id").cast("string")
    obs = spark.range(100).select(
        F.lit(0).alias("file_ord"), F.lit("a").alias("file"), F.lit("").alias("sheet"), F.col("id").alias("ord"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 50).otherwise(F.lit(None)).cast("string").alias("id_raw"),
        F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("first_raw"),
        F.when(F.col("id") % 10 == 0, "x").otherwise(F.concat(F.lit("l"), (F.col("id") % 50).cast("string"))).alias("last_raw"),
        F.lit(None).cast("string").alias("full_raw"), n.alias("value_raw"),
        F.lit(True).alias("has_id"), F.lit(True).alias("has_name"), F.lit(False).alias("has_full"),
    )
    answers = spark.createDataFrame([("a", "0", False), ("a", "10", True)], "file string, id string, answer boolean")
    known, others = found_rows(obs, roster, TINY)
    # Half of the rows have a known id; they come from a written table, and only the others meet the names.
    assert known.count() == 50 and others.count() == 50
    assert "Exchange" not in known._jdf.queryExecution().executedPlan().toString()
    got = {r.ord: (r.member, r.tier, r.same_person) for r in settled_rows([known, others], answers, False, TINY).collect()}
    assert len(got) == 100
    for i, row in got.items():
        m = i % 50
        if i % 2:
            want = (str(m), "name", None)
        elif i % 10 == 0 and m in (0, 10):
            want = (None, None, False) if m == 0 else (str(m), "id", True)
        else:
            want = (str(m), "id", None)
        assert row == want, (i, row, want)


def test_settled_rows_are_written_once_and_without_cells_that_nobody_reads(spark):
    members = spark.createDataFrame(
        [(str(i), f"f{i}", f"l{i}", "", i) for i in range(40)],
        "id string, first_name string, last_name string, email string, ord bigint",
    )
    n = F.col("id") % 40
    last = F.when(F.col("id") % 10 == 0, "x").otherwise(F.concat(F.lit("l"), n.cast("string")))
    obs = spark.range(400).select(
        F.lit(0).alias("file_ord"), F.lit("a").alias("file"), F.lit("").alias("sheet"), F.col("id").alias("ord"),
        F.when(F.col("id") % 4 == 1, None).when(F.col("id") % 4 == 2, F.concat(F.lit("X"), n)).otherwise(n.cast("string")).alias("id_raw"),
        F.when(F.col("id") % 3 == 0, last).otherwise(F.concat(F.lit("f"), n)).alias("first_raw"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), n)).otherwise(last).alias("last_raw"),
        F.lit("unread").alias("full_raw"), F.when(F.col("id") % 7 == 0, "?").otherwise((F.col("id") % 25).cast("string")).alias("value_raw"),
        F.lit(True).alias("has_id"), F.lit(True).alias("has_name"), F.lit(False).alias("has_full"),
    )
    answers = spark.createDataFrame([("a", str(i), i % 20 == 0) for i in range(0, 30, 10)], "file string, id string, answer boolean")

    def run(limits=Limits(), **kw):
        done = reconcile(
            members, obs, decisions=Decisions(name_decisions=answers), params=Params(max_value=20), limits=limits, **kw
        )
        told = done.issues.select("ord", "code", "severity", F.col("detail")["value"].alias("v")).collect()
        asked = done.pending.collect()
        return done, sorted(map(str, told)), sorted(map(str, asked)), sorted(map(str, done.consolidated.collect()))

    want = run()
    # Few answers, and more than are broadcast.
    for limits in (Limits(), Limits(broadcast_bytes=300, hot_rows=50)):
        for details in (True, False):
            got = run(limits, roster_small=False, details=details)
            assert got[1:] == want[1:]
            rows = got[0].rows
            files = [f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in rows.inputFiles()]
            assert "id_hits" in files and "matched" in files
            written = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in rows.inputFiles() if "/id_hits-" in f})
            assert details == ("first_raw" in written.columns)
            if not details:
                # Names stay on rows that are compared or looked up by them.
                assert written.where("roster_name is not null and not mismatch and first_norm is not null").isEmpty()
    assert run(details=False)[1:] == want[1:]
