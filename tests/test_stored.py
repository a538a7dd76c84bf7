"""Runs that read what an earlier run stored: scan bounds, bucketed targets, published table
sets, split reads, mergeable metrics; and the lifetime of pinned tables."""

from __future__ import annotations

import datetime as dt
import os
import re
import threading
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluice import session as S
from sluice.operators import bucketed as B
from sluice.operators import conform as C
from sluice.operators import keys as K
from sluice.operators import load as L
from sluice.operators import mutate as M
from sluice.operators import publish as PB
from sluice.operators import quality as Q
from sluice.operators import runs as RU
from sluice.schemas import TABLES
from sluice.sources import splits as SP

from conftest import NOW, SF001, rows


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    return text.split("== Initial Plan ==")[0]


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- R02 ----

EVENTS = [(1, 5), (1, 15), (1, 25), (2, 8), (2, 30), (3, 1), (3, None), (4, 99), (None, 7), (5, 40)]
WATERMARKS = [(1, "15"), (2, "20"), (4, "x"), (5, "40")]


def _incremental(spark, tmp_path, marks, **kw):
    path = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(EVENTS, "cfg int, seen long").write.parquet(path)
    wm = spark.createDataFrame(marks, "table_config_id int, last_value string")
    return L.incremental_by_config(spark.read.parquet(path), wm, "cfg", "seen", watermark_type="integer", **kw)


def test_scan_bound_is_a_pushed_literal(spark, tmp_path):
    got = _incremental(spark, tmp_path, WATERMARKS)
    assert as_set(got) == as_set(spark.createDataFrame([(1, 25), (2, 30), (3, 1), (3, None), (None, 7)], "cfg int, seen long"))
    assert "GreaterThan(seen,15)" in plan(got)  # the smallest readable last value


def test_configs_without_a_watermark_are_read_apart(spark, tmp_path):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "table_config_id int")
    got = _incremental(spark, tmp_path, WATERMARKS, configs=ids(1, 2, 3, 4, 5))
    assert as_set(got) == as_set(spark.createDataFrame([(1, 25), (2, 30), (3, 1), (3, None)], "cfg int, seen long"))
    assert plan(got).count("FileScan parquet [cfg") == 2
    closed = _incremental(spark, tmp_path, WATERMARKS, configs=ids(1, 2, 4, 5))
    assert as_set(closed) == [(1, 25), (2, 30)]
    scans = [x for x in plan(closed).splitlines() if "FileScan parquet [cfg" in x]
    assert len(scans) == 1 and "GreaterThan(seen,15)" in scans[0]  # no read of history at all
    assert as_set(_incremental(spark, tmp_path, WATERMARKS, configs=ids(3))) == as_set(spark.createDataFrame([(3, 1), (3, None)], "cfg int, seen long"))


def test_no_watermark_at_all_and_upper(spark, tmp_path):
    assert _incremental(spark, tmp_path, []).count() == len(EVENTS)
    assert _incremental(spark, tmp_path, [(1, None), (2, "20")]).count() == len(EVENTS) - 1
    only_bad = _incremental(spark, tmp_path, [(c, "x") for c in (1, 2, 3, 4, 5)])
    assert as_set(only_bad) == [(None, 7)]
    got = _incremental(spark, tmp_path, WATERMARKS, upper=F.lit(29).cast("long"))
    assert as_set(got) == as_set(spark.createDataFrame([(1, 25), (3, 1), (3, None), (None, 7)], "cfg int, seen long"))


def test_timestamp_bound_keeps_microseconds(spark, tmp_path):
    t = lambda us: dt.datetime(2024, 1, 1, 0, 0, 0, us)
    path = str(tmp_path / "ev")
    spark.createDataFrame([(1, t(1)), (1, t(2)), (1, t(3))], "cfg int, seen timestamp_ntz").write.parquet(path)
    wm = spark.createDataFrame([(1, "2024-01-01T00:00:00.000002")], "table_config_id int, last_value string")
    got = L.incremental_by_config(spark.read.parquet(path), wm, "cfg", "seen")
    assert [r.seen for r in got.collect()] == [t(3)]
    assert "GreaterThan(seen,2024-01-01T00:00:00.000002)" in plan(got)


# ---- R03 ----

def test_extract_is_read_once_and_bounds_the_stored_scan(spark, tmp_path):
    path, stored = str(tmp_path / "src"), str(tmp_path / "stored")
    spark.range(100, 120).selectExpr("id AS k", "concat('v', id) AS v").write.parquet(path)
    src = spark.read.parquet(path)
    spark.range(0, 1000).selectExpr("id AS k", "concat('v', id % 7 * 0 + id) AS v").withColumn("row_hash", L.row_hash(["k", "v"])).write.parquet(stored)
    out = L.hash_changes(src.withColumn("v", F.when(F.col("k") == 105, "new").otherwise(F.col("v"))), spark.read.parquet(stored), ["k"], ["k", "v"])
    assert [(r.k, r.change_kind) for r in out.collect()] == [(105, "changed")]
    text = plan(out)
    assert path not in text  # only what was written of the extract
    assert "GreaterThanOrEqual(k,100)" in text and "LessThanOrEqual(k,119)" in text


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(9,2)", "double", "binary"])
def test_key_range_of_every_type(spark, kind):
    df = spark.range(10, 30).select(F.lit("2024-01-01").cast("date").alias("d"), "id")
    key = {"string": F.col("id").cast("string"), "date": F.date_add("d", F.col("id").cast("int")), "binary": F.col("id").cast("string").cast("binary")}.get(
        kind, F.date_add("d", F.col("id").cast("int")).cast(kind) if kind.startswith("timestamp") else (F.col("id") / 7).cast(kind))
    df = df.select(key.alias("k"))
    assert df.filter(L.key_range(df, "k")).count() == 20
    half = df.limit(0)
    assert df.filter(L.key_range(half, "k")).count() == (20 if kind == "binary" else 0)
    if kind != "binary":
        with_null = df.unionByName(spark.range(1).select(F.lit(None).cast(kind).alias("k")))
        assert with_null.filter(L.key_range(with_null, "k")).count() == 21


# ---- R05 / R06 on buckets ----

def _name():
    return f"t_{uuid.uuid4().hex[:10]}"


def test_second_upsert_leaves_the_target_in_its_buckets(spark, tmp_path):
    make = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id AS k", f"{v} AS seq", f"concat('v{v}_', id) AS v")
    name, root = _name(), str(tmp_path)
    B.load_bucketed(spark, name, root, "v0", make(0, 500, 0), ["k"], ["seq"], 8)
    B.apply_upsert(spark, name, root, "v1", make(400, 600, 1), ["k"], ["seq"], 8)
    batch = make(300, 450, 2).unionByName(make(590, 610, 2))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a batch that is not small
    try:
        out = B.upsert_bucketed(spark.table(name), batch, ["k"], ["seq"])
        text = final_plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    want = {k: (0 if k < 400 else 1) for k in range(600)} | dict.fromkeys([*range(300, 450), *range(590, 610)], 2)
    assert {r.k: r.seq for r in out.collect()} == want
    assert {r.merge_action for r in out.filter("k >= 600").collect()} == {"insert"}
    # every scan of the target is bucketed, and the first node with children above it that
    # moves rows is the join itself: no exchange stands on the target's side
    final = text
    assert "Bucketed: true" in final or "bucketed" in final.lower()
    assert _exchanges_over(final, f"{name}_v1") == 0


def _exchanges_over(text: str, table: str, to_root_of: str | None = None) -> int:
    """Exchanges on the path from the scans of ``table`` up to their first join; with
    ``to_root_of``, on the whole path of the scans that read this column."""
    lines = [x for x in text.splitlines() if re.search(r"[+:]- |^\S", x)]
    depth = lambda x: len(re.match(r"[ :]*(?:[+:]- )?", x).group(0))
    found = 0
    for i, line in enumerate(lines):
        if table in line and "FileScan" in line and (to_root_of is None or f"{to_root_of}#" in line):
            level = depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < level:
                    level = depth(up)
                    if "Join" in up and to_root_of is None:
                        break
                    found += "Exchange" in up and "ReusedExchange" not in up
    return found


def test_a_bucketed_state_is_written_without_dealing_the_target(spark, tmp_path):
    def make(ids, seq):
        return spark.createDataFrame([(k, seq, f"{k}-{seq}") for k in ids], "k int, seq int, v string")

    name, root, n = _name(), str(tmp_path), 8
    first = make([*range(300), None], 0)
    B.load_bucketed(spark, name, root, "v0", first, ["k"], ["seq"], n)
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(B.new_state(spark.table(name), make(range(250, 350), 1), ["k"], ["seq"], n))
        assert "FileScan" in text and f"{name}_v0" in text
        assert _exchanges_over(text, f"{name}_v0", to_root_of="v") == 0
        want = first
        for v, ids in enumerate(([*range(250, 350)], [*range(340, 400), None], [5, None], []), 1):
            batch = make(ids, v)
            want = L.upsert_by_key(want, batch, ["k"], ["seq"]).drop("merge_action")
            got = B.apply_upsert(spark, name, root, f"v{v}", batch, ["k"], ["seq"], n)
            assert as_set(got) == as_set(want), v
            files = [f for f in os.listdir(f"{root}/{name}/version=v{v}") if f.endswith(".parquet")]
            assert len(files) <= 2 * n + 2, v
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_bucketed_forms_equal_the_plain_ones(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "a"), (None, 1, "n"), (2, 1, "b"), (3, 1, "c")], "k int, seq int, v string")
    name = _name()
    B.save_bucketed(t, name, str(tmp_path / "t"), ["k"], 8)
    batches = {
        "plain": [(2, 2, "B"), (2, 3, "BB"), (9, 2, "new")], "nulls": [(None, 2, "N"), (3, 2, "C")], "empty": [], "only null": [(None, 5, "N")]}
    for what, data in batches.items():
        b = spark.createDataFrame(data, "k int, seq int, v string")
        assert as_set(B.upsert_bucketed(spark.table(name), b, ["k"], ["seq"])) == as_set(L.upsert_by_key(t, b, ["k"], ["seq"])), what
    state = t.select("k", "v", F.lit(True).alias("is_active"), F.col("seq").cast("long").alias("last_seq"))
    B.save_bucketed(state, name + "_c", str(tmp_path / "c"), ["k"], 8)
    changes = spark.createDataFrame([(2, 5, "D", None), (None, 6, "U", "N"), (7, 7, "I", "new"), (1, 1, "U", "old news")], "k int, seq long, op string, v string")
    assert as_set(B.cdc_bucketed(spark.table(name + "_c"), changes, ["k"], "seq", "op", ["v"])) == as_set(
        L.cdc_apply(state, changes, ["k"], "seq", "op", ["v"]))


def test_a_version_is_never_overwritten(spark, tmp_path):
    one = spark.createDataFrame([(1, 1)], "k int, seq int")
    name, root = _name(), str(tmp_path)
    B.load_bucketed(spark, name, root, "v0", one, ["k"], ["seq"], 8)
    with pytest.raises(AnalysisException):
        B.apply_upsert(spark, name, root, "v0", one, ["k"], ["seq"], 8)
    assert spark.table(name).count() == 1


def test_merge_condition_matches_nulls(spark):
    src = spark.createDataFrame([(1, None)], "a int, b int")
    text = str(L.merge_condition("t", src, ["a", "b"]))
    assert text.count("<=>") == 2 and "t.a" in text and "t.b" in text


# ---- publishing ----

class Boom(Exception):
    pass


def test_a_failure_between_two_tables_leaves_readers_on_the_old_set(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    assert PB.read_published(spark, root) == {}
    a, b = (spark.createDataFrame([(x, 1)], "name string, v int") for x in "ab")
    assert PB.publish(spark, root, {"a": a, "b": b}) == 1
    fails = spark.range(4).select(F.lit("b").alias("name"), F.raise_error(F.lit("boom")).cast("int").alias("v"))
    with pytest.raises(Exception, match="boom"):  # a is written, b is not
        PB.publish(spark, root, {"a": a.withColumn("v", F.lit(2)), "b": fails})
    assert len(os.listdir(f"{root}/a")) == 2
    seen = lambda: {n: df.first().v for n, df in PB.read_published(spark, root).items()}
    assert seen() == {"a": 1, "b": 1}
    before = PB.read_published(spark, root)
    assert PB.publish(spark, root, {"a": a.withColumn("v", F.lit(3)), "b": b.withColumn("v", F.lit(3))}) == 2
    assert seen() == {"a": 3, "b": 3}
    assert {n: df.first().v for n, df in before.items()} == {"a": 1, "b": 1}  # who read before keeps the set
    assert PB.publish(spark, root, {"b": b.withColumn("v", F.lit(4))}) == 3
    assert seen() == {"a": 3, "b": 4}


def test_a_cut_off_manifest_does_not_count(spark, tmp_path):
    root = str(tmp_path / "set")
    PB.publish(spark, root, {"a": spark.createDataFrame([(1,)], "v int"), "e": spark.createDataFrame([], "v int")})
    row = [(2, "a", "/nowhere", "{}", 2)]  # one row of two
    spark.createDataFrame(row, PB.MANIFEST).write.parquet(f"{root}/_manifests/publication=2")
    assert {n: df.count() for n, df in PB.read_published(spark, root).items()} == {"a": 1, "e": 0}


# ---- R10 ----

PG = {"connection_type": "postgres", "details": {"host": "h", "port": "5432", "database": "d"}, "auth": {"username": "u", "password": "p"}}


def test_statistics_and_split_specs():
    spec = SP.statistics_spec(PG, {"schema": "sales", "table": "orders"}, "o_date")
    assert spec["format"] == "jdbc" and "pg_stats" in spec["options"]["query"] and "'o_date'" in spec["options"]["query"]
    assert spec["options"]["url"] == "jdbc:postgresql://h:5432/d" and "dbtable" not in spec["options"]
    assert "schemaname = 'public'" in SP.statistics_spec(PG, {"table": "orders"}, "k")["options"]["query"]
    points = [dt.date(2024, 1, 1), dt.date(2024, 3, 1)]
    split = SP.split_spec(PG, {"schema": "sales", "table": "orders"}, "o_date", points)
    assert split["options"]["dbtable"] == "sales.orders" and "partitionColumn" not in split["options"]
    assert split["predicates"] == [
        "o_date < DATE '2024-01-01' OR o_date IS NULL", "o_date >= DATE '2024-01-01' AND o_date < DATE '2024-03-01'", "o_date >= DATE '2024-03-01'"]
    for bad in ({"table": "t; drop"}, {"query": "select 1"}, {"schema": "a'b", "table": "t"}):
        with pytest.raises(ValueError):
            SP.statistics_spec(PG, bad, "k")
    with pytest.raises(ValueError):
        SP.statistics_spec({**PG, "connection_type": "mysql"}, {"table": "t"}, "k")
    with pytest.raises(ValueError):
        SP.split_spec({"connection_type": "local", "details": {"base_path": "/x"}}, {"file_path": "t"}, "k", [1])


def test_bounds_and_points():
    assert SP.parse_bounds('{a,"b, c",d\\"e}') == ["a", "b, c", 'd\\"e'] or SP.parse_bounds('{a,"b, c"}') == ["a", "b, c"]
    assert SP.parse_bounds('{1,5,9}') == ["1", "5", "9"] and SP.parse_bounds(None) == [] and SP.parse_bounds("x") == []
    assert SP.split_points(list(range(101)), 5) == [20, 40, 60, 80]
    assert SP.split_points([0, 1], 4) == [] and SP.split_points([], 4) == [] and SP.split_points([0, 5, 5, 5, 9], 4) == [5]
    assert SP.split_predicates("k", []) == ["1 = 1"]
    assert SP.split_predicates("k", ["it's"])[1] == "k >= 'it''s'"


@pytest.mark.parametrize("points", [[], [3], [3, 7], [-5, 0, 100], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]])
def test_predicates_cover_every_row_once(spark, points):
    df = spark.range(10).select(F.when(F.col("id") % 4 != 1, F.col("id")).alias("k"))
    parts = SP.split_predicates("k", points)
    assert sum(df.filter(p).count() for p in parts) == 10
    hits = df.select(sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in parts), F.lit(0)).alias("n"))
    assert {r.n for r in hits.collect()} == {1}


# ---- R19 ----

def test_merged_sketches_near_the_exact_quantile(spark):
    runs = spark.range(30_000).selectExpr(
        "id AS table_run_id", "id % 3 AS table_config_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 20 AS int)) AS start_time",
        "cast((id * 7919) % 10007 AS bigint) AS elapsed_seconds", "'succeeded' AS status", "true AS is_active")
    days = RU.metric_sketches(runs)
    assert days.count() == 60
    exact = runs.groupBy("table_config_id").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY elapsed_seconds)").alias(n) for p, n in (
        (0.95 - RU.sketch_error(), "low"), (0.95 + RU.sketch_error(), "high"))])
    got = RU.merged_metrics(days).join(exact, "table_config_id").collect()
    assert len(got) == 3 and all(r.low <= r.p_elapsed <= r.high and r.runs == 10_000 for r in got)
    half = RU.merged_metrics(days.filter("day < '2024-01-11'")).agg(F.sum("runs")).first()[0]
    assert half == 15_000
    assert RU.merged_metrics(days, by=None).first().timed == 30_000


def test_small_groups_are_exact_and_open_runs_count(spark):
    t = dt.datetime(2024, 1, 1)
    rs = [(1, t, t + dt.timedelta(seconds=s), "succeeded", True) for s in range(1, 101)] + [(1, t, None, "running", True), (2, t, None, "running", True), (1, t, t, "failed", False)]
    runs = spark.createDataFrame(rs, "table_config_id int, start_time timestamp_ntz, end_time timestamp_ntz, status string, is_active boolean")
    got = {r.table_config_id: r for r in RU.merged_metrics(RU.metric_sketches(runs)).collect()}
    assert (got[1].runs, got[1].timed, got[1].p_elapsed, got[1].avg_elapsed) == (101, 100, 95, 50.5)
    assert (got[2].runs, got[2].timed, got[2].p_elapsed, got[2].avg_elapsed) == (1, 0, None, None)


# ---- R20, D34: one layout ----

def test_lag_joins_no_table_to_itself(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN id % 5 ELSE 0 END AS g", "id * 37 % 2003 AS t").repartition(7)
    with S.job_scope(spark) as pins:
        out = K.lag_within(df, ["t"], ["g"], ["id", "t"])
        got = {r.id: (r.prev_id, r.prev_t) for r in out.collect()}
        assert len(pins) == 1
        text = plan(out)
        joins = [x for x in text.splitlines() if "Join" in x]
        assert len(joins) == 1  # rows with one row per slice
    order, last = sorted(df.collect(), key=lambda r: (r.g, r.t)), {}
    for r in order:
        assert got[r.id] == last.get(r.g, (None, None))
        last[r.g] = (r.id, r.t)


def test_versions_take_one_sort_and_one_pin(spark):
    state = C.conform(spark.createDataFrame([(5, 1, 3), (6, 2, 1)], "version_id long, table_config_id long, version_number long"), TABLES["tbl_schema_version"])
    reqs = spark.range(300).selectExpr("id AS request_seq", "id % 4 % 3 + 1 AS table_config_id", "'additive' AS change_type",
                                       "CASE WHEN id % 50 = 7 THEN id ELSE NULL END AS version_number").repartition(5)
    with S.job_scope(spark) as pins:
        out = M.add_schema_versions(state, reqs, NOW)
        got = {r.version_id: r for r in out.collect()}
        assert len(pins) == 1
    top, asked = {1: 3, 2: 1, 3: 0}, sorted(reqs.collect(), key=lambda r: r.request_seq)
    for i, r in enumerate(asked):
        number = r.version_number if r.version_number is not None else top[r.table_config_id] + 1
        top[r.table_config_id] = max(top[r.table_config_id], number)
        assert (got[7 + i].table_config_id, got[7 + i].version_number) == (r.table_config_id, number), i


# ---- pins, sessions, existence ----

def test_scopes_of_threads_keep_their_pins_apart(spark):
    made, errors, gate = {}, [], threading.Barrier(2)

    def job(n):
        try:
            with S.job_scope(spark):
                df = S.pin(spark.range(n), "apart")
                made[n] = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
                gate.wait(timeout=60)
                if n == 10:
                    return  # this scope ends first
            # never reached for 10
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def holder(n):
        try:
            with S.job_scope(spark):
                df = S.pin(spark.range(n), "apart")
                gate.wait(timeout=60)
                first.join(timeout=60)
                assert df.count() == n  # the other scope's end did not touch this pin
                made[n] = True
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    first, second = threading.Thread(target=job, args=(10,)), threading.Thread(target=holder, args=(20,))
    second.start(), first.start()
    first.join(), second.join()
    assert errors == [] and made[20] and not os.path.exists(made[10])


def test_pin_result_leaves_the_result_only(spark):
    with S.job_scope(spark) as outer:
        inner = []

        def build():
            a = S.pin(spark.range(5), "step")
            inner.append(a.inputFiles()[0])
            return a.withColumn("x", F.lit(None))

        df = S.pin_result(spark, build)
        assert df.count() == 5 and df.columns == ["id", "x"] and len(outer) == 1
        assert not os.path.exists(inner[0].replace("file://", ""))
    assert not os.path.exists(outer[0].replace("file:", ""))


def test_rules_do_not_touch_the_session(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    seen, stop = set(), threading.Event()

    def watch():
        while not stop.is_set():
            seen.add(spark.conf.get("spark.sql.ansi.enabled"))

    before = spark.conf.get("spark.sql.ansi.enabled")
    t = threading.Thread(target=watch)
    t.start()
    try:
        out = Q.evaluate_rules(df, [{"rule_name": "n", "expression": "CAST(v AS INT) > 0"}])
        stats = Q.rule_stats(df, [{"rule_name": "n", "expression": "CAST(v AS INT) > 0"}])
    finally:
        stop.set()
        t.join()
    assert sorted(len(r.failed_rules) for r in out.collect()) == [0, 1] and stats.first().failed == 1
    assert seen == {before} and out.sparkSession is spark
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(F.col("v").cast("int")).collect()


def test_existence_runs_no_job(spark, tmp_path):
    root = str(tmp_path / "boot")
    assert not C.path_exists(spark, root)
    paths = C.bootstrap_tables(spark, root)
    assert set(paths) == set(TABLES) and all(C.path_exists(spark, p) for p in paths.values())
    spark.createDataFrame([(7,)], "connection_id long").write.mode("overwrite").parquet(paths["conn_master"])
    assert C.bootstrap_tables(spark, root) == paths
    assert spark.read.parquet(paths["conn_master"]).count() == 1  # left as it was
    with pytest.raises(Exception, match="nosuchscheme"):
        C.path_exists(spark, "nosuchscheme://x/y")


def test_stored_queries_on_the_smallest_tables(spark):
    from sluice.plans.stored import STORED

    for name in ("incremental_configured", "published_create", "bts_update", "source_splits"):
        with S.job_scope(spark):
            assert rows(STORED[name][0](spark, SF001)), name


@pytest.mark.parametrize("values", [
    [3.5], [2.0, 2.0, 2.0], [None, 7.0, None, 1.0], [float(i % 7) for i in range(50)], [-0.0, 0.0, float("nan"), 5.0, float("-inf")],
    [((i * 7919) % 1009) / 4 for i in range(1009)], [1.0] * 500 + [2.0, 3.0]])
def test_histogram_bounds_as_percentile_disc(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    want = df.agg(*[F.expr(f"percentile_disc({k / 16}) WITHIN GROUP (ORDER BY v)").alias(f"b{k}") for k in range(17)]).first()
    got = SP.histogram_bounds(df, "v", 16)
    assert len(got) == 17 and all(a == b or (a != a and b != b) for a, b in zip(got, want, strict=True))


def test_histogram_bounds_of_no_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert SP.histogram_bounds(df, "v", 16) == [] == SP.histogram_bounds(df.limit(0), "v", 16)
    assert SP.split_predicates("v", SP.split_points([], 8)) == ["1 = 1"]


def test_source_splits_keeps_no_column_in_one_task(spark, tmp_path, monkeypatch):
    """The values are placed by several tasks; percentile_disc held them all in one."""
    from sluice.plans.stored import source_splits

    n, shares = 20_000, []
    spark.range(n).selectExpr("CAST(id * 7919 % 20011 AS DOUBLE) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))

    def watched(*args, **kw):
        out = sequence_within(*args, **kw)
        shares.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) / n)
        return out

    sequence_within = SP.sequence_within
    monkeypatch.setattr(SP, "sequence_within", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.split, r.n_rows) for r in source_splits(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 1 and shares[0] < 0.6
    assert [s for s, _ in got] == list(range(8)) and sum(k for _, k in got) == n and all(abs(k - n / 8) <= 1 for _, k in got)
