"""Property tests: the skew-safe primitives against brute force (pandas) on random small
fixtures with a hot group, NULL groups and random input partitioning."""

from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.operators import keys as K

GROUPS = st.sampled_from(["hot", "hot", "hot", "a", "b", None])
ROWS = st.lists(st.tuples(GROUPS, st.integers(-50, 50)), min_size=0, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Keep every range partition (no AQE coalescing) so groups really span several tasks
    and the carry-in between slices is exercised."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _frame(spark, data, parts):
    pdf = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(data)], columns=["g", "v", "uid"])
    df = spark.createDataFrame(pdf if len(pdf) else [], "g string, v long, uid long")
    return pdf, df.repartition(parts)


def _key(g):
    return "\x00null" if g is None or (isinstance(g, float) and pd.isna(g)) else g


@SETTINGS
@given(data=ROWS, parts=st.integers(1, 5))
def test_sequence_within_matches_rank(spark, data, parts):
    pdf, df = _frame(spark, data, parts)
    got = {r["uid"]: r["seq"] for r in K.sequence_within(df, ["v", "uid"], ["g"]).collect()}
    if len(pdf):
        pdf["k"] = pdf["g"].map(_key)
        want = pdf.sort_values(["v", "uid"]).groupby("k").cumcount() + 1
        assert got == {int(u): int(want[i]) for i, u in pdf["uid"].items()}
    else:
        assert got == {}


@SETTINGS
@given(data=ROWS, parts=st.integers(1, 5))
def test_running_within_matches_cumulative(spark, data, parts):
    pdf, df = _frame(spark, data, parts)
    s = {r["uid"]: r["running"] for r in K.running_within(df, ["uid"], ["g"], "v", "sum").collect()}
    m = {r["uid"]: r["running"] for r in K.running_within(df, ["uid"], ["g"], "v", "max").collect()}
    if len(pdf):
        pdf["k"] = pdf["g"].map(_key)
        srt = pdf.sort_values("uid")
        want_s = srt.groupby("k")["v"].cumsum()
        want_m = srt.groupby("k")["v"].cummax()
        assert s == {int(srt.loc[i, "uid"]): int(want_s[i]) for i in srt.index}
        assert m == {int(srt.loc[i, "uid"]): int(want_m[i]) for i in srt.index}


@SETTINGS
@given(data=ROWS, parts=st.integers(1, 5))
def test_lag_within_matches_shift(spark, data, parts):
    pdf, df = _frame(spark, data, parts)
    got = {r["uid"]: r["prev_uid"] for r in K.lag_within(df, ["v", "uid"], ["g"], ["uid"]).collect()}
    if len(pdf):
        pdf["k"] = pdf["g"].map(_key)
        srt = pdf.sort_values(["v", "uid"])
        prev = srt.groupby("k")["uid"].shift(1)
        assert got == {int(srt.loc[i, "uid"]): (None if pd.isna(prev[i]) else int(prev[i])) for i in srt.index}


@SETTINGS
@given(data=ROWS, base=st.integers(0, 5))
def test_assign_ids_dense(spark, data, base):
    pdf, df = _frame(spark, data, 3)
    existing = spark.createDataFrame([(base,)], "id long")
    ids = sorted(r["id"] for r in K.assign_sequential_ids(df, existing, "id", ["uid"]).collect())
    assert ids == list(range(base + 1, base + 1 + len(pdf)))


def _sequential_versions(base, reqs):
    """Brute force: apply one request at a time."""
    m, out = base, []
    for e in reqs:
        v = m + 1 if e is None else e
        m = max(m, v)
        out.append(v)
    return out


@SETTINGS
@given(reqs=st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=1, max_size=40), base=st.integers(0, 10))
def test_versions_match_one_by_one(spark, reqs, base):
    import datetime as dt

    from sluice import schemas as S
    from sluice.operators import mutate as M

    seed = dt.datetime(2024, 1, 1)
    st_rows = [(1, 5, base, 1, "{}", "additive", None, "dev", False, "s", seed, "s", seed)] if base else []
    state = spark.createDataFrame(st_rows, S.TABLES["tbl_schema_version"])
    req = spark.createDataFrame([(5, i, e) for i, e in enumerate(reqs)], "table_config_id long, request_seq long, version_number long").repartition(3)
    got = [r["version_number"] for r in M.add_schema_versions(state, req, "2024-02-01 00:00:00").orderBy("version_id").collect()]
    assert got == _sequential_versions(base, reqs)


def test_hot_group_really_spans_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("g"), "id")
    sl = K.ordered_slices(df, ["id"], ["g"])
    assert sl.filter("g = 'hot'").select(K.PID).distinct().count() > 1
    got = K.sequence_within(df, ["id"], ["g"]).filter("g = 'hot'").agg(F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
    assert tuple(got) == (1, 2000, 2000)


KEYED = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 5), st.integers(-3, 3)), max_size=25)


@SETTINGS
@given(target=st.dictionaries(st.integers(0, 8), st.integers(-3, 3), max_size=8), batch=KEYED)
def test_upsert_matches_python_merge(spark, target, batch):
    from sluice.operators import load as L

    t = spark.createDataFrame([(k, 0, v) for k, v in target.items()], "k int, ver int, v int")
    b = spark.createDataFrame(batch, "k int, ver int, v int")
    got = {(r["k"]): (r["ver"], r["v"], r["merge_action"]) for r in L.upsert_by_key(t, b, ["k"], ["ver"]).collect()}
    want = {k: (0, v, "keep") for k, v in target.items()}
    latest = {}
    for k, ver, v in batch:
        if k not in latest or (ver, v) > latest[k]:
            latest[k] = (ver, v)
    for k, (ver, v) in latest.items():
        want[k] = (ver, v, "update" if k in target else "insert")
    assert got == want


@SETTINGS
@given(data=ROWS, parts=st.integers(1, 5))
def test_sequence_prefix_sums(spark, data, parts):
    from pyspark.sql import functions as F

    pdf, df = _frame(spark, data, parts)
    out = K.sequence_within(df, ["uid"], ["g"], sums={"before": F.col("v")}).collect()
    got = {r["uid"]: r["before"] for r in out}
    if len(pdf):
        pdf["k"] = pdf["g"].map(_key)
        srt = pdf.sort_values("uid")
        want = srt.groupby("k")["v"].cumsum() - srt["v"]
        assert got == {int(srt.loc[i, "uid"]): int(want[i]) for i in srt.index}
