"""Keys (D12, D13, positions) and reads (D01, D06-D11) on tiny literal tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sluice.operators import keys as K
from sluice.operators import reads as R


def test_sequence_within_groups_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", 3), ("a", 1), ("b", 2), (None, 5), ("a", 2), (None, 4)], "g string, v int"
    ).repartition(3)
    out = rows(K.sequence_within(df, ["v"], ["g"]), ["g", "v"])
    got = {(r["g"], r["v"]): r["seq"] for r in out}
    assert got == {(None, 4): 1, (None, 5): 2, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 2): 1}


def test_sequence_within_hot_group_spread_over_tasks(spark):
    # one group holds most rows; numbering must still be dense 1..n
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("g"), "id")
    out = K.sequence_within(df.repartition(8), ["id"], ["g"])
    hot = out.filter("g = 'hot'").agg(F.min("seq"), F.max("seq"), F.count("*"), F.countDistinct("seq")).first()
    assert tuple(hot) == (1, 4500, 4500, 4500)


def test_assign_ids_dense_from_max(spark):
    existing = spark.createDataFrame([(7,), (3,)], "id long")
    new = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3)], "name string, o int")
    out = rows(K.assign_sequential_ids(new, existing, "id", ["o"]), ["id"])
    assert [(r["name"], r["id"]) for r in out] == [("y", 8), ("x", 9), ("z", 10)]


def test_assign_ids_empty_table_starts_at_one(spark):
    existing = spark.createDataFrame([], "id long")
    new = spark.createDataFrame([("x", 1)], "name string, o int")
    assert rows(K.assign_sequential_ids(new, existing, "id", ["o"]))[0]["id"] == 1


def test_time_ids_repeatable(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0, 1500), 5)], "ts timestamp_ntz, s long")
    v = rows(K.time_ordered_ids(df, "ts", "s"))[0]["snowflake_id"]
    millis = 1704067200001
    assert v == (millis << 22) | 5


def test_running_within(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 4, 1, 5])] + [("b", 0, 2)], "g string, t int, v int").repartition(3)
    s = {(r["g"], r["t"]): r["running"] for r in rows(K.running_within(df, ["t"], ["g"], "v", "sum"))}
    assert [s[("a", i)] for i in range(5)] == [3, 4, 8, 9, 14] and s[("b", 0)] == 2
    m = {(r["g"], r["t"]): r["running"] for r in rows(K.running_within(df, ["t"], ["g"], "v", "max"))}
    assert [m[("a", i)] for i in range(5)] == [3, 3, 4, 4, 5]


def test_lag_within(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30), ("a", 3, 40)], "g string, t int, v int")
    out = rows(K.lag_within(df, ["t"], ["g"], ["v"]), ["g", "t"])
    assert [r["prev_v"] for r in out] == [None, 10, 20, None]


@pytest.fixture()
def conns(spark):
    return spark.createDataFrame(
        [
            (1, "Sales_DB", "fin", "dev", 1, 0),
            (2, "ops 100%", "Ops", "prod", 1, 1),
            (3, "it's \\ raw", "fin", "dev", 0, 0),
            (4, "other", "SALES", "dev", 1, 1),
        ],
        "connection_id long, connection_name string, connection_domain_name string, env_type string, is_active int, is_target int",
    )


def test_active_with_int_flag(conns):
    assert [r["connection_id"] for r in rows(R.active(conns), ["connection_id"])] == [1, 2, 4]
    assert [r["connection_id"] for r in rows(R.active(conns, False))] == [3]
    assert R.active(conns, None).count() == 4


def test_all_inactive_and_empty(spark, conns):
    assert R.active(conns.withColumn("is_active", F.lit(0))).count() == 0
    assert R.active(conns.limit(0)).count() == 0


def test_equality_filters_truthiness(conns):
    same = R.equality_filters(conns, {"env_type": "", "connection_id": 0, "is_target": None})
    assert same.count() == 4
    dev_targets = R.equality_filters(conns, {"env_type": "dev", "is_target": 1})
    assert [r["connection_id"] for r in rows(dev_targets)] == [4]
    not_target = R.equality_filters(conns, {"is_target": 0})
    assert sorted(r["connection_id"] for r in rows(not_target)) == [1, 3]


def test_search_is_literal_and_case_insensitive(conns):
    assert [r["connection_id"] for r in rows(R.search(conns, "sales", ["connection_name", "connection_domain_name"]), ["connection_id"])] == [1, 4]
    assert [r["connection_id"] for r in rows(R.search(conns, "0%", ["connection_name"]))] == [2]
    assert [r["connection_id"] for r in rows(R.search(conns, "'s \\", ["connection_name"]))] == [3]
    assert R.search(conns, "%", ["connection_name"]).count() == 1


def test_lookup_active_absent_id(spark, conns):
    ids = spark.createDataFrame([(1,), (3,), (99,)], "connection_id long")
    assert [r["connection_id"] for r in rows(R.lookup_active(conns, ids, "connection_id"))] == [1]


def test_page_and_meta(spark):
    df = spark.range(1, 46).withColumnRenamed("id", "pk")
    p2 = R.page(df, 2, 20, "pk")
    assert [r["pk"] for r in rows(p2, [F.col("pk").desc()])] == list(range(25, 5, -1))
    meta = rows(R.with_page_meta(R.page(df, 3, 20, "pk"), df, 20))
    assert [m["pk"] for m in meta] == [5, 4, 3, 2, 1] and meta[0]["total"] == 45 and meta[0]["total_pages"] == 3
    assert R.page(df, 4, 20, "pk").count() == 0
    assert rows(R.page_meta(df, 20))[0] == {"total": 45, "total_pages": 3}
    with pytest.raises(ValueError):
        R.page(df, 1, 201, "pk")
    with pytest.raises(ValueError):
        R.page(df, 0, 20, "pk")


def test_pages_concatenate_to_whole_table(spark):
    df = spark.range(1, 38).withColumnRenamed("id", "pk")
    seen = []
    for p in range(1, 5):
        seen += [r["pk"] for r in R.page(df, p, 10, "pk").collect()]
    assert sorted(seen) == list(range(1, 38))
    assert [r["pk"] for r in R.keyset_page(df, "pk", 30, 5).collect()] == [29, 28, 27, 26, 25]


def test_latest_per_key_skips_inactive(spark):
    wm = spark.createDataFrame(
        [(1, 10, "a", True), (2, 10, "b", True), (3, 10, "c", False), (4, 11, "d", True)],
        "watermark_id long, table_config_id long, last_value string, is_active boolean",
    )
    out = {r["table_config_id"]: r["last_value"] for r in rows(R.latest_per_key(wm, "table_config_id", "watermark_id"))}
    assert out == {10: "b", 11: "d"}


def test_child_history_order(spark):
    pii = spark.createDataFrame([(1, 5, True), (2, 5, True), (3, 5, False), (4, 6, True)], "pii_id long, table_config_id long, is_active boolean")
    out = rows(R.child_history(pii, "table_config_id", "pii_id"), ["table_config_id", "position"])
    assert [(r["table_config_id"], r["pii_id"], r["position"]) for r in out] == [(5, 2, 1), (5, 1, 2), (6, 4, 1)]


def test_positions_on_empty_input(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert K.sequence_within(empty, ["v"], ["g"]).count() == 0
    assert K.assign_sequential_ids(empty, spark.createDataFrame([(3,)], "id long"), "id", ["v"]).count() == 0
    assert K.running_within(empty, ["v"], ["g"], "v").count() == 0
