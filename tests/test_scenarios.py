"""End-to-end runs through configuration snapshots on disk: each step reads the stored
tables, applies one operator and stores the new snapshot for the next."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import NOW, rows
from sluice import schemas as S
from sluice.operators import conform as C
from sluice.operators import eav as EAV
from sluice.operators import load as L
from sluice.operators import mutate as M
from sluice.operators import reads as R
from sluice.sources.tables import read_snapshot, write_snapshot


class Store:
    """The newest snapshot of every configuration table."""

    def __init__(self, spark):
        self.spark, self.paths = spark, C.bootstrap_tables(spark, tempfile.mkdtemp(prefix="sluice-store-"))

    def __getitem__(self, table):
        return read_snapshot(self.spark, self.paths[table], table)

    def put(self, table, df):
        self.paths[table] = write_snapshot(df, self.spark, table)


@pytest.fixture()
def store(spark):
    return Store(spark)


def links(spark, *names, kind="snowflake", auth="basic"):
    req = spark.createDataFrame(
        [(i, n, kind, "logistics", "qa", auth, "ops") for i, n in enumerate(names)],
        "request_seq long, connection_name string, connection_type string, connection_domain_name string, env_type string, auth_type string, created_by string")
    pairs = [F.lit(x) for kv in (("account", "acc-7"), ("warehouse", "wh_small"), ("role", "reader")) for x in kv]
    return req.withColumns({"details": F.create_map(*pairs), "auth": F.create_map(F.lit("username"), F.lit("u7"), F.lit("password"), F.lit("p7"))})


def create(store, requests):
    out = M.composite_create(store["conn_master"], store["connection_details"], store["connection_auth"], requests, NOW)
    refused = rows(out["rejects"])
    for table in ("connection_details", "connection_auth", "conn_master"):  # children before parents
        store.put(table, store[table].unionByName(out[table]))
    return [r["error_code"] for r in refused]


def test_several_connections_then_one_is_deleted(spark, store):
    assert create(store, links(spark, "north", "south")) == []
    assert create(store, links(spark, "east")) == []
    ids = {r["connection_name"]: r["connection_id"] for r in rows(store["conn_master"])}
    assert sorted(ids.values()) == [1, 2, 3]
    gone = spark.createDataFrame([(ids["south"],)], "connection_id long")
    new = M.soft_delete_connections(store["conn_master"], store["connection_details"], store["connection_auth"], gone, NOW, "ops")
    for table, df in new.items():
        store.put(table, df)
    page = rows(EAV.list_connections(store["conn_master"], store["connection_details"], store["connection_auth"], {"env_type": "qa"}, None, 1, 10))
    assert [r["connection_name"] for r in page] == ["east", "north"]
    assert {r["total"] for r in page} == {2}
    assert all(r["details"]["warehouse"] == "wh_small" and r["auth"]["username"] == "u7" for r in page)
    assert store["connection_details"].filter(~F.col("is_active")).count() == 3


def test_names_stay_taken_and_bad_pairs_are_refused(spark, store):
    assert create(store, links(spark, "hub", "hub")) == [S.DUPLICATE_CONNECTION_NAME]
    assert create(store, links(spark, "hub")) == [S.DUPLICATE_CONNECTION_NAME]
    assert create(store, links(spark, "x1", kind="papertape")) == [S.INVALID_CONNECTOR_TYPE]
    assert store["conn_master"].count() == 1


def test_configs_watermarks_and_an_incremental_run(spark, store):
    fields = "request_seq long, connection_source_id long, config_group string, source_attributes string, load_type string, env_type string, watermark_column string, watermark_type string, last_value string"
    req = spark.createDataFrame(
        [(1, 1, "g", '{"schema": "wms", "table": "moves"}', "incremental", "qa", "seen_at", "timestamp", "2024-01-10T00:00:00"),
         (2, 1, "g", '{"schema": "wms", "table": "bins"}', "incremental", "qa", "seen_at", "timestamp", "soon"),
         (3, 1, "g", '{"schema": "wms"}', "incremental", "qa", None, None, None)], fields)
    out = M.create_configs(store["tbl_source_table"], store["tbl_watermark"], req, NOW)
    assert [r["error_code"] for r in rows(out["rejects"])] == [S.INVALID_SOURCE_ATTRIBUTES]
    store.put("tbl_watermark", out["tbl_watermark"])
    store.put("tbl_source_table", store["tbl_source_table"].unionByName(out["tbl_source_table"]))
    source = spark.createDataFrame(
        [(1, "2024-01-09 00:00:00"), (1, "2024-01-11 00:00:00"), (2, "2024-01-11 00:00:00"), (9, "2024-01-05 00:00:00")], "cfg long, t string",
    ).select("cfg", F.col("t").cast("timestamp_ntz").alias("seen_at"))
    state = store["tbl_watermark"]
    good, bad = L.typed_watermarks(state, "timestamp")
    assert good.count() == 1 and [r["last_value"] for r in rows(bad)] == ["soon"]
    got = L.incremental_by_config(source, state, "cfg", "seen_at", upper=L.upper_bound(source, "seen_at"))
    assert sorted((r["cfg"], str(r["seen_at"])) for r in rows(got)) == [(1, "2024-01-11 00:00:00"), (9, "2024-01-05 00:00:00")]
    adv = L.advance_watermark(state, got, "cfg", "seen_at")
    ups = L.watermark_upserts(adv, "seen_at", "timestamp", "run_1", as_text=True)
    done = M.guarded(ups, store["tbl_source_table"], "table_config_id", lambda ok: M.upsert_watermark(state, ok, NOW))
    assert [r["table_config_id"] for r in rows(done["rejects"])] == [9]
    store.put("tbl_watermark", done["state"])
    last = {r["table_config_id"]: r["last_value"] for r in rows(store["tbl_watermark"])}
    assert last == {1: "2024-01-11T00:00:00.000000", 2: "soon"}


def test_first_load_reads_rows_without_a_watermark_value(spark):
    source = spark.createDataFrame([(1, 5), (1, None), (1, 2), (2, None), (2, 4), (3, None), (3, 9), (4, None)], "cfg long, seen long")
    state = spark.createDataFrame([(1, "3"), (2, None)], "table_config_id long, last_value string")
    everything = L.incremental_by_config(source, state, "cfg", "seen", watermark_type="integer")
    bounded = L.incremental_by_config(source, state, "cfg", "seen", watermark_type="integer", upper=L.upper_bound(source, "seen", watermark_type="integer"))
    want = [(1, 5), (2, 4), (2, None), (3, 9), (3, None), (4, None)]
    for got in (everything, bounded):
        assert sorted(((r["cfg"], r["seen"]) for r in rows(got)), key=str) == want
    below = L.incremental_by_config(source, state, "cfg", "seen", watermark_type="integer", upper=F.lit(4))
    assert sorted(((r["cfg"], r["seen"]) for r in rows(below)), key=str) == [(2, 4), (2, None), (3, None), (4, None)]


def test_partitioned_snapshot_round_trip(spark):
    runs = C.conform(spark.createDataFrame([(1, "dev"), (2, "prod")], "table_run_id long, env_type string"), S.TABLES["aud_table_run"])
    path = write_snapshot(runs, spark, "aud_table_run", partition_by=["env_type"])
    back = read_snapshot(spark, path, "aud_table_run")
    assert back.columns == S.column_names("aud_table_run")
    assert [r["table_run_id"] for r in rows(back.filter("env_type = 'prod'"))] == [2]


def test_map_columns_and_missing_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x"}), (1, 2, {"b": "y"}), (2, 1, None)], "k long, seq long, m map<string,string>")
    assert {r["k"]: r["m"] for r in rows(R.latest_per_key(df, "k", "seq"))} == {1: {"b": "y"}, 2: None}
    assert {r["k"]: r["m"] for r in rows(L.latest_by_key(df, ["k"], ["seq"]))} == {1: {"b": "y"}, 2: None}
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        req = links(spark, "a1", "a2").withColumn("details", F.when(F.col("request_seq") == 1, F.col("details")))
        empty = {t: C.empty_table(spark, t) for t in ("conn_master", "connection_details", "connection_auth")}
        out = M.composite_create(*empty.values(), req, NOW)
        assert sorted(r["connection_details_id"] for r in rows(out["connection_details"])) == [1, 2, 3]
        assert sorted(r["connection_auth_id"] for r in rows(out["connection_auth"])) == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
