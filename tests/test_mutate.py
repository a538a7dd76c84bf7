"""Mutations D27-D37 and their invariants: row counts kept, upsert twice = once, dense ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import NOW, NOW_DT, rows
from sluice import schemas as S
from sluice.operators import conform as C
from sluice.operators import mutate as M

SEED = dt.datetime(2024, 1, 1)


def _state(spark):
    return spark.createDataFrame(
        [(1, "g1", "full", True, "seed", SEED), (2, "g2", "full", True, "seed", SEED), (3, "g3", "cdc", False, "seed", SEED)],
        "table_config_id long, config_group string, load_type string, is_active boolean, updated_by string, updated_at timestamp_ntz",
    )


def test_patch_keeps_nulls_and_orders_requests(spark):
    ch = spark.createDataFrame(
        [(1, 10, "a", None, "alice"), (1, 11, None, "incremental", None), (3, 12, "zzz", None, "bob"), (9, 13, "x", None, "eve")],
        "table_config_id long, request_seq long, config_group string, load_type string, updated_by string",
    )
    out = {r["table_config_id"]: r for r in rows(M.patch_update(_state(spark), ch, "table_config_id", ["config_group", "load_type"], NOW))}
    assert len(out) == 3
    assert (out[1]["config_group"], out[1]["load_type"], out[1]["updated_by"]) == ("a", "incremental", "system")
    assert out[1]["updated_at"] == NOW_DT
    assert (out[2]["config_group"], out[2]["updated_by"]) == ("g2", "seed")
    assert (out[3]["config_group"], out[3]["updated_by"]) == ("g3", "seed")  # inactive rows are not patched


def test_overwrite_writes_nulls(spark):
    ch = spark.createDataFrame([(2, 1, None, "cdc"), (2, 2, "new", None)], "table_config_id long, request_seq long, config_group string, load_type string")
    out = {r["table_config_id"]: r for r in rows(M.overwrite_update(_state(spark), ch, "table_config_id", ["config_group", "load_type"], NOW))}
    assert (out[2]["config_group"], out[2]["load_type"]) == ("new", None)


def test_soft_delete_keeps_rows(spark):
    st = _state(spark)
    ids = spark.createDataFrame([(2,), (2,), (3,), (77,)], "table_config_id long")
    out = M.soft_delete(st, ids, "table_config_id", NOW, "ann")
    assert out.count() == st.count()
    got = {r["table_config_id"]: (r["is_active"], r["updated_by"]) for r in rows(out)}
    assert got == {1: (True, "seed"), 2: (False, "ann"), 3: (False, "seed")}


def test_cascade(spark):
    st = _state(spark)
    wm = spark.createDataFrame([(1, 1, True, "seed", SEED), (2, 3, True, "seed", SEED)], "watermark_id long, table_config_id long, is_active boolean, updated_by string, updated_at timestamp_ntz")
    bts = spark.createDataFrame([(1, 1, True, "seed", SEED), (2, None, True, "seed", SEED)], "bts_config_id long, source_config_id long, is_active boolean, updated_by string, updated_at timestamp_ntz")
    ids = spark.createDataFrame([(1,), (3,)], "table_config_id long")
    out = M.cascade_soft_delete(st, {"tbl_watermark": (wm, "table_config_id"), "bts_config": (bts, "source_config_id")}, ids, NOW, "x")
    assert {r["table_config_id"]: r["is_active"] for r in rows(out["tbl_source_table"])} == {1: False, 2: True, 3: False}
    # config 3 was already inactive: its children are not touched
    assert {r["watermark_id"]: r["is_active"] for r in rows(out["tbl_watermark"])} == {1: False, 2: True}
    assert {r["bts_config_id"]: r["is_active"] for r in rows(out["bts_config"])} == {1: False, 2: True}


def test_replace_children_restarts_property_ids(spark):
    st = spark.createDataFrame(
        [(1, 10, 1, "host", "a", True, "s", SEED, "s", SEED), (2, 11, 1, "host", "b", True, "s", SEED, "s", SEED)],
        "d_id long, cid long, pid long, k string, v string, is_active boolean, created_by string, created_at timestamp_ntz, updated_by string, updated_at timestamp_ntz",
    )
    parents = spark.createDataFrame([(10,), (12,)], "cid long")
    new = spark.createDataFrame([(10, 1, "host", "z"), (10, 2, "port", "1")], "cid long, pid long, k string, v string")
    out = rows(M.replace_children(st, parents, new, "cid", "d_id", ["cid", "pid"], NOW, "r"), ["d_id"])
    assert [(r["d_id"], r["cid"], r["pid"], r["is_active"]) for r in out] == [
        (1, 10, 1, False), (2, 11, 1, True), (3, 10, 1, True), (4, 10, 2, True)]


def _wm_state(spark):
    wm = spark.createDataFrame(
        [(5, 1, "ts", "timestamp", "2024-01-01", "r1", "dev", True, "s", SEED, "s", SEED),
         (6, 1, "ts", "timestamp", "2024-01-02", "r2", "dev", True, "s", SEED, "s", SEED)],
        S.TABLES["tbl_watermark"],
    )
    return wm


def test_upsert_watermark_update_and_insert(spark):
    ups = spark.createDataFrame(
        [(1, 1, "ts", "timestamp", "2024-02-01", None, "u"), (2, 2, "id", "integer", "40", "r9", None)],
        "table_config_id long, request_seq long, watermark_column string, watermark_type string, last_value string, last_run_id string, updated_by string",
    )
    out = {r["watermark_id"]: r for r in rows(M.upsert_watermark(_wm_state(spark), ups, NOW))}
    assert set(out) == {5, 6, 7}
    assert (out[6]["last_value"], out[6]["last_run_id"], out[6]["updated_by"]) == ("2024-02-01", None, "u")
    assert out[5]["last_value"] == "2024-01-01"
    assert (out[7]["table_config_id"], out[7]["created_by"], out[7]["env_type"]) == (2, "system", "dev")


def test_upsert_twice_equals_once(spark):
    ups = spark.createDataFrame([(1, 1, "ts", "timestamp", "2024-02-01", "r", "u")],
                                "table_config_id long, request_seq long, watermark_column string, watermark_type string, last_value string, last_run_id string, updated_by string")
    once = M.upsert_watermark(_wm_state(spark), ups, NOW)
    twice = M.upsert_watermark(once, ups, NOW)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_add_schema_versions(spark):
    st = spark.createDataFrame(
        [(1, 7, 3, 5, "{}", "additive", None, "dev", False, "s", SEED, "s", SEED)], S.TABLES["tbl_schema_version"])
    req = spark.createDataFrame([(7, 1, None, 6, "additive"), (7, 2, None, 7, "deletion"), (8, 3, None, 2, "additive"), (8, 4, 10, 2, "additive")],
                                "table_config_id long, request_seq long, version_number long, column_count long, change_type string")
    out = rows(M.add_schema_versions(st, req, NOW))
    got = sorted((r["table_config_id"], r["version_number"], r["version_id"]) for r in out)
    assert got == [(7, 4, 2), (7, 5, 3), (8, 1, 4), (8, 10, 5)]


def test_add_schema_versions_sequential_meaning(spark):
    # base 3; auto, explicit 10, auto, explicit 2, auto -> 4, 10, 11, 2, 12 (as one-by-one calls)
    st = spark.createDataFrame([(1, 7, 3, 5, "{}", "additive", None, "dev", True, "s", SEED, "s", SEED)], S.TABLES["tbl_schema_version"])
    req = spark.createDataFrame([(7, 1, None), (7, 2, 10), (7, 3, None), (7, 4, 2), (7, 5, None), (9, 6, None)],
                                "table_config_id long, request_seq long, version_number long")
    out = rows(M.add_schema_versions(st, req, NOW), ["version_id"])
    assert [(r["table_config_id"], r["version_number"]) for r in out] == [(7, 4), (7, 10), (7, 11), (7, 2), (7, 12), (9, 1)]


def test_open_and_close_runs(spark):
    st = C.empty_table(spark, "aud_table_run")
    req = spark.createDataFrame([("r1", 1, dt.datetime(2024, 1, 1), 1), ("r2", 2, None, 2)],
                                "run_id string, table_config_id long, start_time timestamp_ntz, request_seq long")
    opened = M.open_runs(st, req, NOW)
    r = rows(opened)
    assert len(r) == 1 and (r[0]["table_run_id"], r[0]["status"], r[0]["created_by"]) == (1, "running", "system")
    close = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 0, 5), 300, "succeeded")],
                                  "table_run_id long, request_seq long, end_time timestamp_ntz, elapsed_seconds long, status string")
    closed = rows(M.close_runs(opened, close, NOW))[0]
    assert (closed["status"], closed["elapsed_seconds"], closed["updated_at"]) == ("succeeded", 300, NOW_DT)


def test_composite_create(spark):
    master = C.conform(spark.createDataFrame([(4, "taken", "dev")], "connection_id long, connection_name string, env_type string"), S.TABLES["conn_master"])
    req = spark.createDataFrame([(1, "a", "postgres", "d", 0, "dev", "iam"), (2, "taken", "postgres", "d", 1, "dev", "iam")],
                                "request_seq long, connection_name string, connection_type string, connection_domain_name string, is_target int, env_type string, auth_type string")
    req = req.withColumns({"details": F.create_map(F.lit("host"), F.lit("h"), F.lit("port"), F.lit("5432")),
                           "auth": F.create_map(F.lit("iam_credentials"), F.lit("t"))})
    out = M.composite_create(master, C.empty_table(spark, "connection_details"), C.empty_table(spark, "connection_auth"), req, NOW)
    m = rows(out["conn_master"])
    assert [(x["connection_id"], x["connection_name"], x["is_target"]) for x in m] == [(5, "a", False)]
    d = rows(out["connection_details"], ["connection_details_id"])
    assert [(x["connection_details_id"], x["connection_id"], x["connection_property_id"]) for x in d] == [(1, 5, 1), (2, 5, 2)]
    assert rows(out["connection_auth"])[0]["auth_property"] == "iam_credentials"
    assert [x["error_code"] for x in rows(out["rejects"])] == [S.DUPLICATE_CONNECTION_NAME]


def test_stamp(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "created_by string, updated_by string")
    out = rows(M.stamp(df, NOW_DT.replace(tzinfo=dt.timezone.utc)))
    assert [(r["created_by"], r["updated_by"]) for r in out] == [("a", "a"), ("system", "system")]
    assert out[0]["created_at"] == out[1]["updated_at"] == NOW_DT


def _conn_tables(spark):
    master = C.conform(spark.createDataFrame(
        [(1, "a", "postgres", "d1", False, "dev", True), (2, "b", "s3", "d2", False, "prod", True), (3, "c", "local", "d3", False, "dev", False)],
        "connection_id long, connection_name string, connection_type string, connection_domain_name string, is_target boolean, env_type string, is_active boolean"),
        S.TABLES["conn_master"]).withColumns({"updated_by": F.lit("seed"), "updated_at": F.lit(SEED)})
    det = C.conform(spark.createDataFrame([(1, 1, 1, "host", "h", "dev", True)],
                                          "connection_details_id long, connection_id long, connection_property_id long, connection_property string, connection_property_value string, env_type string, is_active boolean"),
                    S.TABLES["connection_details"]).withColumns({"updated_by": F.lit("seed"), "updated_at": F.lit(SEED)})
    auth = C.conform(spark.createDataFrame([(1, 2, 1, "iam_credentials", "t", "prod", True)],
                                           "connection_auth_id long, connection_id long, auth_property_id long, auth_property string, auth_property_value string, env_type string, is_active boolean"),
                     S.TABLES["connection_auth"]).withColumns({"updated_by": F.lit("seed"), "updated_at": F.lit(SEED)})
    return master, det, auth


def test_update_connections(spark):
    master, det, auth = _conn_tables(spark)
    req = spark.createDataFrame(
        [(1, 1, "new_dom", None, None, None, "ed"), (2, 2, None, 1, {"api_key": "k"}, "key", "ed"),
         (1, 3, None, None, {"api_key": "k"}, "key", "ed"), (3, 4, "x", None, None, None, "ed"), (9, 5, "y", None, None, None, "ed")],
        "connection_id long, request_seq long, connection_domain_name string, is_target int, auth map<string,string>, auth_type string, updated_by string")
    out = M.update_connections(master, det, auth, req, NOW)
    codes = {r["request_seq"]: r["error_code"] for r in rows(out["rejects"])}
    assert codes == {3: S.INVALID_AUTH_TYPE, 4: S.CONNECTION_NOT_FOUND, 5: S.CONNECTION_NOT_FOUND}
    m = {r["connection_id"]: r for r in rows(out["conn_master"])}
    assert (m[1]["connection_domain_name"], m[1]["updated_by"]) == ("new_dom", "ed")
    assert (m[2]["is_target"], m[2]["connection_domain_name"]) == (True, "d2")
    assert m[3]["connection_domain_name"] == "d3"
    a = rows(out["connection_auth"], ["connection_auth_id"])
    assert [(r["connection_auth_id"], r["auth_property"], r["is_active"], r["env_type"]) for r in a] == [
        (1, "iam_credentials", False, "prod"), (2, "api_key", True, "prod")]
    assert rows(out["connection_details"]) == rows(det)  # details not supplied: untouched


def test_soft_delete_connections(spark):
    master, det, auth = _conn_tables(spark)
    ids = spark.createDataFrame([(1,), (3,)], "connection_id long")
    out = M.soft_delete_connections(master, det, auth, ids, NOW, "x")
    assert {r["connection_id"]: r["is_active"] for r in rows(out["conn_master"])} == {1: False, 2: True, 3: False}
    assert [r["is_active"] for r in rows(out["connection_details"])] == [False]
    assert [r["is_active"] for r in rows(out["connection_auth"])] == [True]


def test_create_configs_with_watermark(spark):
    req = spark.createDataFrame(
        [(1, 7, "d", "g", '{"schema":"s","table":"t"}', '{}', "incremental", "ts", "timestamp", "ann"),
         (2, 7, "d", "g", '{"schema":"s"}', '{}', "full", None, None, None),
         (3, 7, "d", "g", '{"file_path":"/x","file_type":"csv"}', '{}', "full", None, None, None)],
        "request_seq long, connection_source_id long, connection_domain_name string, config_group string, source_attributes string, "
        "target_attributes string, load_type string, watermark_column string, watermark_type string, created_by string")
    out = M.create_configs(C.empty_table(spark, "tbl_source_table"), C.empty_table(spark, "tbl_watermark"), req, NOW)
    cfg = rows(out["tbl_source_table"], ["table_config_id"])
    assert [(r["table_config_id"], r["created_by"], r["fail_mode"], r["tags"], r["retry_count"]) for r in cfg] == [
        (1, "ann", "halt", "[]", 0), (2, "system", "halt", "[]", 0)]
    wm = rows(out["tbl_watermark"])
    assert [(r["watermark_id"], r["table_config_id"], r["created_by"], r["updated_by"]) for r in wm] == [(1, 1, "ann", "ann")]
    assert [r["error_code"] for r in rows(out["rejects"])] == [S.INVALID_SOURCE_ATTRIBUTES]


def test_config_defaults_with_int_flags(spark):
    req = spark.createDataFrame([(1, 7, "d", "g", '{"schema":"s","table":"t"}', "full", 1, None, None)],
                                "request_seq long, connection_source_id long, connection_domain_name string, config_group string, "
                                "source_attributes string, load_type string, watermark_enabled int, retry_count int, tags string")
    out = rows(M.create_configs(C.empty_table(spark, "tbl_source_table"), C.empty_table(spark, "tbl_watermark"), req, NOW)["tbl_source_table"])
    assert (out[0]["watermark_enabled"], out[0]["pii_scan_enabled"], out[0]["retry_count"], out[0]["tags"]) == (True, False, 0, "[]")


def test_patch_with_int_flag_on_boolean_state(spark):
    st = spark.createDataFrame([(1, False, True, "s", SEED)], "connection_id long, is_target boolean, is_active boolean, updated_by string, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(1, 1, 1)], "connection_id long, request_seq long, is_target int")
    assert rows(M.patch_update(st, ch, "connection_id", ["is_target"], NOW))[0]["is_target"] is True
    assert rows(M.overwrite_update(st, ch, "connection_id", ["is_target"], NOW))[0]["is_target"] is True


def test_update_configs_checks(spark):
    st = spark.createDataFrame([(1, "full", '{"schema":"a","table":"b"}', True, "s", SEED), (2, "full", "{}", False, "s", SEED)],
                               "table_config_id long, load_type string, source_attributes string, is_active boolean, updated_by string, updated_at timestamp_ntz")
    req = spark.createDataFrame([(1, 1, "bogus", None), (1, 2, None, '{"schema":""}'), (1, 3, "cdc", "{}"), (2, 4, "cdc", None), (9, 5, "cdc", None)],
                                "table_config_id long, request_seq long, load_type string, source_attributes string")
    out = M.update_configs(st, req, NOW)
    codes = {r["request_seq"]: r["error_code"] for r in rows(out["rejects"])}
    assert codes == {1: S.INVALID_LOAD_TYPE, 2: S.INVALID_SOURCE_ATTRIBUTES, 4: S.PIPELINE_CONFIG_NOT_FOUND, 5: S.PIPELINE_CONFIG_NOT_FOUND}
    got = {r["table_config_id"]: (r["load_type"], r["source_attributes"]) for r in rows(out["tbl_source_table"])}
    assert got == {1: ("cdc", "{}"), 2: ("full", "{}")}


def test_bts_create_and_update(spark):
    st = C.empty_table(spark, "bts_config")
    req = spark.createDataFrame([(1, "ds_a", 7, [{"rule_name": "r", "expression": "x > 0"}], None)],
                                "request_seq long, dataset_name string, source_config_id long, dq_rules array<struct<rule_name:string,expression:string>>, tags string")
    new = rows(M.create_bts(st, req, NOW))
    assert len(new) == 1
    r = new[0]
    assert (r["bts_config_id"], r["dq_rules"], r["silver_layout"], r["tags"], r["env_type"], r["created_by"]) == (
        1, '[{"rule_name":"r","expression":"x > 0"}]', "[]", "[]", "dev", "system")
    state = st.unionByName(M.create_bts(st, req, NOW))
    upd = spark.createDataFrame([(1, 2, "ds_b", ["x"]), (5, 3, "nope", None)], "bts_config_id long, request_seq long, dataset_name string, tags array<string>")
    out = M.update_bts(state, upd, NOW)
    assert [x["error_code"] for x in rows(out["rejects"])] == [S.PIPELINE_CONFIG_NOT_FOUND]
    got = rows(out["bts_config"])[0]
    assert (got["dataset_name"], got["tags"], got["dq_rules"]) == ("ds_b", '["x"]', '[{"rule_name":"r","expression":"x > 0"}]')
