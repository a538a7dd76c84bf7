"""D02-D05 schema operators, D14-D17 EAV and maps, D18-D26 JSON and validation."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from sluice import schemas as S
from sluice.functions.exprs import decode_json_list, encode_json, map_text, row_hash
from sluice.operators import conform as C
from sluice.operators import eav as EAV
from sluice.operators import validate as V


def test_conform_orders_drops_and_casts(spark):
    rows_in = spark.createDataFrame(
        [(5, "src", 1, "2024-03-09T07:15:42.250001+00:00", "extra")],
        "connection_id long, connection_name string, is_target int, created_at string, junk string",
    )
    out = C.conform(rows_in, S.TABLES["conn_master"])
    assert out.columns == S.column_names("conn_master")
    r = rows(out)[0]
    assert r["is_target"] is True and r["connection_type"] is None
    assert r["created_at"] == dt.datetime(2024, 3, 9, 7, 15, 42, 250001)
    assert all(f.nullable for f in out.schema.fields)


def test_append_no_rows_is_noop(spark):
    state = C.empty_table(spark, "conn_master")
    assert C.append(state, spark.createDataFrame([], "connection_id long")).count() == 0


def test_bootstrap_idempotent(spark):
    root = tempfile.mkdtemp(prefix="sluice-boot-")
    p1 = C.bootstrap_tables(spark, root)
    p2 = C.bootstrap_tables(spark, root)
    assert p1 == p2 and len(p1) == 9
    assert sorted(os.listdir(root)) == sorted(S.TABLES)
    assert spark.read.parquet(p1["aud_table_run"]).schema.names == S.column_names("aud_table_run")


def test_add_column_after_twice(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    once = C.add_column_after(df, "x", "bigint", "a")
    assert once.columns == ["a", "x", "b"]
    assert C.add_column_after(once, "x", "bigint", "a").columns == ["a", "x", "b"]
    old = spark.createDataFrame([(1,)], "a int")
    assert rows(C.read_snapshots([once, old]), ["a"])[1]["x"] is None


def test_flags_int_and_bool(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, is_active bigint")
    b = spark.createDataFrame([(3, True)], "id int, is_active boolean")
    both = C.normalise_flags(a, ["is_active"]).unionByName(C.normalise_flags(b, ["is_active"]))
    assert [r["is_active"] for r in rows(both, ["id"])] == [False, True, True]
    back = C.store_flags(C.normalise_flags(a, ["is_active"]), a.schema)
    assert back.schema["is_active"].dataType.simpleString() == "bigint"


def test_map_to_eav_positions(spark):
    df = spark.createDataFrame([(1, {"host": "h"}), (2, {})], "connection_id long, details map<string,string>")
    df = df.withColumn("details", F.when(F.col("connection_id") == 1,
                                         F.create_map(F.lit("host"), F.lit("h"), F.lit("port"), F.lit("5432"))).otherwise(F.col("details")))
    out = rows(EAV.map_to_eav(df, "connection_id", "details", "pid", "k", "v"), ["pid"])
    assert [(r["connection_id"], r["pid"], r["k"], r["v"]) for r in out] == [(1, 1, "host", "h"), (1, 2, "port", "5432")]


def test_eav_to_map_rules(spark):
    d = spark.createDataFrame(
        [(1, 1, "host", "a", True), (1, 2, "port", None, True), (1, 3, "host", "b", True),
         (1, 4, None, "x", True), (1, 5, "db", "gone", False), (2, 1, "k", "v", False)],
        "cid long, pid long, k string, v string, is_active boolean",
    )
    out = {r["cid"]: r for r in rows(EAV.eav_to_map(d, "cid", "pid", "k", "v", "m").withColumn("keys", F.map_keys("m")))}
    assert set(out) == {1}
    assert out[1]["keys"] == ["host", "port"] and out[1]["m"] == {"host": "b", "port": ""}


def test_auth_type_inference(spark):
    maps = spark.createDataFrame(
        [(1, {}), (2, {"principal": "p", "keytab_path": "k"}), (3, {"client_id": "a", "client_secret": "b", "token_url": "c"}),
         (4, {"iam_credentials": "t"}), (5, {"api_key": "k"}), (6, {"principal": "p"}), (7, {"username": "u"})],
        "id int, m map<string,string>",
    )
    got = {r["id"]: r["t"] for r in rows(maps.select("id", EAV.infer_auth_type(F.col("m")).alias("t")))}
    assert got == {1: "none", 2: "kerberos", 3: "oauth", 4: "iam", 5: "key", 6: "basic", 7: "basic"}


def test_connection_view_missing_children(spark):
    master = spark.createDataFrame([(1, "c", "postgres", True), (2, "d", "s3", True)], "connection_id long, connection_name string, connection_type string, is_active boolean")
    det = spark.createDataFrame([(1, 1, "host", "h", True)], "connection_id long, connection_property_id long, connection_property string, connection_property_value string, is_active boolean")
    auth = spark.createDataFrame([(1, 1, "iam_credentials", "t", True)], "connection_id long, auth_property_id long, auth_property string, auth_property_value string, is_active boolean")
    out = {r["connection_id"]: r for r in rows(EAV.connection_view(master, det, auth))}
    assert out[1]["auth_type"] == "iam" and out[1]["details"] == {"host": "h"}
    assert out[2]["details"] == {} and out[2]["auth"] == {} and out[2]["auth_type"] == "none"


def test_json_helpers(spark):
    df = spark.createDataFrame([('["a","b"]',), ("",), (None,), ("[]",)], "tags string")
    assert [r["n"] for r in rows(df.select(F.size(decode_json_list("tags")).alias("n")))] == [2, 0, 0, 0]
    s = spark.createDataFrame([("it's \\ x",)], "v string").select(encode_json(F.struct("v")).alias("j"))
    assert rows(s)[0]["j"] == '{"v":"it\'s \\\\ x"}'
    m = spark.createDataFrame([(1,)], "x int").select(map_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("t"))
    assert rows(m)[0]["t"] == "a=1,b=2"


def test_row_hash_null_vs_empty(spark):
    df = spark.createDataFrame([(1, None), (1, "")], "a int, b string")
    hs = [r["h"] for r in rows(df.select(row_hash(["a", "b"]).alias("h")))]
    assert hs[0] != hs[1] and len(hs[0]) == 64


def test_connector_fields_registry(spark):
    f = V.connector_fields(spark)
    pg_iam = rows(f.filter("connector = 'postgres' AND auth_type = 'iam'"), ["field_order"])
    assert [r["field_name"] for r in pg_iam] == ["host", "port", "database", "schema", "iam_credentials"]
    assert pg_iam[1]["default_value"] == "5432"
    assert f.select("connector").distinct().count() == 12


def test_missing_fields_default_auth(spark):
    conns = spark.createDataFrame([(1, "mysql", None)], "connection_id long, connection_type string, auth_type string")
    present = spark.createDataFrame([(1, "host"), (1, "username")], "connection_id long, field_name string")
    got = sorted(r["field_name"] for r in rows(V.missing_fields(conns, present)))
    assert got == ["database", "password", "port"]


def test_connector_check_codes(spark):
    df = spark.createDataFrame([(1, "postgres", "iam"), (2, "postgres", "kerberos"), (3, "sqlite", "basic"), (4, "local", "none")],
                               "id int, connection_type string, auth_type string")
    got = {r["id"]: r["error_code"] for r in rows(V.connector_check(df))}
    assert got == {1: None, 2: S.INVALID_AUTH_TYPE, 3: S.INVALID_CONNECTOR_TYPE, 4: None}


def test_source_attributes_and_load_type(spark):
    df = spark.createDataFrame(
        [(1, "full", '{"schema":"main","table":"orders"}'), (2, "full", '{"schema":"missing_table"}'),
         (3, "cdc", '{"file_path":"/in","file_type":"csv"}'), (4, "api", '{"file_path":null}'),
         (5, "bogus", '{"schema":"main","table":"t"}'), (6, None, '{"schema":"","table":"t"}')],
        "id int, load_type string, source_attributes string",
    )
    got = {r["id"]: r["error_code"] for r in rows(V.bulk_validate(df))}
    assert got == {1: None, 2: S.INVALID_SOURCE_ATTRIBUTES, 3: None, 4: S.MISSING_REQUIRED_FIELD,
                   5: S.INVALID_LOAD_TYPE, 6: S.INVALID_LOAD_TYPE}
    summary = rows(V.bulk_summary(V.bulk_validate(df)))[0]
    assert summary["created_count"] == 2 and summary["failed_count"] == 4
    upd = spark.createDataFrame([(None,), ("",), ("x",)], "load_type string").select(V.load_type_code(F.col("load_type"), required=False).alias("e"))
    assert [r["e"] for r in rows(upd)] == [None, None, S.INVALID_LOAD_TYPE]


def test_unique_names_batch_order(spark):
    existing = spark.createDataFrame([("taken", "dev")], "connection_name string, env_type string")
    req = spark.createDataFrame(
        [(1, "taken", "dev", "postgres", "iam"), (2, "dup", "dev", "postgres", "iam"), (3, "dup", "dev", "postgres", "iam"),
         (4, "dup", "prod", "postgres", "iam"), (5, "bad", "dev", "sqlite", "none"), (6, "bad", "dev", "postgres", "basic")],
        "request_seq long, connection_name string, env_type string, connection_type string, auth_type string",
    )
    got = {r["request_seq"]: r["error_code"] for r in rows(V.unique_names(req, existing))}
    assert got == {1: S.DUPLICATE_CONNECTION_NAME, 2: None, 3: S.DUPLICATE_CONNECTION_NAME, 4: None,
                   5: S.INVALID_CONNECTOR_TYPE, 6: None}


def test_missing_parent(spark):
    parents = spark.createDataFrame([(1, True), (2, False)], "table_config_id long, is_active boolean")
    req = spark.createDataFrame([(1,), (2,), (3,)], "table_config_id long")
    got = {r["table_config_id"]: r["error_code"] for r in rows(V.missing_parent(req, parents, "table_config_id"))}
    assert got == {1: None, 2: S.PIPELINE_CONFIG_NOT_FOUND, 3: S.PIPELINE_CONFIG_NOT_FOUND}


def test_unique_names_self_exclusion(spark):
    existing = spark.createDataFrame([(1, "a", "dev"), (2, "b", "dev"), (3, "b", "dev")], "connection_id long, connection_name string, env_type string")
    req = spark.createDataFrame([(1, 1, "a", "dev"), (2, 2, "b", "dev"), (3, 4, "a", "dev")],
                                "request_seq long, connection_id long, connection_name string, env_type string")
    got = {r["request_seq"]: r["error_code"] for r in rows(V.unique_names(req, existing, check_connector=False, exclude_col="connection_id"))}
    assert got == {1: None, 2: S.DUPLICATE_CONNECTION_NAME, 3: S.DUPLICATE_CONNECTION_NAME}


def test_list_connections_builds_maps_for_page_only(spark):
    master = spark.createDataFrame([(i, f"c{i}", "postgres", "dom", i % 2 == 0 and True or True, "dev") for i in range(1, 6)],
                                   "connection_id long, connection_name string, connection_type string, connection_domain_name string, is_active boolean, env_type string")
    det = spark.createDataFrame([(i, 1, "host", f"h{i}", True) for i in range(1, 6)],
                                "connection_id long, connection_property_id long, connection_property string, connection_property_value string, is_active boolean")
    auth = spark.createDataFrame([(5, 1, "api_key", "k", True)], "connection_id long, auth_property_id long, auth_property string, auth_property_value string, is_active boolean")
    out = rows(EAV.list_connections(master, det, auth, {"env_type": "dev"}, "C", 1, 2), ["connection_id"])
    assert [(r["connection_id"], r["details"], r["auth_type"], r["total"], r["total_pages"]) for r in out] == [
        (4, {"host": "h4"}, "none", 5, 3), (5, {"host": "h5"}, "key", 5, 3)]


def test_list_configs_decodes(spark):
    from sluice.operators import reads as R

    cfg = spark.createDataFrame([(1, "qa", True, '["a"]', '{"schema":"s","table":"t"}'), (2, "qa", True, None, "{}"), (3, "dev", True, "[]", "{}")],
                                "table_config_id long, env_type string, is_active boolean, tags string, source_attributes string")
    out = rows(R.list_configs(cfg, {"env_type": "qa"}, 1, 20), ["table_config_id"])
    assert [(r["table_config_id"], r["tags"], r["source_attributes"].get("table"), r["total"]) for r in out] == [
        (1, ["a"], "t", 2), (2, [], None, 2)]


def test_json_encode_only_non_text_and_decoders(spark):
    from sluice.functions.exprs import decode_audit, decode_bts_config, encode_json_columns
    from sluice.operators import quality as Q

    df = spark.createDataFrame([({"schema": "s"}, '{"a":1}')], "source_attributes map<string,string>, target_attributes string")
    enc = rows(encode_json_columns(df, ["source_attributes", "target_attributes"]))[0]
    assert enc == {"source_attributes": '{"schema":"s"}', "target_attributes": '{"a":1}'}
    aud = rows(decode_audit(spark.createDataFrame([("",), (None,), ('{"k":"v"}',)], "source_attributes string")))
    assert [r["source_attributes"] for r in aud] == [None, None, {"k": "v"}]
    bts = spark.createDataFrame([('[{"rule_name":"pos","expression":"x > 0"}]', "", None, None)],
                                "dq_rules string, silver_layout string, std_rules string, tags string")
    row = decode_bts_config(bts).first()
    assert row["silver_layout"] == [] and row["std_rules"] == [] and row["tags"] == []
    rules = [r.asDict() for r in row["dq_rules"]]
    data = spark.createDataFrame([(1,), (-1,)], "x int")
    assert [r["failed_rules"] for r in rows(Q.evaluate_rules(data, rules), ["x"])] == [["pos"], []]


def test_source_attributes_json_truthiness(spark):
    df = spark.createDataFrame(
        [(1, '{"schema": 0, "table": "t"}'), (2, '{"schema": "0", "table": "t"}'), (3, '{"schema": "s", "table": []}'),
         (4, '{"schema": "s", "table": {"a": 1}}'), (5, '{"file_path": "/x", "file_type": false}'), (6, '{"file_path": 1, "file_type": "csv"}'),
         (7, "not json"), (8, '{"schema": true, "table": 2.5}')],
        "id int, source_attributes string")
    got = {r["id"]: r["error_code"] for r in rows(V.source_attributes_check(df))}
    assert got == {1: S.INVALID_SOURCE_ATTRIBUTES, 2: None, 3: S.INVALID_SOURCE_ATTRIBUTES, 4: None,
                   5: S.MISSING_REQUIRED_FIELD, 6: None, 7: S.INVALID_SOURCE_ATTRIBUTES, 8: None}
