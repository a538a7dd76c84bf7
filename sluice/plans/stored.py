"""Registered queries of runs that read what an earlier run stored (bounded incremental scans,
bucketed targets, published table sets, mergeable metrics) and of the create and update
outputs as checked rows, each with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import bucketed as B
from sluice.operators import conform as C
from sluice.operators import load as L
from sluice.operators import mutate as M
from sluice.operators import publish as PB
from sluice.operators import runs as RU
from sluice.plans import catalog as K
from sluice.plans import oracle as O
from sluice.plans import robust as RB
from sluice.schemas import TABLES
from sluice.session import scratch_path
from sluice.sources import lenses, splits
from sluice.sources.tables import read_table

E = F.expr
NOW, CUT = K.NOW, K.CDC_CUT
STEPS = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")


def _buckets(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _new_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


# ---- R02 with scan bounds ----

def incremental_bounded(spark, sf):
    """R02 for many configs: the smallest readable last value bounds the scan."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    state = RB._stored_watermarks(spark, sf, "timestamp")
    return L.incremental_by_config(ev, state, "user_id", "ts", upper=L.upper_bound(ev, "ts"))


def incremental_configured(spark, sf):
    """R02 for the configs to load only; those without a watermark are read apart."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    configs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("table_config_id"))
    return L.incremental_by_config(ev, RB._stored_watermarks(spark, sf, "integer"), "user_id", "event_id", watermark_type="integer", configs=configs)


def _incremental_sql(col: str, where: str) -> str:
    return f"""
WITH wm AS (SELECT user_id AS c, max({col}) AS v FROM events WHERE ts < TIMESTAMP '{CUT}' AND user_id % 5 <> 0 GROUP BY user_id)
SELECT event_id, user_id, ts FROM events e LEFT JOIN wm ON wm.c = e.user_id
WHERE (wm.c IS NULL OR (wm.c % 5 <> 1 AND e.{col} > wm.v)) AND {where}"""


# ---- R05 and R06 on a bucketed target ----

def _orders_by_customer(spark, sf) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        E("CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END").alias("k"), "o_orderkey", "o_orderstatus", "o_orderdate")


def upsert_bucketed(spark, sf):
    """R05 run by run: a first load, then two upserts of the target stored by key."""
    o = _orders_by_customer(spark, sf)
    first, second = (F.lit(s).cast("timestamp_ntz") for s in STEPS)
    name, root, n = _new_name("orders"), scratch_path(spark, "bucketed"), _buckets(spark)
    B.load_bucketed(spark, name, root, "v0", o.filter(F.col("o_orderdate") < first), ["k"], ["o_orderkey"], n)
    B.apply_upsert(spark, name, root, "v1", o.filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < second)), ["k"], ["o_orderkey"], n)
    return B.upsert_bucketed(spark.table(name), o.filter(F.col("o_orderdate") >= second), ["k"], ["o_orderkey"])


def cdc_bucketed(spark, sf):
    """R06 on a target stored by key; the changes hold everything again."""
    ev = read_table(spark, sf, "events").withColumn("k", E("CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id END"))
    cut = F.lit(CUT).cast("timestamp_ntz")
    op = E("CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END")
    old = L.latest_by_key(ev.filter((F.col("ts") < cut) & E("user_id % 10 <> 0")).select("k", "event_id", "event_type", "value"), ["k"], ["event_id"])
    target = old.select("k", "event_type", "value", F.concat(F.lit("note "), F.coalesce(F.col("k").cast("string"), F.lit("-"))).alias("note"),
                        F.lit(True).alias("is_active"), F.col("event_id").alias("last_seq"))
    table = _new_name("events")
    B.save_bucketed(target, table, scratch_path(spark, "bucketed"), ["k"], _buckets(spark))
    changes = ev.select("k", "event_id", "event_type", "value", op.alias("op"))
    return B.cdc_bucketed(spark.table(table), changes, ["k"], "event_id", "op", ["event_type", "value"])


# ---- R10 split points ----

SPLITS = 8


def source_splits(spark, sf):
    """The reads of ``orders`` that a histogram of o_totalprice gives: one predicate per
    task, what each of them reads. The histogram stands for the database's own."""
    o = read_table(spark, sf, "orders").select("o_totalprice")
    bounds = splits.histogram_bounds(o, "o_totalprice", 2 * SPLITS)
    parts = splits.split_predicates("o_totalprice", splits.split_points(bounds, SPLITS))
    reads = [o.filter(p).agg(F.lit(i).cast("int").alias("split"), F.count(F.lit(1)).alias("n_rows"), F.min("o_totalprice").alias("low"),
                             F.max("o_totalprice").alias("high")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, reads)


# ---- D31 and D37 published by one manifest ----

def _table_counts(tables: dict[str, DataFrame], actor: str) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).cast("long").alias("n_rows"),
                    F.count_if(F.col("updated_by") == actor).cast("long").alias("deactivated"),
                    F.count_if(F.col("is_active")).cast("long").alias("still_active")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def published_cascade(spark, sf):
    """D31 published: the six tables are published, the cascade's new states follow with one
    manifest, readers take all six from it."""
    root = scratch_path(spark, "published")
    PB.publish(spark, root, {
        "tbl_source_table": K._config_state(spark, sf), "tbl_watermark": K._wm_state(spark, sf),
        "tbl_schema_version": K._seeded(lenses.versions(spark, sf).drop("created_at")), "tbl_pii_attribute": K._pii_state(spark, sf),
        "aud_table_run": K._seeded(lenses.runs(spark, sf)), "bts_config": K._bts_state(spark, sf)})
    old = PB.read_published(spark, root)
    ids = read_table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("table_config_id"))
    children = {name: (old[name], parent) for name, parent in K.CASCADE_CHILDREN}
    PB.publish(spark, root, M.cascade_soft_delete(old["tbl_source_table"], children, ids, NOW, "cascader"))
    return _table_counts(PB.read_published(spark, root), "cascader")


def _composite(spark, sf) -> dict[str, DataFrame]:
    reqs = lenses.connections(spark, sf).join(
        K._detail_requests(spark, sf).select("connection_id", "details"), "connection_id").withColumn(
        "auth", F.create_map(F.lit("username"), E("concat('u', CAST(connection_id AS STRING))"))).drop("connection_id")
    master = C.conform(K._seeded(K._existing_master(spark, sf)), TABLES["conn_master"])
    return M.composite_create(master, C.empty_table(spark, "connection_details"), C.empty_table(spark, "connection_auth"), reqs, NOW)


def composite_master(spark, sf):
    """The master rows of a connection create."""
    return _composite(spark, sf)["conn_master"].select(
        "connection_id", "connection_name", "connection_type", "connection_domain_name", "is_target", "env_type", "is_active", "created_by", "updated_by", "created_at")


def composite_auth(spark, sf):
    """The auth rows of a connection create."""
    return _composite(spark, sf)["connection_auth"].select(
        "connection_auth_id", "connection_id", "auth_property_id", "auth_property", "auth_property_value", "env_type", "is_active", "created_by")


def composite_rejects(spark, sf):
    """The refused requests of a connection create, with their codes."""
    return _composite(spark, sf)["rejects"].select("request_seq", "connection_name", "env_type", "error_code")


def published_create(spark, sf):
    """D37 published: details, auth and master of the new connections with one manifest."""
    root = scratch_path(spark, "published")
    master = C.conform(K._seeded(K._existing_master(spark, sf)), TABLES["conn_master"])
    PB.publish(spark, root, {"conn_master": master, "connection_details": C.empty_table(spark, "connection_details"),
                             "connection_auth": C.empty_table(spark, "connection_auth")})
    new, old = _composite(spark, sf), PB.read_published(spark, root)
    PB.publish(spark, root, {name: old[name].unionByName(new[name]) for name in old})
    t = PB.read_published(spark, root)
    keys = {name: t[name].groupBy("connection_id").agg(F.count(F.lit(1)).alias(f"n_{name}")) for name in ("connection_details", "connection_auth")}
    out = t["conn_master"].select("connection_id", "connection_name")
    for name, counts in keys.items():
        out = out.join(counts, "connection_id", "left").fillna(0, [f"n_{name}"])
    return out


# ---- BTS create and update ----

def _bts_requests(spark, sf) -> DataFrame:
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_seq"), F.col("p_name").alias("dataset_name"),
        E("CASE WHEN p_size > 45 THEN NULL ELSE p_partkey END").alias("source_config_id"),
        E("CASE p_size % 3 WHEN 0 THEN array(named_struct('rule_name', 'size_pos', 'expression', concat('p_size > ', p_size))) END").alias("dq_rules"),
        E("CASE WHEN p_brand = 'Brand#1' THEN array('hot', p_type) END").alias("tags"),
        E("CASE WHEN p_size % 2 = 0 THEN 'qa' END").alias("env_type"), F.lit("maker").alias("created_by"))


def bts_create(spark, sf):
    """BTS configs created from requests: ids, stamps, JSON of rules and tags, defaults."""
    out = M.create_bts(C.empty_table(spark, "bts_config"), _bts_requests(spark, sf), NOW)
    return out.select("bts_config_id", "dataset_name", "source_config_id", "silver_layout", "dq_rules", "std_rules", "tags", "env_type", "is_active", "created_by", "created_at")


def _bts_update(spark, sf) -> dict[str, DataFrame]:
    state = C.conform(K._seeded(read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("bts_config_id"), F.col("p_name").alias("dataset_name"), F.lit("[]").alias("tags"),
        E("p_size % 10 <> 0").alias("is_active"))), TABLES["bts_config"])
    changes = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("bts_config_id")).agg(
        F.max("l_orderkey").alias("request_seq"), F.max("l_linenumber").alias("n"))
    unknown = read_table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("bts_config_id"), F.col("s_suppkey").alias("request_seq"), F.lit(1).alias("n"))
    changes = changes.unionByName(unknown).select(
        "bts_config_id", "request_seq", E("CASE WHEN n > 3 THEN concat('set_', n) END").alias("dataset_name"),
        E("CASE WHEN n % 2 = 0 THEN array('n', concat(n)) END").alias("tags"), F.lit("editor").alias("updated_by"))
    return M.update_bts(state, changes, NOW)


def bts_update(spark, sf):
    """BTS configs patched: NULL keeps, JSON of tags, only active rows."""
    return _bts_update(spark, sf)["bts_config"].select("bts_config_id", "dataset_name", "tags", "is_active", "updated_by")


def bts_update_rejects(spark, sf):
    return _bts_update(spark, sf)["rejects"].select("bts_config_id", "request_seq", "error_code")


# ---- R19 from stored sketches ----

def run_metrics_merged(spark, sf):
    """R19 per config from daily sketches that an earlier job stored."""
    path = scratch_path(spark, "metrics")
    RU.metric_sketches(lenses.runs(spark, sf)).write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    return RU.merged_metrics(stored).select("table_config_id", "runs", "timed", "success_rate", "avg_elapsed", "p_elapsed")


_COMPOSITE = O._with(O.CONNECTIONS, O._registry_methods(), O.EXISTING_MASTER, O.UNIQUE_CHAIN, """ok AS (
  SELECT (SELECT coalesce(max(connection_id), 0) FROM ex) + row_number() OVER (ORDER BY request_seq) AS connection_id, request_seq
  FROM checked WHERE error_code IS NULL)""",
    "who AS (SELECT ok.*, s_name, s_nationkey, s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env FROM ok JOIN supplier ON s_suppkey = request_seq)")
_TYPES = "CASE s_suppkey % 6 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mssql' WHEN 2 THEN 's3' WHEN 3 THEN 'local' WHEN 4 THEN 'snowflake' ELSE 'sqlite' END"
_NOW = f"TIMESTAMP '{NOW}'"

STORED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "incremental_bounded": (incremental_bounded, _incremental_sql("ts", "true")),
    "incremental_configured": (incremental_configured, _incremental_sql("event_id", "e.user_id IN (SELECT c_custkey FROM customer)")),
    "upsert_bucketed": (upsert_bucketed, f"""
WITH o AS (SELECT CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_orderstatus, o_orderdate,
  CASE WHEN o_orderdate < TIMESTAMP '{STEPS[0]}' THEN 0 WHEN o_orderdate < TIMESTAMP '{STEPS[1]}' THEN 1 ELSE 2 END AS step FROM orders),
last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY step DESC, o_orderkey DESC) = 1),
first AS (SELECT k, min(step) AS began FROM o GROUP BY k)
SELECT last.k, o_orderkey, o_orderstatus, o_orderdate,
  CASE WHEN step < 2 THEN 'keep' WHEN began < 2 THEN 'update' ELSE 'insert' END AS merge_action
FROM last JOIN first ON last.k IS NOT DISTINCT FROM first.k"""),
    "cdc_bucketed": (cdc_bucketed, RB.ROBUST["cdc_replay"][1]),
    "source_splits": (source_splits, f"""
WITH b AS (SELECT list_distinct([{", ".join(f"quantile_disc(o_totalprice, {(2 * k + 2) / (2 * SPLITS)})" for k in range(SPLITS - 1))}]) AS p FROM orders),
s AS (SELECT CAST(len(list_filter(p, lambda x: x <= o_totalprice)) AS INTEGER) AS split, o_totalprice FROM orders, b)
SELECT split, count(*) AS n_rows, min(o_totalprice) AS low, max(o_totalprice) AS high FROM s GROUP BY split"""),
    "published_cascade": (published_cascade, O.ORACLE_SQL["cascade_delete"]),
    "composite_master": (composite_master, _COMPOSITE + f"""
SELECT connection_id, concat('conn_', CAST(s_suppkey % 40 AS VARCHAR)) AS connection_name, {_TYPES} AS connection_type,
  concat('domain_', CAST(s_nationkey AS VARCHAR)) AS connection_domain_name, s_suppkey % 4 = 0 AS is_target, env AS env_type, true AS is_active,
  'system' AS created_by, 'system' AS updated_by, {_NOW} AS created_at FROM who"""),
    "composite_auth": (composite_auth, _COMPOSITE + """
SELECT row_number() OVER (ORDER BY connection_id) AS connection_auth_id, connection_id, CAST(1 AS BIGINT) AS auth_property_id, 'username' AS auth_property,
  concat('u', CAST(s_suppkey AS VARCHAR)) AS auth_property_value, env AS env_type, true AS is_active, 'system' AS created_by FROM who"""),
    "composite_rejects": (composite_rejects, _COMPOSITE + """
SELECT request_seq, connection_name, env_type, error_code FROM checked WHERE error_code IS NOT NULL"""),
    "published_create": (published_create, _COMPOSITE + """
SELECT CAST(n_nationkey AS BIGINT) AS connection_id, concat('conn_', CAST(n_nationkey AS VARCHAR)) AS connection_name,
  CAST(0 AS BIGINT) AS n_connection_details, CAST(0 AS BIGINT) AS n_connection_auth FROM nation
UNION ALL SELECT connection_id, concat('conn_', CAST(s_suppkey % 40 AS VARCHAR)), 3, 1 FROM who"""),
    "bts_create": (bts_create, f"""
SELECT row_number() OVER (ORDER BY p_partkey) AS bts_config_id, p_name AS dataset_name, CASE WHEN p_size > 45 THEN NULL ELSE p_partkey END AS source_config_id,
  '[]' AS silver_layout, CASE WHEN p_size % 3 = 0 THEN concat('[{{"rule_name":"size_pos","expression":"p_size > ', CAST(p_size AS VARCHAR), '"}}]') ELSE '[]' END AS dq_rules,
  '[]' AS std_rules, CASE WHEN p_brand = 'Brand#1' THEN concat('["hot","', p_type, '"]') ELSE '[]' END AS tags,
  CASE WHEN p_size % 2 = 0 THEN 'qa' ELSE 'dev' END AS env_type, true AS is_active, 'maker' AS created_by, {_NOW} AS created_at FROM part"""),
    "bts_update": (bts_update, """
WITH c AS (SELECT l_partkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS bts_config_id, CASE WHEN p_size % 10 <> 0 AND n > 3 THEN concat('set_', CAST(n AS VARCHAR)) ELSE p_name END AS dataset_name,
  CASE WHEN p_size % 10 <> 0 AND n % 2 = 0 THEN concat('["n","', CAST(n AS VARCHAR), '"]') ELSE '[]' END AS tags, p_size % 10 <> 0 AS is_active,
  CASE WHEN p_size % 10 <> 0 AND n IS NOT NULL THEN 'editor' ELSE 'seed' END AS updated_by FROM part LEFT JOIN c ON k = p_partkey"""),
    "bts_update_rejects": (bts_update_rejects, """
SELECT k AS bts_config_id, seq AS request_seq, 'PIPELINE_CONFIG_NOT_FOUND' AS error_code
FROM (SELECT l_partkey AS k, max(l_orderkey) AS seq FROM lineitem GROUP BY l_partkey UNION ALL SELECT -s_suppkey, s_suppkey FROM supplier) c
WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0)"""),
    "run_metrics_merged": (run_metrics_merged, O._with(O.RUNS, """r AS (
  SELECT *, CAST(floor(epoch(end_time - start_time)) AS BIGINT) AS el FROM runs WHERE is_active)""") + """
SELECT table_config_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(el) AS BIGINT) AS timed, count(*) FILTER (status = 'succeeded') / count(*) AS success_rate,
  CAST(sum(el) AS DOUBLE) / count(el) AS avg_elapsed, quantile_disc(el, 0.95) AS p_elapsed FROM r GROUP BY table_config_id"""),
}

STORED_QUERIES = {k: v[0] for k, v in STORED.items()}
STORED_SQL = {k: v[1] for k, v in STORED.items()}
