"""Registered queries over states as they are stored (text watermarks, 0/1 flags, several
classifications of a column) and over inputs with NULL, repeated, late and unknown keys,
each with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import conform as C
from sluice.operators import load as L
from sluice.operators import mutate as M
from sluice.operators import privacy as P
from sluice.operators import quality as Q
from sluice.operators import reads as R
from sluice.operators import validate as V
from sluice.plans import catalog as K
from sluice.plans.oracle import CONFIGS, RUNS
from sluice.schemas import TABLES
from sluice.sources import lenses
from sluice.sources.tables import read_table

E = F.expr
NOW, CUT = K.NOW, K.CDC_CUT
UPSERT_CUT = "1998-01-01 00:00:00"


def _stored_watermarks(spark, sf, kind: str) -> DataFrame:
    """tbl_watermark as registered (last_value text) from events before the cut: every fifth
    config has no watermark yet, every fifth an unreadable value."""
    col = "ts" if kind == "timestamp" else "event_id"
    ev = read_table(spark, sf, "events").filter((F.col("ts") < F.lit(CUT).cast("timestamp_ntz")) & E("user_id % 5 <> 0"))
    wm = ev.groupBy(F.col("user_id").alias("table_config_id")).agg(F.max("event_id").alias("watermark_id"), F.max(col).alias("_v"))
    text = L.canonical_text("_v", wm.schema["_v"].dataType)
    wm = wm.withColumns({
        "last_value": F.when(E("table_config_id % 5 = 1"), F.lit("12 x")).otherwise(text),
        "watermark_column": F.lit(col), "watermark_type": F.lit(kind), "last_run_id": F.lit("seed_run"), "env_type": F.lit("dev")}).drop("_v")
    return C.conform(K._seeded(wm), TABLES["tbl_watermark"])


def _loop(spark, sf, kind: str) -> DataFrame:
    """R02 -> R04 -> D33 on the registered schema, with one upper bound fixed at run start."""
    col = "ts" if kind == "timestamp" else "event_id"
    state = _stored_watermarks(spark, sf, kind)
    ev = read_table(spark, sf, "events").select("user_id", col)
    got = L.incremental_by_config(ev, state, "user_id", col, watermark_type=kind, upper=L.upper_bound(ev, col))
    adv = L.advance_watermark(state, got, "user_id", col, watermark_type=kind)
    ups = L.watermark_upserts(adv, col, kind, "run_loop", actor="loader", as_text=True)
    out = M.upsert_watermark(state, ups, NOW, ["watermark_column", "watermark_type", "last_value", "last_run_id"])
    return out.select("watermark_id", "table_config_id", "watermark_type", "last_value", "last_run_id", "created_by", "updated_by")


def watermark_loop(spark, sf):
    return _loop(spark, sf, "timestamp")


def watermark_loop_integer(spark, sf):
    return _loop(spark, sf, "integer")


def watermark_rejects(spark, sf):
    parts = [L.typed_watermarks(_stored_watermarks(spark, sf, kind), kind)[1] for kind in ("timestamp", "integer")]
    return parts[0].unionByName(parts[1]).select("watermark_id", "table_config_id", "watermark_type", "last_value", "error_code")


def _loop_sql(kind: str) -> str:
    col = "ts" if kind == "timestamp" else "event_id"
    text = (lambda e: f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%f')") if kind == "timestamp" else (lambda e: f"CAST({e} AS VARCHAR)")
    return f"""
WITH wm AS (SELECT max(event_id) AS watermark_id, user_id AS c, max({col}) AS v FROM events
  WHERE ts < TIMESTAMP '{CUT}' AND user_id % 5 <> 0 GROUP BY user_id),
got AS (SELECT user_id AS c, max({col}) AS mx FROM events e LEFT JOIN wm ON wm.c = e.user_id
  WHERE wm.c IS NULL OR (wm.c % 5 <> 1 AND e.{col} > wm.v) GROUP BY user_id)
SELECT watermark_id, wm.c AS table_config_id, '{kind}' AS watermark_type,
  CASE WHEN wm.c % 5 = 1 THEN '12 x' ELSE {text("greatest(v, mx)")} END AS last_value,
  CASE WHEN mx IS NULL THEN 'seed_run' ELSE 'run_loop' END AS last_run_id, 'seed' AS created_by,
  CASE WHEN mx IS NULL THEN 'seed' ELSE 'loader' END AS updated_by
FROM wm LEFT JOIN got ON got.c = wm.c
UNION ALL
SELECT (SELECT max(watermark_id) FROM wm) + row_number() OVER (ORDER BY c), c, '{kind}', {text("mx")}, 'run_loop', 'loader', 'loader'
FROM got WHERE c NOT IN (SELECT c FROM wm)"""


def cdc_replay(spark, sf):
    """R06 where the batch holds everything again: old changes are skipped by last_seq, keys
    may be NULL, new keys start from their whole history, other target columns stay."""
    ev = read_table(spark, sf, "events").withColumn("k", E("CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id END"))
    cut = F.lit(CUT).cast("timestamp_ntz")
    op = E("CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END")
    changes = ev.select("k", "event_id", "event_type", "value", op.alias("op"))
    old = L.latest_by_key(ev.filter((F.col("ts") < cut) & E("user_id % 10 <> 0")).select("k", "event_id", "event_type", "value"), ["k"], ["event_id"])
    target = old.select("k", "event_type", "value", F.concat(F.lit("note "), F.coalesce(F.col("k").cast("string"), F.lit("-"))).alias("note"),
                        F.lit(True).alias("is_active"), F.col("event_id").alias("last_seq"))
    return L.cdc_apply(target, changes, ["k"], "event_id", "op", ["event_type", "value"])


def hash_changes_nulls(spark, sf):
    """R03 with NULL keys and NULL stored hashes."""
    cols = ["k", "c_name"]
    c = read_table(spark, sf, "customer").groupBy(E("CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END").alias("k")).agg(F.min("c_name").alias("c_name"))
    target = c.filter(E("k IS NULL OR k % 7 <> 0")).select("k", F.when(E("k % 11 = 0"), F.lit(None)).otherwise(L.row_hash(cols)).alias("row_hash"))
    return L.hash_changes(c, target, ["k"], cols).select("k", "c_name", "change_kind")


def upsert_twice(spark, sf):
    """R05 with NULL keys: the batch applied twice gives the rows of applying it once."""
    o = read_table(spark, sf, "orders").select(
        E("CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END").alias("k"), "o_orderkey", "o_orderstatus", "o_orderdate")
    cut = F.lit(UPSERT_CUT).cast("timestamp_ntz")
    target = L.latest_by_key(o.filter(F.col("o_orderdate") < cut).drop("o_orderdate"), ["k"], ["o_orderkey"])
    batch = o.filter(F.col("o_orderdate") >= cut).drop("o_orderdate")
    once = L.upsert_by_key(target, batch, ["k"], ["o_orderkey"]).drop("merge_action")
    return L.upsert_by_key(once, batch, ["k"], ["o_orderkey"])


TWICE = [
    {"column_name": "c_name", "protection_method": "MASK", "masking_policy": "last4", "access_tier": "PUBLIC"},
    {"column_name": "c_name", "protection_method": "PSEUDONYMIZE", "access_tier": "HIGHLY_RESTRICTED"},
    {"column_name": "c_mktsegment", "protection_method": "REDACT", "access_tier": "RESTRICTED"},
    {"column_name": "c_mktsegment", "protection_method": "MASK", "access_tier": "PUBLIC"},
    {"column_name": "short", "protection_method": "MASK", "masking_policy": "last4", "access_tier": "INTERNAL"},
]


def _both_orders(spark, sf, view) -> DataFrame:
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.substring("c_name", 1, 4).alias("short"))
    parts = [view(c, rows).withColumn("row_order", F.lit(name)) for name, rows in (("given", TWICE), ("reversed", TWICE[::-1]))]
    return parts[0].unionByName(parts[1])


def protect_strictest(spark, sf):
    return _both_orders(spark, sf, lambda c, rows: P.protect(c, rows, salt=K.PII_SALT))


def tier_strictest(spark, sf):
    return _both_orders(spark, sf, lambda c, rows: P.tier_view(c, rows, "INTERNAL"))


def _configs(spark, sf):
    return K._seeded(lenses.configs(spark, sf).select("table_config_id", "is_active"))


def _guarded(spark, sf) -> dict[str, dict[str, DataFrame]]:
    """D25 in front of D31-D34 and D36; parents are the active configs (or runs)."""
    configs = _configs(spark, sf)
    orders = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("table_config_id"), F.col("o_orderkey").alias("request_seq"), F.col("o_orderdate").alias("last_value"))
    ups = orders.withColumns({"watermark_column": F.lit("o"), "watermark_type": F.lit("timestamp"), "last_run_id": F.lit("r"), "updated_by": F.lit("loader")})
    fields = ["watermark_column", "watermark_type", "last_value", "last_run_id"]
    versions = C.empty_table(spark, "tbl_schema_version")
    runs = K._seeded(lenses.runs(spark, sf))
    closes = read_table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("table_run_id"), F.col("event_id").alias("request_seq"), F.lit("succeeded").alias("status"), F.lit("closer").alias("updated_by"))
    ids = read_table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("table_config_id"), F.col("c_custkey").alias("request_seq"))
    pii = ids.select("table_config_id", F.lit("text").alias("column_name"), F.lit("email").alias("pii_category"), F.lit("qa").alias("env_type"))
    return {
        "D31": M.guarded(ids, configs, "table_config_id", lambda ok: M.cascade_soft_delete(configs, {}, ok, NOW, "cascader")["tbl_source_table"]),
        "D32": M.guarded(ids, configs, "table_config_id", lambda ok: M.replace_children(
            C.empty_table(spark, "tbl_pii_attribute"), ok, pii, "table_config_id", "pii_id", ["table_config_id"], NOW, "scanner")),
        "D33": M.guarded(ups, configs, "table_config_id", lambda ok: M.upsert_watermark(K._wm_state(spark, sf), ok, NOW, fields)),
        "D34": M.guarded(orders.withColumn("change_type", F.lit("additive")), configs, "table_config_id", lambda ok: M.add_schema_versions(versions, ok, NOW)),
        "D36": M.guarded(closes, runs, "table_run_id", lambda ok: M.close_runs(runs, ok, NOW), code="AUDIT_RUN_NOT_FOUND"),
    }


def guarded_rejects(spark, sf):
    out = None
    for name, parts in _guarded(spark, sf).items():
        key = "table_run_id" if name == "D36" else "table_config_id"
        rows = parts["rejects"].select(F.lit(name).alias("operator"), F.col(key).alias("parent"), "request_seq", "error_code")
        out = rows if out is None else out.unionByName(rows)
    return out


def guarded_pii(spark, sf):
    return _guarded(spark, sf)["D32"]["state"].select("pii_id", "table_config_id", "column_name", "env_type", "is_active", "created_by")


def guarded_watermarks(spark, sf):
    return _guarded(spark, sf)["D33"]["state"].select("watermark_id", "table_config_id", "last_value", "updated_by")


def open_run_rejects(spark, sf):
    reqs = read_table(spark, sf, "events").select(
        E("concat('open_', CAST(event_id AS STRING))").alias("run_id"), F.col("user_id").alias("table_config_id"),
        E("CASE WHEN event_type <> 'click' THEN ts END").alias("start_time"), F.col("event_id").alias("request_seq"))
    return M.run_rejects(reqs).select("run_id", "table_config_id", "request_seq", "error_code")


def soft_delete_stored_flags(spark, sf):
    """D30 and D32 on a state that stores flags as 0/1."""
    state = K._details_state(spark, sf).withColumn("is_active", F.col("is_active").cast("int"))
    sup = read_table(spark, sf, "supplier").filter("s_acctbal > 5000")
    new = sup.select(F.col("s_suppkey").alias("connection_id"), F.lit(9).cast("long").alias("connection_property_id"),
                     F.lit("k").alias("connection_property"), F.col("s_name").alias("connection_property_value"))
    out = M.replace_children(state, sup.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("connection_id")), new,
                             "connection_id", "connection_details_id", ["connection_id"], NOW, "replacer")
    return out.select("connection_details_id", "connection_id", "connection_property", "connection_property_value", "is_active", "updated_by")


def bulk_report(spark, sf):
    """D26 per failed request: its index and error."""
    return V.rejected(V.bulk_validate(lenses.configs(spark, sf))).select(F.col("request_seq").alias("index"), F.col(V.ERROR).alias("error"))


def pii_history(spark, sf):
    """D11 for PII rows: the active classifications of every config, newest first."""
    rows = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("table_config_id"), F.col("o_orderkey").alias("pii_id"), E("lower(o_orderstatus)").alias("column_name"),
        E("o_orderkey % 10 <> 0").alias("is_active"))
    return R.child_history(rows, "table_config_id", "pii_id").select("table_config_id", "pii_id", "column_name", "position")


def dq_good_rows(spark, sf):
    good, _ = Q.apply_fail_mode(read_table(spark, sf, "lineitem"), K.DQ_RULES, "skip")
    return good.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


RAISING = [{"rule_name": "digits", "expression": "CAST(substr(c_name, 10, 20) AS INT) > 100"}, {"rule_name": "text_number", "expression": "CAST(c_mktsegment AS INT) >= 0"},
           {"rule_name": "ratio", "expression": "1 / (c_custkey % 3) > 0"}]


def dq_raising_rules(spark, sf):
    """R15 with rules that fail on some values: those rows fail the rule, the job goes on."""
    return Q.evaluate_rules(read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), RAISING).select(
        "c_custkey", F.array_join(Q.FAILED, ",").alias("failed_rules"))


_MASKED = "regexp_replace(regexp_replace(regexp_replace({v}, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"
_ORDERS = "(VALUES ('given'), ('reversed')) o(row_order)"
_ALIVE = "(SELECT table_config_id FROM configs WHERE is_active)"

ROBUST: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "watermark_loop": (watermark_loop, _loop_sql("timestamp")),
    "watermark_loop_integer": (watermark_loop_integer, _loop_sql("integer")),
    "watermark_rejects": (watermark_rejects, f"""
SELECT max(event_id) AS watermark_id, user_id AS table_config_id, kind AS watermark_type, '12 x' AS last_value, 'INVALID_WATERMARK' AS error_code
FROM events, (VALUES ('timestamp'), ('integer')) k(kind) WHERE ts < TIMESTAMP '{CUT}' AND user_id % 5 = 1 GROUP BY user_id, kind"""),
    "cdc_replay": (cdc_replay, f"""
WITH e AS (SELECT CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id END AS k, event_id, event_type, value, ts, user_id,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events),
t AS (SELECT k, event_type, value, 'note ' || coalesce(CAST(k AS VARCHAR), '-') AS note, event_id AS last_seq FROM e
  WHERE ts < TIMESTAMP '{CUT}' AND user_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1),
c AS (SELECT e.k, max(event_id) AS seq, arg_max(op, event_id) AS last_op, arg_max(e.event_type, event_id) FILTER (op <> 'D') AS et,
    arg_max(e.value, event_id) FILTER (op <> 'D') AS v, count(*) FILTER (op <> 'D') AS writes
  FROM e LEFT JOIN t ON t.k IS NOT DISTINCT FROM e.k WHERE t.last_seq IS NULL OR e.event_id > t.last_seq GROUP BY e.k)
SELECT t.k, CASE WHEN c.writes > 0 THEN c.et ELSE t.event_type END AS event_type, CASE WHEN c.writes > 0 THEN c.v ELSE t.value END AS value, note,
  CASE WHEN c.seq IS NULL THEN true ELSE c.last_op <> 'D' END AS is_active, coalesce(c.seq, t.last_seq) AS last_seq
FROM t LEFT JOIN c ON c.k IS NOT DISTINCT FROM t.k
UNION ALL
SELECT c.k, et, v, NULL, last_op <> 'D', seq FROM c WHERE writes > 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.k IS NOT DISTINCT FROM c.k)"""),
    "hash_changes_nulls": (hash_changes_nulls, """
WITH c AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, min(c_name) AS c_name FROM customer GROUP BY 1)
SELECT k, c_name, CASE WHEN k % 7 = 0 THEN 'new' ELSE 'changed' END AS change_kind FROM c WHERE k % 7 = 0 OR k % 11 = 0"""),
    "upsert_twice": (upsert_twice, f"""
WITH o AS (SELECT CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey, o_orderstatus, o_orderdate FROM orders),
b AS (SELECT * EXCLUDE (o_orderdate) FROM o WHERE o_orderdate >= TIMESTAMP '{UPSERT_CUT}' QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1),
t AS (SELECT * EXCLUDE (o_orderdate) FROM o WHERE o_orderdate < TIMESTAMP '{UPSERT_CUT}' QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1)
SELECT *, 'update' AS merge_action FROM b
UNION ALL SELECT *, 'keep' FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM t.k)"""),
    "protect_strictest": (protect_strictest, f"""
SELECT c_custkey, sha256('{K.PII_SALT}' || c_name) AS c_name, CASE WHEN c_mktsegment IS NULL THEN NULL ELSE '[REDACTED]' END AS c_mktsegment,
  {_MASKED.format(v="substr(c_name, 1, 4)")} AS short, row_order FROM customer, {_ORDERS}"""),
    "tier_strictest": (tier_strictest, f"""
SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE '[REDACTED]' END AS c_name, CASE WHEN c_mktsegment IS NULL THEN NULL ELSE '[REDACTED]' END AS c_mktsegment,
  substr(c_name, 1, 4) AS short, row_order FROM customer, {_ORDERS}"""),
    "guarded_rejects": (guarded_rejects, f"""
WITH {CONFIGS}, {RUNS}, dead AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN {_ALIVE})
SELECT op AS operator, k AS parent, k AS request_seq, 'PIPELINE_CONFIG_NOT_FOUND' AS error_code FROM dead, (VALUES ('D31'), ('D32')) x(op)
UNION ALL SELECT op, o_custkey, o_orderkey, 'PIPELINE_CONFIG_NOT_FOUND' FROM orders, (VALUES ('D33'), ('D34')) x(op) WHERE o_custkey NOT IN {_ALIVE}
UNION ALL SELECT 'D36', event_id, event_id, 'AUDIT_RUN_NOT_FOUND' FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT table_run_id FROM runs WHERE is_active)"""),
    "guarded_pii": (guarded_pii, f"""
WITH {CONFIGS}
SELECT row_number() OVER (ORDER BY c_custkey) AS pii_id, c_custkey AS table_config_id, 'text' AS column_name, 'qa' AS env_type, true AS is_active, 'scanner' AS created_by
FROM customer WHERE c_acctbal < 0 AND c_custkey IN {_ALIVE}"""),
    "guarded_watermarks": (guarded_watermarks, f"""
WITH {CONFIGS}, wm AS (SELECT max(event_id) AS watermark_id, user_id AS table_config_id, max(ts) AS last_value FROM events
  WHERE ts < TIMESTAMP '{CUT}' GROUP BY user_id),
up AS (SELECT o_custkey AS table_config_id, o_orderdate AS v FROM orders WHERE o_custkey IN {_ALIVE}
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT watermark_id, table_config_id, coalesce(v, last_value) AS last_value, CASE WHEN v IS NULL THEN 'seed' ELSE 'loader' END AS updated_by FROM wm LEFT JOIN up USING (table_config_id)
UNION ALL SELECT (SELECT max(watermark_id) FROM wm) + row_number() OVER (ORDER BY table_config_id), table_config_id, v, 'loader'
FROM up WHERE table_config_id NOT IN (SELECT table_config_id FROM wm)"""),
    "open_run_rejects": (open_run_rejects, """
SELECT concat('open_', CAST(event_id AS VARCHAR)) AS run_id, user_id AS table_config_id, event_id AS request_seq, 'MISSING_REQUIRED_FIELD' AS error_code
FROM events WHERE event_type = 'click'"""),
    "soft_delete_stored_flags": (soft_delete_stored_flags, """
WITH d AS (SELECT s_suppkey AS c, 1 AS p, 'host' AS k, s_name AS v, 1 AS a FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'port', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '5432' END, 1 FROM supplier
  UNION ALL SELECT s_suppkey, 3, 'host', 'override', CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END FROM supplier
  UNION ALL SELECT s_suppkey, 4, NULL, 'ignored', 1 FROM supplier),
par AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000 AND s_suppkey % 2 = 0)
SELECT c * 10 + p AS connection_details_id, c AS connection_id, k AS connection_property, v AS connection_property_value,
  CAST(CASE WHEN c IN (SELECT s_suppkey FROM par) THEN 0 ELSE a END AS INTEGER) AS is_active,
  CASE WHEN a = 1 AND c IN (SELECT s_suppkey FROM par) THEN 'replacer' ELSE 'seed' END AS updated_by FROM d
UNION ALL SELECT (SELECT max(c * 10 + p) FROM d) + row_number() OVER (ORDER BY s_suppkey), s_suppkey, 'k', s_name, 1, 'replacer' FROM par"""),
    "bulk_report": (bulk_report, f"""
WITH {CONFIGS}
SELECT table_config_id AS "index", CASE WHEN load_type = 'bogus' THEN 'INVALID_LOAD_TYPE' WHEN table_config_id % 5 = 3 THEN 'MISSING_REQUIRED_FIELD'
  ELSE 'INVALID_SOURCE_ATTRIBUTES' END AS error FROM configs WHERE load_type = 'bogus' OR table_config_id % 5 IN (1, 3, 4)"""),
    "pii_history": (pii_history, """
SELECT o_custkey AS table_config_id, o_orderkey AS pii_id, lower(o_orderstatus) AS column_name,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS position FROM orders WHERE o_orderkey % 10 <> 0"""),
    "dq_good_rows": (dq_good_rows, """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 45 AND l_discount BETWEEN 0 AND 0.08
  AND l_tax < 0.07 AND l_returnflag IN ('A', 'N', 'R') AND l_shipdate < TIMESTAMP '2001-06-01'"""),
    "dq_raising_rules": (dq_raising_rules, """
SELECT c_custkey, concat_ws(',', CASE WHEN coalesce(TRY_CAST(substr(c_name, 10, 20) AS INTEGER) > 100, false) THEN NULL ELSE 'digits' END,
  'text_number', CASE WHEN c_custkey % 3 = 0 THEN 'ratio' END) AS failed_rules FROM customer"""),
}

ROBUST_QUERIES = {k: v[0] for k, v in ROBUST.items()}
ROBUST_SQL = {k: v[1] for k, v in ROBUST.items()}
