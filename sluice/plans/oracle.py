"""DuckDB SQL for every registered query, written independently of the Spark plans, over
the driver's pre-registered views. Same column names and types as the Spark results."""

from __future__ import annotations

from sluice.schemas import AUTH_FIELDS, CONNECTOR_REGISTRY

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
SEED = "TIMESTAMP '2024-01-01 00:00:00'"

RUNS = """runs AS (
  SELECT event_id AS table_run_id, concat('run_', CAST(event_id % 997 AS VARCHAR)) AS run_id, user_id AS table_config_id,
    user_id % 25 AS connection_source_id, ts AS start_time,
    CASE WHEN event_type = 'signup' THEN NULL ELSE ts + to_seconds(event_id % 600) END AS end_time,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS status,
    CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'connection' WHEN event_id % 3 = 1 THEN 'dq' ELSE 'timeout' END AS error_type,
    CAST(floor(value * 10) AS BIGINT) AS rows_read,
    CAST(floor(value * 10) AS BIGINT) - CASE WHEN event_id % 7 = 0 AND value >= 1 THEN 1 ELSE 0 END AS rows_written,
    CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END AS env_type, event_id % 10 <> 0 AS is_active
  FROM events)"""

CONFIGS = """configs AS (
  SELECT c_custkey AS table_config_id, CAST(c_nationkey AS BIGINT) AS connection_source_id, lower(c_mktsegment) AS connection_domain_name,
    concat('grp_', CAST(c_custkey % 7 AS VARCHAR)) AS config_group,
    CASE c_custkey % 5 WHEN 0 THEN '{"schema":"main","table":"orders"}' WHEN 1 THEN '{"schema":"missing_table"}'
      WHEN 2 THEN '{"file_path":"/in","file_type":"csv"}' WHEN 3 THEN '{"file_path":null}' ELSE '{"schema":"","table":"t"}' END AS source_attributes,
    CASE c_custkey % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' WHEN 2 THEN 'cdc' WHEN 3 THEN 'api' WHEN 4 THEN 'file_autoloader'
      WHEN 5 THEN 'full' ELSE 'bogus' END AS load_type,
    CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'adhoc' END AS ingestion_frequency,
    CASE c_custkey % 3 WHEN 0 THEN '["pii","finance"]' WHEN 1 THEN '[]' ELSE NULL END AS tags,
    CASE c_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END AS env_type, c_custkey % 10 <> 0 AS is_active, c_custkey AS request_seq
  FROM customer)"""

CONNECTIONS = """conns AS (
  SELECT s_suppkey AS connection_id, concat('conn_', CAST(s_suppkey % 40 AS VARCHAR)) AS connection_name,
    CASE s_suppkey % 6 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mssql' WHEN 2 THEN 's3' WHEN 3 THEN 'local' WHEN 4 THEN 'snowflake' ELSE 'sqlite' END AS connection_type,
    CASE s_suppkey % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'kerberos' WHEN 2 THEN 'iam' WHEN 3 THEN 'none' ELSE 'key' END AS auth_type,
    concat('domain_', CAST(s_nationkey AS VARCHAR)) AS connection_domain_name, s_suppkey % 4 = 0 AS is_target,
    CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env_type, s_suppkey % 10 <> 0 AS is_active, s_suppkey AS request_seq
  FROM supplier)"""

DETAILS = """details AS (
  SELECT s_suppkey AS connection_id, CAST(1 AS BIGINT) AS connection_property_id, 'host' AS connection_property, s_name AS connection_property_value, true AS is_active FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'port', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '5432' END, true FROM supplier
  UNION ALL SELECT s_suppkey, 3, 'host', 'override', s_suppkey % 2 = 0 FROM supplier
  UNION ALL SELECT s_suppkey, 4, NULL, 'ignored', true FROM supplier)"""

VERSIONS = """versions AS (
  SELECT o_custkey AS table_config_id, o_orderkey AS request_seq, CASE WHEN o_orderstatus = 'P' THEN 'deletion' ELSE 'additive' END AS change_type,
    o_orderdate AS created_at, o_orderkey % 10 <> 0 AS is_active
  FROM orders)"""

WATERMARKS = """wm AS (
  SELECT max(event_id) AS watermark_id, user_id AS table_config_id, 'ts' AS watermark_column, 'timestamp' AS watermark_type, max(ts) AS last_value
  FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)"""

AUTH_ROWS = """auth_keys AS (
  SELECT s_suppkey AS connection_id, CASE s_suppkey % 6 WHEN 1 THEN ['principal','keytab_path']
    WHEN 2 THEN ['client_id','client_secret','token_url'] WHEN 3 THEN ['iam_credentials'] WHEN 4 THEN ['api_key']
    WHEN 5 THEN ['principal'] ELSE []::VARCHAR[] END AS keys FROM supplier)"""

AUTH_TYPE_CASE = """CASE WHEN len(keys) = 0 THEN 'none' WHEN list_has_all(keys, ['principal','keytab_path']) THEN 'kerberos'
  WHEN list_has_all(keys, ['client_id','client_secret','token_url']) THEN 'oauth' WHEN list_contains(keys, 'iam_credentials') THEN 'iam'
  WHEN list_contains(keys, 'api_key') THEN 'key' ELSE 'basic' END"""


def _values(rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _registry_methods() -> str:
    rows = [(k, m) for k, _l, _b, _d, methods in CONNECTOR_REGISTRY for m in methods]
    return f"reg(connector, auth_method) AS (VALUES\n  {_values(rows)})"


def _registry_fields() -> str:
    rows = []
    for k, _l, base, defaults, methods in CONNECTOR_REGISTRY:
        for auth in methods:
            for f in base:
                rows.append((k, auth, "base", f, defaults.get(f)))
            for f in AUTH_FIELDS[auth]:
                rows.append((k, auth, "auth", f, None))
    return f"fields(connector, auth_type, field_kind, field_name, default_value) AS (VALUES\n  {_values(rows)})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CONNECTOR_CODE = """CASE WHEN c.connection_type NOT IN (SELECT connector FROM reg) THEN 'INVALID_CONNECTOR_TYPE'
  WHEN NOT EXISTS (SELECT 1 FROM reg r WHERE r.connector = c.connection_type AND r.auth_method = c.auth_type) THEN 'INVALID_AUTH_TYPE' END"""

SOURCE_CODE = """CASE WHEN list_contains(json_keys(source_attributes), 'file_path') AND coalesce(json_extract_string(source_attributes, '$.file_type'), '') = ''
    THEN 'MISSING_REQUIRED_FIELD'
  WHEN NOT list_contains(json_keys(source_attributes), 'file_path')
    AND (coalesce(json_extract_string(source_attributes, '$.schema'), '') = '' OR coalesce(json_extract_string(source_attributes, '$.table'), '') = '')
    THEN 'INVALID_SOURCE_ATTRIBUTES' END"""

LOAD_CODE = "CASE WHEN load_type IS NULL OR load_type NOT IN ('full','incremental','cdc','api','file_autoloader') THEN 'INVALID_LOAD_TYPE' END"

EXISTING_MASTER = """ex AS (SELECT CAST(n_nationkey AS BIGINT) AS connection_id, concat('conn_', CAST(n_nationkey AS VARCHAR)) AS connection_name,
  CASE n_nationkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env_type FROM nation)"""

UNIQUE_CHAIN = """c1 AS (SELECT c.*, coalesce(""" + CONNECTOR_CODE + """,
    CASE WHEN EXISTS (SELECT 1 FROM ex WHERE ex.connection_name = c.connection_name AND ex.env_type = c.env_type)
      THEN 'DUPLICATE_CONNECTION_NAME' END) AS code1 FROM conns c),
firsts AS (SELECT connection_name, env_type, min(request_seq) AS first_seq FROM c1 WHERE code1 IS NULL GROUP BY 1, 2),
checked AS (SELECT c1.*, coalesce(code1, CASE WHEN request_seq <> first_seq THEN 'DUPLICATE_CONNECTION_NAME' END) AS error_code
  FROM c1 LEFT JOIN firsts USING (connection_name, env_type))"""

DQ_CASES = [
    ("qty_positive", "l_quantity > 0"),
    ("qty_max", "l_quantity <= 45"),
    ("discount_range", "l_discount BETWEEN 0 AND 0.08"),
    ("tax_small", "l_tax < 0.07"),
    ("flag_valid", "l_returnflag IN ('A', 'N', 'R')"),
    ("ship_known", "l_shipdate < TIMESTAMP '2001-06-01'"),
]


def _row_hash_sql(cols: list[str]) -> str:
    parts = [f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '~')" for c in cols]
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


HASH = _row_hash_sql(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])

MASK = "regexp_replace(regexp_replace(regexp_replace({v}, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"

LUHN = """list_sum(list_transform(range(length(t)), lambda i: CASE WHEN i % 2 = 1
    THEN (CASE WHEN CAST(substr(t, length(t) - i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr(t, length(t) - i, 1) AS INTEGER) * 2 - 9
          ELSE CAST(substr(t, length(t) - i, 1) AS INTEGER) * 2 END)
    ELSE CAST(substr(t, length(t) - i, 1) AS INTEGER) END)) % 10 = 0"""


def _pii_scan_sql() -> str:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    phone = r"\(\d{3}\) ?\d{3}[- ]\d{4}|\b\d{3}[-. ]\d{3}[-. ]\d{4}\b|\+\d{1,3}[- ]?\(?\d{1,4}\)?([- ]\d{2,4}){2,4}\b"
    nid = r"\b\d{3}-\d{2}-\d{4}\b"
    card = r"\b\d(?:[ -]?\d){12,18}\b"
    per_col = []
    for c in ["text", "lang", "source"]:
        per_col.append(f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n,
      CAST(count_if(regexp_matches({c}, '{email}')) AS BIGINT) AS m_email,
      CAST(count_if(regexp_matches({c}, '{phone}')) AS BIGINT) AS m_phone,
      CAST(count_if(regexp_matches({c}, '{nid}')) AS BIGINT) AS m_national_id,
      CAST(count_if(coalesce(list_bool_or(list_transform(list_transform(regexp_extract_all({c}, '{card}'), lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda t: {LUHN})), false)) AS BIGINT) AS m_financial
    FROM documents""")
    unions = "\n  UNION ALL ".join(per_col)
    cats = [("email", "MASK", "PII"), ("phone", "MASK", "PII"), ("national_id", "ENCRYPT", "PII"), ("financial", "ENCRYPT", "PCI")]
    sel = "\nUNION ALL ".join(
        f"SELECT column_name, '{cat}' AS pii_category, m_{cat} AS matching_rows, m_{cat} / n AS share, '{m}' AS suggested_protection, "
        f"'{s}' AS sensitivity FROM agg WHERE m_{cat} > 0" for cat, m, s in cats)
    return f"WITH agg AS (\n  {unions})\n{sel}"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["config_status"] = _with(CONFIGS, RUNS, """per AS (SELECT table_config_id, max(table_run_id) AS last_run_id,
    arg_max(status, table_run_id) AS last_status, arg_max(start_time, table_run_id) AS last_start_time,
    CAST(count(*) AS BIGINT) AS runs, CAST(count_if(status = 'succeeded') AS BIGINT) AS succeeded,
    CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(sum(rows_read) AS BIGINT) AS rows_read,
    CAST(sum(rows_written) AS BIGINT) AS rows_written
  FROM runs WHERE is_active GROUP BY table_config_id)""") + """
SELECT c.table_config_id, c.connection_source_id, c.config_group, c.load_type, c.env_type, p.last_run_id, p.last_status,
  p.last_start_time, p.runs, p.succeeded, p.failed, p.rows_read, p.rows_written
FROM configs c LEFT JOIN per p USING (table_config_id)
WHERE c.is_active AND c.env_type = 'dev' ORDER BY c.table_config_id DESC"""

    q["active_scan"] = _with(CONFIGS) + """SELECT table_config_id, connection_source_id, connection_domain_name, config_group, load_type, env_type
FROM configs WHERE is_active"""

    q["filtered_list"] = _with(CONFIGS) + """SELECT table_config_id, config_group, load_type, env_type, is_active
FROM configs WHERE env_type = 'qa' AND load_type = 'full' AND is_active"""

    q["search_page"] = _with(CONNECTIONS, """hits AS (SELECT * FROM conns WHERE is_active
    AND (contains(lower(connection_name), 'conn_1') OR contains(lower(connection_domain_name), 'conn_1')))""") + """
SELECT connection_id, connection_name, connection_domain_name, (SELECT count(*) FROM hits) AS total,
  CAST(ceil((SELECT count(*) FROM hits) / 5.0) AS BIGINT) AS total_pages
FROM hits ORDER BY connection_id DESC LIMIT 5 OFFSET 5"""

    q["keyset_page"] = _with(CONFIGS) + """SELECT table_config_id, config_group, env_type FROM configs
WHERE is_active AND table_config_id < 700 ORDER BY table_config_id DESC LIMIT 20"""

    q["audit_page"] = _with(RUNS, "hits AS (SELECT * FROM runs WHERE is_active AND status = 'failed')") + """
SELECT table_run_id, run_id, table_config_id, status, error_type, (SELECT count(*) FROM hits) AS total,
  CAST(ceil((SELECT count(*) FROM hits) / 20.0) AS BIGINT) AS total_pages
FROM hits ORDER BY table_run_id DESC LIMIT 20"""

    q["bts_search"] = """WITH hits AS (SELECT p_partkey AS bts_config_id, p_name AS dataset_name,
    CASE WHEN p_size > 45 THEN NULL ELSE p_partkey END AS source_config_id FROM part WHERE contains(lower(p_name), 'blue'))
SELECT bts_config_id, dataset_name, source_config_id, (SELECT count(*) FROM hits) AS total,
  CAST(ceil((SELECT count(*) FROM hits) / 20.0) AS BIGINT) AS total_pages
FROM hits ORDER BY bts_config_id DESC LIMIT 20"""

    q["lookup_ids"] = _with(CONFIGS) + """SELECT table_config_id, config_group, load_type, env_type FROM configs
WHERE is_active AND table_config_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""

    q["latest_per_key"] = """SELECT user_id AS table_config_id, max(event_id) AS watermark_id, arg_max(ts, event_id) AS last_value
FROM events WHERE event_id % 10 <> 0 GROUP BY user_id"""

    q["child_history"] = _with(VERSIONS) + """SELECT table_config_id, request_seq, change_type,
  row_number() OVER (PARTITION BY table_config_id ORDER BY request_seq DESC) AS position
FROM versions WHERE is_active"""

    q["conform_append"] = _with(CONFIGS) + """SELECT table_config_id, connection_source_id, connection_domain_name, config_group, source_attributes,
  CAST(NULL AS VARCHAR) AS target_attributes, load_type, CAST(NULL AS VARCHAR) AS natural_key_columns, CAST(NULL AS VARCHAR) AS hash_key_column,
  CAST(NULL AS VARCHAR) AS partition_columns, table_config_id % 2 <> 0 AS watermark_enabled, CAST(NULL AS BOOLEAN) AS pii_scan_enabled,
  CAST(NULL AS VARCHAR) AS fail_mode, CAST(NULL AS BIGINT) AS retry_count, ingestion_frequency, tags, env_type, is_active,
  'tester' AS created_by, TIMESTAMP '2024-03-09 07:15:42.250001' AS created_at, CAST(NULL AS VARCHAR) AS updated_by,
  CAST(NULL AS TIMESTAMP) AS updated_at
FROM configs"""

    q["evolve_add_column"] = _with(RUNS) + "SELECT table_run_id, connection_source_id, CAST(NULL AS BIGINT) AS connection_target_id, status FROM runs"

    q["normalise_flags"] = """SELECT s_suppkey AS connection_id, s_suppkey % 4 = 0 AS is_target, s_suppkey % 10 <> 0 AS is_active
FROM supplier WHERE s_suppkey % 4 = 0"""

    q["assign_ids"] = """SELECT o_orderkey, (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id
FROM orders"""

    q["time_ids"] = "SELECT event_id, ((epoch_us(ts) // 1000) << 22) | (event_id & 4194303) AS snowflake_id FROM events"

    q["map_to_eav"] = """SELECT s_suppkey AS connection_id, CAST(1 AS BIGINT) AS connection_property_id, 'host' AS connection_property,
  s_name AS connection_property_value, CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env_type FROM supplier
UNION ALL SELECT s_suppkey, 2, 'port', CAST(1000 + s_nationkey AS VARCHAR), CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END FROM supplier
UNION ALL SELECT s_suppkey, 3, 'database', concat('db_', CAST(s_nationkey AS VARCHAR)), CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END FROM supplier"""

    q["eav_to_map"] = _with(DETAILS, """kv AS (SELECT connection_id, connection_property AS k, min(connection_property_id) AS first_id,
    arg_max(coalesce(connection_property_value, ''), connection_property_id) AS v
  FROM details WHERE is_active AND connection_property IS NOT NULL GROUP BY 1, 2)""") + """
SELECT connection_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS details_text,
  string_agg(k, ',' ORDER BY first_id) AS key_order, CAST(count(*) AS BIGINT) AS n_keys
FROM kv GROUP BY connection_id"""

    q["auth_type"] = _with(AUTH_ROWS) + f"SELECT connection_id, {AUTH_TYPE_CASE} AS auth_type FROM auth_keys"

    q["connection_view"] = _with(CONNECTIONS, DETAILS, AUTH_ROWS, """kv AS (SELECT connection_id, connection_property AS k,
    arg_max(coalesce(connection_property_value, ''), connection_property_id) AS v
  FROM details WHERE is_active AND connection_property IS NOT NULL GROUP BY 1, 2)""",
        """dm AS (SELECT connection_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS details_text FROM kv GROUP BY 1)""",
        f"""am AS (SELECT connection_id, coalesce(list_aggregate(list_sort(list_transform(keys, lambda x: x || '=secret_' || CAST(connection_id AS VARCHAR))), 'string_agg', ','), '') AS auth_text,
    {AUTH_TYPE_CASE} AS auth_type FROM auth_keys)""") + """
SELECT c.connection_id, c.connection_name, c.connection_type, coalesce(dm.details_text, '') AS details_text,
  coalesce(am.auth_text, '') AS auth_text, coalesce(am.auth_type, 'none') AS auth_type
FROM conns c LEFT JOIN dm USING (connection_id) LEFT JOIN am USING (connection_id) WHERE c.is_active"""

    q["connection_page"] = _with(CONNECTIONS, DETAILS, AUTH_ROWS,
        """hits AS (SELECT * FROM conns WHERE is_active AND env_type = 'dev'
    AND (contains(lower(connection_name), 'conn_1') OR contains(lower(connection_domain_name), 'conn_1')))""",
        "pg AS (SELECT * FROM hits ORDER BY connection_id DESC LIMIT 20)",
        """kv AS (SELECT connection_id, connection_property AS k, arg_max(coalesce(connection_property_value, ''), connection_property_id) AS v
    FROM details WHERE is_active AND connection_property IS NOT NULL GROUP BY 1, 2)""",
        """dm AS (SELECT connection_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS details_text FROM kv GROUP BY 1)""",
        f"""am AS (SELECT connection_id, coalesce(list_aggregate(list_sort(list_transform(keys, lambda x: x || '=secret_' || CAST(connection_id AS VARCHAR))), 'string_agg', ','), '') AS auth_text,
    {AUTH_TYPE_CASE} AS auth_type FROM auth_keys)""") + """
SELECT pg.connection_id, pg.connection_name, coalesce(dm.details_text, '') AS details_text, coalesce(am.auth_text, '') AS auth_text,
  coalesce(am.auth_type, 'none') AS auth_type, (SELECT count(*) FROM hits) AS total,
  CAST(ceil((SELECT count(*) FROM hits) / 20.0) AS BIGINT) AS total_pages
FROM pg LEFT JOIN dm USING (connection_id) LEFT JOIN am USING (connection_id)"""

    q["config_page"] = _with(CONFIGS, "hits AS (SELECT * FROM configs WHERE is_active AND env_type = 'qa' AND config_group = 'grp_3')",
        "pg AS (SELECT * FROM hits ORDER BY table_config_id DESC LIMIT 10 OFFSET 10)") + """
SELECT table_config_id, load_type, coalesce(array_to_string(json_extract_string(tags, '$[*]'), ','), '') AS tags,
  json_extract_string(source_attributes, '$.schema') AS source_schema, json_extract_string(source_attributes, '$.table') AS source_table,
  (SELECT count(*) FROM hits) AS total, CAST(ceil((SELECT count(*) FROM hits) / 10.0) AS BIGINT) AS total_pages
FROM pg"""

    q["json_roundtrip"] = """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(to_json({'k': CAST(json_extract(props, '$.k') AS INTEGER)}) AS VARCHAR) AS props_json FROM events"""

    q["json_tags"] = _with(CONFIGS) + """SELECT table_config_id, CAST(coalesce(json_array_length(tags), 0) AS BIGINT) AS n_tags,
  json_extract_string(tags, '$[0]') AS first_tag FROM configs"""

    q["bts_decode"] = """WITH b AS (SELECT p_partkey AS bts_config_id,
    CASE p_size % 3 WHEN 0 THEN '[{"rule_name":"size_pos","expression":"p_size > 0"},{"rule_name":"price_max","expression":"p_retailprice < 990"}]'
      WHEN 1 THEN '' ELSE NULL END AS dq_rules,
    CASE WHEN p_size > 25 THEN '[{"name":"p_partkey","type":"bigint","nullable":false}]' ELSE '[]' END AS silver_layout,
    CASE WHEN p_brand = 'Brand#1' THEN '["hot"]' END AS tags FROM part)
SELECT bts_config_id,
  CAST(CASE WHEN coalesce(dq_rules, '') = '' THEN 0 ELSE json_array_length(dq_rules) END AS BIGINT) AS n_dq_rules,
  CASE WHEN coalesce(dq_rules, '') = '' THEN NULL ELSE json_extract_string(dq_rules, '$[0].rule_name') END AS first_rule,
  CAST(json_array_length(silver_layout) AS BIGINT) AS n_layout,
  CAST(json_extract(silver_layout, '$[0].nullable') AS BOOLEAN) AS first_nullable,
  CAST(0 AS BIGINT) AS n_std,
  CAST(CASE WHEN coalesce(tags, '') = '' THEN 0 ELSE json_array_length(tags) END AS BIGINT) AS n_tags
FROM b"""

    q["connector_fields"] = _with(CONNECTIONS, _registry_fields(), """present AS (
    SELECT s_suppkey AS connection_id, 'host' AS field_name FROM supplier
    UNION ALL SELECT s_suppkey, 'port' FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT s_suppkey, 'database' FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 'iam_credentials' FROM supplier WHERE s_suppkey % 5 = 2)""") + """
SELECT c.connection_id, f.field_kind, f.field_name, f.default_value
FROM conns c JOIN fields f ON f.connector = c.connection_type AND f.auth_type = c.auth_type
WHERE c.is_active AND NOT EXISTS (SELECT 1 FROM present p WHERE p.connection_id = c.connection_id AND p.field_name = f.field_name)"""

    q["connector_check"] = _with(CONNECTIONS, _registry_methods()) + f"""SELECT connection_id, connection_type, auth_type, {CONNECTOR_CODE} AS error_code
FROM conns c"""

    q["load_type_check"] = _with(CONFIGS) + f"SELECT table_config_id, load_type, {LOAD_CODE} AS error_code FROM configs"

    q["source_attr_check"] = _with(CONFIGS) + f"SELECT table_config_id, {SOURCE_CODE} AS error_code FROM configs"

    q["unique_names"] = _with(CONNECTIONS, _registry_methods(), EXISTING_MASTER, UNIQUE_CHAIN) + """
SELECT request_seq, connection_name, env_type, error_code FROM checked"""

    q["missing_parent"] = _with(CONFIGS) + """SELECT o_orderkey AS request_seq, o_custkey AS table_config_id,
  CASE WHEN o_custkey IN (SELECT table_config_id FROM configs WHERE is_active) THEN NULL ELSE 'PIPELINE_CONFIG_NOT_FOUND' END AS error_code
FROM orders"""

    q["bulk_create"] = _with(CONFIGS, f"v AS (SELECT coalesce({LOAD_CODE}, {SOURCE_CODE}) AS e FROM configs)") + """
SELECT CAST(count_if(e IS NULL) AS BIGINT) AS created_count, CAST(count_if(e IS NOT NULL) AS BIGINT) AS failed_count,
  CAST(count_if(e = 'INVALID_LOAD_TYPE') AS BIGINT) AS invalid_load_type,
  CAST(count_if(e = 'INVALID_SOURCE_ATTRIBUTES') AS BIGINT) AS invalid_source_attributes,
  CAST(count_if(e = 'MISSING_REQUIRED_FIELD') AS BIGINT) AS missing_required_field FROM v"""

    q["patch_update"] = _with(CONFIGS, """ch AS (SELECT o_custkey AS table_config_id, o_orderkey AS request_seq,
    CASE WHEN o_orderpriority = '1-URGENT' THEN concat('grp_u', CAST(o_orderkey % 5 AS VARCHAR)) END AS config_group,
    CASE WHEN o_orderstatus = 'F' THEN 'incremental' END AS load_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'alice' END AS updated_by FROM orders)""",
        """f AS (SELECT table_config_id, arg_max(config_group, request_seq) FILTER (WHERE config_group IS NOT NULL) AS n_cg,
    arg_max(load_type, request_seq) FILTER (WHERE load_type IS NOT NULL) AS n_lt,
    arg_max(coalesce(updated_by, 'system'), request_seq) AS n_actor FROM ch GROUP BY 1)""") + f"""
SELECT c.table_config_id,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN coalesce(n_cg, c.config_group) ELSE c.config_group END AS config_group,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN coalesce(n_lt, c.load_type) ELSE c.load_type END AS load_type,
  c.ingestion_frequency, c.is_active,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN n_actor ELSE 'seed' END AS updated_by,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN {NOW} ELSE {SEED} END AS updated_at
FROM configs c LEFT JOIN f USING (table_config_id)"""

    q["update_configs"] = _with(CONFIGS, """req AS (SELECT o_custkey AS table_config_id, o_orderkey AS request_seq,
    CASE o_orderstatus WHEN 'F' THEN 'incremental' WHEN 'P' THEN 'bogus' END AS load_type,
    CASE o_orderpriority WHEN '5-LOW' THEN '{"schema":""}' WHEN '1-URGENT' THEN '{"schema":"s2","table":"t2"}' END AS source_attributes,
    CASE WHEN o_orderkey % 4 = 0 THEN concat('grp_o', CAST(o_orderkey % 3 AS VARCHAR)) END AS config_group FROM orders)""",
        f"""ok AS (SELECT r.* FROM req r WHERE r.table_config_id IN (SELECT table_config_id FROM configs WHERE is_active)
    AND (r.load_type IS NULL OR r.load_type IN ('full','incremental','cdc','api','file_autoloader'))
    AND (r.source_attributes IS NULL OR ({SOURCE_CODE.replace("source_attributes", "r.source_attributes")}) IS NULL))""",
        """f AS (SELECT table_config_id, arg_max(config_group, request_seq) FILTER (WHERE config_group IS NOT NULL) AS n_cg,
    arg_max(load_type, request_seq) FILTER (WHERE load_type IS NOT NULL) AS n_lt,
    arg_max(source_attributes, request_seq) FILTER (WHERE source_attributes IS NOT NULL) AS n_sa FROM ok GROUP BY 1)""") + f"""
SELECT c.table_config_id,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN coalesce(n_cg, c.config_group) ELSE c.config_group END AS config_group,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN coalesce(n_lt, c.load_type) ELSE c.load_type END AS load_type,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN coalesce(n_sa, c.source_attributes) ELSE c.source_attributes END AS source_attributes,
  c.is_active,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN 'editor' ELSE 'seed' END AS updated_by,
  CASE WHEN f.table_config_id IS NOT NULL AND c.is_active THEN {NOW} ELSE {SEED} END AS updated_at
FROM configs c LEFT JOIN f USING (table_config_id)"""

    q["overwrite_update"] = _with(WATERMARKS, """ch AS (SELECT user_id AS table_config_id, ts AS last_value,
    CASE WHEN event_type = 'error' THEN NULL ELSE concat('run_', CAST(event_id AS VARCHAR)) END AS last_run_id
  FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""") + f"""
SELECT w.watermark_id, w.table_config_id, CASE WHEN ch.table_config_id IS NOT NULL THEN ch.last_value ELSE w.last_value END AS last_value,
  CASE WHEN ch.table_config_id IS NOT NULL THEN ch.last_run_id ELSE 'seed_run' END AS last_run_id,
  CASE WHEN ch.table_config_id IS NOT NULL THEN 'system' ELSE 'seed' END AS updated_by,
  CASE WHEN ch.table_config_id IS NOT NULL THEN {NOW} ELSE {SEED} END AS updated_at
FROM wm w LEFT JOIN ch USING (table_config_id)"""

    q["soft_delete"] = _with(CONNECTIONS) + f"""SELECT connection_id,
  CASE WHEN is_active AND connection_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) THEN false ELSE is_active END AS is_active,
  CASE WHEN is_active AND connection_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) THEN 'remover' ELSE 'seed' END AS updated_by,
  CASE WHEN is_active AND connection_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) THEN {NOW} ELSE {SEED} END AS updated_at
FROM conns"""

    q["cascade_delete"] = _with(CONFIGS, WATERMARKS, VERSIONS, RUNS,
        "ids AS (SELECT table_config_id FROM configs WHERE is_active AND table_config_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))",
        "bts AS (SELECT p_partkey AS bts_config_id, CASE WHEN p_size > 45 THEN NULL ELSE p_partkey END AS source_config_id FROM part)") + """
SELECT 'tbl_source_table' AS table_name, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count_if(is_active AND table_config_id IN (SELECT * FROM ids)) AS BIGINT) AS deactivated,
  CAST(count_if(is_active AND table_config_id NOT IN (SELECT * FROM ids)) AS BIGINT) AS still_active FROM configs
UNION ALL SELECT 'tbl_watermark', count(*), CAST(count_if(table_config_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(table_config_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM wm
UNION ALL SELECT 'tbl_schema_version', count(*), CAST(count_if(is_active AND table_config_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(is_active AND table_config_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM versions
UNION ALL SELECT 'tbl_pii_attribute', count(*), CAST(count_if(o_orderkey % 10 <> 0 AND o_custkey IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(o_orderkey % 10 <> 0 AND o_custkey NOT IN (SELECT * FROM ids)) AS BIGINT) FROM orders
UNION ALL SELECT 'aud_table_run', count(*), CAST(count_if(is_active AND table_config_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(is_active AND table_config_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM runs
UNION ALL SELECT 'bts_config', count(*), CAST(count_if(source_config_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(source_config_id IS NULL OR source_config_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM bts"""

    q["replace_children"] = _with(DETAILS, "par AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000)",
        "st AS (SELECT connection_id * 10 + connection_property_id AS connection_details_id, * FROM details)",
        """fresh AS (SELECT s_suppkey AS connection_id, CAST(1 AS BIGINT) AS connection_property_id, 'host' AS connection_property,
      concat('new_', s_name) AS connection_property_value FROM par
    UNION ALL SELECT s_suppkey, 2, 'port', '6543' FROM par)""") + """
SELECT connection_details_id, connection_id, connection_property_id, connection_property, connection_property_value,
  CASE WHEN is_active AND connection_id IN (SELECT s_suppkey FROM par) THEN false ELSE is_active END AS is_active,
  CASE WHEN is_active AND connection_id IN (SELECT s_suppkey FROM par) THEN 'replacer' ELSE 'seed' END AS updated_by FROM st
UNION ALL
SELECT (SELECT max(connection_details_id) FROM st) + row_number() OVER (ORDER BY connection_id, connection_property_id),
  connection_id, connection_property_id, connection_property, connection_property_value, true, 'replacer' FROM fresh"""

    q["upsert_watermark"] = _with(WATERMARKS, """up AS (SELECT o_custkey AS table_config_id, o_orderdate AS last_value,
    concat('run_', CAST(o_orderkey AS VARCHAR)) AS last_run_id FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)""") + """
SELECT w.watermark_id, w.table_config_id, CASE WHEN up.table_config_id IS NULL THEN w.watermark_column ELSE 'o_orderdate' END AS watermark_column,
  CASE WHEN up.table_config_id IS NULL THEN w.last_value ELSE up.last_value END AS last_value,
  CASE WHEN up.table_config_id IS NULL THEN 'seed_run' ELSE up.last_run_id END AS last_run_id,
  'seed' AS created_by, CASE WHEN up.table_config_id IS NULL THEN 'seed' ELSE 'loader' END AS updated_by
FROM wm w LEFT JOIN up USING (table_config_id)
UNION ALL
SELECT (SELECT max(watermark_id) FROM wm) + row_number() OVER (ORDER BY table_config_id), table_config_id, 'o_orderdate', last_value,
  last_run_id, 'loader', 'loader'
FROM up WHERE table_config_id NOT IN (SELECT table_config_id FROM wm)"""

    q["add_versions"] = _with(VERSIONS, """old AS (SELECT table_config_id, request_seq,
    row_number() OVER (PARTITION BY table_config_id ORDER BY request_seq) AS version_number FROM versions
  WHERE created_at < TIMESTAMP '1998-01-01 00:00:00')""",
        "base AS (SELECT table_config_id, max(version_number) AS mx FROM old GROUP BY 1)",
        """req AS (SELECT v.*, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 100 + v.request_seq % 7 END AS given
    FROM versions v JOIN orders o ON o.o_orderkey = v.request_seq WHERE v.created_at >= TIMESTAMP '1998-01-01 00:00:00')""",
        """a AS (SELECT *, sum(CASE WHEN given IS NULL THEN 1 ELSE 0 END) OVER w AS autos FROM req
    WINDOW w AS (PARTITION BY table_config_id ORDER BY request_seq ROWS UNBOUNDED PRECEDING))""",
        """p AS (SELECT *, max(CASE WHEN given IS NOT NULL THEN given - autos END) OVER w AS lift FROM a
    WINDOW w AS (PARTITION BY table_config_id ORDER BY request_seq ROWS UNBOUNDED PRECEDING))""") + """
SELECT (SELECT coalesce(max(request_seq), 0) FROM old) + row_number() OVER (ORDER BY p.request_seq) AS version_id, p.table_config_id,
  CAST(CASE WHEN given IS NULL THEN autos + greatest(coalesce(b.mx, 0), lift) ELSE given END AS BIGINT) AS version_number, p.change_type
FROM p LEFT JOIN base b USING (table_config_id)"""

    q["open_runs"] = _with(RUNS) + f"""SELECT (SELECT coalesce(max(table_run_id), 0) FROM runs WHERE status <> 'running')
    + row_number() OVER (ORDER BY event_id) AS table_run_id,
  concat('open_', CAST(event_id AS VARCHAR)) AS run_id, user_id AS table_config_id, ts AS start_time, 'running' AS status,
  'opener' AS created_by, 'opener' AS updated_by, {NOW} AS created_at
FROM events WHERE event_type = 'signup'"""

    q["close_runs"] = _with(RUNS, """ch AS (SELECT event_id AS table_run_id, ts + INTERVAL 300 SECOND AS end_time,
    CAST(floor(value * 10) AS BIGINT) AS rows_read FROM events WHERE event_type = 'signup')""") + f"""
SELECT r.table_run_id, CASE WHEN hit THEN ch.end_time ELSE r.end_time END AS end_time,
  CASE WHEN hit THEN CAST(300 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS elapsed_seconds,
  CASE WHEN hit THEN ch.rows_read ELSE r.rows_read END AS rows_read,
  CASE WHEN hit THEN 'succeeded' ELSE r.status END AS status,
  CASE WHEN hit THEN 'closer' ELSE 'seed' END AS updated_by,
  CASE WHEN hit THEN {NOW} ELSE {SEED} END AS updated_at
FROM (SELECT r.*, ch.table_run_id IS NOT NULL AND r.is_active AS hit FROM runs r LEFT JOIN ch USING (table_run_id)) r
LEFT JOIN ch USING (table_run_id)"""

    q["composite_create"] = _with(CONNECTIONS, _registry_methods(), EXISTING_MASTER, UNIQUE_CHAIN,
        """ok AS (SELECT (SELECT coalesce(max(connection_id), 0) FROM ex) + row_number() OVER (ORDER BY request_seq) AS connection_id,
    request_seq FROM checked WHERE error_code IS NULL)""",
        """d AS (SELECT ok.connection_id, CAST(1 AS BIGINT) AS connection_property_id, 'host' AS connection_property, s_name AS connection_property_value
    FROM ok JOIN supplier ON s_suppkey = ok.request_seq
    UNION ALL SELECT ok.connection_id, 2, 'port', CAST(1000 + s_nationkey AS VARCHAR) FROM ok JOIN supplier ON s_suppkey = ok.request_seq
    UNION ALL SELECT ok.connection_id, 3, 'database', concat('db_', CAST(s_nationkey AS VARCHAR)) FROM ok JOIN supplier ON s_suppkey = ok.request_seq)""") + """
SELECT row_number() OVER (ORDER BY connection_id, connection_property_id) AS connection_details_id, connection_id, connection_property_id,
  connection_property, connection_property_value FROM d"""

    auth_state = """auth_state AS (
    SELECT connection_id * 10 + pos AS connection_auth_id, connection_id, pos AS auth_property_id, k AS auth_property,
      concat('secret_', CAST(connection_id AS VARCHAR)) AS auth_property_value, true AS is_active, 'seed' AS updated_by,
      CASE connection_id % 2 WHEN 0 THEN 'dev' ELSE 'prod' END AS env_type
    FROM (SELECT connection_id, unnest(keys) AS k, unnest(range(1, len(keys) + 1)) AS pos FROM auth_keys))"""
    upd = """req AS (
    SELECT s_suppkey AS connection_id, s_suppkey AS request_seq,
      CASE WHEN s_acctbal > 5000 THEN concat('upd_', CAST(s_nationkey AS VARCHAR)) END AS dom,
      CASE WHEN s_nationkey % 4 = 1 THEN true END AS tgt, s_nationkey % 3 = 0 AS has_auth,
      concat('k', CAST(s_suppkey AS VARCHAR)) AS api_key,
      coalesce(CASE WHEN s_nationkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'key' END, 'basic') AS atype, 'editor' AS actor
    FROM supplier
    UNION ALL SELECT n_nationkey, 1000 + n_nationkey, concat('nat_', n_name), NULL, false, NULL, 'basic', 'system' FROM nation),
chk AS (SELECT r.*, CASE WHEN c.connection_id IS NULL THEN 'CONNECTION_NOT_FOUND'
      WHEN r.has_auth AND c.connection_type NOT IN (SELECT connector FROM reg) THEN 'INVALID_CONNECTOR_TYPE'
      WHEN r.has_auth AND NOT EXISTS (SELECT 1 FROM reg g WHERE g.connector = c.connection_type AND g.auth_method = r.atype)
        THEN 'INVALID_AUTH_TYPE' END AS err
    FROM req r LEFT JOIN conns c ON c.connection_id = r.connection_id AND c.is_active),
ok AS (SELECT * FROM chk WHERE err IS NULL)"""
    q["update_connections"] = _with(CONNECTIONS, _registry_methods(), upd,
        """f AS (SELECT connection_id, arg_max(dom, request_seq) FILTER (WHERE dom IS NOT NULL) AS n_dom,
    arg_max(tgt, request_seq) FILTER (WHERE tgt IS NOT NULL) AS n_tgt, arg_max(actor, request_seq) AS n_actor FROM ok GROUP BY 1)""") + f"""
SELECT c.connection_id,
  CASE WHEN f.connection_id IS NOT NULL AND c.is_active THEN coalesce(n_dom, c.connection_domain_name) ELSE c.connection_domain_name END AS connection_domain_name,
  CASE WHEN f.connection_id IS NOT NULL AND c.is_active THEN coalesce(n_tgt, c.is_target) ELSE c.is_target END AS is_target,
  CASE WHEN f.connection_id IS NOT NULL AND c.is_active THEN n_actor ELSE 'seed' END AS updated_by,
  CASE WHEN f.connection_id IS NOT NULL AND c.is_active THEN {NOW} ELSE {SEED} END AS updated_at
FROM conns c LEFT JOIN f USING (connection_id)"""

    q["update_connection_auth"] = _with(CONNECTIONS, _registry_methods(), AUTH_ROWS, auth_state, upd,
        """la AS (SELECT connection_id, arg_max(api_key, request_seq) AS api_key, arg_max(actor, request_seq) AS actor
    FROM ok WHERE has_auth GROUP BY 1)""") + """
SELECT a.connection_auth_id, a.connection_id, a.auth_property_id, a.auth_property, a.auth_property_value,
  CASE WHEN a.is_active AND la.connection_id IS NOT NULL THEN false ELSE a.is_active END AS is_active,
  CASE WHEN a.is_active AND la.connection_id IS NOT NULL THEN la.actor ELSE a.updated_by END AS updated_by, a.env_type
FROM auth_state a LEFT JOIN la USING (connection_id)
UNION ALL
SELECT (SELECT max(connection_auth_id) FROM auth_state) + row_number() OVER (ORDER BY la.connection_id), la.connection_id,
  CAST(1 AS BIGINT), 'api_key', la.api_key, true, la.actor, c.env_type
FROM la JOIN conns c USING (connection_id)"""

    q["soft_delete_connections"] = _with(CONNECTIONS, DETAILS, AUTH_ROWS, auth_state,
        "ids AS (SELECT connection_id FROM conns WHERE is_active AND connection_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000))") + """
SELECT 'conn_master' AS table_name, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count_if(is_active AND connection_id IN (SELECT * FROM ids)) AS BIGINT) AS deactivated,
  CAST(count_if(is_active AND connection_id NOT IN (SELECT * FROM ids)) AS BIGINT) AS still_active FROM conns
UNION ALL SELECT 'connection_details', count(*), CAST(count_if(is_active AND connection_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(is_active AND connection_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM details
UNION ALL SELECT 'connection_auth', count(*), CAST(count_if(is_active AND connection_id IN (SELECT * FROM ids)) AS BIGINT),
  CAST(count_if(is_active AND connection_id NOT IN (SELECT * FROM ids)) AS BIGINT) FROM auth_state"""

    created = f"""created AS (SELECT row_number() OVER (ORDER BY request_seq) AS table_config_id, load_type, coalesce(tags, '[]') AS tags,
    coalesce(CASE WHEN request_seq % 2 = 0 THEN 'tester' END, 'system') AS actor
  FROM configs WHERE coalesce({LOAD_CODE}, {SOURCE_CODE}) IS NULL)"""
    q["create_configs"] = _with(CONFIGS, created) + f"""SELECT table_config_id, load_type, tags, 'halt' AS fail_mode, CAST(0 AS BIGINT) AS retry_count,
  false AS watermark_enabled, actor AS created_by, actor AS updated_by, true AS is_active, {NOW} AS created_at FROM created"""

    q["create_config_watermarks"] = _with(CONFIGS, created) + """SELECT row_number() OVER (ORDER BY table_config_id) AS watermark_id, table_config_id,
  'updated_at' AS watermark_column, 'timestamp' AS watermark_type, 'dev' AS env_type, actor AS created_by, actor AS updated_by
FROM created WHERE load_type = 'incremental'"""

    q["full_load"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders"

    q["incremental_orders"] = """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate > TIMESTAMP '1999-12-31 00:00:00' AND o_orderdate <= (SELECT max(o_orderdate) FROM orders)"""

    q["hash_changes"] = f"""WITH prev AS (SELECT c_custkey, c_name, c_nationkey,
    CASE WHEN c_custkey % 11 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey <> 3),
t AS (SELECT c_custkey, {HASH} AS h FROM prev),
s AS (SELECT c_custkey, {HASH} AS row_hash FROM customer)
SELECT s.c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'new' ELSE 'changed' END AS change_kind, s.row_hash
FROM s LEFT JOIN t USING (c_custkey) WHERE t.c_custkey IS NULL OR t.h <> s.row_hash"""

    q["advance_watermark"] = _with(WATERMARKS, """got AS (SELECT e.user_id, max(e.ts) AS mx, count(*) AS n FROM events e
    LEFT JOIN wm ON wm.table_config_id = e.user_id WHERE wm.last_value IS NULL OR e.ts > wm.last_value GROUP BY 1)""") + """
SELECT w.table_config_id, w.last_value AS watermark_start, greatest(w.last_value, g.mx) AS watermark_end,
  CAST(coalesce(g.n, 0) AS BIGINT) AS rows_read
FROM wm w LEFT JOIN got g ON g.user_id = w.table_config_id"""

    order = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
    q["upsert_lineitem"] = f"""WITH tgt AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1),
b AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1)
SELECT coalesce(b.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, t.l_linenumber) AS l_linenumber,
  CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_partkey ELSE t.l_partkey END AS l_partkey,
  CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_quantity ELSE t.l_quantity END AS l_quantity,
  CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_extendedprice ELSE t.l_extendedprice END AS l_extendedprice,
  CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_shipdate ELSE t.l_shipdate END AS l_shipdate,
  CASE WHEN b.l_orderkey IS NOT NULL AND t.l_orderkey IS NOT NULL THEN 'update' WHEN b.l_orderkey IS NOT NULL THEN 'insert' ELSE 'keep' END AS merge_action
FROM tgt t FULL OUTER JOIN b ON t.l_orderkey = b.l_orderkey AND t.l_linenumber = b.l_linenumber"""

    q["cdc_events"] = """WITH tgt AS (SELECT user_id, event_type, value, true AS is_active FROM events WHERE ts < TIMESTAMP '2024-01-15'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
ch AS (SELECT user_id, event_id, event_type, value,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
c AS (SELECT user_id, max(event_id) AS seq, arg_max(op, event_id) AS last_op, arg_max(event_type, event_id) FILTER (op <> 'D') AS et,
    arg_max(value, event_id) FILTER (op <> 'D') AS v, count(*) FILTER (op <> 'D') AS writes FROM ch GROUP BY user_id)
SELECT coalesce(t.user_id, c.user_id) AS user_id,
  CASE WHEN c.writes > 0 THEN c.et ELSE t.event_type END AS event_type,
  CASE WHEN c.writes > 0 THEN c.v ELSE t.value END AS value,
  CASE WHEN c.user_id IS NULL THEN t.is_active ELSE c.last_op <> 'D' END AS is_active,
  c.seq AS last_seq
FROM tgt t FULL OUTER JOIN c ON t.user_id = c.user_id
WHERE t.user_id IS NOT NULL OR c.writes > 0"""

    q["autoload_events"] = "SELECT * FROM events"

    q["row_hash"] = f"SELECT c_custkey, {HASH} AS row_hash FROM customer"

    q["partition_write"] = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'REWRITTEN' ELSE o_orderpriority END AS o_orderpriority
FROM orders"""

    q["source_from_connection"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"

    q["pii_scan"] = _pii_scan_sql()

    q["pii_protect"] = f"""SELECT sha256('s1' || CAST(c_custkey AS VARCHAR)) AS c_custkey,
  CASE WHEN c_name IS NULL THEN NULL WHEN length(c_name) <= 4 THEN c_name
    ELSE {MASK.format(v="substr(c_name, 1, length(c_name) - 4)")} || right(c_name, 4) END AS c_name,
  c_nationkey, CASE WHEN c_mktsegment IS NULL THEN NULL ELSE '[REDACTED]' END AS c_mktsegment
FROM customer"""

    q["pii_encrypt_roundtrip"] = "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE true END AS roundtrip_ok FROM customer"

    q["tier_view"] = """SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE '[REDACTED]' END AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal,
  c_mktsegment FROM customer"""

    q["schema_drift"] = """WITH o AS (SELECT user_id AS cfg, event_type AS col, CASE WHEN max(value) >= 100 THEN 'double' ELSE 'int' END AS typ
    FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
n AS (SELECT user_id AS cfg, event_type AS col, CASE WHEN max(value) >= 100 THEN 'double' ELSE 'int' END AS typ
    FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2),
j AS (SELECT coalesce(n.cfg, o.cfg) AS cfg, coalesce(n.col, o.col) AS col, o.col IS NULL AS added, n.col IS NULL AS removed,
    o.col IS NOT NULL AND n.col IS NOT NULL AND o.typ <> n.typ AS changed, n.col IS NOT NULL AS present
  FROM o FULL OUTER JOIN n ON o.cfg = n.cfg AND o.col = n.col),
per AS (SELECT cfg, list_sort(coalesce(list(col) FILTER (WHERE added), [])) AS a, list_sort(coalesce(list(col) FILTER (WHERE removed), [])) AS r,
    list_sort(coalesce(list(col) FILTER (WHERE changed), [])) AS t, CAST(count_if(present) AS BIGINT) AS column_count FROM j GROUP BY cfg)
SELECT cfg AS table_config_id, array_to_string(a, ',') AS added, array_to_string(r, ',') AS removed, array_to_string(t, ',') AS type_changed,
  column_count, CASE WHEN len(r) > 0 THEN 'deletion' WHEN len(a) > 0 THEN 'additive' ELSE 'modified' END AS change_type,
  CAST(to_json({'added': a, 'removed': r, 'type_changed': t}) AS VARCHAR) AS column_changes_json
FROM per WHERE len(a) + len(r) + len(t) > 0"""

    q["dq_rules"] = "WITH s AS (\n" + "\n  UNION ALL\n".join(
        f"  SELECT '{n}' AS rule_name, CAST(count_if(NOT coalesce({e}, false)) AS BIGINT) AS failed, count(*) AS total FROM lineitem"
        for n, e in DQ_CASES) + ")\nSELECT rule_name, failed, CASE WHEN total > 0 THEN failed / total END AS fail_rate FROM s"

    names = ", ".join(f"CASE WHEN NOT coalesce({e}, false) THEN '{n}' END" for n, e in DQ_CASES)
    q["dq_quarantine"] = f"""SELECT l_orderkey, l_linenumber, concat_ws(',', {names}) AS failed_rules FROM lineitem
WHERE concat_ws(',', {names}) <> ''"""

    any_fail = " OR ".join(f"NOT coalesce({e}, false)" for _n, e in DQ_CASES)
    q["dq_outcome"] = f"""WITH c AS (SELECT count(*) AS n, count_if({any_fail}) AS bad FROM lineitem)
SELECT CAST(n AS BIGINT) AS rows_read, CAST(n - bad AS BIGINT) AS rows_written, 'succeeded' AS status,
  CASE WHEN bad > 0 THEN 'dq' END AS error_type,
  CASE WHEN bad > 0 THEN CAST(bad AS VARCHAR) || ' rows failed quality rules (quarantine)' END AS error_message FROM c"""

    q["standardise"] = """SELECT p_partkey, upper(trim(p_name)) AS p_name, replace(p_brand, 'Brand#1', '') AS p_brand, lower(p_type) AS p_type,
  coalesce(p_size, 0) AS p_size FROM part"""

    q["silver_layout"] = """WITH s AS (SELECT p_partkey, replace(p_brand, 'Brand#1', '') AS b, coalesce(p_size, 0) AS p_size FROM part),
r AS (SELECT p_partkey, TRY_CAST(b AS INTEGER) AS p_brand, CAST(p_size AS INTEGER) AS p_size,
    concat_ws(',', CASE WHEN p_partkey IS NULL THEN 'null:p_partkey' END,
      CASE WHEN b IS NOT NULL AND TRY_CAST(b AS INTEGER) IS NULL THEN 'cast:p_brand' END,
      CASE WHEN p_size IS NULL THEN 'null:p_size' END) AS reject_reasons FROM s)
SELECT p_partkey, p_brand, p_size, reject_reasons = '' AS accepted, reject_reasons FROM r"""

    q["run_metrics"] = _with(RUNS) + """SELECT table_config_id, status, GROUPING(table_config_id, status) AS gid,
  CAST(count(*) AS BIGINT) AS runs, CAST(count_if(status = 'succeeded') AS BIGINT) AS succeeded,
  CAST(sum(rows_read) AS BIGINT) AS rows_read, CAST(sum(rows_written) AS BIGINT) AS rows_written,
  avg((epoch_us(end_time) - epoch_us(start_time)) // 1000000) AS avg_elapsed,
  round(quantile_cont((epoch_us(end_time) - epoch_us(start_time)) // 1000000, 0.95), 6) AS p95_elapsed,
  count_if(status = 'succeeded') / count(*) AS success_rate
FROM runs WHERE is_active GROUP BY ROLLUP (table_config_id, status)"""

    q["run_reconcile"] = _with(RUNS, """r AS (SELECT *, start_time - to_seconds(table_run_id % 300) AS watermark_start, start_time AS watermark_end
  FROM runs WHERE is_active)""", """l AS (SELECT *, lag(watermark_end) OVER w AS prev_end, lag(table_run_id) OVER w AS prev_run_id FROM r
  WINDOW w AS (PARTITION BY table_config_id ORDER BY start_time, table_run_id))""") + f"""
SELECT table_run_id, table_config_id, start_time, (epoch_us(end_time) - epoch_us(start_time)) // 1000000 AS elapsed_seconds, prev_run_id,
  rows_read <> rows_written AS rows_mismatch,
  prev_run_id IS NOT NULL AND watermark_start IS DISTINCT FROM prev_end AS watermark_gap,
  status = 'running' AND start_time < {NOW} - INTERVAL 24 HOURS AS running_too_long
FROM l"""

    q["freshness"] = _with(CONFIGS, RUNS, """ok AS (SELECT table_config_id, max(end_time) AS last_success FROM runs
  WHERE is_active AND status = 'succeeded' GROUP BY 1)""") + f"""
SELECT c.table_config_id, c.ingestion_frequency, ok.last_success,
  CASE c.ingestion_frequency
    WHEN 'daily' THEN ok.last_success IS NULL OR ok.last_success < {NOW} - INTERVAL 1 DAY
    WHEN 'weekly' THEN ok.last_success IS NULL OR ok.last_success < {NOW} - INTERVAL 7 DAY
    WHEN 'monthly' THEN ok.last_success IS NULL OR ok.last_success < {NOW} - INTERVAL 1 MONTH
    ELSE false END AS is_stale
FROM configs c LEFT JOIN ok USING (table_config_id) WHERE c.is_active"""

    q["tag_index"] = _with(CONFIGS) + """SELECT tag, CAST(count(*) AS BIGINT) AS n_configs FROM (
  SELECT DISTINCT table_config_id, unnest(json_extract_string(tags, '$[*]')) AS tag FROM configs WHERE is_active AND tags IS NOT NULL AND tags <> '')
GROUP BY tag"""
    q["pii_classify"] = "WITH scan AS (\n" + _pii_scan_sql() + """)
SELECT row_number() OVER (ORDER BY column_name, pii_category) AS pii_id, CAST(1 AS BIGINT) AS table_config_id, column_name,
  pii_category, suggested_protection AS protection_method, sensitivity, 'INTERNAL' AS access_tier, true AS is_active,
  'scanner' AS created_by FROM scan"""

    q["drift_versions"] = "WITH d AS (\n" + q["schema_drift"] + """),
base AS (SELECT o_custkey AS cfg, count(*) AS mx FROM orders GROUP BY 1)
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY d.table_config_id) AS version_id, d.table_config_id,
  CAST(coalesce(base.mx, 0) + 1 AS BIGINT) AS version_number, d.column_count, d.change_type, d.column_changes_json,
  'drift_run' AS detected_by_run_id, 'detector' AS created_by
FROM d LEFT JOIN base ON base.cfg = d.table_config_id"""

    q["advance_and_upsert"] = _with(WATERMARKS, """got AS (SELECT e.user_id, max(e.ts) AS mx, count(*) AS n FROM events e
    LEFT JOIN wm ON wm.table_config_id = e.user_id WHERE wm.last_value IS NULL OR e.ts > wm.last_value GROUP BY 1)""") + """
SELECT w.watermark_id, w.table_config_id, CASE WHEN g.n > 0 THEN greatest(w.last_value, g.mx) ELSE w.last_value END AS last_value,
  CASE WHEN g.n > 0 THEN 'run_adv' ELSE 'seed_run' END AS last_run_id, CASE WHEN g.n > 0 THEN 'loader' ELSE 'seed' END AS updated_by
FROM wm w LEFT JOIN got g ON g.user_id = w.table_config_id"""
    q["advance_and_close"] = _with(RUNS, WATERMARKS, """got AS (SELECT e.user_id, max(e.ts) AS mx, count(*) AS n FROM events e
    LEFT JOIN wm ON wm.table_config_id = e.user_id WHERE wm.last_value IS NULL OR e.ts > wm.last_value GROUP BY 1)""",
        """adv AS (SELECT w.table_config_id, w.last_value AS ws, greatest(w.last_value, g.mx) AS we, CAST(coalesce(g.n, 0) AS BIGINT) AS n
    FROM wm w LEFT JOIN got g ON g.user_id = w.table_config_id)""",
        """op AS (SELECT table_config_id, max(table_run_id) AS rid FROM runs WHERE is_active AND status = 'running' GROUP BY 1)""",
        """cl AS (SELECT op.rid AS table_run_id, adv.* FROM adv JOIN op USING (table_config_id))""") + f"""
SELECT r.table_run_id, CASE WHEN h THEN {NOW} ELSE r.end_time END AS end_time,
  CASE WHEN h THEN (epoch_us({NOW}) - epoch_us(r.start_time)) // 1000000 ELSE CAST(NULL AS BIGINT) END AS elapsed_seconds,
  CASE WHEN h THEN cl.n ELSE r.rows_read END AS rows_read, CASE WHEN h THEN cl.n ELSE r.rows_written END AS rows_written,
  CASE WHEN h THEN strftime(cl.ws, '%Y-%m-%dT%H:%M:%S.%f') END AS watermark_start,
  CASE WHEN h THEN strftime(cl.we, '%Y-%m-%dT%H:%M:%S.%f') END AS watermark_end,
  CASE WHEN h THEN 'succeeded' ELSE r.status END AS status, CASE WHEN h THEN 'loader' ELSE 'seed' END AS updated_by
FROM (SELECT r.*, cl.table_run_id IS NOT NULL AND r.is_active AS h FROM runs r LEFT JOIN cl USING (table_run_id)) r
LEFT JOIN cl USING (table_run_id)"""
    return q


ORACLE_SQL = build()
