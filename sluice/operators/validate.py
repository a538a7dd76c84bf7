"""Validation D20-D26. Every check adds or fills an ``error_code`` column (NULL = the row
passed), in the reference's order of checks; accepted and rejected rows are then two
filters of the same plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas as S
from sluice.functions.exprs import decode_json_variants, is_blank, json_truthy
from sluice.operators.reads import active

ERROR = "error_code"


def registry_frame(spark: SparkSession) -> DataFrame:
    """Connectors as rows: connector, label, auth_methods, default_auth (first method)."""
    rows = [(k, label, methods, methods[0]) for k, label, _b, _d, methods in S.CONNECTOR_REGISTRY]
    return spark.createDataFrame(rows, "connector string, label string, auth_methods array<string>, default_auth string")


def connector_fields(spark: SparkSession) -> DataFrame:
    """Per (connector, auth method) one row per base field (with its default) and
    per auth field; ``field_order`` keeps the registry order, base fields first."""
    rows = []
    for key, _label, base, defaults, methods in S.CONNECTOR_REGISTRY:
        for auth in methods:
            pos = 0
            for f in base:
                pos += 1
                rows.append((key, auth, auth == methods[0], "base", f, defaults.get(f), pos))
            for f in S.AUTH_FIELDS.get(auth, []):
                pos += 1
                rows.append((key, auth, auth == methods[0], "auth", f, None, pos))
    return spark.createDataFrame(
        rows,
        "connector string, auth_type string, is_default_auth boolean, field_kind string, "
        "field_name string, default_value string, field_order int",
    )


def missing_fields(connections: DataFrame, present: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """D20 as a dimension: required fields a connection does not have.

    ``connections``: connection_id, connection_type, auth_type (NULL = connector default).
    ``present``: connection_id, field_name (details and auth keys). The registry is a
    fixed table of about a hundred rows, so it is broadcast.
    """
    spark = spark or connections.sparkSession
    fields = F.broadcast(connector_fields(spark))
    defaults = fields.filter("is_default_auth").select(F.col("connector").alias("_c"), F.col("auth_type").alias("_da")).distinct()
    conn = connections.join(F.broadcast(defaults), connections["connection_type"] == defaults["_c"], "left").select(
        "connection_id", "connection_type", F.coalesce(F.col("auth_type"), F.col("_da")).alias("_auth")
    )
    required = conn.join(
        fields, (conn["connection_type"] == fields["connector"]) & (conn["_auth"] == fields["auth_type"]), "inner"
    ).select("connection_id", "connection_type", F.col("_auth").alias("auth_type"), "field_kind", "field_name", "default_value", "field_order")
    return required.join(present.select("connection_id", "field_name").distinct(), ["connection_id", "field_name"], "left_anti")


def connector_code(df: DataFrame, type_col: str = "connection_type", auth_col: str = "auth_type",
                   name: str = "_connector_code") -> DataFrame:
    """D21 as a column ``name``: unknown connector -> INVALID_CONNECTOR_TYPE, else an auth
    method the connector does not offer -> INVALID_AUTH_TYPE, else NULL. The registry is a
    fixed table of twelve rows, so it is broadcast."""
    reg = F.broadcast(registry_frame(df.sparkSession).select(F.col("connector").alias("_rc"), F.col("auth_methods").alias("_rm")))
    j = df.join(reg, df[type_col] == reg["_rc"], "left")
    code = (
        F.when(F.col("_rc").isNull(), F.lit(S.INVALID_CONNECTOR_TYPE))
        .when(~F.coalesce(F.array_contains(F.col("_rm"), F.col(auth_col)), F.lit(False)), F.lit(S.INVALID_AUTH_TYPE))
    )
    return j.withColumn(name, code).drop("_rc", "_rm")


def connector_check(df: DataFrame, type_col: str = "connection_type", auth_col: str = "auth_type") -> DataFrame:
    """Fills ``error_code`` (only where still NULL) with the connector/auth code."""
    return _fill(connector_code(df, type_col, auth_col), F.col("_connector_code")).drop("_connector_code")


def _fill(df: DataFrame, code: Column) -> DataFrame:
    if ERROR in df.columns:
        return df.withColumn(ERROR, F.coalesce(F.col(ERROR), code))
    return df.withColumn(ERROR, code)


def load_type_code(load_type: Column, required: bool = True) -> Column:
    """A load type outside the vocabulary -> INVALID_LOAD_TYPE. On update (``required``
    false) a NULL or empty value is not checked."""
    bad = ~F.coalesce(load_type.isin(*S.LOAD_TYPES), F.lit(False))
    if not required:
        bad = bad & ~is_blank(load_type)
    return F.when(bad, F.lit(S.INVALID_LOAD_TYPE))


def load_type_check(df: DataFrame, col: str = "load_type", required: bool = True) -> DataFrame:
    return _fill(df, load_type_code(F.col(col), required))


def source_attributes_code(attrs_json: Column) -> Column:
    """With a ``file_path`` key (even JSON null) a falsy ``file_type`` ->
    MISSING_REQUIRED_FIELD; otherwise a falsy ``schema`` or ``table`` ->
    INVALID_SOURCE_ATTRIBUTES. Values are decoded as VARIANT so falsiness follows the JSON
    type (0, false, [], {} are falsy; the string "0" is not)."""
    return source_attributes_code_of(decode_json_variants(attrs_json))


def source_attributes_code_of(m: Column) -> Column:
    """D23 on an already decoded map<string,variant>."""
    file_source = F.coalesce(F.map_contains_key(m, F.lit("file_path")), F.lit(False))
    return (
        F.when(file_source & ~json_truthy(m["file_type"]), F.lit(S.MISSING_REQUIRED_FIELD))
        .when(~file_source & ~(json_truthy(m["schema"]) & json_truthy(m["table"])), F.lit(S.INVALID_SOURCE_ATTRIBUTES))
    )


def source_attributes_check(df: DataFrame, col: str = "source_attributes") -> DataFrame:
    return _fill(df, source_attributes_code(F.col(col)))


def unique_names(requests: DataFrame, existing: DataFrame, seq_col: str = "request_seq",
                 name_col: str = "connection_name", env_col: str = "env_type",
                 check_connector: bool = True, exclude_col: str | None = None) -> DataFrame:
    """D24 (batch form): D21 first; then a (name, env) already in ``existing`` (inactive
    rows included) -> DUPLICATE_CONNECTION_NAME; then every surviving copy after the first
    (by ``seq_col``) inside the batch is a duplicate too, as sequential calls would find.

    ``exclude_col`` (e.g. connection_id on a rename) is the self-exclusion: an existing row
    with the request's own id does not count as a clash.

    Both lookups are aggregations keyed by (name, env), combined map-side, then joined
    back; no group is collected and no pairs are formed.
    """
    checked = connector_check(requests) if check_connector else _fill(requests, F.lit(None).cast("string"))
    ids = [F.min(exclude_col).alias("_tmin"), F.max(exclude_col).alias("_tmax")] if exclude_col else [F.count(F.lit(1)).alias("_tmin")]
    taken = existing.groupBy(F.col(name_col).alias("_tn"), F.col(env_col).alias("_te")).agg(*ids)
    j = checked.join(taken, (checked[name_col] == taken["_tn"]) & (checked[env_col] == taken["_te"]), "left")
    clash = F.col("_tn").isNotNull()
    if exclude_col:
        only_self = (F.col("_tmin") == F.col(exclude_col)) & (F.col("_tmax") == F.col(exclude_col))
        clash = clash & ~F.coalesce(only_self, F.lit(False))
    j = _fill(j, F.when(clash, F.lit(S.DUPLICATE_CONNECTION_NAME))).drop("_tn", "_te", "_tmin", "_tmax")
    firsts = j.filter(F.col(ERROR).isNull()).groupBy(
        F.col(name_col).alias("_fn"), F.col(env_col).alias("_fe")
    ).agg(F.min(seq_col).alias("_first"))
    k = j.join(firsts, (j[name_col] == firsts["_fn"]) & (j[env_col] == firsts["_fe"]), "left")
    k = _fill(k, F.when(F.col(seq_col) != F.col("_first"), F.lit(S.DUPLICATE_CONNECTION_NAME)))
    return k.drop("_fn", "_fe", "_first")


def missing_parent(requests: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None,
                   code: str = S.PIPELINE_CONFIG_NOT_FOUND) -> DataFrame:
    """Requests whose active parent is absent get ``code``."""
    parent_key = parent_key or key
    alive = active(parents).select(F.col(parent_key).alias("_pk")).distinct().withColumn("_alive", F.lit(True))
    j = requests.join(alive, requests[key] == alive["_pk"], "left")
    return _fill(j, F.when(F.col("_alive").isNull(), F.lit(code))).drop("_pk", "_alive")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(ERROR).isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(ERROR).isNotNull())


def bulk_validate(requests: DataFrame) -> DataFrame:
    """D26 per row: D22 then D23, first failing check wins."""
    return source_attributes_check(load_type_check(requests))


def bulk_summary(validated: DataFrame) -> DataFrame:
    """D26 report: created_count, failed_count and the count per error code, one pass."""
    e = F.col(ERROR)
    return validated.agg(
        F.count_if(e.isNull()).cast("long").alias("created_count"),
        F.count_if(e.isNotNull()).cast("long").alias("failed_count"),
        F.count_if(e == S.INVALID_LOAD_TYPE).cast("long").alias("invalid_load_type"),
        F.count_if(e == S.INVALID_SOURCE_ATTRIBUTES).cast("long").alias("invalid_source_attributes"),
        F.count_if(e == S.MISSING_REQUIRED_FIELD).cast("long").alias("missing_required_field"),
    )
