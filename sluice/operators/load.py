"""Load jobs described by the configuration.

The reference stores these load settings and runs none of them; the meanings here are
what a Spark user would build from the stored fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from sluice.functions.exprs import row_hash
from sluice.operators.conform import conform
from sluice.schemas import WATERMARK_TYPES
from sluice.session import pin


def _ties(df: DataFrame, cols: list[str]) -> list[Column]:
    """``cols`` as orderable tie-breakers: columns without an order (maps, variants) by
    their JSON text."""
    def unordered(t: DataType) -> bool:
        return any(x in t.simpleString() for x in ("map<", "variant"))

    return [F.to_json(F.struct(c)) if unordered(df.schema[c].dataType) else F.col(c) for c in cols]


def _key_cond(left: DataFrame, right: DataFrame, keys: list[str], rprefix: str, null_safe: bool = True) -> Column:
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(right[rprefix + k]) if null_safe else left[k] == right[rprefix + k]
        cond = term if cond is None else cond & term
    return cond


# ---- R01 full load ----

def full_load(source: DataFrame, target_path: str, schema: StructType | None = None, fmt: str = "parquet",
              partition_by: list[str] | None = None) -> str:
    """Read source, conform (D02) when a target schema is given, replace the target in
    place. A job that fails midway leaves the target incomplete; ``full_load_version`` keeps
    readers off that."""
    df = conform(source, schema) if schema is not None else source
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(target_path)
    return target_path


def full_load_version(source: DataFrame, target_root: str, version: str, schema: StructType | None = None,
                      partition_by: list[str] | None = None) -> str:
    """R01 published by version: a new folder ``version=...`` under ``target_root`` is written
    whole, and only then returned for the caller to record (D36) and readers to switch to.
    Earlier versions stay until removed; an existing version is an error, not overwritten."""
    path = f"{target_root.rstrip('/')}/version={version}"
    df = conform(source, schema) if schema is not None else source
    w = df.write.mode("errorifexists").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


# ---- R02 incremental extract ----

def _typed_literal(value, watermark_type: str, col_type: DataType) -> Column:
    if watermark_type == "integer":
        return F.lit(value).cast("long")
    if watermark_type == "timestamp":
        return F.lit(str(value)).cast(col_type if col_type.typeName().startswith("timestamp") else "timestamp")
    return F.lit(value).cast(col_type)


def upper_bound(source: DataFrame, watermark_col: str, last_value=None, watermark_type: str = "timestamp") -> Column:
    """The high end fixed at run start: the largest watermark above ``last_value``, taken
    once and returned as a literal, so that the extract, the advance and the audit of one
    run all use the same value however often their plans are evaluated. Only rows above
    ``last_value`` are scanned (pushed filter); nothing new gives a typed NULL."""
    col_type = source.schema[watermark_col].dataType
    rows = incremental_extract(source, watermark_col, last_value, watermark_type)
    return F.lit(rows.agg(F.max(watermark_col)).first()[0]).cast(col_type)


def incremental_extract(source: DataFrame, watermark_col: str, last_value, watermark_type: str = "timestamp",
                        upper=None) -> DataFrame:
    """Rows with watermark strictly above ``last_value`` and at most ``upper``.

    The cast sits on the literal, never on the column, so the range reaches the Parquet
    scan as pushed filters. NULL ``last_value`` reads everything up to ``upper``.
    """
    col_type = source.schema[watermark_col].dataType
    out = source
    if last_value is not None:
        out = out.filter(F.col(watermark_col) > _typed_literal(last_value, watermark_type, col_type))
    if upper is not None:
        hi = upper if isinstance(upper, Column) else _typed_literal(upper, watermark_type, col_type)
        out = out.filter(F.col(watermark_col) <= hi)
    return out


#: Spark type of a stored (text) last value, by watermark_type.
WATERMARK_CASTS = dict(zip(WATERMARK_TYPES, ("timestamp_ntz", "bigint", "string"), strict=True))


def _typed_last(watermarks: DataFrame, last_col: str, watermark_type: str) -> Column:
    """The stored text read by ``watermark_type`` (NULL where it cannot be); a column that
    already has a type is taken as it is."""
    c = F.col(last_col)
    return c.try_cast(WATERMARK_CASTS[watermark_type]) if isinstance(watermarks.schema[last_col].dataType, StringType) else c


def typed_watermarks(watermarks: DataFrame, watermark_type: str, last_col: str = "last_value") -> tuple[DataFrame, DataFrame]:
    """(watermarks with ``_last`` typed, rejects): the stored text read by
    ``watermark_type``. A value that cannot be read goes to the rejects with its code
    instead of failing the batch; NULL stays NULL (read everything)."""
    typed = watermarks.withColumn("_last", _typed_last(watermarks, last_col, watermark_type))
    bad = F.col("_last").isNull() & F.col(last_col).isNotNull()
    return typed.filter(~bad), typed.filter(bad).drop("_last").withColumn("error_code", F.lit("INVALID_WATERMARK"))


def _as_literal(text: str | None, typ: DataType) -> Column:
    """A value taken from Spark as text, as a typed literal again."""
    return F.lit(text).cast(typ)


def lower_bound(watermarks: DataFrame, last_col: str = "last_value", watermark_type: str = "timestamp") -> str | None:
    """The low end of a run over many configs, taken once at run start: the smallest readable
    last value, as text; None when no config has one. One row per config is aggregated."""
    return watermarks.agg(F.min(_typed_last(watermarks, last_col, watermark_type)).cast("string")).first()[0]


def incremental_by_config(source: DataFrame, watermarks: DataFrame, config_col: str, watermark_col: str,
                          last_col: str = "last_value", watermark_type: str = "timestamp", upper: Column | None = None,
                          configs: DataFrame | None = None) -> DataFrame:
    """R02 for many configs in one run: each source row is kept when it is above its own
    config's last value and at most ``upper``; configs without a watermark read everything
    up to ``upper``, rows without a value in the watermark column included. Stored values are
    read by ``watermark_type``; a config whose value cannot be read extracts nothing (see
    ``typed_watermarks`` for the rejects). The watermark table has one row per config.

    The two kinds are read apart. Configs with a watermark: the smallest of the last values is
    taken once, as a literal, and bounds the scan (pushed filter), so history below it is not
    read; then each row meets its own config's value. Configs without one need their whole
    history: with ``configs`` (table_config_id of the configs to load; rows of others are not
    read) only theirs is kept, and there is no such read when all have a watermark. Without
    ``configs`` every row whose config has no watermark counts."""
    wm = watermarks.select(F.col("table_config_id").alias("_wcfg"), F.col(last_col).alias("_wtext"),
                           _typed_last(watermarks, last_col, watermark_type).alias("_wlast"))
    low = lower_bound(watermarks, last_col, watermark_type)
    rows = source if upper is None else source.filter((F.col(watermark_col) <= upper) | F.col(watermark_col).isNull())
    known = wm.filter(F.col("_wtext").isNotNull()).select("_wcfg")
    if configs is None:
        whole = rows.join(known, rows[config_col] == known["_wcfg"], "left_anti")
    else:
        asked = configs.select(F.col("table_config_id").alias("_ocfg")).distinct()
        wm = wm.join(asked, wm["_wcfg"] == asked["_ocfg"], "left_semi")
        open_ = asked.join(known, asked["_ocfg"] == known["_wcfg"], "left_anti")
        whole = None if open_.isEmpty() else rows.join(open_, rows[config_col] == open_["_ocfg"], "left_semi")
    if low is None:
        return whole if whole is not None else source.filter(F.lit(False))
    recent = rows.filter(F.col(watermark_col) > _as_literal(low, source.schema[watermark_col].dataType))
    j = recent.join(wm.filter(F.col("_wlast").isNotNull()), recent[config_col] == F.col("_wcfg"))
    above = j.filter(F.col(watermark_col) > F.col("_wlast")).select(*source.columns)
    return above if whole is None else above.unionByName(whole)


# ---- R03 hash-key incremental ----

def key_range(df: DataFrame, key: str) -> Column:
    """The condition that ``key`` lies between the least and the largest of ``df`` (or is NULL,
    where ``df`` has NULL keys): literals, so it reaches the scan it is put on as a pushed
    filter. A type without an order through text (binary, maps, structs) gives no bound."""
    typ = df.schema[key].dataType
    if not (isinstance(typ, (NumericType, StringType, DateType)) or typ.typeName().startswith("timestamp")):
        return F.lit(True)
    row = df.agg(F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"),
                 F.count_if(F.col(key).isNull()).alias("nulls")).first()
    inside = F.col(key).between(_as_literal(row.low, typ), _as_literal(row.high, typ)) if row.low is not None else F.lit(False)
    return (inside | F.col(key).isNull()) if row.nulls else inside


def hash_changes(source: DataFrame, target: DataFrame, keys: list[str], hash_cols: list[str],
                 hash_col: str = "row_hash") -> DataFrame:
    """Source rows whose natural key is new, or whose row hash (R08) differs from the
    target's, with ``change_kind`` new/changed. ``target`` holds (keys, hash_col) of the last
    load. Keys match null-safe, so an unchanged row with a NULL key is not new again on every
    run; a NULL stored hash counts as changed.

    The extract is read once: it is written with its hashes, and the bound on the stored table
    (the extract's key range, pushed to its scan), the stored hashes of the extract's keys and
    the comparison all come from what was written."""
    src = pin(source.withColumn(hash_col, row_hash(hash_cols)), "extract")
    # keep only the stored hashes of keys in this extract: a semi join that AQE broadcasts
    # when the extract is small, so the stored (key, hash) table is scanned, not shuffled
    stored = target.select(*keys, hash_col).filter(key_range(src, keys[0]))
    extract = src.select(*[F.col(k).alias(f"_e_{k}") for k in keys])
    relevant = stored.join(extract, _key_cond(stored, extract, keys, "_e_"), "left_semi")
    tgt = relevant.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(hash_col).alias("_t_hash"))
    tgt = tgt.withColumn("_t_hit", F.lit(True))
    j = src.join(tgt, _key_cond(src, tgt, keys, "_t_"), "left")
    kind = F.when(F.col("_t_hit").isNull(), F.lit("new")).when(~F.col("_t_hash").eqNullSafe(F.col(hash_col)), F.lit("changed"))
    return j.withColumn("change_kind", kind).filter(F.col("change_kind").isNotNull()).drop(
        *[f"_t_{k}" for k in keys], "_t_hash", "_t_hit"
    )


def with_row_hash(df: DataFrame, cols: list[str], name: str = "row_hash") -> DataFrame:
    """R08 as a column of the DataFrame."""
    return df.withColumn(name, row_hash(cols))


# ---- R04 watermark advance ----

def advance_watermark(watermarks: DataFrame, extracted: DataFrame, config_col: str, watermark_col: str,
                      last_col: str = "last_value", watermark_type: str = "timestamp") -> DataFrame:
    """Per config the new value = max extracted, never lower than the old one and
    unchanged when nothing was extracted. Covers every config that has a watermark or
    extracted rows (a first load has no watermark yet); configs whose stored value cannot
    be read are left out, as R02 extracts nothing for them. Values are compared in the
    type of ``watermark_type``. Returns table_config_id, watermark_start (old, as stored),
    watermark_end (new, typed), rows_read: the inputs of D33 and D36."""
    got = extracted.groupBy(F.col(config_col).alias("_cfg")).agg(
        F.max(watermark_col).alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    readable, _ = typed_watermarks(watermarks, watermark_type, last_col)
    wm = readable.select("table_config_id", F.col(last_col).alias("_start"), "_last")
    j = wm.join(got, wm["table_config_id"] == got["_cfg"], "full")
    return j.select(
        F.coalesce("table_config_id", "_cfg").alias("table_config_id"),
        F.col("_start").alias("watermark_start"),
        F.greatest(F.col("_last"), F.col("_max")).alias("watermark_end"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("rows_read"),
    )


def canonical_text(col: str | Column, typ: DataType) -> Column:
    """A watermark as stored text: ISO with microseconds for timestamps."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, ISO_MICROS) if isinstance(typ, (TimestampType, TimestampNTZType)) else c.cast("string")


def watermark_upserts(advanced: DataFrame, watermark_column: str, watermark_type: str, run_id: str,
                      actor: str = "system", as_text: bool = False) -> DataFrame:
    """R04 -> D33: upsert requests for the configs whose watermark moved (rows were read);
    configs with nothing extracted keep their watermark untouched. ``as_text`` writes the
    value as the stored schema has it: canonical text."""
    if as_text:
        typ = advanced.schema["watermark_end"].dataType
        advanced = advanced.withColumn("watermark_end", canonical_text("watermark_end", typ))
    return advanced.filter(F.col("rows_read") > 0).select(
        "table_config_id", F.col("table_config_id").alias("request_seq"),
        F.lit(watermark_column).alias("watermark_column"), F.lit(watermark_type).alias("watermark_type"),
        F.col("watermark_end").alias("last_value"), F.lit(run_id).alias("last_run_id"), F.lit(actor).alias("updated_by"),
    )


ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def run_close_requests(advanced: DataFrame, runs: DataFrame, now, status: str = "succeeded", actor: str = "system") -> DataFrame:
    """R04 -> D36: close each config's latest open (active, running) run with the advance:
    end_time = ``now``, elapsed seconds, rows read (= written), watermark start/end as ISO
    text. The latest open run per config is a map-side max, joined on the config key."""
    from sluice.operators.mutate import ts_literal

    open_runs = runs.filter(F.col("is_active") & (F.col("status") == "running")).groupBy(
        F.col("table_config_id").alias("_cfg")).agg(F.max(F.struct("table_run_id", "start_time")).alias("_r"))
    t = ts_literal(now)
    j = advanced.join(open_runs, advanced["table_config_id"] == open_runs["_cfg"], "inner")

    def text(c):
        return canonical_text(c, advanced.schema[c].dataType)

    return j.select(
        F.col("_r.table_run_id").alias("table_run_id"), F.col("_r.table_run_id").alias("request_seq"),
        t.alias("end_time"), F.timestamp_diff("SECOND", F.col("_r.start_time"), t).cast("long").alias("elapsed_seconds"),
        F.col("rows_read"), F.col("rows_read").alias("rows_written"),
        text("watermark_start").alias("watermark_start"), text("watermark_end").alias("watermark_end"),
        F.lit(status).alias("status"), F.lit(actor).alias("updated_by"),
    )


# ---- R05 natural-key upsert ----

def latest_by_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per natural key; ties in ``order`` are broken by every other column
    (maps by their JSON), so the pick is deterministic. Aggregated map-side (hot keys shrink
    before the shuffle)."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order, *_ties(batch, rest))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]]).select(*batch.columns)


def _matched_keys(target: DataFrame, batch_keys: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Batch keys present in the target: a key-only scan of the target joined with the
    batch's keys (which the planner broadcasts when the batch is small)."""
    t = target.select(*[F.col(k).alias(f"_m_{k}") for k in keys])
    return batch_keys.join(t, _key_cond(batch_keys, t, keys, "_m_", null_safe), "left_semi")


def _absent(batch: DataFrame, target: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Batch rows whose key is not in the target: anti join of batch-sized sides."""
    known = _matched_keys(target, batch.select(*keys), keys, null_safe).select(*[F.col(k).alias(f"_a_{k}") for k in keys])
    return batch.join(known, _key_cond(batch, known, keys, "_a_", null_safe), "left_anti")


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], null_safe: bool = True) -> DataFrame:
    """Dedupe the batch to its latest row per key, update matched target rows,
    insert new keys, keep the rest; keys match null-safe, so the same batch twice gives the
    same rows as once. Adds ``merge_action`` (insert/update/keep).

    No full outer join (which always shuffles both sides): the target left-joins the
    deduplicated batch (broadcast by AQE when the batch is small, so the big target is
    not shuffled), and the inserts are the batch keys absent from a key-only scan of the
    target, an anti join between two batch-sized sides. ``null_safe=False`` is for batches
    without NULL keys: plain equality, which a bucketed target serves without a shuffle
    (``sluice.operators.bucketed``).
    """
    latest = pin(latest_by_key(batch, keys, order), "batch")  # folded once, read three times
    b = latest.select(*[F.col(c).alias(f"_b_{c}") for c in latest.columns]).withColumn("_b_hit", F.lit(True))
    j = target.join(b, _key_cond(target, b, keys, "_b_", null_safe), "left")
    hit = F.col("_b_hit").isNotNull()
    kept = j.select(*[F.when(hit, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) if c in latest.columns else F.col(c) for c in target.columns],
                    F.when(hit, F.lit("update")).otherwise(F.lit("keep")).alias("merge_action"))
    inserts = _absent(latest, target, keys, null_safe)
    inserts = inserts.select(*[F.col(c) if c in inserts.columns else F.lit(None).cast(target.schema[c].dataType).alias(c)
                               for c in target.columns], F.lit("insert").alias("merge_action"))
    return kept.unionByName(inserts)


def merge_condition(table: str, src: DataFrame, keys: list[str]) -> Column:
    """Keys of the target table equal to the batch's, NULL to NULL: as in ``upsert_by_key``."""
    cond = None
    for k in keys:
        term = F.col(f"{table}.{k}").eqNullSafe(src[k])
        cond = term if cond is None else cond & term
    return cond


def merge_into_table(table: str, batch: DataFrame, keys: list[str], order: list[str]) -> None:
    """R05 in place, for catalogs with row-level operations (Delta, Iceberg): the batch is
    deduplicated to its latest row per key first (MERGE rejects several source rows for
    one target row), then merged null-safe: matched rows updated, new keys inserted. Spark's
    built-in catalog refuses row-level writes; there ``upsert_by_key`` plus a new
    snapshot is the path."""
    src = latest_by_key(batch, keys, order)
    src.mergeInto(table, merge_condition(table, src, keys)).whenMatched().updateAll().whenNotMatched().insertAll().merge()


# ---- R06 CDC apply ----

def cdc_apply(target: DataFrame, changes: DataFrame, keys: list[str], seq_col: str, op_col: str,
              value_cols: list[str], null_safe: bool = True) -> DataFrame:
    """As if the changes were applied one by one in ``seq_col`` order. The values come
    from the key's last I or U, the activity from its last change (D keeps the values); a
    key with only D changes and no target row adds nothing. When the target has
    ``last_seq``, changes at or below it are old news and skipped, so a replayed or older
    batch changes nothing. Keys match null-safe. Output: all target columns (new keys have
    NULL in those the changes don't carry), is_active and last_seq.

    Same shape as R05: the target left-joins the folded changes (broadcastable when the
    change set is small), new keys come from an anti join of change-sized sides;
    ``null_safe=False`` as there, for changes without NULL keys.
    """
    ch = changes.select(*keys, F.col(seq_col).alias("_seq"), F.col(op_col).alias("_op"), *[F.col(v).alias(f"_v_{v}") for v in value_cols])
    if "last_seq" in target.columns:
        seen = target.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("last_seq").alias("_last"))
        ch = ch.join(seen, _key_cond(ch, seen, keys, "_s_", null_safe), "left")
        ch = ch.filter(F.col("_last").isNull() | (F.col("_seq") > F.col("_last"))).drop(*[f"_s_{k}" for k in keys], "_last")
    values = [f"_v_{v}" for v in value_cols]
    order = F.struct("_seq", "_op", *_ties(ch, values))
    writes = F.col("_op").isin("I", "U")
    folded = ch.groupBy(*keys).agg(
        F.max_by("_op", order).alias("_last_op"), F.max("_seq").alias("_c_seq"),
        F.max_by(F.struct(*values), F.when(writes, order)).alias("_w"))
    folded = pin(folded, "changes")
    c = folded.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_last_op", "_c_seq", "_w")
    t = target if "last_seq" in target.columns else target.withColumn("last_seq", F.lit(None).cast(changes.schema[seq_col].dataType))
    j = t.join(c, _key_cond(t, c, keys, "_c_", null_safe), "left")
    new = {v: F.when(F.col("_w").isNotNull(), F.col(f"_w._v_{v}")).otherwise(F.col(v)) for v in value_cols}
    new["is_active"] = F.when(F.col("_last_op").isin("I", "U"), F.lit(True)).when(F.col("_last_op") == "D", F.lit(False)).otherwise(F.col("is_active"))
    new["last_seq"] = F.coalesce("_c_seq", "last_seq")
    existing = j.withColumns(new).select(*t.columns)
    fresh = _absent(folded.filter(F.col("_w").isNotNull()), t, keys, null_safe)
    given = {**{k: F.col(k) for k in keys}, **{v: F.col(f"_w._v_{v}") for v in value_cols},
             "is_active": F.col("_last_op") != "D", "last_seq": F.col("_c_seq")}
    fresh = fresh.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema.fields])
    return existing.unionByName(fresh)


# ---- R09 partitioned write ----

def partitioned_write(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet",
                      cluster: bool = False, num_partitions: int | None = None,
                      max_records_per_file: int | None = None) -> str:
    """Write by partition columns, replacing only the partitions present in ``df``
    (dynamic partition overwrite); untouched partitions stay as they are.

    ``cluster`` rebalances on the partition columns first: each task then writes few
    partition values (few files), and AQE splits a value with a third of the rows over many
    tasks and joins small ones. With ``num_partitions`` the layout is fixed instead: a range
    partitioning on (partition columns, a deterministic row hash).
    """
    out = df
    if cluster and num_partitions:
        out = df.repartitionByRange(num_partitions, *[F.col(c) for c in partition_cols], F.xxhash64(*[F.col(c) for c in df.columns]))
    elif cluster:
        out = df.hint("rebalance", *partition_cols)
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).format(fmt)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.save(path)
    return path


def split_columns(csv_text: Column) -> Column:
    """'a, b ,c' -> ['a','b','c'] for natural_key_columns / partition_columns."""
    return F.filter(F.transform(F.split(csv_text, ","), lambda x: F.trim(x)), lambda x: x != F.lit(""))
