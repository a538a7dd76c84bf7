"""Mutations D27-D37 as (old state, change rows, actor, now) -> new state.

Nothing is updated in place: every operator returns the whole new state as a DataFrame
(same row count for updates and soft deletes) for the caller to write as a new snapshot.
Change rows carry ``request_seq``: several requests for one key in a batch end as if
applied one after another in that order. ``now`` is always an argument.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from sluice import schemas as S
from sluice.functions.exprs import as_flag, decode_json_variants, encode_json_columns
from sluice.operators.conform import conform
from sluice.operators.eav import map_to_eav
from sluice.operators.keys import (
    PID,
    POS,
    assign_sequential_ids,
    earlier_rows,
    earlier_slices,
    in_slice,
    join_slice_stats,
    next_id_base,
    ordered_slices,
    sequence_within,
)
from sluice.operators.load import _ties
from sluice.operators.reads import latest_per_key
from sluice.operators.validate import (
    ERROR,
    bulk_validate,
    connector_code,
    load_type_code,
    missing_parent,
    source_attributes_code_of,
    unique_names,
)

SEQ = "request_seq"


def ts_literal(now) -> Column:
    """``now`` (datetime or ISO text) as a timestamp_ntz literal in UTC wall-clock time."""
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    return F.lit(str(now)).cast(TimestampNTZType())


def _active(df: DataFrame) -> Column:
    return as_flag("is_active", df.schema["is_active"].dataType)


def _stored_flag(state: DataFrame, value: Column, name: str = "is_active") -> Column:
    """A boolean in the state's own flag type (D05 on write: 0/1 states keep integers)."""
    typ = state.schema[name].dataType
    return value if typ.typeName() == "boolean" else value.cast("int").cast(typ)


def _as_state_type(state: DataFrame, name: str, value: Column) -> Column:
    """A change value in the state column's type (0/1 flags become booleans, D05)."""
    typ = state.schema[name].dataType
    return as_flag(value, None) if typ.typeName() == "boolean" else value.cast(typ)


def _latest_value(col: str, seq: str = SEQ) -> Column:
    """Last non-NULL value of ``col`` in request order (max_by ignores NULL orderings)."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(seq)))


def stamp(df: DataFrame, now, default_actor: str = S.DEFAULT_ACTOR) -> DataFrame:
    """created_by default 'system', updated_by defaults to created_by,
    created_at = updated_at = one instant for the whole batch."""
    created_by = F.coalesce(F.col("created_by"), F.lit(default_actor)) if "created_by" in df.columns else F.lit(default_actor)
    updated_by = F.coalesce(F.col("updated_by"), created_by) if "updated_by" in df.columns else created_by
    t = ts_literal(now)
    return df.withColumns({"created_by": created_by, "updated_by": updated_by, "created_at": t, "updated_at": t})


def patch_update(state: DataFrame, changes: DataFrame, key: str, fields: list[str], now,
                 actor_col: str = "updated_by") -> DataFrame:
    """Non-NULL fields replace, NULL keeps; only active rows change; updated_by is
    the last request's actor (default 'system'), updated_at = ``now``.

    Requests are folded per key map-side (``max_by`` on request_seq), then one left join
    on the primary key; the state keeps its row count.
    """
    aggs = [_latest_value(f).alias(f"_new_{f}") for f in fields]
    actor = F.coalesce(F.col(actor_col), F.lit(S.DEFAULT_ACTOR)) if actor_col in changes.columns else F.lit(S.DEFAULT_ACTOR)
    folded = changes.withColumn("_actor", actor).groupBy(F.col(key).alias("_k")).agg(
        *aggs, F.max_by("_actor", F.col(SEQ)).alias("_new_actor")
    )
    j = state.join(folded, state[key] == folded["_k"], "left")
    hit = F.col("_k").isNotNull() & _active(state)
    out = {f: F.when(hit, F.coalesce(_as_state_type(state, f, F.col(f"_new_{f}")), F.col(f))).otherwise(F.col(f)) for f in fields}
    out["updated_by"] = F.when(hit, F.col("_new_actor")).otherwise(F.col("updated_by"))
    out["updated_at"] = F.when(hit, ts_literal(now)).otherwise(F.col("updated_at"))
    return j.withColumns(out).select(*state.columns)


def overwrite_update(state: DataFrame, changes: DataFrame, key: str, fields: list[str], now,
                     actor_col: str = "updated_by") -> DataFrame:
    """Every supplied field replaces, NULL included; the last request per key wins."""
    actor = F.coalesce(F.col(actor_col), F.lit(S.DEFAULT_ACTOR)) if actor_col in changes.columns else F.lit(S.DEFAULT_ACTOR)
    last = changes.withColumn("_actor", actor).groupBy(F.col(key).alias("_k")).agg(
        F.max_by(F.struct(*[F.col(f).alias(f"_new_{f}") for f in fields], F.col("_actor")),
                 F.struct(F.col(SEQ), *_ties(changes, fields), F.col("_actor"))).alias("_l")
    ).select("_k", "_l.*")
    j = state.join(last, state[key] == last["_k"], "left")
    hit = F.col("_k").isNotNull() & _active(state)
    out = {f: F.when(hit, _as_state_type(state, f, F.col(f"_new_{f}"))).otherwise(F.col(f)) for f in fields}
    out["updated_by"] = F.when(hit, F.col("_actor")).otherwise(F.col("updated_by"))
    out["updated_at"] = F.when(hit, ts_literal(now)).otherwise(F.col("updated_at"))
    return j.withColumns(out).select(*state.columns)


def soft_delete(state: DataFrame, ids: DataFrame, key: str, now, actor: str = S.DEFAULT_ACTOR,
                id_col: str | None = None, actor_col: str | None = None) -> DataFrame:
    """Active rows whose ``key`` is in ``ids`` get is_active=false and new stamps;
    no row is removed. ``ids`` is reduced to one row per key before the join; with
    ``actor_col`` each id carries its own actor (the largest if an id repeats)."""
    id_col = id_col or key
    who = F.max(actor_col) if actor_col else F.lit(actor)
    hits = ids.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_d")).agg(who.alias("_who"))
    j = state.join(hits, state[key] == hits["_d"], "left")
    hit = F.col("_d").isNotNull() & _active(state)
    return j.withColumns({
        "is_active": _stored_flag(state, F.when(hit, F.lit(False)).otherwise(_active(state))),
        "updated_by": F.when(hit, F.col("_who")).otherwise(F.col("updated_by")),
        "updated_at": F.when(hit, ts_literal(now)).otherwise(F.col("updated_at")),
    }).select(*state.columns)


def soft_delete_connections(master: DataFrame, details: DataFrame, auth: DataFrame, ids: DataFrame, now,
                            actor: str = S.DEFAULT_ACTOR) -> dict[str, DataFrame]:
    """D30 for connections: the master row and its details and auth rows, by connection_id.
    Only connections that are active are deleted (the reference's not-found guard)."""
    alive = master.filter(_active(master)).select("connection_id").join(ids.select("connection_id").distinct(), "connection_id", "left_semi")
    return {
        "conn_master": soft_delete(master, alive, "connection_id", now, actor),
        "connection_details": soft_delete(details, alive, "connection_id", now, actor),
        "connection_auth": soft_delete(auth, alive, "connection_id", now, actor),
    }


def cascade_soft_delete(configs: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame, now,
                        actor: str = S.DEFAULT_ACTOR, key: str = "table_config_id") -> dict[str, DataFrame]:
    """Soft-delete active configs in ``ids``, then, for the configs that were active,
    every child table by its parent column (watermark, schema version, PII, audit by
    table_config_id; BTS by source_config_id). Returns table name -> new state."""
    alive = configs.filter(_active(configs)).select(key).join(ids.select(key).distinct(), key, "left_semi")
    out = {"tbl_source_table": soft_delete(configs, alive, key, now, actor)}
    for name, (df, parent_col) in children.items():
        out[name] = soft_delete(df, alive, parent_col, now, actor, id_col=key)
    return out


def replace_children(state: DataFrame, parents: DataFrame, new_children: DataFrame, parent_col: str, id_col: str,
                     order: list, now, actor: str = S.DEFAULT_ACTOR, actor_col: str | None = None) -> DataFrame:
    """Soft-delete every active child of the ``parents``, then append the
    ``new_children`` of those parents with fresh ids (max+1.. in ``order``). A parent with no new children
    is just cleared. Children are stamped with ``actor`` (or the per-parent ``actor_col``
    carried by ``parents`` and ``new_children``) and ``now``."""
    cleared = soft_delete(state, parents, parent_col, now, actor, actor_col=actor_col)
    asked = parents.select(F.col(parent_col).alias("_asked")).distinct()
    mine = new_children.join(asked, new_children[parent_col] == asked["_asked"], "left_semi")
    fresh = assign_sequential_ids(mine, state, id_col, order)
    t = ts_literal(now)
    who = F.col(actor_col) if actor_col else F.lit(actor)
    fresh = fresh.withColumns({
        "is_active": F.lit(True), "created_by": who, "updated_by": who, "created_at": t, "updated_at": t,
    })
    return cleared.unionByName(conform(fresh, state.schema))


WATERMARK_FIELDS = ["watermark_column", "watermark_type", "last_value", "last_run_id", "env_type"]


def upsert_watermark(state: DataFrame, upserts: DataFrame, now, fields: list[str] | None = None) -> DataFrame:
    """Per config, if an active watermark exists (highest watermark_id) all payload
    fields overwrite it (D28, NULL included); otherwise a row is inserted with the next
    id. created_by = updated_by = the request's actor. The last request per config wins.
    Returns the whole new state."""
    fields = fields or [f for f in WATERMARK_FIELDS if f in upserts.columns]
    cur = latest_per_key(state, "table_config_id", "watermark_id").select(
        F.col("table_config_id").alias("_cfg"), F.col("watermark_id").alias("_wid")
    )
    actor = F.coalesce(F.col("updated_by"), F.lit(S.DEFAULT_ACTOR)) if "updated_by" in upserts.columns else F.lit(S.DEFAULT_ACTOR)
    last = upserts.withColumn("updated_by", actor).groupBy("table_config_id").agg(
        F.max_by(F.struct(*[F.col(f) for f in fields], F.col("updated_by")),
                 F.struct(F.col(SEQ), *_ties(upserts, fields), F.col("updated_by"))).alias("_l")
    ).select("table_config_id", *[F.col(f"_l.{f}").alias(f) for f in [*fields, "updated_by"]])
    matched = last.join(cur, last["table_config_id"] == cur["_cfg"], "left")
    updates = matched.filter(F.col("_wid").isNotNull()).select(F.col("_wid").alias("watermark_id"), *fields, "updated_by")
    updates = updates.withColumn(SEQ, F.lit(0))
    new_state = overwrite_update(state, updates, "watermark_id", fields, now)
    inserts = matched.filter(F.col("_wid").isNull()).drop("_cfg", "_wid")
    inserts = assign_sequential_ids(inserts, state, "watermark_id", ["table_config_id"])
    t = ts_literal(now)
    inserts = inserts.withColumns({
        "is_active": F.lit(True), "created_by": F.col("updated_by"), "created_at": t, "updated_at": t,
        "env_type": F.coalesce(F.col("env_type"), F.lit("dev")) if "env_type" in inserts.columns else F.lit("dev"),
    })
    return new_state.unionByName(conform(inserts, state.schema))


def add_schema_versions(state: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Append one version row per request. An explicit ``version_number`` is kept;
    otherwise the number continues the config's running maximum, as sequential calls
    would: the maximum over *all* existing versions (inactive too), raised by explicit
    numbers and by the automatic numbers of earlier requests in the batch (request order).
    Ids are D12. Returns only the new rows.

    An automatic number is A + max(base, max over earlier explicit k of (e_k - A_k)),
    where A counts the automatic requests so far (without explicit numbers: base + A). Both
    counters, the config's and the ids', come from one sorted layout (``_number_versions``).
    """
    base = state.groupBy(F.col("table_config_id").alias("_cfg")).agg(F.max("version_number").alias("_max"))
    requests = encode_json_columns(requests, ["column_changes_json"])
    if "version_number" not in requests.columns:
        requests = requests.withColumn("version_number", F.lit(None).cast("long"))
    rows = _number_versions(requests, base)
    rows = rows.withColumn("version_id", (next_id_base(state, "version_id") + F.col("_place")).cast("long"))
    actor = F.coalesce(F.col("created_by"), F.lit(S.DEFAULT_ACTOR)) if "created_by" in rows.columns else F.lit(S.DEFAULT_ACTOR)
    t = ts_literal(now)
    rows = rows.withColumns({
        "created_by": actor, "updated_by": actor, "created_at": t, "updated_at": t, "is_active": F.lit(True),
        "env_type": F.coalesce(F.col("env_type"), F.lit("dev")) if "env_type" in rows.columns else F.lit("dev"),
    })
    return conform(rows, state.schema)


def _number_versions(requests: DataFrame, base: DataFrame) -> DataFrame:
    """Version numbers per config and each row's place in the whole batch (``_place``, from
    1), in one layout sorted by request order (``ordered_slices``): a config's rows in one
    task are a slice of it, and its slices follow each other in task order.

    v_i = A_i + max(base, max over earlier explicit k of (e_k - A_k)), A = automatic
    requests so far. Inside a slice A and the running max of (e_k - A_k) are window
    aggregates; a slice's carry-in (A of earlier slices, and their best e_k - A_k, which
    shifts by that same carry) comes from the per-slice summary windowed over the config. The
    config's base and the task's count of earlier rows ride on the same summary, so the rows
    are joined once.
    """
    group = ["table_config_id"]
    auto = F.col("version_number").isNull()
    r = ordered_slices(requests.withColumn("_auto", auto.cast("long")), [F.col(SEQ)], [])
    r = r.withColumn("_a_loc", F.sum("_auto").over(in_slice(group)))
    r = r.withColumn("_d", F.when(~auto, F.col("version_number") - F.col("_a_loc")))
    r = r.withColumn("_d_loc", F.max("_d").over(in_slice(group)))
    stats = r.groupBy(PID, *group).agg(F.sum("_auto").alias("_cnt"), F.max("_d").alias("_md"))
    stats = stats.withColumn("_a_carry", F.coalesce(F.sum("_cnt").over(earlier_slices(group)), F.lit(0)))
    stats = stats.withColumn("_p_carry", F.max(F.col("_md") - F.col("_a_carry")).over(earlier_slices(group)))
    stats = stats.join(base, stats["table_config_id"].eqNullSafe(base["_cfg"]), "left").join(earlier_rows(r), PID)
    r = join_slice_stats(r, stats, group, ["_a_carry", "_p_carry", "_max", "_er_before"])
    lift = F.greatest(F.col("_d_loc") - F.col("_a_carry"), F.col("_p_carry"))
    numbered = F.col("_a_loc") + F.col("_a_carry") + F.greatest(F.coalesce(F.col("_max"), F.lit(0)), lift)
    r = r.withColumns({
        "version_number": F.when(auto, numbered).otherwise(F.col("version_number")).cast("long"),
        "_place": F.col(POS) + F.col("_er_before") + 1})
    return r.drop(PID, POS, "_auto", "_a_loc", "_d", "_d_loc", "_a_carry", "_p_carry", "_max", "_er_before")


def guarded(requests: DataFrame, parents: DataFrame, key: str, apply, parent_key: str | None = None,
            code: str = S.PIPELINE_CONFIG_NOT_FOUND) -> dict[str, DataFrame]:
    """D25 in front of a change: requests whose active parent is missing are refused with
    ``code``; ``apply`` gets the others. Returns the change's ``state`` and the ``rejects``.
    Used for watermarks, schema versions, PII sets, deletes (parent: the config) and run
    closes (parent: the run itself)."""
    tagged = missing_parent(requests, parents, key, parent_key, code)
    return {"state": apply(tagged.filter(F.col(ERROR).isNull()).drop(ERROR)), "rejects": tagged.filter(F.col(ERROR).isNotNull())}


RUN_CLOSE_FIELDS = ["end_time", "elapsed_seconds", "rows_read", "rows_written", "watermark_start",
                    "watermark_end", "status", "error_message", "error_type"]


def open_runs(state: DataFrame, requests: DataFrame, now, order: list | None = None) -> DataFrame:
    """One audit row per request: status default 'running', start_time required
    (requests without one are not opened; ``run_rejects`` returns them), ids D12, stamps D29. Returns only the new rows."""
    reqs = encode_json_columns(requests.filter(F.col("start_time").isNotNull()), ["source_attributes", "target_attributes"])
    reqs = reqs.withColumn("status", F.coalesce(F.col("status"), F.lit("running")) if "status" in reqs.columns else F.lit("running"))
    reqs = stamp(reqs, now).withColumn("is_active", F.lit(True))
    if "env_type" not in reqs.columns:
        reqs = reqs.withColumn("env_type", F.lit("dev"))
    reqs = assign_sequential_ids(reqs, state, "table_run_id", order or [F.col(SEQ)])
    return conform(reqs, state.schema)


def run_rejects(requests: DataFrame) -> DataFrame:
    """The requests that ``open_runs`` refuses (no start_time), with their code."""
    return requests.filter(F.col("start_time").isNull()).withColumn(ERROR, F.lit(S.MISSING_REQUIRED_FIELD))


def close_runs(state: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Patch (D27) of the close fields of active runs."""
    fields = [f for f in RUN_CLOSE_FIELDS if f in changes.columns]
    return patch_update(state, changes, "table_run_id", fields, now)


def _entries(map_col: str) -> Column:
    """Entries of a map, 0 for NULL (``size`` gives -1 there without ANSI mode)."""
    return F.when(F.col(map_col).isNotNull(), F.size(map_col)).otherwise(F.lit(0))


def composite_create(master: DataFrame, details: DataFrame, auth: DataFrame, requests: DataFrame, now) -> dict[str, DataFrame]:
    """Connection requests (name, type, domain, is_target, env_type, auth_type,
    details map, auth map, created_by, updated_by, request_seq) -> validated (D21, D24),
    id-assigned (D12) rows for conn_master, connection_details and connection_auth, plus
    the rejects. Children are returned first-class so the caller writes them before the
    master (a reader never sees a parent without its children)."""
    checked = unique_names(requests, master)
    ok = checked.filter(F.col(ERROR).isNull()).drop(ERROR)
    # One sorted pass gives each connection its id and the offsets at which its details
    # and auth rows start, so the children's ids need no sort of their own.
    ok = sequence_within(ok, [F.col(SEQ)], None, name="_pos", sums={
        "_d_off": _entries("details") if "details" in ok.columns else F.lit(0),
        "_a_off": _entries("auth") if "auth" in ok.columns else F.lit(0),
    })
    ok = ok.withColumns({
        "connection_id": (next_id_base(master, "connection_id") + F.col("_pos")).cast("long"),
        "_d_base": next_id_base(details, "connection_details_id") + F.col("_d_off"),
        "_a_base": next_id_base(auth, "connection_auth_id") + F.col("_a_off"),
    })
    ok = stamp(ok, now).withColumn("is_active", F.lit(True))
    ok = ok.withColumn("is_target", F.coalesce(as_flag("is_target", ok.schema["is_target"].dataType), F.lit(False))
                       if "is_target" in ok.columns else F.lit(False))
    carry = ["env_type", "is_active", "created_by", "created_at"]
    d = map_to_eav(ok, "connection_id", "details", "connection_property_id", "connection_property",
                   "connection_property_value", [*carry, "_d_base"])
    d = d.withColumns({"updated_by": F.col("created_by"), "updated_at": F.col("created_at"),
                       "connection_details_id": (F.col("_d_base") + F.col("connection_property_id")).cast("long")})
    a = map_to_eav(ok, "connection_id", "auth", "auth_property_id", "auth_property", "auth_property_value", [*carry, "_a_base"])
    a = a.withColumns({"updated_by": F.col("created_by"), "updated_at": F.col("created_at"),
                       "connection_auth_id": (F.col("_a_base") + F.col("auth_property_id")).cast("long")})
    return {
        "connection_details": conform(d, details.schema),
        "connection_auth": conform(a, auth.schema),
        "conn_master": conform(ok, master.schema),
        "rejects": checked.filter(F.col(ERROR).isNotNull()),
    }


CONNECTION_PATCH_FIELDS = ["connection_domain_name", "is_target"]
_CHILD_SETS = [
    ("connection_details", "details", "connection_details_id", "connection_property_id", "connection_property", "connection_property_value"),
    ("connection_auth", "auth", "connection_auth_id", "auth_property_id", "auth_property", "auth_property_value"),
]


def validate_connection_updates(master: DataFrame, requests: DataFrame) -> DataFrame:
    """D25 then D21 for connection updates: CONNECTION_NOT_FOUND without an active master
    row; when an ``auth`` map is supplied its ``auth_type`` (default 'basic') must be
    offered by the stored connection type."""
    checked = missing_parent(requests, master, "connection_id", code=S.CONNECTION_NOT_FOUND)
    if "auth" not in checked.columns:
        return checked
    types = master.select(F.col("connection_id").alias("_cid"), F.col("connection_type").alias("_ctype"))
    j = checked.join(types, checked["connection_id"] == types["_cid"], "left")
    auth_type = F.coalesce(F.col("auth_type"), F.lit("basic")) if "auth_type" in j.columns else F.lit("basic")
    j = connector_code(j.withColumn("_atype", auth_type), "_ctype", "_atype")
    code = F.when(F.col("auth").isNotNull(), F.col("_connector_code"))
    return j.withColumn(ERROR, F.coalesce(F.col(ERROR), code)).drop("_cid", "_ctype", "_atype", "_connector_code")


def update_connections(master: DataFrame, details: DataFrame, auth: DataFrame, requests: DataFrame, now,
                       only: set[str] | None = None) -> dict[str, DataFrame]:
    """D27 + D32 for connections. Requests: connection_id, request_seq, optional
    connection_domain_name / is_target (patched, NULL keeps), optional details / auth maps
    (when supplied, the active children are replaced; property ids restart at 1; the last
    supplying request per connection wins), auth_type, updated_by. Returns the new master,
    details and auth states plus the rejects (D25, D21); ``only`` limits the child tables
    built (id assignment pins its rows with a checkpoint, so unused outputs cost a job)."""
    checked = validate_connection_updates(master, requests)
    ok = checked.filter(F.col(ERROR).isNull()).drop(ERROR)
    actor = F.coalesce(F.col("updated_by"), F.lit(S.DEFAULT_ACTOR)) if "updated_by" in ok.columns else F.lit(S.DEFAULT_ACTOR)
    ok = ok.withColumn("updated_by", actor)
    fields = [f for f in CONNECTION_PATCH_FIELDS if f in ok.columns]
    if "is_target" in fields:
        ok = ok.withColumn("is_target", as_flag("is_target", ok.schema["is_target"].dataType))
    out = {"conn_master": patch_update(master, ok, "connection_id", fields, now),
           "rejects": checked.filter(F.col(ERROR).isNotNull())}
    env = master.select(F.col("connection_id").alias("_eid"), F.col("env_type").alias("_env"))
    states = {"connection_details": details, "connection_auth": auth}
    for name, map_col, id_col, pid, kcol, vcol in _CHILD_SETS:
        if map_col not in ok.columns or (only is not None and name not in only):
            out[name] = states[name]
            continue
        last = ok.filter(F.col(map_col).isNotNull()).groupBy("connection_id").agg(
            F.max_by(map_col, SEQ).alias(map_col), F.max_by("updated_by", SEQ).alias("updated_by"))
        new = map_to_eav(last, "connection_id", map_col, pid, kcol, vcol, ["updated_by"])
        new = new.join(env, new["connection_id"] == env["_eid"], "left").withColumn("env_type", F.col("_env")).drop("_eid", "_env")
        out[name] = replace_children(states[name], last.select("connection_id", "updated_by"), new, "connection_id", id_col,
                                     ["connection_id", pid], now, actor_col="updated_by")
    return out


CONFIG_UPDATE_FIELDS = ["connection_source_id", "connection_domain_name", "config_group", "source_attributes",
                        "target_attributes", "load_type", "natural_key_columns", "hash_key_column", "partition_columns",
                        "watermark_enabled", "pii_scan_enabled", "fail_mode", "retry_count", "ingestion_frequency", "tags",
                        "env_type"]


def validate_config_updates(configs: DataFrame, requests: DataFrame) -> DataFrame:
    """D25 then D22 and D23 for config updates: PIPELINE_CONFIG_NOT_FOUND without an active
    config; a supplied load type must be known; supplied (non-empty) source attributes must
    pass D23."""
    checked = missing_parent(requests, configs, "table_config_id")
    if "load_type" in checked.columns:
        checked = checked.withColumn(ERROR, F.coalesce(F.col(ERROR), load_type_code(F.col("load_type"), required=False)))
    if "source_attributes" in checked.columns:
        # parsed once; validated only when the supplied object is truthy (non-empty)
        checked = checked.withColumn("_sa", decode_json_variants("source_attributes"))
        supplied = F.coalesce(F.size("_sa") > 0, F.lit(False))
        checked = checked.withColumn(ERROR, F.coalesce(F.col(ERROR), F.when(supplied, source_attributes_code_of(F.col("_sa"))))).drop("_sa")
    return checked


def update_configs(configs: DataFrame, requests: DataFrame, now) -> dict[str, DataFrame]:
    """D27 for pipeline configs: validated requests (D25, D22, D23) patch the active
    configs, attribute and tag values JSON-encoded when not text (D18), NULL keeps, the
    last request per config wins field by field. Returns the new state and the rejects."""
    checked = validate_config_updates(configs, encode_json_columns(requests, ["source_attributes", "target_attributes", "tags"]))
    ok = checked.filter(F.col(ERROR).isNull()).drop(ERROR)
    fields = [f for f in CONFIG_UPDATE_FIELDS if f in ok.columns and f in configs.columns]
    return {"tbl_source_table": patch_update(configs, ok, "table_config_id", fields, now),
            "rejects": checked.filter(F.col(ERROR).isNotNull())}


BTS_JSON = ["silver_layout", "dq_rules", "std_rules", "tags"]
BTS_FIELDS = ["dataset_name", "source_config_id", *BTS_JSON, "transformation_yaml", "env_type"]


def create_bts(bts: DataFrame, requests: DataFrame, now) -> DataFrame:
    """BTS config create: ids (D12, request order), stamps (D29), layout / rules / tags
    JSON-encoded when not text (D18) and [] when absent, env_type default 'dev'. Returns
    the new rows."""
    reqs = encode_json_columns(requests, BTS_JSON)
    reqs = reqs.withColumns({c: F.coalesce(F.col(c), F.lit("[]")) if c in reqs.columns else F.lit("[]") for c in BTS_JSON})
    reqs = reqs.withColumn("env_type", F.coalesce(F.col("env_type"), F.lit("dev")) if "env_type" in reqs.columns else F.lit("dev"))
    reqs = assign_sequential_ids(stamp(reqs, now).withColumn("is_active", F.lit(True)), bts, "bts_config_id", [F.col(SEQ)])
    return conform(reqs, bts.schema)


def update_bts(bts: DataFrame, requests: DataFrame, now) -> dict[str, DataFrame]:
    """BTS config update: PIPELINE_CONFIG_NOT_FOUND without an active BTS row (D25), then
    a patch (D27) of the supplied fields, JSON-encoded when not text."""
    checked = missing_parent(encode_json_columns(requests, BTS_JSON), bts, "bts_config_id")
    ok = checked.filter(F.col(ERROR).isNull()).drop(ERROR)
    fields = [f for f in BTS_FIELDS if f in ok.columns]
    return {"bts_config": patch_update(bts, ok, "bts_config_id", fields, now), "rejects": checked.filter(F.col(ERROR).isNotNull())}


WATERMARK_REQUEST_FIELDS = ["watermark_column", "watermark_type", "last_value", "last_run_id"]

# ---- fixed values: defaults of a pipeline-config create request ----
CONFIG_DEFAULTS = {
    "watermark_enabled": False, "pii_scan_enabled": False, "fail_mode": "halt", "retry_count": 0,
    "ingestion_frequency": "adhoc", "tags": "[]", "env_type": "dev",
}


def with_config_defaults(df: DataFrame) -> DataFrame:
    """Missing or NULL create-request fields take the request model's defaults."""
    out = {}
    for name, value in CONFIG_DEFAULTS.items():
        lit = F.lit(value)
        if name not in df.columns:
            out[name] = lit
            continue
        col = as_flag(name, df.schema[name].dataType) if isinstance(value, bool) else F.col(name)
        out[name] = F.coalesce(col, lit.cast(df.schema[name].dataType) if not isinstance(value, bool) else lit)
    return df.withColumns(out)


def create_configs(configs: DataFrame, watermarks: DataFrame, requests: DataFrame, now,
                   only: set[str] | None = None) -> dict[str, DataFrame]:
    """D37 for pipeline configs: validate (D22, D23), assign ids (D12, request order),
    stamp (D29, actor = created_by, default 'system'), conform to tbl_source_table; a
    request with ``watermark_column`` also gets its initial watermark through D33 with the
    same actor. Returns the new config rows, the new watermark state and the rejects."""
    checked = bulk_validate(encode_json_columns(requests, ["source_attributes", "target_attributes", "tags"]))
    ok = checked.filter(F.col(ERROR).isNull()).drop(ERROR)
    ok = assign_sequential_ids(ok, configs, "table_config_id", [F.col(SEQ)])
    ok = with_config_defaults(stamp(ok, now).withColumn("is_active", F.lit(True)))
    new_configs = conform(ok, configs.schema)
    out = {"tbl_source_table": new_configs, "rejects": checked.filter(F.col(ERROR).isNotNull())}
    if "watermark_column" in ok.columns and (only is None or "tbl_watermark" in only):
        wm = ok.filter(F.col("watermark_column").isNotNull()).select(
            "table_config_id", SEQ, *[F.col(f) if f in ok.columns else F.lit(None).cast("string").alias(f) for f in WATERMARK_REQUEST_FIELDS],
            (F.col("wm_env_type") if "wm_env_type" in ok.columns else F.lit("dev")).alias("env_type"),
            F.col("created_by").alias("updated_by"))
        out["tbl_watermark"] = upsert_watermark(watermarks, wm, now, [*WATERMARK_REQUEST_FIELDS, "env_type"])
    else:
        out["tbl_watermark"] = watermarks
    return out
