"""EAV and maps: D14 map -> rows, D15 rows -> map, D16 auth-type inference,
D17 the connection view (master + details + auth in one plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.reads import active

EMPTY_MAP = "cast(map() as map<string,string>)"


def map_to_eav(df: DataFrame, parent: str, map_col: str, id_col: str, key_col: str, value_col: str,
               carry: list[str] | None = None) -> DataFrame:
    """One row per map entry, ``id_col`` = 1..n in map order, value as text; parent
    columns in ``carry`` (env_type, stamps) are copied. An empty or NULL map gives no rows."""
    carry = list(carry or [])
    exploded = df.select(parent, *carry, F.posexplode(F.map_entries(F.col(map_col))).alias("_pos", "_e"))
    return exploded.select(
        parent,
        (F.col("_pos") + F.lit(1)).cast("long").alias(id_col),
        F.col("_e.key").alias(key_col),
        F.col("_e.value").cast("string").alias(value_col),
        *carry,
    )


def eav_to_map(df: DataFrame, parent: str, id_col: str, key_col: str, value_col: str, name: str = "props") -> DataFrame:
    """Per parent, the active rows as a map: NULL key skipped, NULL value -> '',
    a repeated key keeps its first position and its last value (by ``id_col``).

    Two aggregations, both combined map-side: (parent, key) first, so the per-parent list
    holds one entry per distinct key whatever the number of rows.
    """
    rows = active(df).filter(F.col(key_col).isNotNull())
    per_key = rows.groupBy(parent, key_col).agg(
        F.min(id_col).alias("_first"),
        F.max_by(F.coalesce(F.col(value_col), F.lit("")), F.col(id_col)).alias("_val"),
    )
    entries = per_key.groupBy(parent).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col(key_col).alias("k"), F.col("_val").alias("v")))).alias("_es")
    )
    return entries.select(parent, F.map_from_entries(F.transform("_es", lambda e: F.struct(e["k"], e["v"]))).alias(name))


def infer_auth_type(auth_map: Column) -> Column:
    """First match over the keys present: none, kerberos, oauth, iam, key, basic."""
    keys = F.map_keys(auth_map)

    def has(*names):
        cond = None
        for n in names:
            term = F.array_contains(keys, F.lit(n))
            cond = term if cond is None else cond & term
        return cond

    return (
        F.when(auth_map.isNull() | (F.size(auth_map) == 0), F.lit("none"))
        .when(has("principal", "keytab_path"), F.lit("kerberos"))
        .when(has("client_id", "client_secret", "token_url"), F.lit("oauth"))
        .when(has("iam_credentials"), F.lit("iam"))
        .when(has("api_key"), F.lit("key"))
        .otherwise(F.lit("basic"))
    )


def connection_view(master: DataFrame, details: DataFrame, auth: DataFrame, only_active: bool = True) -> DataFrame:
    """Connection rows with ``details`` and ``auth`` maps and the inferred
    ``auth_type``; a connection without children gets empty maps. One plan, two joins on
    pre-aggregated maps (one row per connection each)."""
    dmap = eav_to_map(details, "connection_id", "connection_property_id", "connection_property",
                      "connection_property_value", "details")
    amap = eav_to_map(auth, "connection_id", "auth_property_id", "auth_property", "auth_property_value", "auth")
    base = active(master) if only_active else master
    out = base.join(dmap, "connection_id", "left").join(amap, "connection_id", "left")
    out = out.withColumns({
        "details": F.coalesce(F.col("details"), F.expr(EMPTY_MAP)),
        "auth": F.coalesce(F.col("auth"), F.expr(EMPTY_MAP)),
    })
    return out.withColumn("auth_type", infer_auth_type(F.col("auth")))


def list_connections(master: DataFrame, details: DataFrame, auth: DataFrame, filters: dict | None = None,
                     search_term: str | None = None, page_no: int = 1, page_size: int = 20) -> DataFrame:
    """The connection list (D01 + D06 + D07 + D09 + D17 + D16) as one plan: filter and
    search the masters, take the page (TakeOrderedAndProject), then build maps only for the
    page's ids: the ids (at most ``MAX_PAGE_SIZE`` rows, a fixed bound) are broadcast into
    semi joins on details and auth before their aggregation, so the EAV tables are scanned
    but never aggregated or shuffled in full. Every row carries total and total_pages."""
    from sluice.operators.reads import active as _active
    from sluice.operators.reads import equality_filters, page, search, with_page_meta
    from sluice.session import pin

    flt = dict(filters or {})
    state = flt.pop("is_active", True)
    hits = search(equality_filters(_active(master, state), flt), search_term, ["connection_name", "connection_domain_name"])
    # the page with its totals, computed once (at most MAX_PAGE_SIZE rows)
    pg = pin(with_page_meta(page(hits, page_no, page_size, "connection_id"), hits, page_size), "page")
    ids = F.broadcast(pg.select("connection_id"))
    return connection_view(pg, details.join(ids, "connection_id", "left_semi"), auth.join(ids, "connection_id", "left_semi"),
                           only_active=False)
