"""Read-side operators D01, D06-D11: active scans, optional filters, search, lookups,
pages, latest row per key and ordered child history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.exprs import as_flag, contains_ci
from sluice.operators.keys import sequence_within

MAX_PAGE_SIZE = 200
DEFAULT_PAGE_SIZE = 20


def _flag(df: DataFrame, name: str) -> Column:
    return as_flag(name, df.schema[name].dataType)


def active(df: DataFrame, is_active: bool | None = True) -> DataFrame:
    """Rows whose ``is_active`` equals the wanted state (default true); None keeps all.
    The predicate is a plain column test so Parquet receives it as a pushed filter."""
    if is_active is None:
        return df
    flag = _flag(df, "is_active")
    return df.filter(flag if is_active else ~flag)


def _absent(v) -> bool:
    # '' and 0 count as absent, as the reference's truthiness test does
    return v is None or v == "" or (isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0)


def equality_filters(df: DataFrame, filters: dict, none_only: tuple[str, ...] = ("is_active", "is_target")) -> DataFrame:
    """AND of ``col == value`` for every supplied filter; a missing filter is no
    constraint. Empty string and 0 count as missing, except for the ``none_only``
    columns, which are only skipped when None."""
    preds = []
    for name, value in filters.items():
        if name in none_only:
            if value is None:
                continue
            col = _flag(df, name) if name in df.columns else F.col(name)
            preds.append(col == F.lit(bool(value)))
        elif not _absent(value):
            preds.append(F.col(name) == F.lit(value))
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def search(df: DataFrame, term: str | None, columns: list[str]) -> DataFrame:
    """Case-insensitive literal substring match on any of ``columns``."""
    if not term:
        return df
    return df.filter(reduce(lambda a, b: a | b, [contains_ci(c, term) for c in columns]))


def lookup_active(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The active rows whose key is in ``ids`` (a semi join; AQE broadcasts a small
    id set at run time and shuffles a large one)."""
    return active(df).join(ids.select(key), on=key, how="left_semi")


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be in 1..{MAX_PAGE_SIZE}")


def page(df: DataFrame, page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE, order_col: str = "id") -> DataFrame:
    """Rows (page-1)*size < n <= page*size under ``order_col`` DESC.

    Planned as TakeOrderedAndProject(limit, offset): each task keeps its top page*size
    rows, no global window and no full sort.
    """
    check_page(page_no, page_size)
    return df.orderBy(F.col(order_col).desc()).offset((page_no - 1) * page_size).limit(page_size)


def with_page_meta(page_rows: DataFrame, full: DataFrame, page_size: int) -> DataFrame:
    """D09 totals on every page row: ``total`` and ``total_pages`` = ceil(total/size), from
    a scalar subquery over the unpaged input."""
    total = full.agg(F.count(F.lit(1)).cast("long")).scalar()
    return page_rows.withColumns({
        "total": total,
        "total_pages": F.ceil(total / F.lit(page_size)).cast("long"),
    })


def page_meta(full: DataFrame, page_size: int) -> DataFrame:
    """D09 totals as a one-row frame (for an empty page)."""
    return full.agg(F.count(F.lit(1)).cast("long").alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(page_size)).cast("long")
    )


def keyset_page(df: DataFrame, order_col: str, after: int | None, page_size: int) -> DataFrame:
    """D09 for deep pages: rows with key < ``after`` (the last key seen), so the filter is
    pushed to the scan instead of skipping page*size rows."""
    src = df if after is None else df.filter(F.col(order_col) < F.lit(after))
    return src.orderBy(F.col(order_col).desc()).limit(page_size)


def latest_per_key(df: DataFrame, key: list[str] | str, order_col: str, only_active: bool = True) -> DataFrame:
    """Per key the (active) row with the highest ``order_col``.

    ``max_by`` is aggregated map-side first, so a hot key is reduced inside each task before
    the shuffle; ties fall to the other columns (maps by their JSON).
    """
    keys = [key] if isinstance(key, str) else list(key)
    src = active(df) if only_active and "is_active" in df.columns else df
    rest = [c for c in src.columns if c not in keys and c != order_col]
    from sluice.operators.load import _ties

    best = src.groupBy(*keys).agg(F.max_by(F.struct(order_col, *rest), F.struct(order_col, *_ties(src, rest))).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [order_col, *rest]])


def child_history(df: DataFrame, parent: str, order_col: str, name: str = "position") -> DataFrame:
    """The active children of every parent, numbered 1.. by ``order_col`` DESC."""
    return sequence_within(active(df), [F.col(order_col).desc()], [parent], name=name)


CONFIG_LIST_FILTERS = ("env_type", "connection_source_id", "config_group", "load_type")


def list_configs(configs: DataFrame, filters: dict | None = None, page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The pipeline-config list (D01 + D06 + D09 + D19): is_active filter (default true),
    optional equality filters, the page by table_config_id DESC, JSON columns decoded
    (tags -> array, [] when NULL or empty; source/target attributes -> maps), totals."""
    from sluice.functions.exprs import decode_json_list, decode_json_map

    flt = dict(filters or {})
    state = flt.pop("is_active", True)
    unknown = set(flt) - set(CONFIG_LIST_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    hits = equality_filters(active(configs, state), flt)
    pg = page(hits, page_no, page_size, "table_config_id").withColumns({
        "tags": decode_json_list("tags"),
        "source_attributes": decode_json_map("source_attributes"),
    })
    if "target_attributes" in configs.columns:
        pg = pg.withColumn("target_attributes", decode_json_map("target_attributes"))
    return with_page_meta(pg, hits, page_size)
