"""Parallel reads of a database table from the source's own statistics.

A numeric range cut into equal widths leaves most rows to a few tasks when values cluster, and
cannot split dates or text. A database keeps a histogram of its columns; its bounds are split
points that hold about as many rows each. They become one predicate per task; together the
predicates cover every row, NULL values included, exactly once, however old the statistics are.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.keys import sequence_within
from sluice.session import job_scope
from sluice.sources.connections import reader_spec

# ---- fixed values: where each database keeps the histogram of a column ----
STATISTICS = {
    "postgres": "SELECT histogram_bounds AS bounds FROM pg_catalog.pg_stats WHERE schemaname = '{schema}' AND tablename = '{table}' AND attname = '{column}'",
    "mssql": (
        "SELECT CAST(h.range_high_key AS NVARCHAR(4000)) AS bound FROM sys.stats s JOIN sys.stats_columns c ON c.object_id = s.object_id AND c.stats_id = s.stats_id "
        "AND c.stats_column_id = 1 CROSS APPLY sys.dm_db_stats_histogram(s.object_id, s.stats_id) h "
        "WHERE s.object_id = OBJECT_ID('{schema}.{table}') AND COL_NAME(c.object_id, c.column_id) = '{column}' ORDER BY h.step_number"),
    "oracle": (
        "SELECT endpoint_actual_value AS bound FROM all_tab_histograms WHERE owner = '{schema}' AND table_name = '{table}' "
        "AND column_name = '{column}' ORDER BY endpoint_number"),
}
DEFAULT_SCHEMA = {"postgres": "public", "mssql": "dbo"}

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]*")


def _name(text: str, what: str) -> str:
    if not _NAME.fullmatch(text or ""):
        raise ValueError(f"{what} {text!r} is no plain name")
    return text


def statistics_spec(connection: dict, source_attributes: dict, column: str) -> dict:
    """Reader spec of the histogram of one column of the configured table."""
    ctype = connection["connection_type"]
    if ctype not in STATISTICS:
        raise ValueError(f"connector {ctype!r} has no statistics query here")
    if source_attributes.get("query") or not source_attributes.get("table"):
        raise ValueError("statistics need a table, not a query")
    schema = source_attributes.get("schema") or DEFAULT_SCHEMA.get(ctype)
    query = STATISTICS[ctype].format(
        schema=_name(schema, "schema"), table=_name(source_attributes["table"], "table"), column=_name(column, "column"))
    return reader_spec(connection, {"query": query, **{k: v for k, v in source_attributes.items() if k == "fetch_size"}})


def parse_bounds(text: str | None) -> list[str]:
    """'{a,"b,c",d}' (the array text of a histogram) as a list; NULL has no bounds."""
    body = (text or "").strip()
    if not (body.startswith("{") and body.endswith("}")):
        return []
    items = re.findall(r'"((?:[^"\\]|\\.)*)"|([^,"]+)', body[1:-1])
    return [re.sub(r"\\(.)", r"\1", quoted) if quoted or not bare else bare for quoted, bare in items]


def histogram_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """The ``buckets + 1`` bounds of an equal-height histogram of a column of ``df``, each a
    value of the column as percentile_disc picks it: NULLs do not count, no value no bounds.

    percentile_disc keeps every distinct value in the memory of one task. Here the values are
    counted per value and sorted over many tasks; each knows how many rows stand before it,
    and only those where a bound falls come to the driver."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
    total = values.count()
    if not total:
        return []
    ranks = [max(1, -(-k * total // buckets)) for k in range(buckets + 1)]
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    with job_scope(df.sparkSession):
        placed = sequence_within(counts, ["value"], sums={"before": F.col("n")})
        hit = F.exists(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))
        found = placed.where(hit).select("before", "n", "value").collect()
    return [next(row["value"] for row in found if row["before"] < r <= row["before"] + row["n"]) for r in ranks]


def split_points(bounds: list, n_splits: int) -> list:
    """At most ``n_splits - 1`` distinct inner points, evenly spaced among the histogram's
    bounds (in value order, as the database gives them)."""
    inner = bounds[1:-1]
    if n_splits < 2 or not inner:
        return []
    take = min(n_splits - 1, len(inner))
    picked = [inner[(k + 1) * (len(inner) + 1) // (take + 1) - 1] for k in range(take)]
    return list(dict.fromkeys(picked))


def _literal(value) -> str:
    if isinstance(value, bool) or value is None:
        raise ValueError(f"{value!r} is no split point")
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    text = str(value).replace("'", "''")
    return f"'{text}'"


def split_predicates(column: str, points: list) -> list[str]:
    """One condition per task: below the first point or NULL, between neighbours, from the
    last point on. Any points in rising order cover every row exactly once."""
    c = _name(column, "column")
    lits = [_literal(p) for p in points]
    if not lits:
        return ["1 = 1"]
    middle = [f"{c} >= {a} AND {c} < {b}" for a, b in zip(lits, lits[1:], strict=False)]
    return [f"{c} < {lits[0]} OR {c} IS NULL", *middle, f"{c} >= {lits[-1]}"]


def split_spec(connection: dict, source_attributes: dict, column: str, points: list) -> dict:
    """Reader spec of the configured table with one predicate per task."""
    if source_attributes.get("query"):
        raise ValueError("split points need a table, not a query")
    spec = reader_spec(connection, {k: v for k, v in source_attributes.items() if k != "partition_column"})
    if spec["format"] != "jdbc":
        raise ValueError("split points are for databases; Spark splits files itself")
    return {**spec, "predicates": split_predicates(column, points)}


def read_split(spark: SparkSession, spec: dict) -> DataFrame:
    """The table of a ``split_spec``, one task per predicate."""
    options = dict(spec["options"])
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=spec["predicates"], properties=options)


def read_by_statistics(spark: SparkSession, connection: dict, source_attributes: dict, column: str, n_splits: int, convert=str) -> DataFrame:
    """The configured table in about ``n_splits`` parallel reads at the database's own
    histogram bounds; ``convert`` makes a bound's text a value of the column. A histogram has
    a few hundred bounds at most, whatever the table's size; without one the table is read by
    one task."""
    from sluice.sources.connections import read_source

    rows = [r[0] for r in read_source(spark, statistics_spec(connection, source_attributes, column)).collect()]
    texts = parse_bounds(rows[0]) if connection["connection_type"] == "postgres" and rows else [r for r in rows if r is not None]
    return read_split(spark, split_spec(connection, source_attributes, column, split_points([convert(t) for t in texts], n_splits)))
