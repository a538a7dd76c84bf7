"""A Spark reader built from a connection (D17 view row) and a config's
source_attributes. One connection row describes where data lives; the data itself is
read by Spark's own sources (files or JDBC), in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: JDBC URL shapes and drivers per database connector ----
JDBC = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{service_name}", "oracle.jdbc.OracleDriver"),
    "redshift": ("jdbc:redshift://{cluster_endpoint}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver"),
}
FILE_ROOTS = {
    "local": "{base_path}",
    "s3": "s3a://{bucket_name}/{path_prefix}",
    "gcs": "gs://{bucket_name}/{path_prefix}",
    "azure-blob": "abfss://{container_name}@{storage_account_name}.dfs.core.windows.net/{blob_path_prefix}",
}


def _fmt(pattern: str, props: dict) -> str:
    return pattern.format(**{k: ("" if v is None else v) for k, v in props.items()}).rstrip("/")


DEFAULT_FETCH_SIZE = 10_000
DEFAULT_SPLITS = 32


def _range_split(source_attributes: dict) -> dict[str, str]:
    """Parallel range reads of a table: by ``partition_column`` between ``lower_bound`` and
    ``upper_bound`` (they only shape the ranges, no row is left out) in ``num_partitions``
    tasks. A query text cannot be split; a table without these fields is read by one task."""
    column = source_attributes.get("partition_column")
    if not column:
        return {}
    if source_attributes.get("query"):
        raise ValueError("partition_column needs a table, not a query")
    low, high = source_attributes.get("lower_bound"), source_attributes.get("upper_bound")
    if low is None or high is None:
        raise ValueError("partition_column needs lower_bound and upper_bound")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(source_attributes.get("num_partitions") or DEFAULT_SPLITS)}


def reader_spec(connection: dict, source_attributes: dict) -> dict:
    """Format, options and path for one (connection, source) pair, without reading."""
    ctype = connection["connection_type"]
    details = {**(connection.get("details") or {})}
    auth = connection.get("auth") or {}
    if ctype in FILE_ROOTS:
        needed = {p for p in ("base_path", "bucket_name", "path_prefix", "container_name", "storage_account_name", "blob_path_prefix")}
        props = {k: details.get(k, "") for k in needed}
        root = _fmt(FILE_ROOTS[ctype], props)
        fmt = (source_attributes.get("file_type") or "parquet").lower()
        opts = {}
        if fmt == "csv":
            opts["header"] = str(source_attributes.get("has_header", True)).lower()
            if source_attributes.get("delimiter"):
                opts["sep"] = source_attributes["delimiter"]
        path = f"{root}/{source_attributes.get('file_path', '').lstrip('/')}" if root else source_attributes.get("file_path")
        return {"format": fmt, "options": opts, "path": path}
    if ctype in JDBC:
        url_pattern, driver = JDBC[ctype]
        url = url_pattern.format(**{k: details.get(k, "") for k in ("host", "port", "database", "service_name", "cluster_endpoint")})
        opts = {"url": url, "driver": driver}
        if source_attributes.get("query"):
            opts["query"] = source_attributes["query"]
        else:
            schema = source_attributes.get("schema")
            opts["dbtable"] = f"{schema}.{source_attributes['table']}" if schema else source_attributes["table"]
        if "username" in auth:
            opts["user"] = auth["username"]
            opts["password"] = auth.get("password", "")
        elif auth:
            # never read without the login that the connection asks for
            raise ValueError(f"auth fields {sorted(auth)} are not supported for {ctype!r} here")
        opts["fetchsize"] = str(source_attributes.get("fetch_size") or details.get("fetch_size") or DEFAULT_FETCH_SIZE)
        opts.update(_range_split(source_attributes))
        return {"format": "jdbc", "options": opts, "path": None}
    raise ValueError(f"connector {ctype!r} has no Spark source here")


def jdbc_spec(url: str, table: str, driver: str | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None) -> dict:
    """A JDBC spec for an explicit URL (e.g. an embedded database), optionally split into
    parallel range reads on a numeric column."""
    opts = {"url": url, "dbtable": table}
    if driver:
        opts["driver"] = driver
    if partition_column:
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                     "numPartitions": str(num_partitions or 8)})
    return {"format": "jdbc", "options": opts, "path": None}


def read_source(spark: SparkSession, spec: dict, schema=None) -> DataFrame:
    r = spark.read.format(spec["format"]).options(**spec["options"])
    if schema is not None:
        r = r.schema(schema)
    return r.load(spec["path"]) if spec.get("path") else r.load()


def source_from_connection(spark: SparkSession, connection: dict, source_attributes: dict, schema=None) -> DataFrame:
    """Read the source a (connection, source_attributes) pair points at."""
    return read_source(spark, reader_spec(connection, source_attributes), schema)
