"""Session helpers: building a session, the shared work folder and lineage cuts.

On a cluster the shared folder comes from ``spark.checkpoint.dir``; it is read from the
session and never replaced. Only a local session without one (tests) gets a fresh
temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "sluice", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs expect. ``master`` is set only when asked for or
    when the environment names none, so a cluster's own setting stands."""
    parts = shuffle_partitions or 8
    builder = SparkSession.builder
    if master or not (os.environ.get("MASTER") or os.environ.get("SPARK_REMOTE") or os.environ.get("PYSPARK_SUBMIT_ARGS")):
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    builder = (
        builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Uses the directory the session already has (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). A local-mode session without one gets a temporary folder; a
    cluster session without one is an error, because a machine-local folder would not be
    visible to the other executors. Over Spark Connect (no SparkContext on the client)
    ``spark.checkpoint.dir`` must be set.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect client
        sc = None
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running sluice jobs")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running sluice jobs")
        configured = tempfile.mkdtemp(prefix="sluice-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder, for one written table."""
    return f"{checkpoint_root(spark).rstrip('/')}/sluice-{name}-{uuid.uuid4().hex}"


#: Pins of the innermost open scope of this thread (or task); None outside any scope.
_SCOPE: ContextVar[list[str] | None] = ContextVar("sluice_pins", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A ``work_path`` that the open job scope, if any, removes when it ends."""
    path = work_path(spark, name)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables. Without a JVM handle (Spark Connect) they are left to whoever
    cleans the shared folder."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    except Exception:  # noqa: BLE001 - Spark Connect client
        return
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def job_scope(spark: SparkSession):
    """Removes the pinned tables of a job when it ends. Write or collect the job's outputs
    inside: their plans read the pins, which are gone afterwards. Scopes nest, and each thread
    has its own, so jobs that run side by side keep their pins apart. Pins made outside any
    scope stay until the shared folder is cleaned."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield mine
    finally:
        _SCOPE.reset(token)
        remove_paths(spark, mine)


def pin_result(spark: SparkSession, build: Callable[[], DataFrame], name: str = "result") -> DataFrame:
    """The DataFrame that ``build`` returns, pinned; what it pinned on the way is removed."""
    path = scratch_path(spark, name)
    with job_scope(spark):
        return _write_and_read(build(), path)


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql.types import NullType

    void = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]
    kept = df.drop(*void)
    kept.write.mode("errorifexists").parquet(path)
    # read with the known schema: an empty input leaves no data file to infer it from
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    if void:
        back = back.withColumns({c: F.lit(None) for c in void}).select(*df.columns)
    return back


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Cut lineage through a written Parquet table in the shared folder: columnar and
    compressed (about half the bytes of an RDD checkpoint), and later steps read back
    only the columns they use. Columns of void type, which Parquet cannot store, are
    left out and restored as typed NULLs."""
    return _write_and_read(df, scratch_path(df.sparkSession, name))


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, cores: int | None = None) -> dict[str, str]:
    """Settings sized from the bytes a job reads: enough shuffle partitions that each holds
    about ``target_partition_bytes`` (AQE coalesces small ones and splits skewed ones at run
    time), scan splits of the same size, and AQE skew handling on. Apply with
    ``spark.conf.set`` before building the job."""
    parts = max(1, -(-input_bytes // target_partition_bytes))
    if cores:
        parts = max(parts, 2 * cores)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }
