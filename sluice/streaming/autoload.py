"""File auto-load. New files under a folder are picked up exactly once in
micro-batches and appended to a bronze folder; the checkpoint keeps the file-source
progress, so a rerun after a crash (or on the next schedule) only reads files it has not
committed yet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def start_autoload(spark: SparkSession, source_dir: str, schema: StructType, target_dir: str, checkpoint_dir: str,
                   file_type: str = "parquet", glob: str | None = None, options: dict | None = None,
                   max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the stream: ``readStream`` over ``source_dir`` (optionally filtered by
    ``glob``) -> append to ``target_dir`` (Parquet file sink, exactly once with the
    checkpoint). ``available_now`` processes everything present and stops."""
    reader = spark.readStream.format(file_type).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    stream = reader.load(source_dir)
    writer = stream.writeStream.format("parquet").option("path", target_dir).option("checkpointLocation", checkpoint_dir).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def autoload_once(spark: SparkSession, source_dir: str, schema: StructType, target_dir: str, checkpoint_dir: str,
                  file_type: str = "parquet", glob: str | None = None, options: dict | None = None) -> str:
    """Run one available-now pass to completion and return ``target_dir``."""
    q = start_autoload(spark, source_dir, schema, target_dir, checkpoint_dir, file_type, glob, options)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return target_dir


def autoload_from_connection(spark: SparkSession, connection: dict, source_attributes: dict, schema: StructType,
                             target_dir: str, checkpoint_dir: str, glob: str | None = None) -> str:
    """R07 driven by configuration: the file connector and source_attributes (file_path,
    file_type, delimiter, has_header) give the folder, format and reader options (R10)."""
    from sluice.sources.connections import reader_spec

    spec = reader_spec(connection, source_attributes)
    return autoload_once(spark, spec["path"], schema, target_dir, checkpoint_dir, spec["format"], glob, spec["options"])
