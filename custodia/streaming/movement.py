"""Finish data movement as a stream: every file staged for a movement is
appended to the target exactly once.

The batch ``finish_movement`` appends whatever is staged each time it is
called. As a stream, the source's offsets and the file sink's commit log
live in a checkpoint on shared storage, so a restarted or retried job
(after losing the driver or executors) resumes where it stopped and never
appends a staged file twice. Readers of the target read it through the
sink's log (``spark.read.parquet(target)`` does this automatically), so
they never see partial batches.
"""

from __future__ import annotations

import hashlib
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from custodia.plans.movement import DEFAULT_FILL, MovementError, fill_present
from custodia.session import checkpoint_path


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path)  # path resolution only, no job
        return True
    except AnalysisException:
        return False


def _holds_batch_data(spark: SparkSession, target: str) -> bool:
    """An existing target without a stream commit log: its files were
    written by batch jobs, and a sink's log would make readers skip them."""
    return _exists(spark, target) and not _exists(spark, f"{target.rstrip('/')}/_spark_metadata")


def stream_movement(spark: SparkSession, staging: str, target: str,
                    schema: T.StructType | None = None,
                    fill: Mapping[str, object] | None = None,
                    options: Mapping[str, str] | None = None,
                    checkpoint: str | None = None,
                    partition_by: list[str] | None = None,
                    available_now: bool = True,
                    max_files_per_trigger: int | None = None,
                    processing_time: str = "10 seconds") -> StreamingQuery:
    """Start a stream from the staging folder to the target table.

    ``schema`` defaults to the schema of what is already staged (a stream
    needs it up front). ``available_now=True`` processes everything staged
    so far, then stops (in batches of ``max_files_per_trigger`` files; one
    batch when that is None); ``False`` keeps watching the
    folder, starting a batch every ``processing_time``. The checkpoint
    defaults to a folder under the session's shared ``spark.checkpoint.dir``
    named after the target. A target that already holds batch-written data
    is refused.
    """
    opts = dict(options or {})
    if _holds_batch_data(spark, target):
        raise MovementError(f"{target} already holds batch-written data; a stream sink there "
                            "would hide it from readers (give the stream its own target)")
    if schema is None:
        try:
            schema = spark.read.options(**opts).parquet(staging).schema
        except AnalysisException as exc:
            raise MovementError(f"nothing staged at {staging}; pass a schema") from exc
    reader = spark.readStream.schema(schema).options(**opts)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = fill_present(reader.parquet(staging), DEFAULT_FILL if fill is None else fill)
    if checkpoint is None:
        tag = hashlib.sha256(target.encode()).hexdigest()[:16]
        checkpoint = checkpoint_path(spark, "movement", tag)
    writer = (rows.writeStream.format("parquet").outputMode("append")
              .option("path", target).option("checkpointLocation", checkpoint)
              .options(**opts))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time))
    return writer.start()
