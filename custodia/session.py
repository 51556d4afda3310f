"""Session helpers.

Library code never sets cluster sizing; a cluster job brings its own
session. ``local_session`` is for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session running these plans should have: AQE re-plans
# joins from runtime sizes (broadcast only below the threshold it measures),
# coalesces small shuffle partitions and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # remove reliable-checkpoint files once their DataFrame is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "custodia") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to a shared file system and it is
    only read here; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor. Only a
    local-mode session (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="custodia-ckpt-"))
    return sc.getCheckpointDir()


def shared_checkpoint_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder that the session already has or names in
    ``spark.checkpoint.dir``; None otherwise (operators never make one)."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    return ensure_checkpoint_dir(spark) if named else None


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-path of the shared checkpoint folder (stream checkpoints)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def scale_conf(shuffle_bytes: int, partition_bytes: int = 256 << 20,
               max_partitions: int = 100_000) -> dict[str, str]:
    """Partition settings for a job whose largest shuffle moves about
    ``shuffle_bytes`` (e.g. the measurement columns of an export).

    Shuffle partitions start at ``shuffle_bytes / partition_bytes`` (capped;
    AQE coalesces small ones at runtime toward ``partition_bytes``), input
    splits are ``partition_bytes``, and a join partition counts as skewed
    above 4 x ``partition_bytes`` so AQE splits it. Apply these when the
    session is built; library code never sets them.
    """
    if shuffle_bytes < 0 or partition_bytes <= 0:
        raise ValueError("sizes must be positive")
    partitions = max(200, min(max_partitions, -(-shuffle_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        **RECOMMENDED_CONF,
    }
