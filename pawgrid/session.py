"""Spark session helpers.

Library code never builds its own session; it takes the caller's.  ``local_session``
exists for tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pawgrid") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UTC, Arrow on, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Arrow batches to Python are bounded in bytes as well as rows: a batch of long texts
        # (documents up to ~20k words) stays small in the embedding / top-k workers
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no Python call-site capture per DataFrame/Column call (several JVM round trips each);
        # plan building stays cheap for expression-heavy queries
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the platform and is only read here; without one a cluster
    session is refused, as a folder of the driver's machine is not seen by the executors.  In local
    mode (tests, local runs) a fresh scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="pawgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a materialised intermediate table under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def run_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this call, in a folder of this application (see ``drop_runs``)."""
    return shared_path(spark, f"pawgrid-runs/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")


def drop_runs(spark: SparkSession) -> None:
    """Delete the per-call tables of this application; call it once their results were consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        shared_path(spark, f"pawgrid-runs/{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
