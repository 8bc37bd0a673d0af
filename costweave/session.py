"""Session helpers for tests, the bench and one-off runs. The operators never build a session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "costweave", cores: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COSTWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors do not replay the loop.

    The folder is the one the session was given (``spark.checkpoint.dir``). Only a local session without one gets
    a temporary folder; on a cluster a machine-local folder would not survive, so that case is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="costweave-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, the checkpoints
    that no frame refers to any more. It finds them when the driver collects its garbage, which may be long after."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out over all shuffle partitions, for a step that multiplies every row.

    Adaptive execution sizes partitions by their bytes and would run a small table in one task. One shuffle of the
    rows before they are multiplied costs little next to the multiplied rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
