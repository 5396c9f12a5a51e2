"""Session defaults for local runs; a cluster's own settings are never overridden."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from loanloom.errors import ContractError


def local_session(cores: str = "8", partitions: int = 8, app: str = "loanloom", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small inputs: keep shuffled rows spread over the cores instead of one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the setting ``spark.checkpoint.dir``.

    Without it, a session on one machine gets a temporary folder; on a cluster that would be a folder of the driver
    alone, so it is an error there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ContractError("Set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loanloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
