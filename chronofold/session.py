"""Sessions, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "chronofold", cores: str = "*", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, whose checkpoints go once nothing refers to them; for local use and tests."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder that the cluster names; local sessions without one get their own."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove checkpoints and shuffle files that nothing refers to now, not once the driver's heap
    happens to be full. What a caller still names, be it as an argument, stays."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
