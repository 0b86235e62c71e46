"""Session defaults: what the engine's plans count on, for local tests and for clusters."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partition sizes suit executors with a few GB a core; adaptive execution splits skewed joins and merges small partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def dealt(rows: DataFrame) -> DataFrame:
    """Rows for a costly Python stage: at least a partition for each core."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the folder that driver and executors share (``spark.checkpoint.dir``); a local session without one gets its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/lexloom/{label}-{uuid.uuid4().hex}"
