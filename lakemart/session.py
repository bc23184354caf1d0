"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings for a job on many executors, to be given to spark-submit.

    Shuffles start with many small partitions and are joined up to the advisory
    size at run time, so one setting serves a daily load and a full rebuild.
    Broadcasts are decided on measured sizes only.
    """
    return {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(4 * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.speculation": "false",
    }


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lakemart")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or else one below the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{warehouse.rstrip('/')}/work"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/lakemart/{name}-{uuid.uuid4().hex}"


def cores_from_environment(default: int) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
