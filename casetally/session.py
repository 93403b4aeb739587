"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that hold on a laptop and on a cluster; partition counts stay with AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Call-site capture costs milliseconds for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "16g", app: str = "casetally") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def task_count(spark: SparkSession) -> int:
    """Tasks for work that is heavy beyond the size of its rows: all cores, and as many as shuffles are sized for."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it is not installed; Spark hands the file on to them."""
    root = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        spark.addArtifact(shutil.make_archive(f"{folder}/casetally", "zip", os.path.dirname(root), "casetally"), pyfile=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a fresh folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="casetally-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared folder so that checkpoint() and ML training can cut lineage."""
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
