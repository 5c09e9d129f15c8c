"""Session and shared-storage helpers."""
from __future__ import annotations

import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession


def build_session(
    app: str = "leafmill", master: str | None = None, shuffle_partitions: int | None = None, shared: str | None = None
) -> SparkSession:
    """Session with the settings the operators expect; ``shared`` is the folder for checkpoints and streams.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration and adaptive execution decide.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole texts travel in Arrow batches: keep a batch small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


#: Rows of an Arrow batch; whole texts travel in them.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default of 10,000 rows a batch, 512 are set, so that a worker holds few texts at a time."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "512")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
    return spark.sparkContext.getCheckpointDir()


def shared_files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and its path there."""
    path = folder.removeprefix("file://").removeprefix("file:")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
