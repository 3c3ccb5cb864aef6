"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "foresight", cores: int | str = "*") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Spark deletes a checkpoint once no frame refers to it any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Small single-file inputs: keep the shuffle's parallelism after a join turns into a broadcast.
        .config("spark.sql.adaptive.localShuffleReader.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; make one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foresight-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes row placement for later jobs."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet below the checkpoint folder and read back.

    For wide frames that several jobs read: it is a fraction of a checkpoint's size, each reader takes
    only its columns, and filters reach the files. The files stay until the folder goes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The frame stored once as Parquet, in as many buckets of ``key`` as a shuffle has partitions.

    Whatever joins or groups it by ``key`` later finds its rows in place and does not shuffle them again.
    The files stay below the checkpoint folder; the table's name leaves the catalog at once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name, width = f"bucketed_{uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.repartition(width, key).write.bucketBy(width, key).format("parquet").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # a table with a path of its own: its files stay
