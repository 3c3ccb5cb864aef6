"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from foresight.session import ensure_checkpoint_dir


class Workspace:
    """Tables written once and read by later jobs, so that a lost executor never costs lineage.

    They lie below ``spark.checkpoint.dir`` as Parquet: columns are pruned on reading, and a reread
    table carries no partitioning, so AQE may split skewed joins on it. ``drop`` deletes what no
    returned frame reads any more.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables; Spark's cleaner, told to look, deletes the shuffle files of ended jobs."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context._jvm.System.gc()
