"""Stages that an operator writes to the shared folder, and removes when what they led to is written too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orelayer.session import shared_dir


class Scratch:
    """Written stages under one folder of the shared one; each is computed once and read back from there."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.count = spark, shared_dir(spark, purpose), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:02d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the stages of these names, or all. Nothing may read them any more."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        if not names:
            files.delete(root, True)
            return
        for status in files.listStatus(root):
            if status.getPath().getName().partition("-")[2] in names:
                files.delete(status.getPath(), True)
