"""Tables that operators write into the shared folder to cut lineage and to be read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gristmill.session import ensure_checkpoint_dir


class Scratch:
    """A fresh folder below the cluster's checkpoint folder.

    A written table is read back by its files, so a lost executor costs nothing, and joins with
    it are planned on fresh exchanges, which adaptive execution can split at hot keys.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)
