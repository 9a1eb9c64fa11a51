"""Tables written to the folder that the cluster shares, to cut lineage between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if all runs on this machine, as in tests; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables that one run of an operator writes to the shared folder.

    A written table cuts the lineage: executors that are lost later cost no recomputation of what
    came before. Tables are deleted with `drop` as soon as no plan reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table, written and read back; `by` names a column of few values, by which its files are kept apart."""
        df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """Add rows to a table, which is made if need be; all its rows."""
        df.write.mode("append").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
