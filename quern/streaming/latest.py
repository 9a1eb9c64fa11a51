"""Latest state of each object, folded from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest_states(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, state, order, n_events): the newest state of each object. Works on a batch and on a stream alike."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order), F.count("*").alias("n_events"))


def stream_latest_states(spark: SparkSession, path: str, schema: StructType, key: str, state: str, order: str, **options: str) -> DataFrame:
    """The same over a folder to which Parquet files are added. Use output mode "update".

    There is no watermark, since nothing bounds how late an event may come; the state has one row for each object.
    """
    return latest_states(spark.readStream.schema(schema).options(**options).parquet(path), key, state, order)


def run_to_now(spark: SparkSession, log: str, target: str, checkpoint: str, schema: StructType, key: str, state: str, order: str) -> DataFrame:
    """Take in all files that a log folder has gained since the last run with this checkpoint, and end; the latest states so far.

    Started again, it goes on where it ended or died: the checkpoint holds which files were read and the counts of each object, `target` the snapshots.
    """
    stream = stream_latest_states(spark, log, schema, key, state, order)
    query = stream.writeStream.outputMode("update").foreachBatch(upsert_latest(target, key, state, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return newest_snapshot(spark, target)


def newest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The snapshot of the last batch that was written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{s.getPath().getName()}/_SUCCESS"))]
    return spark.read.parquet(f"{target}/v={max(done)}")


def upsert_latest(target: str, key: str, state: str, order: str):
    """A foreachBatch function that keeps the latest states as a Parquet snapshot; each batch writes a new version folder `v=<batch>`.

    A repeated batch writes the same version again, so restarts leave one row for each object.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(key, state, order, "n_events")
        if batch_id > 0:
            old = spark.read.parquet(f"{target}/v={batch_id - 1}")
            fresh = fresh.unionByName(old.join(fresh.select(key), key, "left_anti").select(key, state, order, "n_events"))
        fresh.write.mode("overwrite").parquet(f"{target}/v={batch_id}")

    return write
