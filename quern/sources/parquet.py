"""Parquet source and sink of pipelines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, schema: Any = None, **options: Any) -> DataFrame:
    """A lazy scan. `columns` reads those only; other options go to the reader."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: Any) -> DataFrame:
    """Write, and return what was written: later operators go on from the files, so nothing is computed twice."""
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if partition_by:
        return df.sparkSession.read.parquet(path).select(*df.columns)
    return df.sparkSession.read.schema(df.schema).parquet(path)
