"""Results to files: the formats Spark writes, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a result; nothing is overwritten unless ``mode`` says so."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    out = df.write.mode(mode).format(kind)
    out = out.option("header", "true") if kind == "csv" else out
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Read files with a schema; never by looking at the data."""
    back = spark.read.format(kind).schema(schema)
    return (back.option("header", "true") if kind == "csv" else back).load(path)
