"""File sources and sinks with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
# one row per window, the waveform of both axes as arrays
WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("window_id", T.LongType()),
        T.StructField("x", T.ArrayType(T.FloatType())),
        T.StructField("y", T.ArrayType(T.FloatType())),
    ]
)


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """One or many CSV files or globs under a fixed schema; no inference pass, malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_parquet(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*path) if isinstance(path, (list, tuple)) else reader.parquet(path)


def read_windows(spark: SparkSession, path) -> DataFrame:
    return read_parquet(spark, path, WINDOW_SCHEMA)


def concat(*tables: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def from_path(pattern: str, group: int = 1) -> Column:
    """A field of the file name, for a DataFrame read from files."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def write_table(df: DataFrame, path: str, partition_by=("dataset",), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Partitioned write; rows of one partition value go to as many files as they need.

    Rows are not regrouped by the partition columns, so one large asset is not sent to one task.
    """
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
