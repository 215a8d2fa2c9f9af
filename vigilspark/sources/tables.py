"""Adapters that turn stored tables into the canonical series layout.

``series``: dataset, asset_id, pos (dense, 0-based), n, x, y [, condition]
``samples``: asset_id, pos, n, x, y - one row per waveform sample.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import deal_groups
from ..operators.ordered import Extent, extent, position

KEY = ["asset_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@lru_cache(maxsize=64)
def _measured(app: str, folder: str, name: str, key: str, files: int) -> Extent:
    return extent(table(SparkSession.getActiveSession(), folder, name).select(key), [key])


def table_extent(spark: SparkSession, folder: str, name: str, key: str) -> Extent:
    """Size of a stored table and of its largest key; measured once per application and set of files."""
    files = hash(tuple(sorted(table(spark, folder, name).inputFiles())))
    return _measured(spark.sparkContext.applicationId, folder, name, key, files)


def dataset_number() -> Column:
    """Number of an event asset's dataset, the digit in its name."""
    return F.pmod("asset_id", F.lit(2))


def event_group() -> Column:
    """Independence group of an event asset: four consecutive assets share one run."""
    return F.floor(F.col("asset_id") / 4).cast("bigint")


def event_runs(spark: SparkSession, folder: str, folds: int) -> tuple[DataFrame, Extent]:
    """The event series with the independence group of every asset and the fold bucket that the group was dealt to."""
    series, ext = event_series(spark, folder)
    series = series.withColumn("grp", event_group())
    # counted from the events themselves, before they are ordered
    ids = table(spark, folder, "events").select(F.concat(F.lit("d"), F.pmod("user_id", F.lit(2))).alias("dataset"), F.col("user_id").alias("asset_id"))
    manifest = ids.groupBy("dataset", event_group().alias("grp")).agg(F.count(F.lit(1)).alias("size"))
    return series.join(deal_groups(manifest, folds, ext.assets), ["dataset", "grp"]), ext


def event_series(spark: SparkSession, folder: str) -> tuple[DataFrame, Extent]:
    """One snapshot per event: x is the value, y the numeric property, ordered by (ts, event_id)."""
    ext = table_extent(spark, folder, "events", "user_id")
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("d"), F.pmod("user_id", F.lit(2))).alias("dataset"),
        F.col("user_id").alias("asset_id"),
        F.col("event_type").alias("condition"),
        "ts",
        "event_id",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
    )
    return position(rows, KEY, ["ts", "event_id"], ext).drop("ts", "event_id"), ext


def waveform_samples(spark: SparkSession, folder: str) -> tuple[DataFrame, Extent]:
    """One sample per line item of a supplier, in shipping order."""
    ext = table_extent(spark, folder, "lineitem", "l_suppkey")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return position(rows, KEY, order, ext).drop(*order), ext
