"""Tables written in runs that count only once they are committed.

A run writes its rows below ``<table>/run=<id>`` and, when all its tables are there, one row to ``_commits``. Readers join with
the commits, so rows of a run that broke off are never seen, whatever it had written, and the next run does that work again.
A run may replace what came before it: readers take the committed runs from the last replacing one on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_table

COMMIT_SCHEMA = "run string, number long, replaces boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark reads it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(run, number) of the runs that count."""
    path = f"{folder}/_commits"
    if not _exists(spark, path):
        return spark.createDataFrame([], COMMIT_SCHEMA).select("run", "number")
    # the leading underscore would hide the folder's files from a scan of the parent, not from one of the folder itself
    made = spark.read.schema(COMMIT_SCHEMA).parquet(path)
    since = made.where("replaces").agg(F.coalesce(F.max("number"), F.lit(0)).alias("since"))  # one row
    return made.crossJoin(F.broadcast(since)).where("number >= since").select("run", "number")


class Run:
    """One run over a folder of tables: ``write`` tables, then ``commit``. Nothing is seen before, all of it after."""

    def __init__(self, spark: SparkSession, folder: str, replaces: bool = False):
        self.spark, self.folder, self.replaces, self.name = spark, folder, replaces, uuid.uuid4().hex

    def write(self, df: DataFrame, table: str, partition_by=("dataset",)) -> None:
        write_table(df, f"{self.folder}/{table}/run={self.name}", partition_by)

    def commit(self) -> None:
        last = commits(self.spark, self.folder).agg(F.max("number")).first()[0] or 0
        row = self.spark.createDataFrame([(self.name, last + 1, self.replaces)], COMMIT_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/_commits")


def read_runs(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of all runs that count, without the run's name; the join prunes the folders of the others."""
    return spark.read.parquet(f"{folder}/{table}").join(commits(spark, folder).select("run"), "run", "left_semi").drop("run")
