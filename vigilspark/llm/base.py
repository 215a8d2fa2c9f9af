"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLE = {}

#: White space of the word rules, as a character class body that Java, RE2 and Python read alike.
SPACE = r"\x20\x09-\x0D"


def query(name: str, sql: str | None = None):
    """Register a query of this package, with the SQL it is checked against."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Words between white space, without the empty strings that split() leaves at either end."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(df: DataFrame, name: str = "row") -> Column:
    """The whole row as one struct, so that names made by an operator never clash with the table's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is set (tests, local sessions)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    import tempfile

    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: smaller than a checkpoint, and it can be read in parts."""
    import uuid

    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
