"""Queries over sources and sinks: each writes to the folder the session names and reads its own output back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import windowing
from ..operators.ordered import keep, shared_folder
from ..sources.files import SERIES_SCHEMA, read_csv, read_parquet, read_windows, write_table
from ..sources.tables import event_series, waveform_samples
from .artifacts import build_artifacts, read_artifact
from .control_queries import fold_parameter_record
from .registry import ORACLE, query
from .sqlkit import define, sql

LENGTH, HOP, RECORDING = 16, 8, 32


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex}"


def _dataset():
    return F.concat(F.lit("d"), F.pmod("asset_id", F.lit(2)))


@query("csv_round_trip", sql("SELECT dataset, asset_id::VARCHAR AS asset_id, pos AS snapshot_id, x, y FROM ev"))
def csv_round_trip(spark, folder):
    """The event series as CSV, read again under its schema; numbers come back bit for bit."""
    series, _ = event_series(spark, folder)
    rows = series.select("dataset", F.col("asset_id").cast("string").alias("asset_id"), F.col("pos").cast("bigint").alias("snapshot_id"), "x", "y")
    path = _folder(spark, "csv")
    write_table(rows, path, partition_by=(), fmt="csv")
    return read_csv(spark, path, SERIES_SCHEMA)


@query("window_scan", sql("""
SELECT 'd' || (asset_id % 2) AS dataset, asset_id::VARCHAR AS asset_id, win // 4 AS snapshot_id, win AS window_id, count(*)::INT AS length,
       max(x::FLOAT)::DOUBLE AS x_max, round(sum(x::FLOAT::DOUBLE), 3) AS x_sum, round(sum(y::FLOAT::DOUBLE), 3) AS y_sum FROM cut GROUP BY ALL"""))
def window_scan(spark, folder):
    """Windows stored as arrays of 32-bit floats, scanned under their schema."""
    samples, _ = waveform_samples(spark, folder)
    arrays = windowing.window_arrays(windowing.cut_windows(samples, LENGTH, HOP), ["asset_id", "win"], ["x", "y"])
    rows = arrays.select(
        _dataset().alias("dataset"), F.col("asset_id").cast("string").alias("asset_id"), F.floor(F.col("win") / 4).cast("bigint").alias("snapshot_id"),
        F.col("win").alias("window_id"), *[F.col(c).cast("array<float>").alias(c) for c in ("x", "y")],
    )
    path = _folder(spark, "windows")
    write_table(rows, path)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")), 3)
    return read_windows(spark, path).select(
        "dataset", "asset_id", "snapshot_id", "window_id", F.size("x").alias("length"), F.array_max("x").cast("double").alias("x_max"), total("x").alias("x_sum"), total("y").alias("y_sum")
    )


define("recorded", "SELECT asset_id, pos // 32 AS snapshot_id, count(*) AS m FROM wave GROUP BY ALL")
define("stored_snaps", """
SELECT 'd' || (r.asset_id % 2) AS dataset, r.asset_id, r.snapshot_id, (m - 16) // 8 + 1 AS w, e.y AS temp, count(*) OVER (PARTITION BY r.asset_id) AS n
FROM recorded r LEFT JOIN ev e ON e.asset_id = r.asset_id AND e.pos = r.snapshot_id WHERE m >= 16""")


def _artifacts(spark, folder):
    """The stored tables, built in two runs: a third of the assets comes in the second, which resumes from the manifest."""
    samples, _ = waveform_samples(spark, folder)
    pos = F.col("pos")
    samples = keep(samples.select(_dataset().alias("dataset"), "asset_id", F.floor(pos / RECORDING).cast("bigint").alias("snapshot_id"), (pos % RECORDING).cast("bigint").alias("sample_idx"), "x", "y"))
    series, _ = event_series(spark, folder)
    side = keep(series.select("dataset", "asset_id", F.col("pos").cast("bigint").alias("snapshot_id"), F.col("y").alias("temperature")))
    path = _folder(spark, "artifacts")
    later = samples.where("asset_id % 3 = 0").select("dataset", "asset_id").distinct()
    build_artifacts(samples, path, LENGTH, 0.5, temperature=side, done=later)
    build_artifacts(samples, path, LENGTH, 0.5, temperature=side, done=read_artifact(spark, path, "manifest"))
    return path


@query("artifact_manifest", sql("SELECT dataset, asset_id, count(*) AS n_snapshots, sum(w)::BIGINT AS n_windows, max((temp IS NOT NULL)::INT) AS has_temp FROM stored_snaps WHERE n >= 10 GROUP BY ALL"))
def artifact_manifest(spark, folder):
    out = read_artifact(spark, _artifacts(spark, folder), "manifest")
    return out.select("dataset", "asset_id", "n_snapshots", "n_windows", F.col("has_temp").cast("int").alias("has_temp"))


@query("artifact_labels", sql("""
SELECT dataset, asset_id, snapshot_id, n - 1 AS h_fail, round((n - 1 - snapshot_id) / (n - 1)::DOUBLE, 6) AS rul, round(snapshot_id / (n - 1)::DOUBLE, 6) AS deg,
       round(LEAST(1, (n - 1 - snapshot_id) / GREATEST(0.6::DOUBLE * (n - 1), 1)), 6) AS rul_capped, round((n - 1) * 10 / 3600.0::DOUBLE, 6) AS life_hours
FROM stored_snaps WHERE n >= 10"""))
def artifact_labels(spark, folder):
    """Position labels of the stored label table."""
    out = read_artifact(spark, _artifacts(spark, folder), "labels")
    return out.select("dataset", "asset_id", "snapshot_id", F.col("H_fail").alias("h_fail"), *rounded(["rul", "deg", "rul_capped", "life_hours"]))


@query("artifact_index", sql("SELECT dataset, asset_id, count(*) AS n, 1 AS in_range, round(max(snapshot_id), 0)::BIGINT AS last FROM stored_snaps WHERE n >= 10 GROUP BY ALL"))
def artifact_index(spark, folder):
    """The stored index: a value within [0, 1] for every snapshot of every asset."""
    out = read_artifact(spark, _artifacts(spark, folder), "index")
    inside = F.coalesce(F.col("index").between(0, 1), F.lit(False)).cast("int")
    return out.groupBy("dataset", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("in_range"), F.max("snapshot_id").alias("last"))


@query("fold_record_written", ORACLE["fold_parameter_record"])
def fold_record_written(spark, folder):
    """The frozen parameters of every fold, one partition per fold."""
    record = fold_parameter_record(spark, folder)
    path = _folder(spark, "folds")
    write_table(record, path, partition_by=("fold_id",))
    return read_parquet(spark, path).select(*record.columns)
