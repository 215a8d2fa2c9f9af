"""Queries over streams: the given tables are laid out as files, read as a stream, and what the stream wrote is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators.ordered import SAFE_GROUP, blocks_of, keep, shared_folder
from ..operators import health
from ..sources.tables import dataset_number, table
from ..streaming.alarms import BLOCKS, stream_index_flags
from ..streaming.windows import run_available, window_features
from .pipelines import event_components, event_roles
from .registry import query
from .sqlkit import FOLDS, sql


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _as_stream(spark, rows, path: str, batch, batches: int, files: int = 1):
    """The rows as files of ``batches`` arrivals, one arrival of ``files`` files per micro-batch."""
    for k in range(batches):
        arrival = rows.where(batch == k)
        (arrival.coalesce(1) if files == 1 else arrival.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    "streamed_alarm_flags",
    sql("""
SELECT asset_id, pos, round(idx, 9) AS index, (pos >= 2 AND idx > 0.5 AND lag(idx) OVER w > 0.5 AND lag(idx, 2) OVER w > 0.5)::INT AS flag
FROM held WINDOW w AS (PARTITION BY asset_id ORDER BY pos)"""),
)
def streamed_alarm_flags(spark, folder):
    """Alarms of the held-out index from a stream whose snapshots arrive in hashed order, in four batches."""
    comp, ext = event_components(spark, folder)
    params = keep(health.fit_index(comp, FOLDS, ext, dataset=dataset_number()))
    rows = event_roles(comp.select("asset_id", "bucket", "pos", "n", "E", "C")).where("role = 'test'").drop("role")
    path = _folder(spark)
    batch = F.pmod(F.xxhash64("asset_id", "pos"), F.lit(4))
    stream = _as_stream(spark, rows, f"{path}/in", batch, 4, -(-max(ext.rows, 1) // SAFE_GROUP))
    run_available(stream_index_flags(stream, params, 0.5, blocks=max(BLOCKS, 4 * blocks_of(ext))), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("asset_id", "pos", F.round("index", 9).alias("index"), "flag")


@query(
    "streamed_window_features",
    """
SELECT event_type, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS rows, round(sqrt(avg(value * value) + 1e-12), 6) AS rms,
       round((avg(pow(value, 4)) - 4 * avg(value) * avg(pow(value, 3)) + 6 * pow(avg(value), 2) * avg(value * value) - 3 * pow(avg(value), 4))
             / (pow(avg(value * value) - pow(avg(value), 2), 2) + 1e-12), 4) AS kurtosis,
       round(max(abs(value)) / (sqrt(avg(value * value) + 1e-12) + 1e-12), 6) AS crest, round(median(value), 6) AS median
FROM events GROUP BY ALL
HAVING time_bucket(INTERVAL '7 days', any_value(ts), TIMESTAMP '1970-01-01') + INTERVAL '7 days' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'""",
)
def streamed_window_features(spark, folder):
    """Weekly features of every event type from a stream in order of time; a week is reported once the watermark has passed it."""
    # a watermark needs an instant: the stored wall time is taken as UTC, whatever the session's zone
    since = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    rows = keep(table(spark, folder, "events").select("event_type", F.timestamp_micros(F.expr(since)).alias("ts"), "value"))
    micros = F.unix_micros("ts")
    lo, hi = rows.agg(F.min(micros), F.max(micros)).first()
    share = (micros - F.lit(lo)) / F.lit(max((hi or 0) - (lo or 0), 1))
    path = _folder(spark)
    stream = _as_stream(spark, rows, f"{path}/in", F.least(F.floor(share * 4), F.lit(3)), 4)
    run_available(window_features(stream, ["event_type"], "ts", "value", "7 days", "1 day"), f"{path}/out", f"{path}/state")
    out = spark.read.parquet(f"{path}/out")
    return out.select("event_type", F.expr("timestampadd(MICROSECOND, unix_micros(start), TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("start"), "rows", *rounded(["rms", "crest", "median"]), F.round("kurtosis", 4).alias("kurtosis"))
