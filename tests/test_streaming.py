"""Streams against the batch operators: any cut into batches, restarts, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import alarms
from vigilspark.operators.ordered import Extent
from vigilspark.streaming.alarms import stream_flags
from vigilspark.streaming.windows import run_available, window_features

SCHEMA = "asset_id long, pos long, v double"


def series():
    rng = random.Random(4)
    rows = [(a, p, rng.random()) for a in range(6) for p in range(30)]
    return [(a, p, None if a == 3 and p % 7 == 0 else v) for a, p, v in rows] + [(None, p, 0.9) for p in range(5)]


def batch_flags(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).where("asset_id IS NOT NULL")
    out = alarms.persistent_flags(frame, ["asset_id"], "v", F.lit(0.4), Extent(1000, 40), back_fill=False)
    return {(r.asset_id, r.pos): r.flag for r in out.collect()}


@pytest.mark.parametrize("cut", ["in order", "reversed", "shuffled"])
def test_flags_of_a_stream_are_those_of_the_series(spark, tmp_path, cut):
    rows = series()
    sent = rows if cut == "in order" else rows[::-1] if cut == "reversed" else random.Random(1).sample(rows, len(rows))
    def put(part, k):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: stream_flags(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "asset_id", "v", 0.4)
    put(sent[:70], 0)
    put(sent[70:75] + sent[:10], 1)  # rows seen before are ignored
    run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    put(sent[75:], 2)  # a later start goes on from the checkpoint
    run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    own = {(r.asset_id, r.pos): r.flag for r in got if r.asset_id is not None}
    assert len(got) == len(rows) and own == batch_flags(spark, rows) and sum(own.values()) > 5
    assert sum(r.flag for r in got if r.asset_id is None) == 3


def test_assets_of_a_block_are_advanced_in_one_call(spark, tmp_path):
    """As many state groups as blocks, whatever the number of assets, and the flags of every asset whole."""
    rng = random.Random(6)
    rows = [(a, p, rng.random()) for a in range(400) for p in range(6)]
    rng.shuffle(rows)
    for part in (rows[:900], rows[900:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_flags(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "asset_id", "v", 0.4, blocks=3)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]][-1] == 3
    got = {(r.asset_id, r.pos): r.flag for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    frame = spark.createDataFrame(rows, SCHEMA)
    want = alarms.persistent_flags(frame, ["asset_id"], "v", F.lit(0.4), Extent(2400, 6), back_fill=False).collect()
    assert got == {(r.asset_id, r.pos): r.flag for r in want} and len(got) == 2400


def test_a_gap_holds_back_what_follows(spark, tmp_path):
    rows = [(1, p, 0.9) for p in (0, 1, 3, 4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    run = lambda: run_available(stream_flags(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "asset_id", "v", 0.4), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(1, 2, 0.1)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [r.flag for r in spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()] == [0] * 5


def test_windows_equal_the_batch_and_late_rows_are_counted(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    early = [("a", at(m), float(m % 7)) for m in range(0, 120)] + [("b", at(5), 1.0), ("b", None, 2.0), ("a", at(6), None)]
    later = [("a", at(m), float(m % 5)) for m in range(120, 300)]
    late = [("a", at(3), 100.0), ("b", at(290), 4.0)]
    schema = "kind string, ts timestamp, v double"
    lost = 0
    for part in (early, later, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        lost += run_available(window_features(stream, ["kind"], "ts", "v", "60 minutes", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert lost == 1
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    whole = window_features(spark.createDataFrame(early + later + late[1:], schema), ["kind"], "ts", "v", "60 minutes", "10 minutes")
    want = sorted(tuple(r) for r in whole.collect() if r.start <= at(180))
    assert len(got) == len(want) == 5
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])
