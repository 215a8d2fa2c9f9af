"""Committed runs: what breaks off is never seen, what resumes adds, what replaces hides the earlier runs."""

import numpy as np
import pytest

from vigilspark.plans.artifacts import build_artifacts, read_artifact
from vigilspark.sources import runs

TABLES = ("snapshot_features", "index", "labels", "manifest")


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    rows = [("d", a, s, i, float(rng.normal()), float(rng.normal())) for a, count in (("A", 12), ("B", 11)) for s in range(count) for i in range(32)]
    return spark.createDataFrame(rows, "dataset string, asset_id string, snapshot_id long, sample_idx long, x double, y double").cache()


def counts(spark, folder):
    return {t: {r.asset_id: r["count"] for r in read_artifact(spark, folder, t).groupBy("asset_id").count().collect()} for t in TABLES}


def test_a_run_that_breaks_off_leaves_no_duplicate(spark, samples, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    only_b = spark.createDataFrame([("d", "B")], "dataset string, asset_id string")
    build_artifacts(samples, folder, 16, 0.5, done=only_b)
    written = []
    whole = runs.Run.write

    def breaks(self, df, table, partition_by=("dataset",)):
        if len(written) == 2:
            raise OSError("lost")
        written.append(table)
        whole(self, df, table, partition_by)

    monkeypatch.setattr(runs.Run, "write", breaks)
    with pytest.raises(OSError, match="lost"):
        build_artifacts(samples, folder, 16, 0.5, done=read_artifact(spark, folder, "manifest"))
    monkeypatch.setattr(runs.Run, "write", whole)
    one = {"A": 12}
    assert counts(spark, folder) == {"snapshot_features": one, "index": one, "labels": one, "manifest": {"A": 1}}
    assert spark.read.parquet(f"{folder}/{written[0]}").where("asset_id = 'B'").count() > 0  # its rows are there, and not seen
    build_artifacts(samples, folder, 16, 0.5, done=read_artifact(spark, folder, "manifest"))
    both = {"A": 12, "B": 11}
    assert counts(spark, folder) == {"snapshot_features": both, "index": both, "labels": both, "manifest": {"A": 1, "B": 1}}
    build_artifacts(samples, folder, 16, 0.5)
    assert counts(spark, folder)["index"] == both  # replaced, not added


def test_no_commit_no_rows(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path / "t"))
    run.write(spark.createDataFrame([("d", 1)], "dataset string, v int"), "one")
    assert runs.read_runs(spark, str(tmp_path / "t"), "one").count() == 0 and runs.commits(spark, str(tmp_path / "t")).count() == 0
    run.commit()
    again = runs.Run(spark, str(tmp_path / "t"), replaces=True)
    again.write(spark.createDataFrame([("d", 2), ("e", None)], "dataset string, v int"), "one")
    assert [r.v for r in runs.read_runs(spark, str(tmp_path / "t"), "one").collect()] == [1]
    again.commit()
    out = runs.read_runs(spark, str(tmp_path / "t"), "one")
    assert sorted(out.columns) == ["dataset", "v"] and {r.v for r in out.collect()} == {2, None}
