"""Waveform source to stored per-asset tables: windows' features, index, labels, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, health, joins, labels, windowing
from ..operators.ordered import Extent, extent, keep, position, quantiles
from ..sources.runs import Run, read_runs

CHANNELS = ["x", "y"]
FEATURES = [f"{f}_{c}" for f in ("rms", "kurt", "crest", "energy", "envelope") for c in CHANNELS]


def snapshot_features(samples: DataFrame, length: int, overlap: float, most: int | None = None) -> DataFrame:
    """Median features per snapshot from samples (dataset, asset_id, snapshot_id, sample_idx, x, y).

    A snapshot is one recording; its own sample index is the position, so no asset is ever sorted.
    """
    keys = ["dataset", "asset_id", "snapshot_id"]
    hop = windowing.hop_length(length, overlap)
    # a recording is bounded, so its samples meet in one Arrow group and its windows in one median
    feats = windowing.window_table(samples.withColumnRenamed("sample_idx", "pos"), keys, CHANNELS, length, hop, samples.count(), whole=True)
    if most:
        feats = feats.where(windowing.is_kept(F.col("win"), windowing.window_count(F.col("n"), length, hop), most))
    return quantiles(feats, keys, {f: (f, 0.5) for f in FEATURES}, Extent(0, most or 0), also=[F.count(F.lit(1)).alias("n_windows")])


def build_artifacts(samples: DataFrame, folder: str, length: int, overlap: float, most: int | None = None, temperature: DataFrame | None = None, cadence_s: float = 10.0, done: DataFrame | None = None, least: int = 10) -> dict[str, DataFrame]:
    """All per-asset tables of every asset in one pass, written partitioned by dataset and committed as one run.

    ``done`` lists finished (dataset, asset_id) keys to skip: their rows stay, those of the other assets are
    added. Without it the run replaces the earlier ones. A run that breaks off leaves nothing that a reader
    sees (:func:`read_artifact`), and the next run does its assets again. Assets with fewer than ``least`` snapshots are left out.
    """
    keys = ["dataset", "asset_id"]
    if done is not None:
        samples = joins.remaining(samples, done, keys)
    feats = keep(snapshot_features(samples, length, overlap, most))
    ext = extent(feats, keys)
    feats = position(feats, keys, ["snapshot_id"], ext).where(F.col("n") >= least)
    if temperature is not None:
        feats = feats.join(temperature.select(*keys, "snapshot_id", "temperature"), [*keys, "snapshot_id"], "left")
    else:
        feats = feats.withColumn("temperature", F.lit(None).cast("double"))
    feats = keep(feats)
    manifest = feats.groupBy(*keys).agg(
        F.countDistinct("snapshot_id").alias("n_snapshots"), F.sum("n_windows").alias("n_windows"), F.max(F.col("temperature").isNotNull()).alias("has_temp")
    )
    comp = keep(health.raw_components(feats, keys, FEATURES, ext))
    comp = health.trailing_slope(comp.withColumn("_t", F.coalesce("temperature", F.lit(0.0))), keys, "_t", "G", ext).drop("_t")
    prefix = F.col("pos") < F.greatest(F.col("n_base"), F.floor(F.col("n") * F.lit(0.6)))
    index = composite.prefix_minmax(comp, keys, ["E", "C", "G"], prefix)
    index = index.withColumn("index", composite.combine(composite.FIXED_WITH_TEMPERATURE))
    index = keep(index.select(*keys, "snapshot_id", "pos", "n", "E", "C", "G", "E_norm", "C_norm", "G_norm", "index"))
    labelled = labels.label_table(index, keys, "index", ext, F.lit(float(cadence_s)))
    tables = {
        "snapshot_features": feats.select(*keys, "snapshot_id", *FEATURES, "temperature"),
        "index": index.select(*keys, "snapshot_id", "E", "C", "G", "E_norm", "C_norm", "G_norm", "index"),
        "labels": labelled.select(*keys, "snapshot_id", "rul", "deg", "rul_capped", "stage_time", "stage_index", "warning_label", "rul_hours", "life_hours", "H_fail"),
        "manifest": manifest,
    }
    run = Run(samples.sparkSession, folder, replaces=done is None)
    for name, df in tables.items():
        run.write(df, name)
    run.commit()
    return tables


def read_artifact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the stored tables, as far as committed runs have written it."""
    return read_runs(spark, folder, name)
