"""Count windows over waveform samples and the time-domain features of each window.

Samples carry (asset_id, pos, n, channels...). Every window holds at most ``length`` samples, so
grouping by (asset, window) is bounded however long one recording is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ordered import Extent, neighbours, quantiles, same_keys, spread
from .spectra import envelope_energies

TINY = 1e-12
#: Samples of an Arrow group, and windows of a tile of a series.
GROUP_SAMPLES, TILE_WINDOWS = 1 << 17, 512


def hop_length(length: int, overlap: float) -> int:
    return max(1, int(length * (1.0 - overlap)))


def window_count(n: Column, length: int, hop: int) -> Column:
    return F.when(n >= length, F.floor((n - length) / F.lit(hop)) + 1).otherwise(F.lit(0)).cast("bigint")


def cut_windows(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """Copy each sample into every full window that covers it, as (win, i); short series give none."""
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - length + 1) / F.lit(hop)))
    last = F.least(F.floor(F.col("pos") / F.lit(hop)), window_count(F.col("n"), length, hop) - 1)
    out = samples.withColumns({"_a": first.cast("bigint"), "_b": last.cast("bigint")}).where("_a <= _b")
    out = out.withColumn("win", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return out.withColumn("i", (F.col("pos") - F.col("win") * hop).cast("int"))


def is_kept(win: Column, count: Column, most: int) -> Column:
    """Whether a window belongs to ``most`` evenly spaced ones (all of them when there are fewer).

    Window w is kept when some k rounds to it; only the neighbours of its own position can.
    """
    if most == 1:
        return (count <= 1) | (win == 0)
    step = (count - 1) / F.lit(float(most - 1))
    near = F.floor(F.try_divide(win, step))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        k = near + d
        hit = hit | F.coalesce((k >= 0) & (k <= most - 1) & (F.bround(k * step, 0) == win), F.lit(False))
    return (count <= most) | hit


def window_arrays(cut: DataFrame, keys, channels) -> DataFrame:
    """One row per window with each channel as an array in sample order."""
    packed = cut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", *channels))).alias("_s"))
    return packed.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in channels])


def window_features(cut: DataFrame, keys, channels, length: int, arrays: bool = False) -> DataFrame:
    """RMS, kurtosis, crest factor and spectral energy per window and channel.

    Spectral energy is the one-sided power of the mean-free window; by Parseval it needs only the
    centred power and the alternating sum, so no transform is computed.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    cut = cut.withColumns({f"_d_{c}": F.col(c) - F.avg(c).over(w) for c in channels})
    alt = F.when(F.col("i") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    aggs = []
    for c in channels:
        d = F.col(f"_d_{c}")
        d2 = d * d
        aggs += [
            F.sqrt(F.avg(F.col(c) * F.col(c)) + TINY).alias(f"rms_{c}"),
            (F.avg(d2 * d2) / (F.avg(d2) * F.avg(d2) + TINY)).alias(f"kurt_{c}"),
            F.max(F.abs(F.col(c))).alias(f"_peak_{c}"),
            (length * F.sum(d2)).alias(f"_pow_{c}"),
            F.sum(alt * d).alias(f"_alt_{c}"),
        ]
    if arrays:
        aggs.append(F.sort_array(F.collect_list(F.struct("i", *channels))).alias("_s"))
    out = cut.groupBy(*keys).agg(*aggs)
    nyquist = 1.0 if length % 2 == 0 else 0.0
    for c in channels:
        out = out.withColumns(
            {
                f"crest_{c}": F.col(f"_peak_{c}") / (F.col(f"rms_{c}") + TINY),
                f"energy_{c}": (F.col(f"_pow_{c}") + nyquist * F.col(f"_alt_{c}") * F.col(f"_alt_{c}")) / 2,
            }
        )
    if arrays:
        out = out.withColumns({c: F.col(f"_s.{c}") for c in channels}).drop("_s")
    return out.drop(*[f"_{t}_{c}" for t in ("peak", "pow", "alt") for c in channels])


def _features(v: np.ndarray, ok: np.ndarray, i: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The features of every run of samples that begins at ``starts``: missing samples are left out, NaN where nothing is there."""
    total = lambda x: np.add.reduceat(x, starts)
    sizes = np.diff(starts, append=len(v))
    present = total(ok.astype(np.int64))
    m = np.where(present > 0, present, np.nan)
    own = np.where(ok, v, 0.0)
    d = np.where(ok, v - np.repeat(total(own) / m, sizes), 0.0)
    d2 = d * d
    rms = np.sqrt(total(own * own) / m + TINY)
    power = total(d2)
    peak = np.maximum.reduceat(np.where(ok, np.abs(v), -np.inf), starts)
    turn = total(np.where(i % 2 == 0, d, -d)) if length % 2 == 0 else 0.0
    empty = np.where(present > 0, 0.0, np.nan)
    return {
        "rms": rms,
        "kurt": (total(d2 * d2) / m) / ((power / m) ** 2 + TINY),
        "crest": peak / (rms + TINY) + empty,
        "energy": (length * power + turn * turn) / 2 + empty,
    }


def window_table(samples: DataFrame, keys, channels, length: int, hop: int, rows: int, variants=("",), whole: bool = False) -> DataFrame:
    """(keys, win, n, <feature>_<channel>): every full window's time features and envelope energy, as :func:`cut_windows`,
    :func:`window_features` and the envelope of its arrays give them, from one exchange of the samples.

    A sample goes to the tile of ``TILE_WINDOWS`` windows it lies in and, near an edge, to the one before. An Arrow group holds
    the tiles of about ``GROUP_SAMPLES`` of the ``rows`` samples; windows are cut and summed inside NumPy. With ``whole`` a
    group holds whole series, whose length ``n`` is then counted there (recordings, which are bounded); else rows carry ``n``.
    ``variants`` names versions of the channels that rows carry side by side, as ``<channel><variant>``; with more than the
    plain one, the windows of each come as rows of their own, numbered in ``variant``. A feature without samples is NULL.
    """
    keys, channels, names = list(keys), list(channels), ("rms", "kurt", "crest", "energy", "envelope")
    cols = [f"{c}{v}" for v in variants for c in channels]
    many = len(variants) > 1
    out = samples.select(*keys, F.col("pos").cast("bigint").alias("pos"), *([] if whole else [F.col("n").cast("bigint").alias("n")]), *[F.col(c).cast("double").alias(c) for c in cols])
    place = []
    if not whole:
        width, reach = TILE_WINDOWS * hop, max(length - hop, 0)
        home = F.floor(F.col("pos") / F.lit(width)).cast("bigint")
        back = -(-reach // width)
        tiles = F.array_compact(F.array(home, *[F.when((home >= k) & (F.col("pos") - (home - k + 1) * width < reach), home - k) for k in range(1, back + 1)]))
        out, place = out.withColumn("_tile", F.explode(tiles)), ["_tile"]
    blocks = max(1, -(-max(rows, 1) // GROUP_SAMPLES))
    out = out.withColumn("_block", F.pmod(F.xxhash64(*keys, *place), F.lit(blocks)))
    fields = [*[samples.schema[k] for k in keys], *([T.StructField("variant", T.IntegerType())] if many else []), T.StructField("win", T.LongType()), T.StructField("n", T.LongType())]
    schema = T.StructType([*fields, *[T.StructField(f"{f}_{c}", T.DoubleType()) for f in names for c in channels]])
    arrow = to_arrow_schema(schema)

    def cut(own: pa.Table) -> pa.Table:
        code = np.zeros(own.num_rows, np.int64)
        for k in [*keys, *place]:
            part = own[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1]
        pos = own["pos"].to_numpy()
        n = np.bincount(code)[code] if whole else own["n"].to_numpy()
        first = np.maximum(0, -(-(pos - length + 1) // hop))
        last = np.minimum(pos // hop, np.where(n >= length, (n - length) // hop + 1, 0) - 1)
        if place:
            tile = own["_tile"].to_numpy()
            first, last = np.maximum(first, tile * TILE_WINDOWS), np.minimum(last, tile * TILE_WINDOWS + TILE_WINDOWS - 1)
        count = np.maximum(last - first + 1, 0)
        if not count.sum():
            return arrow.empty_table()
        row = np.repeat(np.arange(len(pos)), count)
        win = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((pos[row], win, code[row]))
        row, win = row[order], win[order]
        i, starts = pos[row] - win * hop, np.flatnonzero(np.r_[True, (np.diff(win) != 0) | (np.diff(code[row]) != 0)])
        heads = pa.array(row[starts])
        parts = []
        for k, variant in enumerate(variants):
            got = {}
            for c in channels:
                column = own[f"{c}{variant}"].combine_chunks()
                ok = column.is_valid().to_numpy(zero_copy_only=False)[row]
                v = column.to_numpy(zero_copy_only=False)[row]
                for name, x in (_features(v, ok, i, starts, length) | {"envelope": envelope_energies(v, starts)}).items():
                    # what is computed from nothing is NULL; NaN among the samples stays NaN, but not in the envelope
                    here = np.logical_or.reduceat(ok, starts) if name != "envelope" else ~np.isnan(x)
                    got[f"{name}_{c}"] = pa.array(x, mask=~here)
            ahead = [*[own[c].combine_chunks().take(heads) for c in keys], *([pa.array(np.full(len(starts), k, np.int32))] if many else []), pa.array(win[starts]), pa.array(n[row[starts]].astype(np.int64))]
            parts.append(pa.table([*ahead, *[got[f.name] for f in schema.fields[len(fields) :]]], schema=arrow))
        return pa.concat_tables(parts)

    return spread(out, "_block").groupBy("_block").applyInArrow(cut, schema)


def snapshot_medians(windows: DataFrame, keys, features, per_snapshot: int) -> DataFrame:
    """Median of each feature over the windows of a snapshot (at most ``per_snapshot`` of them)."""
    out = quantiles(windows, keys, {f"_med_{f}": (f, 0.5) for f in features}, Extent(0, per_snapshot))
    return out.select(*keys, *[F.col(f"_med_{f}").alias(f) for f in features])


def resample(series: DataFrame, keys, value: str, points: Column, ext: Extent) -> DataFrame:
    """Linear interpolation of a series onto ``points`` evenly spaced positions, as (i, value).

    Each source row emits the target positions between itself and the next row, so no join is needed.
    """
    keys = list(keys)
    rows = neighbours(series.select(*keys, "pos", "n", value, points.cast("bigint").alias("_h")), keys, {"_next": (value, -1)}, ext)
    span, last = F.col("n") - 1, F.col("_h") - 1
    lo = F.when(span == 0, F.lit(0)).otherwise(F.ceil(F.col("pos") * last / span))
    one = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.lit(-1))
    hi = F.when(last == 0, one).when((span == 0) | (F.col("pos") == span), last).otherwise(F.floor(((F.col("pos") + 1) * last - 1) / span))
    rows = rows.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).where("_lo <= _hi")
    rows = rows.withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    at = F.when(last > 0, F.col("i") * span / last).otherwise(F.lit(0.0)) - F.col("pos")
    slope = F.coalesce(F.col("_next") - F.col(value), F.lit(0.0))
    return rows.select(*keys, "i", (F.col(value) + slope * at).alias(value))


# ------------------------------------------------------------------ normalisation
def channel_stats(samples: DataFrame, channels) -> DataFrame:
    """Per-asset count, mean and population variance of each channel: the mergeable part."""
    aggs = [f(c).alias(f"{t}_{c}") for c in channels for f, t in ((F.avg, "m"), (F.var_pop, "v"))]
    return samples.groupBy("asset_id").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def pooled_stats(per_asset: DataFrame, keys, channels, floor: float = 1e-8) -> DataFrame:
    """Merge per-asset moments, centred on the group's mean, into one mean and deviation per group."""
    means = per_asset.groupBy(*keys).agg(
        F.sum("rows").alias("_total"),
        *[(F.sum(F.col("rows") * F.col(f"m_{c}")) / F.sum("rows")).alias(f"mean_{c}") for c in channels],
    )

    def variance(c):
        off = F.col(f"m_{c}") - F.col(f"mean_{c}")
        return F.sum(F.col("rows") * (F.col(f"v_{c}") + off * off)) / F.max("_total")

    return same_keys(per_asset, means, keys).groupBy(*keys).agg(
        F.max("_total").alias("rows"),
        *[F.max(f"mean_{c}").alias(f"mean_{c}") for c in channels],
        *[(F.sqrt(variance(c)) + floor).alias(f"std_{c}") for c in channels],
    )


def sensor_stats(per_asset: DataFrame, keys, channel: str, has_sensor: str, floor: float = 1e-8) -> DataFrame:
    """Pooled stats over assets that carry the sensor; 0 and 1 when fewer than two rows do."""
    real = F.when(F.col(has_sensor), F.col("rows")).otherwise(F.lit(0))
    total = F.sum(real)
    means = per_asset.groupBy(*keys).agg(total.alias("_total"), F.try_divide(F.sum(real * F.col(f"m_{channel}")), total).alias("_m"))
    off = F.col(f"m_{channel}") - F.col("_m")
    spread_of = F.try_divide(F.sum(real * (F.col(f"v_{channel}") + off * off)), F.max("_total"))
    out = same_keys(per_asset, means, keys).groupBy(*keys).agg(F.max("_total").alias("sensor_rows"), F.max("_m").alias("_m"), spread_of.alias("_var"))
    enough = F.col("sensor_rows") >= 2
    return out.select(
        *keys,
        "sensor_rows",
        F.when(enough, F.col("_m")).otherwise(F.lit(0.0)).alias(f"mean_{channel}"),
        F.when(enough, F.sqrt("_var") + floor).otherwise(F.lit(1.0)).alias(f"std_{channel}"),
    )


def zscore(rows: DataFrame, stats: DataFrame, keys, channels) -> DataFrame:
    """Apply frozen means and deviations; each channel gains a z_<channel> column."""
    out = rows.join(stats, list(keys))
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in channels})


def healthy_prefix_zscore(rows: DataFrame, keys, channels, fraction: float = 0.2, floor: float = 1e-8) -> DataFrame:
    """Normalise a target-domain asset by its own first windows (all of them if the prefix is empty)."""
    keys = list(keys)
    healthy = F.col("pos") < F.greatest(F.floor(F.col("n") * F.lit(float(fraction))), F.lit(1))
    aggs = []
    for c in channels:
        v = F.when(healthy, F.col(c))
        aggs += [
            F.coalesce(F.avg(v), F.avg(c)).alias(f"mean_{c}"),
            (F.coalesce(F.stddev_pop(v), F.stddev_pop(c)) + floor).alias(f"std_{c}"),
        ]
    return zscore(rows, rows.groupBy(*keys).agg(*aggs), keys, channels)


