"""Spectral features that need a transform, as Arrow UDFs over bounded window arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Published geometry of the LDK UER204 bearing (balls, ball and pitch diameter in mm, contact angle).
BALLS, BALL_MM, PITCH_MM, ANGLE_DEG = 8, 7.92, 34.55, 0.0
RATIO = BALL_MM / PITCH_MM * math.cos(math.radians(ANGLE_DEG))
# Defect frequencies as multiples of the shaft frequency.
FAULT_FACTORS = {
    "BPFO": BALLS / 2 * (1 - RATIO),
    "BPFI": BALLS / 2 * (1 + RATIO),
    "BSF": PITCH_MM / (2 * BALL_MM) * (1 - RATIO**2),
    "FTF": 0.5 * (1 - RATIO),
}


def _stack(arrays: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, float) for a in arrays])


def _envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal along the last axis."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1))


def _energy(x: np.ndarray, band=None) -> np.ndarray:
    mag = np.abs(np.fft.rfft(x - x.mean(axis=-1, keepdims=True), axis=-1)) ** 2
    return (mag if band is None else mag[:, band[0] : band[1]]).sum(axis=-1)


def _by_length(arrays: pd.Series, fn) -> pd.Series:
    """Apply a matrix function to the arrays of equal length in one call each."""
    out = [None] * len(arrays)
    lengths = arrays.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        got = fn(_stack(arrays.iloc[at]))
        for i, v in zip(at, got):
            out[i] = v.tolist() if isinstance(v, np.ndarray) else float(v)
    return pd.Series(out)


def envelope_energies(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spectral energy of the mean-free Hilbert envelope of every run of ``v`` that begins at ``starts``."""
    sizes, out = np.diff(starts, append=len(v)), np.empty(len(starts))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at] = _energy(_envelope(v[starts[at][:, None] + np.arange(n)]))
    return out


def envelope_energy(band: tuple[int, int] | None = None):
    """UDF: spectral energy of the mean-free Hilbert envelope of a window."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return _by_length(x, lambda m: _energy(_envelope(m), band))

    return run


def band_energy(lo: int, hi: int):
    """UDF: spectral energy of the bins [lo, hi) of a mean-free window."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return _by_length(x, lambda m: _energy(m, (lo, hi)))

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def envelope_spectrum(x: pd.Series) -> pd.Series:
    """Magnitude spectrum of the mean-free envelope."""

    def run(m):
        env = _envelope(m)
        return np.abs(np.fft.rfft(env - env.mean(axis=1, keepdims=True), axis=1))

    return _by_length(x, run)


def shaft_hz(name: Column, default: float = 35.0) -> Column:
    """Shaft frequency from a leading '<number>Hz' in the asset name."""
    found = F.regexp_extract(name, r"^([0-9.]+)Hz", 1)
    return F.coalesce(F.when(found != "", found.cast("double")), F.lit(float(default)))


def fault_frequencies(assets: DataFrame, shaft: str = "shaft_hz") -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), (F.lit(v) * F.col(shaft)).alias("hz")) for k, v in FAULT_FACTORS.items()]))
    return assets.select("*", pairs.alias("_f")).select(*assets.columns, "_f.fault", "_f.hz")


def mean_spectrum(windows: DataFrame, keys, channels, most: int | None = None) -> DataFrame:
    """Mean envelope spectrum of a snapshot's windows, over all channels, as (bin, mag).

    With ``most``, of its first windows only, by ``seq``, their number inside the snapshot.
    """
    first = windows if most is None else windows.where(F.col("seq") < most)
    spectra = first.select(*keys, F.explode(F.array(*[envelope_spectrum(c) for c in channels])).alias("_m"))
    return spectra.select(*keys, F.posexplode("_m").alias("bin", "_v")).groupBy(*keys, "bin").agg(F.avg("_v").alias("mag"))


def defect_band_energy(spectrum: DataFrame, keys, bin_hz: float, bins: int, shaft: str = "shaft_hz", harmonics: int = 4, tolerance_hz: float = 12.5) -> DataFrame:
    """Energy near each defect frequency and its harmonics; overlapping bands count separately.

    The bands are a fixed handful per fault, so they are conditional sums in one aggregate.
    """
    freq = F.col("bin") * F.lit(float(bin_hz))
    last = float(bin_hz) * (bins - 1)
    power = F.col("mag") * F.col("mag")
    aggs = []
    for fault, factor in FAULT_FACTORS.items():
        total = F.lit(0.0)
        for h in range(1, harmonics + 1):
            fc = F.lit(factor * h) * F.col(shaft)
            inside = (fc < last) & (freq >= fc - tolerance_hz) & (freq <= fc + tolerance_hz)
            total = total + F.when(inside, power).otherwise(F.lit(0.0))
        aggs.append(F.sum(total).alias(fault))
    out = spectrum.groupBy(*keys).agg(*aggs)
    return out.withColumn("ALL", sum((F.col(f) for f in FAULT_FACTORS), F.lit(0.0)))
