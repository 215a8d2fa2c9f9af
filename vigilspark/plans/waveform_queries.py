"""Queries over windows, signal features, spectra, normalisation and perturbations, on the waveform."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import linspace_grid, rounded
from ..operators import alarms, health, ordered, perturb, quality, spectra, windowing
from ..operators.ordered import Extent, keep
from ..sources.tables import event_runs, event_series, table, waveform_samples
from .pipelines import event_roles, long_indicators
from .registry import query
from .sqlkit import FOLDS, define, sql

L, HOP, PER_SNAPSHOT = 16, 8, 4
CH = ["x", "y"]
WIN = ["asset_id", "win"]
TIME_FEATURES = [f"{f}_{c}" for f in ("rms", "kurt", "crest", "energy") for c in CH]
FEATURES = [*TIME_FEATURES, "envelope_x", "envelope_y"]

define("wave", """
SELECT l_suppkey AS asset_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
       count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity AS x, l_extendedprice AS y FROM lineitem""")
define("cut", "SELECT w.*, k AS win, pos - k * 8 AS i FROM wave w JOIN generate_series(0, 2000) g(k) ON pos >= k * 8 AND pos < k * 8 + 16 AND k * 8 + 16 <= n")
define("cut2", "SELECT asset_id, n, win, i, 'x' AS ch, x AS v FROM cut UNION ALL SELECT asset_id, n, win, i, 'y', y FROM cut")
define("dev", "SELECT *, v - avg(v) OVER (PARTITION BY asset_id, win, ch) AS d FROM cut2")
define("feat", """
SELECT asset_id, win, ch, max(n) AS n, sqrt(avg(v * v) + 1e-12) AS rms, avg(power(d, 4)) / (power(avg(d * d), 2) + 1e-12) AS kurt, max(abs(v)) / (sqrt(avg(v * v) + 1e-12) + 1e-12) AS crest,
       (16 * sum(d * d) + power(sum(CASE WHEN i % 2 = 0 THEN d ELSE -d END), 2)) / 2 AS energy FROM dev GROUP BY asset_id, win, ch""")
define("dft", """
SELECT asset_id, win, ch, k, sum(v * cos(2 * pi() * k * i / 16)) AS re, -sum(v * sin(2 * pi() * k * i / 16)) AS im FROM cut2, generate_series(0, 15) g(k) GROUP BY ALL""")
define("env", """
SELECT asset_id, win, ch, m, sqrt(power(sum(h * (re * cos(2 * pi() * k * m / 16) - im * sin(2 * pi() * k * m / 16))) / 16, 2) + power(sum(h * (re * sin(2 * pi() * k * m / 16) + im * cos(2 * pi() * k * m / 16))) / 16, 2)) AS e
FROM (SELECT *, CASE WHEN k IN (0, 8) THEN 1 WHEN k < 8 THEN 2 ELSE 0 END AS h FROM dft), generate_series(0, 15) g(m) GROUP BY ALL""")
define("ese", """
SELECT asset_id, win, ch, (16 * sum(d * d) + power(sum(CASE WHEN m % 2 = 0 THEN d ELSE -d END), 2)) / 2 AS ese
FROM (SELECT *, e - avg(e) OVER (PARTITION BY asset_id, win, ch) AS d FROM env) GROUP BY ALL""")


def _cut(spark, folder):
    samples, ext = waveform_samples(spark, folder)
    return windowing.cut_windows(samples, L, HOP), ext


def _window_features(spark, folder, samples=None, envelope=True):
    if samples is None:
        samples, _ = waveform_samples(spark, folder)
    cut = windowing.cut_windows(samples, L, HOP)
    out = windowing.window_features(cut, WIN, CH, L, arrays=envelope)
    if envelope:
        out = out.withColumns({f"envelope_{c}": spectra.envelope_energy()(c) for c in CH}).drop(*CH)
    return out


@query("hopping_windows", sql("SELECT asset_id, win, count(*) AS samples, min(pos) AS first_pos, round(sum(x), 4) AS sum_x, round(sum(y), 2) AS sum_y FROM cut GROUP BY asset_id, win"))
def hopping_windows(spark, folder):
    cut, _ = _cut(spark, folder)
    return cut.groupBy(*WIN).agg(
        F.count(F.lit(1)).alias("samples"), F.min("pos").alias("first_pos"), F.round(F.sum("x"), 4).alias("sum_x"), F.round(F.sum("y"), 2).alias("sum_y")
    )


define("thin", """
SELECT DISTINCT asset_id, CASE WHEN nw <= 20 THEN k ELSE CAST(round_even(k * ((nw - 1) / 19.0::DOUBLE), 0) AS BIGINT) END AS win
FROM (SELECT asset_id, max(win) + 1 AS nw FROM cut GROUP BY asset_id), generate_series(0, 19) g(k) WHERE k < nw""")


@query("evenly_spaced_windows", sql("SELECT asset_id, win, sum(x) AS sum_x FROM cut JOIN thin USING (asset_id, win) GROUP BY ALL"))
def evenly_spaced_windows(spark, folder):
    cut, _ = _cut(spark, folder)
    kept = cut.where(windowing.is_kept(F.col("win"), windowing.window_count(F.col("n"), L, HOP), 20))
    return kept.groupBy(*WIN).agg(F.sum("x").alias("sum_x"))


@query(
    "window_time_features",
    sql("""
SELECT asset_id, win, ch, round(rms, 4) AS rms, round(kurt, 6) AS kurt, round(crest, 6) AS crest, round(energy / (power(rms, 2) * 128), 6) AS relative_energy FROM feat"""),
)
def window_time_features(spark, folder):
    f = _window_features(spark, folder, envelope=False)
    long = f.select(*WIN, F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), *[F.col(f"{k}_{c}").alias(k) for k in ("rms", "kurt", "crest", "energy")]) for c in CH])).alias("_s")).select(*WIN, "_s.*")
    rel = F.col("energy") / (F.col("rms") * F.col("rms") * 128)
    return long.select(*WIN, "ch", F.round("rms", 4).alias("rms"), *rounded(["kurt", "crest"]), F.round(rel, 6).alias("relative_energy"))


@query(
    "band_spectral_energy",
    sql("SELECT asset_id, win, round(sum(re * re + im * im), 3) AS energy FROM dft WHERE ch = 'x' AND k BETWEEN 2 AND 4 GROUP BY ALL"),
)
def band_spectral_energy(spark, folder):
    cut, _ = _cut(spark, folder)
    arrays = windowing.window_arrays(cut, WIN, ["x"])
    return arrays.select(*WIN, F.round(spectra.band_energy(2, 5)("x"), 3).alias("energy"))


@query("envelope_spectral_energy", sql("SELECT asset_id, win, round(ese, 3) AS envelope FROM ese WHERE ch = 'x'"))
def envelope_spectral_energy(spark, folder):
    cut, _ = _cut(spark, folder)
    arrays = windowing.window_arrays(cut, WIN, ["x"])
    return arrays.select(*WIN, F.round(spectra.envelope_energy()("x"), 3).alias("envelope"))


define("snap", """
SELECT asset_id, win // 4 AS snapshot_id, ch, median(rms) AS rms, median(kurt) AS kurt, median(crest) AS crest, median(energy) AS energy, median(ese) AS ese FROM feat JOIN ese USING (asset_id, win, ch) GROUP BY ALL""")


def _snapshot_features(spark, folder, samples=None):
    f = _window_features(spark, folder, samples).withColumn("snapshot_id", F.floor(F.col("win") / PER_SNAPSHOT))
    return windowing.snapshot_medians(f, ["asset_id", "snapshot_id"], FEATURES, PER_SNAPSHOT)


@query(
    "snapshot_feature_table",
    sql("""
SELECT s.asset_id, s.snapshot_id, round(s.rms, 4) AS rms_x, round(t.rms, 3) AS rms_y, round(s.kurt, 6) AS kurt_x, round(t.kurt, 6) AS kurt_y, round(s.crest, 6) AS crest_x, round(t.crest, 6) AS crest_y,
       round(ln(1 + s.energy), 6) AS log_energy_x, round(ln(1 + t.energy), 6) AS log_energy_y, round(ln(1 + s.ese), 6) AS log_envelope_x, round(ln(1 + t.ese), 6) AS log_envelope_y, round(temp, 6) AS temperature
FROM snap s JOIN snap t ON s.asset_id = t.asset_id AND s.snapshot_id = t.snapshot_id AND s.ch = 'x' AND t.ch = 'y'
LEFT JOIN (SELECT user_id AS asset_id, pos AS snapshot_id, y AS temp FROM (SELECT asset_id AS user_id, pos, y FROM ev)) q ON q.asset_id = s.asset_id AND q.snapshot_id = s.snapshot_id"""),
)
def snapshot_feature_table(spark, folder):
    """Ten medians per snapshot, left-joined with a slow side channel of the same asset id."""
    f = _snapshot_features(spark, folder)
    series, _ = event_series(spark, folder)
    side = series.select("asset_id", F.col("pos").alias("snapshot_id"), F.col("y").alias("temperature"))
    out = f.join(side, ["asset_id", "snapshot_id"], "left")
    logs = [F.round(F.log1p(f"{k}_{c}"), 6).alias(f"log_{k}_{c}") for k in ("energy", "envelope") for c in CH]
    return out.select(
        "asset_id", "snapshot_id", F.round("rms_x", 4).alias("rms_x"), F.round("rms_y", 3).alias("rms_y"),
        *rounded(["kurt_x", "kurt_y", "crest_x", "crest_y"]), *logs, *rounded(["temperature"]),
    )


@query(
    "simple_indicators",
    sql("""
SELECT asset_id, win, 'rms' AS indicator, round(sum(rms) / 2, 3) AS value FROM feat GROUP BY asset_id, win UNION ALL
SELECT asset_id, win, 'kurtosis', round(sum(kurt) / 2, 3) FROM feat GROUP BY asset_id, win UNION ALL
SELECT asset_id, win, 'crest', round(sum(crest) / 2, 3) FROM feat GROUP BY asset_id, win"""),
)
def simple_indicators(spark, folder):
    f = _window_features(spark, folder, envelope=False)
    both = {k: (F.col(f"{k}_x") + F.col(f"{k}_y")) / 2 for k in ("rms", "kurt", "crest")}
    f = f.select(*WIN, *[v.alias(k) for k, v in both.items()])
    long = long_indicators(f, WIN, {"rms": "rms", "kurtosis": "kurt", "crest": "crest"})
    return long.select(*WIN, "indicator", F.round("value", 3).alias("value"))


@query(
    "window_size_sweep",
    sql("""
SELECT len::INT AS length, count(*) AS windows, round(avg(rms), 6) AS rms_mean, round(avg(crest), 6) AS crest_mean FROM (
  SELECT len, asset_id, k, sqrt(avg(x * x) + 1e-12) AS rms, max(abs(x)) / (sqrt(avg(x * x) + 1e-12) + 1e-12) AS crest
  FROM wave, (VALUES (8), (16), (32)) t(len), generate_series(0, 2000) g(k) WHERE pos >= k * len // 2 AND pos < k * len // 2 + len AND k * len // 2 + len <= n GROUP BY len, asset_id, k)
GROUP BY len"""),
)
def window_size_sweep(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    parts = None
    for length in (8, 16, 32):
        f = windowing.window_features(windowing.cut_windows(samples.select("asset_id", "pos", "n", "x"), length, length // 2), WIN, ["x"], length)
        row = f.agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("rms_x"), 6).alias("rms_mean"), F.round(F.avg("crest_x"), 6).alias("crest_mean"))
        row = row.select(F.lit(length).alias("length"), "*")
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query(
    "resampled_side_series",
    sql("""
SELECT t.asset_id, i, round(a.y + (b.y - a.y) * (i * (n - 1) / 39.0::DOUBLE - floor(i * (n - 1) / 39.0::DOUBLE)), 6) AS y
FROM (SELECT asset_id, max(n) AS n FROM ev GROUP BY asset_id) t, generate_series(0, 39) g(i), ev a, ev b
WHERE a.asset_id = t.asset_id AND b.asset_id = t.asset_id AND a.pos = (i * (t.n - 1)) // 39 AND b.pos = LEAST(a.pos + 1, t.n - 1)""".replace("i * (n - 1)", "i * (t.n - 1)")),
)
def resampled_side_series(spark, folder):
    series, ext = event_series(spark, folder)
    return windowing.resample(series, ["asset_id"], "y", F.lit(40), ext).select("asset_id", "i", *rounded(["y"]))


# ------------------------------------------------------------------ normalisation
define("wroles", f"SELECT w.*, CAST(f AS INT) AS fold_id, CASE WHEN asset_id % {FOLDS} = f THEN 'test' WHEN asset_id % {FOLDS} = (f + 1) % {FOLDS} THEN 'val' ELSE 'train' END AS role FROM wave w, generate_series(0, {FOLDS - 1}) g(f)")
define("wstat", "SELECT fold_id, avg(x) AS mx, stddev_pop(x) + 1e-8 AS sx, avg(y) AS my, stddev_pop(y) + 1e-8 AS sy FROM wroles WHERE role = 'train' GROUP BY fold_id")


def _fold_stats(spark, folder):
    samples, ext = waveform_samples(spark, folder)
    per_asset = health.assign_roles(windowing.channel_stats(samples, CH), FOLDS).where("role = 'train'")
    return windowing.pooled_stats(per_asset, ["fold_id"], CH), samples


@query("channel_norm_stats", sql("SELECT fold_id, round(mx, 6) AS mean_x, round(sx, 6) AS std_x, round(my, 4) AS mean_y, round(sy, 4) AS std_y FROM wstat"))
def channel_norm_stats(spark, folder):
    stats, _ = _fold_stats(spark, folder)
    return stats.select("fold_id", *rounded(["mean_x", "std_x"]), *rounded(["mean_y", "std_y"], 4))


@query("frozen_zscore", sql("SELECT fold_id, asset_id, pos, round((x - mx) / sx, 6) AS z_x, round((y - my) / sy, 6) AS z_y FROM wroles JOIN wstat USING (fold_id) WHERE role = 'test'"))
def frozen_zscore(spark, folder):
    stats, samples = _fold_stats(spark, folder)
    held = health.assign_roles(samples, FOLDS).where("role = 'test'")
    z = windowing.zscore(held, F.broadcast(stats.drop("rows")), ["fold_id"], CH)  # one row per fold
    return z.select("fold_id", "asset_id", "pos", *rounded(["z_x", "z_y"]))


@query(
    "sensor_norm_stats",
    sql("""
SELECT fold_id, count(CASE WHEN asset_id % 3 <> 0 THEN 1 END) AS sensor_rows, round(coalesce(avg(CASE WHEN asset_id % 3 <> 0 THEN x END), 0), 6) AS mean_x, round(coalesce(stddev_pop(CASE WHEN asset_id % 3 <> 0 THEN x END) + 1e-8, 1), 6) AS std_x
FROM wroles WHERE role = 'train' GROUP BY fold_id"""),
)
def sensor_norm_stats(spark, folder):
    """Statistics over the assets that carry the sensor (here every asset id not divisible by three)."""
    samples, _ = waveform_samples(spark, folder)
    per_asset = windowing.channel_stats(samples, ["x"]).withColumn("has_sensor", F.pmod("asset_id", F.lit(3)) != 0)
    train = health.assign_roles(per_asset, FOLDS).where("role = 'train'")
    return windowing.sensor_stats(train, ["fold_id"], "x", "has_sensor").select("fold_id", "sensor_rows", *rounded(["mean_x", "std_x"]))


@query(
    "healthy_prefix_zscore",
    sql("""
SELECT asset_id, pos, round((x - m) / (s + 1e-8), 6) AS z_x FROM wave JOIN (SELECT asset_id, avg(x) AS m, stddev_pop(x) AS s FROM wave WHERE pos < GREATEST(floor(0.2::DOUBLE * n), 1) GROUP BY asset_id) USING (asset_id)"""),
)
def healthy_prefix_zscore(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    z = windowing.healthy_prefix_zscore(samples.select("asset_id", "pos", "n", "x"), ["asset_id"], ["x"])
    return z.select("asset_id", "pos", *rounded(["z_x"]))


# ------------------------------------------------------------------ defect frequencies
FS, LS = 1600.0, 64
define("named", """
SELECT s_suppkey AS asset_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE (30 + 2.5 * (s_suppkey % 3))::VARCHAR || 'Hz12kN_' END || 'Bearing' || s_nationkey || '_' || s_suppkey AS name,
       CASE WHEN s_suppkey % 4 = 0 THEN 35.0::DOUBLE ELSE 30 + 2.5::DOUBLE * (s_suppkey % 3) END AS fr FROM supplier""")
FACTORS = "(VALUES ('BPFO', 4 * (1 - 7.92::DOUBLE / 34.55)), ('BPFI', 4 * (1 + 7.92::DOUBLE / 34.55)), ('BSF', 34.55::DOUBLE / 15.84 * (1 - power(7.92::DOUBLE / 34.55, 2))), ('FTF', 0.5::DOUBLE * (1 - 7.92::DOUBLE / 34.55))) t(fault, k)"
define("cut64", "SELECT w.asset_id, k AS win, pos - k * 64 AS i, x, y FROM wave w JOIN generate_series(0, 500) g(k) ON pos >= k * 64 AND pos < k * 64 + 64 AND k * 64 + 64 <= n")
define("sig64", "SELECT asset_id, win, i, 'x' AS ch, x AS v FROM cut64 UNION ALL SELECT asset_id, win, i, 'y', y FROM cut64")
define("dft64", "SELECT asset_id, win, ch, k, sum(v * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM sig64, generate_series(0, 32) g(k) GROUP BY ALL")
define("env64", """
SELECT asset_id, win, ch, m, sqrt(power(sum(h * (re * cos(2 * pi() * ((k * m) % 64) / 64) - im * sin(2 * pi() * ((k * m) % 64) / 64))) / 64, 2) + power(sum(h * (re * sin(2 * pi() * ((k * m) % 64) / 64) + im * cos(2 * pi() * ((k * m) % 64) / 64))) / 64, 2)) AS e
FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS h FROM dft64), generate_series(0, 63) g(m) GROUP BY ALL""")
define("mag64", """
SELECT asset_id, win, ch, k AS bin, sqrt(power(sum(d * cos(2 * pi() * ((k * m) % 64) / 64)), 2) + power(sum(d * sin(2 * pi() * ((k * m) % 64) / 64)), 2)) AS mag
FROM (SELECT *, e - avg(e) OVER (PARTITION BY asset_id, win, ch) AS d FROM env64), generate_series(0, 32) g(k) GROUP BY ALL""")
define("spec64", "SELECT asset_id, win // 8 AS snapshot_id, bin, avg(mag) AS mag FROM mag64 GROUP BY ALL")
define("bands", f"SELECT asset_id, fault, h, k * fr * h AS fc FROM named, {FACTORS}, generate_series(1, 4) g(h) WHERE k * fr * h < 800")
def _defect_sql(spec: str) -> str:
    case = lambda f: f"coalesce(sum(CASE WHEN fault = '{f}' THEN mag * mag END), 0) AS {f.lower()}"
    return f"""
SELECT s.asset_id, s.snapshot_id, {', '.join(case(f) for f in spectra.FAULT_FACTORS)}, coalesce(sum(CASE WHEN fault IS NOT NULL THEN mag * mag END), 0) AS total
FROM {spec} s LEFT JOIN bands b ON s.asset_id = b.asset_id AND s.bin * 25.0::DOUBLE BETWEEN fc - 12.5 AND fc + 12.5 GROUP BY ALL"""


define("defect", _defect_sql("spec64"))
define("spec1", "SELECT asset_id, win AS snapshot_id, bin, avg(mag) AS mag FROM mag64 GROUP BY ALL")
define("defect1", _defect_sql("spec1"))


def _assets(spark, folder):
    """Asset names with and without a shaft frequency, from the supplier table."""
    hz = F.format_string("%.1fHz12kN_", F.lit(30.0) + F.lit(2.5) * F.pmod("s_suppkey", F.lit(3)))
    prefix = F.when(F.pmod("s_suppkey", F.lit(4)) == 0, F.lit("")).otherwise(hz)
    name = F.concat(prefix, F.lit("Bearing"), F.col("s_nationkey"), F.lit("_"), F.col("s_suppkey"))
    out = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), name.alias("name"))
    return out.withColumn("shaft_hz", spectra.shaft_hz(F.col("name")))


@query("defect_frequencies", sql(f"SELECT asset_id, fault, round(k * fr, 6) AS hz FROM named, {FACTORS}"))
def defect_frequencies(spark, folder):
    return spectra.fault_frequencies(_assets(spark, folder)).select("asset_id", "fault", *rounded(["hz"]))


def _spectrum(spark, folder, per_snapshot=8):
    samples, _ = waveform_samples(spark, folder)
    cut = windowing.cut_windows(samples, LS, LS)
    cut = cut.withColumn("snapshot_id", F.floor(F.col("win") / per_snapshot))
    arrays = windowing.window_arrays(cut, ["asset_id", "snapshot_id", "win"], CH)
    return spectra.mean_spectrum(arrays, ["asset_id", "snapshot_id"], CH)


@query("envelope_spectrum", sql("SELECT asset_id, snapshot_id, bin::INT AS bin, round(mag, 2) AS mag FROM spec64"))
def envelope_spectrum(spark, folder):
    return _spectrum(spark, folder).select("asset_id", "snapshot_id", "bin", F.round("mag", 2).alias("mag"))


def _defect(spark, folder, per_snapshot=8):
    spec = _spectrum(spark, folder, per_snapshot).join(_assets(spark, folder).select("asset_id", "shaft_hz"), "asset_id")
    return spectra.defect_band_energy(spec, ["asset_id", "snapshot_id"], FS / LS, LS // 2 + 1)


@query("defect_band_energy", sql("SELECT asset_id, snapshot_id, round(ln(1 + bpfo), 5) AS bpfo, round(ln(1 + bpfi), 5) AS bpfi, round(ln(1 + bsf), 5) AS bsf, round(ln(1 + ftf), 5) AS ftf, round(ln(1 + total), 5) AS total FROM defect"))
def defect_band_energy(spark, folder):
    d = _defect(spark, folder)
    return d.select("asset_id", "snapshot_id", *[F.round(F.log1p(f), 5).alias(a) for f, a in (("BPFO", "bpfo"), ("BPFI", "bpfi"), ("BSF", "bsf"), ("FTF", "ftf"), ("ALL", "total"))])


define("hi16", "SELECT asset_id, win // 8 AS snapshot_id, round(avg(rms), 9) AS rms FROM feat WHERE ch = 'x' GROUP BY ALL")
define("dval", "SELECT asset_id, snapshot_id, rms, round(ln(1 + total), 9) AS energy FROM defect1 JOIN hi16 USING (asset_id, snapshot_id)")
define("dcorr", """
SELECT asset_id, snapshot_id, rank() OVER (PARTITION BY asset_id ORDER BY rms) + (count(*) OVER (PARTITION BY asset_id, rms) - 1) / 2.0::DOUBLE AS rx,
       rank() OVER (PARTITION BY asset_id ORDER BY energy) + (count(*) OVER (PARTITION BY asset_id, energy) - 1) / 2.0::DOUBLE AS ry, rank() OVER (PARTITION BY asset_id ORDER BY snapshot_id) AS rz FROM dval""")


@query(
    "defect_energy_correlation",
    sql("""
SELECT asset_id, n, round(xy, 5) AS raw, round((xy - xz * yz) / (sqrt((1 - xz * xz) * (1 - yz * yz)) + 1e-12), 5) AS partial FROM (
  SELECT asset_id, count(*) AS n, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry) + 1e-12) AS xy, covar_pop(rx, rz) / (stddev_pop(rx) * stddev_pop(rz) + 1e-12) AS xz, covar_pop(ry, rz) / (stddev_pop(ry) * stddev_pop(rz) + 1e-12) AS yz
  FROM dcorr GROUP BY asset_id HAVING count(*) >= 5)"""),
)
def defect_energy_correlation(spark, folder):
    """Rank correlation of RMS with defect energy per asset, raw and with life held fixed."""
    feats = _window_features(spark, folder, envelope=False).withColumn("snapshot_id", F.floor(F.col("win") / 8))
    hi = feats.groupBy("asset_id", "snapshot_id").agg(F.round(F.avg("rms_x"), 9).alias("rms"))
    d = _defect(spark, folder, 1).select("asset_id", "snapshot_id", F.round(F.log1p("ALL"), 9).alias("energy"))
    rows = keep(d.join(hi, ["asset_id", "snapshot_id"]))
    _, ext = waveform_samples(spark, folder)
    out = quality.partial_spearman(rows, ["asset_id"], "rms", "energy", "snapshot_id", ext)
    n = rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return out.join(n, "asset_id").select("asset_id", "n", *rounded(["raw", "partial"], 5))


@query(
    "partial_rank_correlation",
    sql("""
SELECT asset_id, round((xy - xz * yz) / (sqrt((1 - xz * xz) * (1 - yz * yz)) + 1e-12), 5) AS partial, round(xy, 5) AS raw FROM (
  SELECT asset_id, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry) + 1e-12) AS xy, covar_pop(rx, rz) / (stddev_pop(rx) * stddev_pop(rz) + 1e-12) AS xz, covar_pop(ry, rz) / (stddev_pop(ry) * stddev_pop(rz) + 1e-12) AS yz
  FROM (SELECT asset_id, rank() OVER (PARTITION BY asset_id ORDER BY x) + (count(*) OVER (PARTITION BY asset_id, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY asset_id ORDER BY y) + (count(*) OVER (PARTITION BY asset_id, y) - 1) / 2.0::DOUBLE AS ry, pos + 1 AS rz FROM ev) GROUP BY asset_id)"""),
)
def partial_rank_correlation(spark, folder):
    series, ext = event_series(spark, folder)
    out = quality.partial_spearman(series, ["asset_id"], "x", "y", "pos", ext)
    return out.select("asset_id", *rounded(["partial", "raw"], 5))


# ------------------------------------------------------------------ perturbations
def _g(ch: str, kind: str) -> str:
    key = f"asset_id || '|' || pos || '|{ch}|{kind}|"
    u = lambda t: f"('0x' || substr(md5({key}{t}'), 1, 8))::BIGINT"
    return f"sqrt(-2 * ln(({u('r')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ({u('t')} / 4294967296.0::DOUBLE))"


@query(
    "noise_at_healthy_snr",
    sql(f"""
SELECT asset_id, pos, round(x + {_g('x', 'snr10')} * rx / sqrt(10::DOUBLE), 6) AS x, round(y + {_g('y', 'snr10')} * ry / sqrt(10::DOUBLE), 4) AS y
FROM wave JOIN (SELECT asset_id, sqrt(avg(x * x)) AS rx, sqrt(avg(y * y)) AS ry FROM wave WHERE pos < GREATEST(floor(0.2::DOUBLE * n), 1) GROUP BY asset_id) USING (asset_id)"""),
)
def noise_at_healthy_snr(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    healthy = F.col("pos") < F.greatest(F.floor(F.col("n") * F.lit(0.2)), F.lit(1))
    out = perturb.noise_at_healthy_snr(samples, ["asset_id"], CH, 10.0, healthy)
    return out.select("asset_id", "pos", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query(
    "noise_at_window_snr",
    sql(f"""
SELECT asset_id, win, pos, round(x + {_g('x', 'win5')} * np, 4) AS x FROM (
  SELECT *, sqrt((avg(x * x) OVER (PARTITION BY asset_id, win) + avg(y * y) OVER (PARTITION BY asset_id, win)) / 2 / power(10, 0.5::DOUBLE)) AS np FROM cut)"""),
)
def noise_at_window_snr(spark, folder):
    cut, _ = _cut(spark, folder)
    return perturb.noise_at_window_snr(cut, WIN, CH, 5.0).select(*WIN, "pos", F.round("x", 4).alias("x"))


@query(
    "gain_drift_missing",
    sql("""
SELECT asset_id, pos, round(x * 0.7::DOUBLE, 6) AS gain_x, round(y * 1.3::DOUBLE, 4) AS gain_y, round(x * (1 + 0.2::DOUBLE * (pos / GREATEST(n - 1, 1)::DOUBLE)), 9) AS drift_x, 0.0::DOUBLE AS missing_y FROM wave"""),
)
def gain_drift_missing(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    g = perturb.gain(samples.withColumns({"gain_x": F.col("x"), "gain_y": F.col("y"), "drift_x": F.col("x"), "missing_y": F.col("y")}), {"gain_x": 0.7, "gain_y": 1.3})
    g = perturb.missing_axis(perturb.sensitivity_drift(g, ["drift_x"]), "missing_y")
    return g.select("asset_id", "pos", F.round("gain_x", 6).alias("gain_x"), F.round("gain_y", 4).alias("gain_y"), F.round("drift_x", 9).alias("drift_x"), "missing_y")


@query(
    "temperature_faults",
    sql("""
SELECT fold_id, asset_id, pos, round((0 - mx) / sx, 6) AS missing, round((x - mx) / sx + 5 / sx, 6) AS drifted
FROM roles JOIN (SELECT fold_id, avg(x) AS mx, stddev_pop(x) + 1e-8 AS sx FROM roles WHERE role = 'train' GROUP BY fold_id) USING (fold_id) WHERE role = 'test'"""),
)
def temperature_faults(spark, folder):
    """Dead and drifting temperature sensor, in the frozen normalised units of each fold."""
    series, _ = event_runs(spark, folder, FOLDS)
    stats = windowing.channel_stats(series, ["x"]).join(series.select("asset_id", "bucket").distinct(), "asset_id")
    train = event_roles(stats).where("role = 'train'")
    stats = windowing.pooled_stats(train, ["fold_id"], ["x"]).drop("rows")
    held = event_roles(series.select("asset_id", "bucket", "pos", "x")).where("role = 'test'")
    z = windowing.zscore(held, F.broadcast(stats), ["fold_id"], ["x"])  # one row per fold
    drifted = perturb.temperature_drift(z, ["x"], 5.0).withColumnRenamed("z_x", "drifted")
    out = perturb.missing_temperature(drifted, ["x"]).withColumnRenamed("z_x", "missing")
    return out.select("fold_id", "asset_id", "pos", *rounded(["missing", "drifted"]))


@query("features_under_noise", sql(f"""
SELECT asset_id, win // 4 AS snapshot_id, round(median(rms), 4) AS rms_x, round(median(kurt), 6) AS kurt_x FROM (
  SELECT asset_id, win, sqrt(avg(v * v) + 1e-12) AS rms, avg(power(d, 4)) / (power(avg(d * d), 2) + 1e-12) AS kurt FROM (
    SELECT asset_id, win, v, v - avg(v) OVER (PARTITION BY asset_id, win) AS d FROM (
      SELECT asset_id, win, x + {_g('x', 'snr10')} * rx / sqrt(10::DOUBLE) AS v FROM cut JOIN (SELECT asset_id, sqrt(avg(x * x)) AS rx FROM wave WHERE pos < GREATEST(floor(0.2::DOUBLE * n), 1) GROUP BY asset_id) USING (asset_id)))
  GROUP BY asset_id, win) GROUP BY ALL"""))
def features_under_noise(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    healthy = F.col("pos") < F.greatest(F.floor(F.col("n") * F.lit(0.2)), F.lit(1))
    noisy = perturb.scenario(samples, ["asset_id"], CH, "snr10", healthy)
    f = _window_features(spark, folder, noisy, envelope=False).withColumn("snapshot_id", F.floor(F.col("win") / PER_SNAPSHOT))
    out = windowing.snapshot_medians(f, ["asset_id", "snapshot_id"], ["rms_x", "kurt_x"], PER_SNAPSHOT)
    return out.select("asset_id", "snapshot_id", F.round("rms_x", 4).alias("rms_x"), F.round("kurt_x", 6).alias("kurt_x"))


def waveform_components(spark, folder, kinds=None, **options):
    """Raw index components on the ten window features, one window per snapshot.

    ``kinds`` names perturbations: each asset then has a series for every ``kind``. They travel as columns beside each other, so the
    samples are exchanged once.
    """
    samples, ext = waveform_samples(spark, folder)
    keys, variants = ["asset_id"], ("",)
    if kinds:
        healthy = F.col("pos") < F.greatest(F.floor(F.col("n") * F.lit(0.2)), F.lit(1))
        variants = tuple(f"_{i}" for i in range(len(kinds)))
        samples = perturb.scenario_columns(samples, keys, CH, dict(zip(variants, kinds)), healthy)
    feats = windowing.window_table(samples, keys, CH, L, HOP, ext.rows, variants)
    if kinds:
        keys = ["kind", *keys]
        feats = feats.withColumn("kind", F.array(*[F.lit(k) for k in kinds])[F.col("variant")]).drop("variant")
    series = keep(feats.withColumn("n", windowing.window_count(F.col("n"), L, HOP)).withColumnRenamed("win", "pos"))
    ext = Extent(ext.rows // HOP + 1, ext.longest // HOP + 1, ext.groups)
    comp = health.raw_components(series, keys, FEATURES, ext, **options)
    return keep(comp.drop(*[f"z_{f}" for f in FEATURES])), ext


@query("waveform_components")
def waveform_raw_components(spark, folder):
    """Ten features, shrunk covariance where the healthy prefix allows it, diagonal otherwise."""
    comp, _ = waveform_components(spark, folder)
    return comp.select("asset_id", "pos", "n_base", "estimator", *rounded(["shrinkage", "E", "C"]))


@query("robustness_table")
def robustness_table(spark, folder, kinds=("clean", "gain", "drift", "snr20", "snr10", "snr5")):
    """Indicator quality and train-selected alarm scores of the held-out assets under each scenario.

    Scenarios run in one plan: each gets its own block of fold ids, so nothing is shared between fits.
    """
    comp, ext = waveform_components(spark, folder, kinds)
    ext = Extent(ext.rows * len(kinds), ext.longest, ext.groups * len(kinds))
    # every (asset, scenario) is a series of its own; its number tells the scenario, its bucket follows the asset
    count, number = len(kinds), sum((F.when(F.col("kind") == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(kinds)), F.lit(0))
    series = comp.select("kind", (F.col("asset_id") * count + number).alias("asset_id"), F.pmod("asset_id", F.lit(FOLDS)).alias("bucket"), "pos", "n", "E", "C", "rms_x", "kurt_x")
    block = F.pmod("asset_id", F.lit(count))
    params = keep(health.fit_index(series, FOLDS, ext, dataset=block))
    held = health.apply_index(health.assign_roles(series, FOLDS, "bucket", block).where("role = 'test'"), params)
    # exchanged once, before there is a row per fold; the run minima and first alarms of a (fold, asset) then find their rows together
    placed = series.select("kind", "asset_id", "bucket", "pos", "n", "E", "C")
    if ext.longest <= ordered.SAFE_GROUP:
        placed = ordered.spread(placed, "asset_id", rows=FOLDS * ext.rows)
    applied = health.apply_index(health.assign_roles(placed, FOLDS, "bucket", block).where("role != 'val'"), params)
    applied = applied.select("kind", "fold_id", "role", "asset_id", "pos", "n", "index")
    longs = long_indicators(held, ["kind", "asset_id", "pos", "n"], {"index": "index", "abnormality": "E_norm", "rms": "rms_x", "kurtosis": "kurt_x"})
    # an indicator has a row per asset under one scenario
    assets = Extent(ext.groups, ext.groups // count, count)
    summary = quality.quality_table(quality.asset_criteria(longs, ["kind", "indicator", "asset_id"], "value", ext), ["kind", "indicator"], assets)
    firsts = alarms.with_run_minimum(applied, ["fold_id", "asset_id"], "index", ext)
    firsts = alarms.first_over_grid(firsts, ["kind", "fold_id", "role", "asset_id"], linspace_grid(0.3, 13, 0.05), lambda p: p, 13, "p")
    scored = alarms.alarm_scores(firsts, alarms.onset_at(F.col("n"), F.lit(0.6)))
    # a fold belongs to one scenario: a row per fold, role and threshold is kept in place of one per asset
    sums = [F.sum(c).alias(c) for c in ("precision", "recall")]
    scored = keep(scored.groupBy("kind", "fold_id", "role", "p").agg(F.avg("f1").alias("f1"), *sums, F.count(F.lit(1)).alias("assets")))
    best = alarms.select_parameter(scored.where("role = 'train'"), ["fold_id"], "p").select("fold_id", "p")
    test = scored.where("role = 'test'").join(F.broadcast(best), ["fold_id", "p"])  # one row per fold
    ew = test.groupBy("kind", F.lit("index").alias("indicator")).agg(*[(F.sum(c) / F.sum("assets")).alias(f"alarm_{c}") for c in ("precision", "recall")])
    names = ["monotonicity_median", "trendability_median", "prognosability", "alarm_precision", "alarm_recall"]
    return summary.join(ew, ["kind", "indicator"], "left").select(F.col("kind").alias("perturbation"), "indicator", *rounded(names))
