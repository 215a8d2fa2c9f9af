"""Windows, spectra, files and statistics against NumPy and published values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.functions import distributions as dist
from vigilspark.operators import inference, regress, spectra, windowing
from vigilspark.operators.ordered import Extent
from vigilspark.plans.artifacts import build_artifacts
from vigilspark.sources import files

EXT = Extent(10_000, 500)


def samples(lengths=(70, 33, 15), seed=3):
    rng = np.random.default_rng(seed)
    rows = [(a, k, n, float(rng.normal()), float(rng.normal() + 2)) for a, n in enumerate(lengths) for k in range(n)]
    return pd.DataFrame(rows, columns=["asset_id", "pos", "n", "x", "y"])


def analytic_envelope(x):
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


@pytest.mark.parametrize("length,overlap", [(16, 0.5), (15, 0.0), (16, 0.75)])
def test_window_features_match_numpy(spark, length, overlap):
    pdf = samples()
    hop = windowing.hop_length(length, overlap)
    cut = windowing.cut_windows(spark.createDataFrame(pdf), length, hop)
    out = windowing.window_features(cut.drop("n"), ["asset_id", "win"], ["x", "y"], length, arrays=True)
    out = out.withColumn("env", spectra.envelope_energy()("x")).withColumn("band", spectra.band_energy(2, 5)("x")).toPandas()
    want = sum(max(0, (n - length) // hop + 1) for n in (70, 33, 15))
    assert len(out) == want
    for r in out.itertuples():
        v = pdf[pdf.asset_id == r.asset_id].x.to_numpy()[r.win * hop : r.win * hop + length]
        p = np.abs(np.fft.rfft(v)) ** 2
        p[0] = 0
        d = v - v.mean()
        rms = np.sqrt((v**2).mean() + 1e-12)
        e = analytic_envelope(v)
        pe = np.abs(np.fft.rfft(e - e.mean())) ** 2
        assert np.allclose(
            [r.energy_x, r.rms_x, r.kurt_x, r.crest_x, r.env, r.band],
            [p.sum(), rms, (d**4).mean() / ((d**2).mean() ** 2 + 1e-12), np.abs(v).max() / (rms + 1e-12), pe[1:].sum(), p[2:5].sum()],
        )


@pytest.mark.parametrize("count,most", [(1, 6), (7, 6), (50, 6), (101, 20), (8, 1)])
def test_even_subsample(spark, count, most):
    df = spark.range(count).select(F.col("id").alias("win"), F.lit(count).alias("c"))
    got = sorted(r.win for r in df.where(windowing.is_kept(F.col("win"), F.col("c"), most)).collect())
    want = list(range(count)) if count <= most else sorted(set(np.round(np.linspace(0, count - 1, most)).astype(int).tolist()))
    assert got == want


def test_resample(spark):
    pdf = samples((9, 1, 2, 30))
    for points in (1, 2, 5, 40):
        got = windowing.resample(spark.createDataFrame(pdf), ["asset_id"], "x", F.lit(points), EXT).toPandas()
        for a, g in got.groupby("asset_id"):
            v = pdf[pdf.asset_id == a].x.to_numpy()
            g = g.sort_values("i")
            assert g.i.tolist() == list(range(points))
            want = np.interp(np.linspace(0, 1, points), np.linspace(0, 1, len(v)), v) if len(v) > 1 else np.full(points, v[0])
            assert np.allclose(g.x, want)


def test_defect_bands(spark):
    rng = np.random.default_rng(0)
    mag = rng.random(33)
    df = spark.createDataFrame([(1, b, float(m), 35.0) for b, m in enumerate(mag)], "asset_id long, bin int, mag double, shaft_hz double")
    got = spectra.defect_band_energy(df, ["asset_id"], 25.0, 33).first()
    freqs = np.arange(33) * 25.0
    for name, k in spectra.FAULT_FACTORS.items():
        e = 0.0
        for h in range(1, 5):
            fc = k * 35.0 * h
            if fc >= freqs[-1]:
                break
            e += (mag[(freqs >= fc - 12.5) & (freqs <= fc + 12.5)] ** 2).sum()
        assert np.isclose(got[name], e)
    names = spark.createDataFrame([("37.5Hz11kN_Bearing2_1",), ("Bearing1_1",)], "name string")
    assert [r.h for r in names.select(spectra.shaft_hz(F.col("name")).alias("h")).collect()] == [37.5, 35.0]


def test_pooled_stats_and_missing_sensor(spark):
    pdf = samples()
    per = windowing.channel_stats(spark.createDataFrame(pdf), ["x"]).withColumn("g", F.lit(1))
    got = windowing.pooled_stats(per, ["g"], ["x"]).first()
    assert np.isclose(got.mean_x, pdf.x.mean()) and np.isclose(got.std_x, pdf.x.std(ddof=0) + 1e-8)
    none = windowing.sensor_stats(per.withColumn("has", F.lit(False)), ["g"], "x", "has").first()
    assert none.mean_x == 0 and none.std_x == 1


def test_files_round_trip(spark, tmp_path):
    for asset, n in (("A", 3), ("B", 2)):
        pd.DataFrame({"dataset": "d", "asset_id": asset, "snapshot_id": range(n), "x": 1.5, "y": 2.5}).to_csv(tmp_path / f"run_{asset}_s42.csv", index=False)
    df = files.read_csv(spark, str(tmp_path / "run_*.csv"), files.SERIES_SCHEMA)
    got = df.withColumn("seed", files.from_path(r"_s(\d+)\.csv")).toPandas()
    assert len(got) == 5 and set(got.seed) == {"42"} and got.x.eq(1.5).all()
    files.write_table(df, str(tmp_path / "out"), ("dataset", "asset_id"))
    assert files.read_parquet(spark, str(tmp_path / "out")).where("asset_id = 'B'").count() == 2
    wins = spark.createDataFrame([("d", "A", 0, 0, [1.0, 2.0], [3.0, 4.0])], files.WINDOW_SCHEMA)
    files.write_table(wins, str(tmp_path / "w"), ())
    assert files.read_windows(spark, str(tmp_path / "w")).first().x == [1.0, 2.0]


def test_artifacts(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [("d", a, s, i, float(rng.normal()), float(rng.normal())) for a, count in (("A", 14), ("B", 12), ("C", 4)) for s in range(count) for i in range(48)]
    df = spark.createDataFrame(rows, "dataset string, asset_id string, snapshot_id long, sample_idx long, x double, y double")
    done = spark.createDataFrame([("d", "B")], "dataset string, asset_id string")
    build_artifacts(df, str(tmp_path / "a"), 16, 0.5, most=4, done=done)
    man = files.read_parquet(spark, str(tmp_path / "a/manifest")).toPandas()
    assert man.asset_id.tolist() == ["A"] and man.n_snapshots[0] == 14 and man.n_windows[0] == 14 * 4 and not man.has_temp[0]
    lab = files.read_parquet(spark, str(tmp_path / "a/labels")).toPandas().sort_values("snapshot_id")
    assert len(lab) == 14 and lab.rul.iloc[-1] == 0
    # a second run adds the other asset and leaves the finished one alone, in all four tables
    finished = spark.createDataFrame([("d", "A")], "dataset string, asset_id string")
    build_artifacts(df, str(tmp_path / "a"), 16, 0.5, most=4, done=finished)
    for name, count in (("manifest", {"A": 1, "B": 1}), ("snapshot_features", {"A": 14, "B": 12}), ("index", {"A": 14, "B": 12}), ("labels", {"A": 14, "B": 12})):
        assert files.read_parquet(spark, str(tmp_path / "a" / name)).toPandas().asset_id.value_counts().to_dict() == count


# ------------------------------------------------------------------ statistics
def brute_wilcoxon(d):
    r = pd.Series(np.abs(d)).rank().to_numpy()
    w = r[d > 0].sum()
    n = len(d)
    sums = [sum(r[i] for i in range(n) if m >> i & 1) for m in range(2**n)]
    up, lo = np.mean([s >= w for s in sums]), np.mean([s <= w for s in sums])
    return min(1.0, 2 * min(up, lo)), up


def test_wilcoxon_exact(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0.4, 1, 9)
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(d)], "g string, asset_id long, diff double")
    for ext in (EXT,):
        sums = inference.signed_ranks(df, ["g"], ext)
        two = inference.with_wilcoxon_p(sums).first()
        one = inference.with_wilcoxon_p(sums, "greater").first()
        want = brute_wilcoxon(d)
        assert np.isclose(two.p_value, want[0]) and np.isclose(one.p_value, want[1])


def test_signed_ranks_split_and_zeros(spark, split_groups):
    d = [0.0, 0.0, 1.0, -1.0, 2.0, 3.0, 3.0, -4.0]
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(d)] + [("z", k, 0.0) for k in range(3)], "g string, asset_id long, diff double")
    got = {r.g: r for r in inference.with_wilcoxon_p(inference.signed_ranks(df, ["g"], split_groups)).collect()}
    assert got["g"].n_zero == 2 and got["g"].w_plus == 1.5 + 3 + 4.5 + 4.5 and got["g"].w_minus == 1.5 + 6
    assert got["z"].n_used == 0 and got["z"].rank_biserial == 0 and (got["z"].p_value is None or got["z"].p_value != got["z"].p_value)


def test_t_distribution():
    # textbook values
    assert np.isclose(dist.t_quantile(0.975, 10), 2.228139, atol=1e-5)
    assert np.isclose(dist.t_quantile(0.95, 16), 1.745884, atol=1e-5)
    assert np.isclose(dist.t_sf(2.0, 5), 0.0509697, atol=1e-6) and np.isclose(dist.t_sf(-2.0, 5), 1 - 0.0509697, atol=1e-6)
    assert np.isclose(2 * dist.normal_sf(1.959964), 0.05, atol=1e-6)


def test_holm_is_monotone_and_per_family(spark):
    p = {"a": [0.01, 0.04, 0.03, 0.005], "b": [0.5, 0.9]}
    df = spark.createDataFrame([(f, i, v) for f, vs in p.items() for i, v in enumerate(vs)], "f string, i int, p double")
    got = inference.holm(df, ["f"], "p", tie="i").toPandas().sort_values(["f", "i"])
    assert np.allclose(got[got.f == "a"].holm_p, [0.03, 0.06, 0.06, 0.02]) and np.allclose(got[got.f == "b"].holm_p, [1.0, 1.0])


def test_tost_and_interval(spark):
    d = np.array([0.001, -0.002, 0.003, 0.0, 0.002, -0.001])
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(d)], "g string, asset_id long, diff double")
    out = inference.mean_difference(df, ["g"])
    out = inference.with_interval(out.withColumn("p", inference.tost_p("n", "t_lo", "t_hi")), 0.9, "lo", "hi").first()
    se = d.std(ddof=1) / np.sqrt(6)
    assert np.isclose(out.se, se) and np.isclose(out.hi - out.lo, 2 * 2.015048 * se, rtol=1e-5)
    assert np.isclose(out.p, max(dist.t_sf((d.mean() + 0.01) / se, 5), dist.t_sf(-(d.mean() - 0.01) / se, 5)))


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([("g", k, float(k)) for k in range(20)], "g string, asset_id long, diff double")
    a = inference.bootstrap_mean(df, ["g"], replicates=300).first()
    b = inference.bootstrap_mean(df.repartition(7), ["g"], replicates=300).first()
    assert np.allclose((a.boot_lo, a.boot_hi), (b.boot_lo, b.boot_hi)) and a.boot_lo < 9.5 < a.boot_hi


def test_bootstrap_interval_is_that_of_the_mean(spark):
    x = np.random.default_rng(2).normal(1, 2, 400)
    rows = [(None if k % 2 else 5, k, float(v)) for k, v in enumerate(x)] + [(5, 1000, None), (7, 1, 3.0)]
    got = {r.g: r for r in inference.bootstrap_mean(spark.createDataFrame(rows, "g int, asset_id long, diff double"), ["g"]).collect()}
    for key, own in ((5, x[::2]), (None, x[1::2])):
        half = 1.96 * own.std(ddof=1) / np.sqrt(len(own))
        assert abs(got[key].boot_lo - own.mean() + half) < 0.06 * half and abs(got[key].boot_hi - own.mean() - half) < 0.06 * half
    assert got[7].boot_lo == got[7].boot_hi == 3.0


def test_multiplicities_are_poisson_and_independent():
    m = inference.multiplicities(np.arange(5_000, 5_400, dtype=np.int64) * 7919 % 2**32, np.arange(2000))
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02
    assert [abs((m == k).mean() - np.exp(-1) / math.factorial(k)) < 0.005 for k in range(5)] == [True] * 5
    assert np.abs(np.corrcoef(m[:100]) - np.eye(100)).max() < 0.12 and np.abs(np.corrcoef(m[:, :100].T) - np.eye(100)).max() < 0.25


def test_ridge_from_moments(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, -3]
    y = x @ [0.02, -0.01, 0.3] + rng.normal(0, 0.05, n) + 1.4
    pdf = pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]).assign(k=1)
    m = regress.moments(spark.createDataFrame(pdf), ["k"], ["a", "b", "c"], "y")
    got = regress.ridge_by_fold(m, ["a", "b", "c"], ["a", "b", "c"], 1.0).first().model
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(got, [y.mean() - beta @ x.mean(0), *beta])


def test_factorial_needs_all_cells(spark):
    rows = [("d", a, b, m) for a, b, m in (("off", "off", 1.0), ("off", "on", 2.0), ("on", "off", 4.0), ("on", "on", 8.0))] + [("e", "on", "on", 1.0)]
    got = inference.factorial_effects(spark.createDataFrame(rows, "dataset string, first string, second string, mean double"), ["dataset"]).collect()
    assert len(got) == 1 and (got[0].effect_first, got[0].effect_second, got[0].interaction) == (4.5, 2.5, 3.0)


def test_merged_moments_keep_digits_under_a_large_offset(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"asset_id": np.arange(600) % 4, "x": 1e9 + rng.normal(size=600), "a": 1e9 + rng.normal(size=600)})
    pdf["x"] += pdf.asset_id
    pdf["y"] = 0.3 * (pdf.a - 1e9) + rng.normal(0, 0.1, 600)
    per = windowing.channel_stats(spark.createDataFrame(pdf), ["x"]).withColumns({"g": F.lit(1), "has": F.lit(True)})
    assert abs(windowing.pooled_stats(per, ["g"], ["x"]).first().std_x - pdf.x.std(ddof=0)) < 1e-6
    assert abs(windowing.sensor_stats(per, ["g"], "x", "has").first().std_x - pdf.x.std(ddof=0)) < 1e-6
    parts = regress.moments(spark.createDataFrame(pdf), ["asset_id"], ["a"], "y").withColumn("k", F.lit(1))
    got = regress.ridge_by_fold(regress.merge_moments(parts, ["k"], 1), ["a"], ["a"], 1.0).first().model
    z = (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)
    slope = (z * (pdf.y - pdf.y.mean())).sum() / (len(z) + 1.0) / pdf.a.std(ddof=0)
    assert abs(got[1] - slope) < 1e-6


@pytest.mark.parametrize("length,hop,tile", [(16, 8, 2), (15, 15, 1), (16, 4, 3), (16, 20, 512)])
def test_window_table_equals_windows_cut_by_copies(spark, monkeypatch, length, hop, tile):
    monkeypatch.setattr(windowing, "TILE_WINDOWS", tile)
    monkeypatch.setattr(windowing, "GROUP_SAMPLES", 40)
    pdf = samples((70, 33, 15, 64)).assign(k=lambda d: np.where(d.asset_id == 1, None, "a"))
    pdf["x"] = pdf["x"].astype(object).where(~pdf.index.isin([3, 90]) & ~pdf.pos.between(32, 63), None)
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "asset_id long, pos long, n long, x double, y double, k string")
    keys, names = ["asset_id", "k"], ["rms", "kurt", "crest", "energy"]
    got = windowing.window_table(df, keys, ["x", "y"], length, hop, len(pdf)).toPandas()
    plain = windowing.window_features(windowing.cut_windows(df, length, hop).drop("n"), [*keys, "win"], ["x", "y"], length, arrays=True)
    want = plain.withColumns({f"envelope_{c}": spectra.envelope_energy()(c) for c in ("x", "y")}).drop("x", "y").toPandas()
    got, want = (d.sort_values(["asset_id", "win"]).reset_index(drop=True) for d in (got, want))
    cols = [f"{f}_{c}" for f in (*names, "envelope") for c in ("x", "y")]
    assert got[["asset_id", "win"]].equals(want[["asset_id", "win"]]) and got.k.isna().equals(want.k.isna())
    assert got.x.equals(want.x) if "x" in got else np.allclose(got[cols].to_numpy(float), want[cols].to_numpy(float), rtol=1e-9, equal_nan=True)
    whole = windowing.window_table(df.drop("n"), keys, ["x", "y"], length, hop, len(pdf), whole=True).toPandas().sort_values(["asset_id", "win"]).reset_index(drop=True)
    assert whole[["asset_id", "win", "n"]].equals(got[["asset_id", "win", "n"]]) and np.allclose(whole[cols].to_numpy(float), got[cols].to_numpy(float), equal_nan=True)


def test_window_table_exchanges_samples_once(spark):
    df = spark.createDataFrame(samples())
    plan = windowing.window_table(df, ["asset_id"], ["x", "y"], 16, 8, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Repartition") == 1


def test_scenarios_as_columns_and_as_rows(spark):
    from vigilspark.operators import perturb

    df, kinds = spark.createDataFrame(samples()), ("clean", "gain", "drift", "snr10")
    healthy = F.col("pos") < 5
    rows = perturb.all_scenarios(df, ["asset_id"], ["x", "y"], kinds, healthy).toPandas()
    assert len(rows) == 4 * len(samples())
    for kind in kinds:
        alone = perturb.scenario(df, ["asset_id"], ["x", "y"], kind, healthy).toPandas().sort_values(["asset_id", "pos"])
        own = rows[rows.kind == kind].sort_values(["asset_id", "pos"])
        assert np.allclose(own[["x", "y"]].to_numpy(), alone[["x", "y"]].to_numpy(), rtol=1e-12)


def test_leading_direction_takes_each_covariance_once(spark):
    from vigilspark.operators import directions

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3))
    out = directions.leading_direction(spark.createDataFrame([(1, *map(float, r)) for r in x], "k int, a double, b double, c double"), ["k"], ["a", "b", "c"])
    v = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1]
    assert np.allclose(np.abs(out.first()["pc"]), np.abs(v))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("covar_pop(") == 6


def test_ranks_of_short_series_need_no_ladder_however_many_rows_there_are(spark, monkeypatch):
    """The longest asset decides the form of its ranks, not the rows of the table."""
    import __spark_entry__ as entry
    from vigilspark.operators import ordered

    def ladder(*_):
        raise AssertionError("ranked as one long series")

    monkeypatch.setattr(ordered, "SAFE_GROUP", 200)
    monkeypatch.setattr(ordered, "_ladder", ladder)
    out = entry.queries()["healthy_fraction_ten_features"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 6 and sum(r.n_assets + r.n_short for r in out) == 30


def test_scenario_summaries_are_sized_by_the_assets_of_one_scenario(spark, monkeypatch):
    import __spark_entry__ as entry
    from vigilspark.operators import quality

    class Seen(Exception):
        pass

    def sized(criteria, keys, assets):
        raise Seen(assets.longest, assets.rows)

    monkeypatch.setattr(quality, "quality_table", sized)
    with pytest.raises(Seen) as seen:
        entry.queries()["robustness_table"](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (10, 60)
