"""Health index: NumPy references, edge cases, and the same result when groups are split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import composite, controls, directions, health, ordered, quality, weights
from vigilspark.operators.ordered import Extent

EXT = Extent(1000, 100)


def make(n_assets=8, d=3, seed=0, lengths=None):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(n_assets):
        n = (lengths or {}).get(a, 30 + 3 * a)
        base = rng.normal(size=(n, d)).cumsum(axis=0) * 0.3 + rng.normal(size=(n, d))
        for k in range(n):
            rows.append((f"d{a % 2}", a, k, n, *base[k]))
    return pd.DataFrame(rows, columns=["dataset", "asset_id", "pos", "n", *[f"f{i}" for i in range(d)]])


def ledoit_wolf(x):
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta2 = (s**2).sum()
    beta = ((x**2).T @ (x**2)).sum() / n - delta2
    beta /= n * p
    delta = (delta2 - 2 * mu * np.trace(s) + p * mu**2) / p
    shrink = 0.0 if beta == 0 else min(beta, delta) / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p), shrink


def reference(g, cols, frac=0.2):
    x = g[cols].to_numpy()
    n, d = x.shape
    nb = int(max(3.0 * d, frac * n))
    nb = int(min(max(nb, 5), max(n // 2, 5), n))
    b = x[:nb]
    q1, q2, q3 = np.percentile(b, [25, 50, 75], axis=0)
    z = (x - q2) / (q3 - q1 + 1e-9)
    base = z[:nb]
    dev = z - base.mean(axis=0)
    if nb < 3.0 * d:
        e = np.sqrt((dev**2 / (base.var(axis=0) + 1e-6)).sum(axis=1) + 1e-9)
    else:
        inv = np.linalg.pinv(ledoit_wolf(base)[0])
        e = np.sqrt(np.maximum(np.einsum("hi,ij,hj->h", dev, inv, dev), 0) + 1e-9)
    step = np.sqrt((np.diff(z, axis=0) ** 2).sum(axis=1) + 1e-9)
    c = np.concatenate([[step[0]] if len(step) else [0.0], step])
    return np.log1p(e), np.log1p(c)


@pytest.mark.parametrize("split", [False, True])
def test_components_match_numpy(spark, split, request):
    ext = request.getfixturevalue("split_groups") if split else EXT
    cols = ["f0", "f1", "f2"]
    pdf = make(lengths={0: 12, 1: 60, 2: 1, 3: 2})
    got = health.raw_components(spark.createDataFrame(pdf), ["asset_id"], cols, ext).toPandas()
    assert len(got) == len(pdf)
    for a, g in got.groupby("asset_id"):
        g = g.sort_values("pos")
        e, c = reference(pdf[pdf.asset_id == a], cols)
        assert np.allclose(g.E, e, atol=1e-7) and np.allclose(g.C, c, atol=1e-9), a
    kinds = got.groupby("asset_id").estimator.first()
    assert kinds[0] == "diagonal" and kinds[1] == "ledoit_wolf"


def spearman(a, b):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]


@pytest.mark.parametrize("split", [False, True])
def test_weight_scores_match_brute_force(spark, split, request):
    ext = request.getfixturevalue("split_groups") if split else EXT
    pdf = make(4, 2, 3, lengths={0: 1, 1: 2, 2: 37})
    pdf["f0"] = pdf.f0.clip(0, 1).round(1)
    grid = [(0.0, 1.0), (0.3, 0.7), (1.0, 0.0)]
    rows = spark.createDataFrame(pdf.assign(fold_id=0))
    got = weights.score_weights(rows, ["fold_id", "asset_id"], ["f0", "f1"], grid, ext).toPandas()
    assert len(got) == 4 * 3
    for (a, w), g in got.groupby(["asset_id", "w"]):
        s = pdf[pdf.asset_id == a]
        v = np.round(grid[w][0] * s.f0.to_numpy() + grid[w][1] * s.f1.to_numpy(), 9)
        n = len(v)
        d = np.diff(v)
        mono = abs((d > 0).sum() - (d < 0).sum()) / len(d) if len(d) else 0.0
        r = g.iloc[0]
        assert np.isclose(r.mono, mono)
        if n >= 3 and v.std() >= 1e-12:
            assert np.isclose(r.rho, spearman(v, np.arange(n))) and np.isclose(r.trend, abs(np.corrcoef(v, np.arange(n))[0, 1]))
        else:
            assert r.rho == 0 and r.trend == 0
        assert r.first_value == v[0] and r.last_value == v[-1]


def test_fit_is_the_same_when_groups_are_split(spark, split_groups):
    pdf = make(10, 2, 7)
    comp = health.raw_components(spark.createDataFrame(pdf), ["asset_id"], ["f0", "f1"], split_groups, estimator="diagonal").persist()
    a = health.fit_index(comp, 3, split_groups).toPandas().sort_values("fold_id").reset_index(drop=True)
    from vigilspark.operators import ordered

    ordered.SAFE_GROUP, weights.SAFE_GROUP = 1 << 20, 1 << 20
    b = health.fit_index(comp, 3, EXT).toPandas().sort_values("fold_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], atol=1e-9)


def test_held_out_assets_do_not_move_the_fit(spark):
    pdf = make(10, 2, 7)
    changed = pdf.copy()
    changed.loc[changed.asset_id % 5 == 0, ["f0", "f1"]] *= 50.0
    fits = []
    for p in (pdf, changed):
        comp = health.raw_components(spark.createDataFrame(p), ["asset_id"], ["f0", "f1"], EXT, estimator="diagonal")
        fits.append(health.fit_index(comp, 5, EXT).where("fold_id = 0").toPandas())
    pd.testing.assert_frame_equal(*fits)


def test_quality_of_monotone_and_constant_series(spark):
    rows = [("up", k, 10, float(k)) for k in range(10)] + [("flat", k, 10, 1.0) for k in range(10)] + [("one", 0, 1, 3.0)]
    df = spark.createDataFrame(rows, "asset_id string, pos long, n long, v double")
    got = quality.asset_criteria(df, ["asset_id"], "v", EXT).toPandas().set_index("asset_id")
    assert got.loc["up", "monotonicity"] == 1 and np.isclose(got.loc["up", "rho"], 1) and np.isclose(got.loc["up", "trendability"], 1)
    for name in ("flat", "one"):
        assert got.loc[name, ["monotonicity", "rho", "trendability"]].eq(0).all()
    assert got.loc["flat", "n_tie"] == 9


def test_shuffle_keeps_the_multiset(spark, split_groups):
    pdf = make(3, 1, 2)
    df = spark.createDataFrame(pdf)
    got = controls.shuffled(df, ["asset_id"], "f0", "s", split_groups).toPandas()
    assert len(got) == len(pdf)
    for _, g in got.groupby("asset_id"):
        assert sorted(g.f0) == sorted(g.s) and not (g.sort_values("pos").f0.to_numpy() == g.sort_values("pos").s.to_numpy()).all()


def test_ablation_is_null_when_nothing_is_left(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.5, 0.2, 0.1)], "wE double, wC double, wG double, E_norm double, C_norm double, G_norm double")
    r = df.select(composite.without_component("E").alias("e"), composite.without_component("C").alias("c"), composite.without_component("G", False).alias("g")).first()
    assert r.e is None and r.c == 0.5 and r.g is None


def test_search_beats_its_own_random_start(spark):
    pdf = make(8, 3, 4)
    rows = health.assign_roles(spark.createDataFrame(pdf), 2).where("role != 'test'").withColumn("role", F.lit("train"))
    std = directions.standardise_by_fold(rows, rows, ["f0", "f1", "f2"]).persist()
    cols = ["s_f0", "s_f1", "s_f2"]
    start = directions.linear_parameter_fitness(std, cols, directions.random_directions(40, 3), EXT).groupBy("fold_id").agg(F.max("fitness").alias("f")).toPandas().set_index("fold_id").f.sort_index()
    best = directions.best_linear_parameter(std, cols, EXT, candidates=40, rounds=3).toPandas().set_index("fold_id").sort_index()
    assert (best.fitness >= start - 1e-12).all()
    assert np.allclose(best.weights.map(lambda w: np.linalg.norm(w)), 1.0)


def test_folds_of_one_dataset_ignore_the_other(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame([(a, p, 12, float(rng.random()), float(rng.random())) for a in range(12) for p in range(12)], columns=["asset_id", "pos", "n", "E", "C"])
    other = pdf.assign(E=pdf.E.where(pdf.asset_id % 2 == 0, pdf.E * 100 + 7))

    def fitted(frame):
        out = health.fit_index(spark.createDataFrame(frame), 3, Extent(1000, 200), dataset=F.pmod("asset_id", F.lit(2)))
        return out.toPandas().sort_values("fold_id").set_index("fold_id")

    a, b = fitted(pdf), fitted(other)
    assert list(a.index) == [0, 1, 2, 3, 4, 5]
    assert a.loc[:2].equals(b.loc[:2])
    assert (a.loc[3:, "E_hi"] != b.loc[3:, "E_hi"]).all()


def test_settings_share_the_components_of_their_baseline_fraction(spark, monkeypatch):
    """Five settings with three baseline fractions ask for components three times, from one stored series."""
    from vigilspark.plans import sensitivity_queries as plans

    asked = []

    def made(spark, folder, estimator, runs, fraction):
        asked.append((fraction, id(runs[0])))
        return runs

    def fitted(comp, *args, **options):
        raise StopIteration

    monkeypatch.setattr(plans, "event_components", made)
    monkeypatch.setattr(plans.health, "fit_index", fitted)
    with pytest.raises(StopIteration):
        plans.index_sensitivity(spark, "/root/testdata/sf0.001")
    assert [f for f, _ in asked] == [0.1, 0.2, 0.3] and len({s for _, s in asked}) == 1


@pytest.mark.parametrize("kind", ["plain", "ties", "gaps", "missing"])
def test_series_are_judged_in_blocks_as_one_by_one(spark, monkeypatch, kind):
    """Many short series share an Arrow group and no window sorts them; values equal those of the distributed form."""
    rng = np.random.default_rng(8)
    rows = []
    for a, n in enumerate([1, 2, 3, *rng.integers(4, 30, 30).tolist()]):
        for p in range(n):
            v = float(rng.integers(0, 4)) if kind == "ties" else float(rng.random())
            v = None if kind == "missing" and rng.random() < 0.3 else 700.3 if a == 7 else v + 1e-10 * p if a == 9 else v
            rows.append((["x", "y", None][a % 3], a if a != 12 else None, 2 * p if kind == "gaps" else p, v))
    df = spark.createDataFrame(rows, "indicator string, asset_id long, pos long, v double")
    keys = ["indicator", "asset_id"]
    short = quality.asset_criteria(df, keys, "v", Extent(len(rows), 60, 33))
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    short = short.toPandas().sort_values(keys).reset_index(drop=True)
    monkeypatch.setattr(ordered, "SAFE_GROUP", 4)
    monkeypatch.setattr(ordered, "CHUNK", 8)
    long = quality.asset_criteria(df, keys, "v", Extent(10_000, 10_000)).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(short, long[short.columns], rtol=1e-7, atol=1e-9)
