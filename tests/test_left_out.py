"""Dealt groups, the guard inside a fit, quantiles by subtraction, scores of series that go out once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import folds, health, ordered, weights
from vigilspark.operators.ordered import Extent

EXT = Extent(10_000, 100, 100)


def test_groups_are_dealt_whole_and_evenly(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{k % 2}", k, int(rng.zipf(1.6) % 500 + 1)) for k in range(80)]
    got = folds.deal_groups(spark.createDataFrame(rows, "dataset string, grp long, size long"), 4, EXT).toPandas()
    assert len(got) == 80 and got.groupby("dataset")["bucket"].value_counts().unique().tolist() == [10]
    sizes = {(d, g): n for d, g, n in rows}
    for d, own in got.groupby("dataset"):
        order = sorted(own["grp"], key=lambda g: (-sizes[d, g], g))
        want = {g: (r % 4 if r // 4 % 2 == 0 else 3 - r % 4) for r, g in enumerate(order)}
        assert dict(zip(own["grp"], own["bucket"])) == want


@pytest.fixture(scope="module")
def components(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{a % 2}", a // 4, (a // 4) % 3, a, p, 40, float(rng.normal(a % 5, 1 + p / 20)), float(np.round(rng.exponential(), 1))) for a in range(36) for p in range(40)]
    return spark.createDataFrame(rows, "dataset string, grp long, bucket int, asset_id long, pos long, n long, E double, C double").cache()


def test_a_group_in_two_buckets_stops_the_fit(spark, components):
    assert health.fit_index(components, 3, EXT, dataset=F.pmod("asset_id", F.lit(2))).count() == 6
    torn = components.withColumn("bucket", F.when(F.col("asset_id") == 8, (F.col("bucket") + 1) % 3).otherwise(F.col("bucket")).cast("int"))
    with pytest.raises(Exception, match="leakage: 1 groups"):
        health.fit_index(torn, 3, EXT, dataset=F.pmod("asset_id", F.lit(2))).collect()
    with pytest.raises(Exception, match="leakage"):
        health.guarded(spark.range(1), torn).collect()


def test_quantiles_without_units_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(p, u, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1 + p)), float(rng.random())) for p in range(2) for u in range(7) for _ in range(40)]
    rows += [(0, 0, 0.5, 0.5)] * 300 + [(1, None, 9.0, None)] * 5 + [(0, 3, float("nan"), 1.0)]
    frame = spark.createDataFrame(rows, "pool int, unit int, v double, w double").repartition(5)
    asked = [(0, "a", [0, 1]), (0, "b", [2]), (0, "c", []), (1, "a", [5, 5, 99]), (1, "d", list(range(7))), (2, "e", [1])]
    requests = spark.createDataFrame(asked, "pool int, name string, without array<int>")
    wanted = {"q1": ("v", 0.1), "q2": ("v", 0.5), "q3": ("w", 0.99), "q4": ("w", 0.0), "q5": ("v", 1.0)}
    got = {(r.pool, r.name): r for r in ordered.quantiles_without(frame, ["pool"], "unit", wanted, requests).collect()}
    assert len(got) == len(asked)
    own = pd.DataFrame(rows, columns=["pool", "unit", "v", "w"])
    for pool, name, gone in asked:
        some = own[(own["pool"] == pool) & ~own["unit"].isin(gone)]
        for new, (c, p) in wanted.items():
            x = np.array([r[2 if c == "v" else 3] for r in rows if r[0] == pool and r[1] not in gone and r[2 if c == "v" else 3] is not None])
            value = got[pool, name][new]
            if not len(x):
                assert value is None and (c == "w" or not len(some.dropna(subset=["v"])))
                continue
            x = np.sort(x)  # NaN last, as the largest value
            at = p * (len(x) - 1)
            lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
            want = lo + (hi - lo) * (at - np.floor(at))
            assert np.isclose(value, want, equal_nan=True)


def test_no_request_and_no_row(spark):
    frame = spark.createDataFrame([], "pool int, unit int, v double")
    requests = spark.createDataFrame([(0, "a", [1])], "pool int, name string, without array<int>")
    assert [tuple(r) for r in ordered.quantiles_without(frame, ["pool"], "unit", {"q": ("v", 0.5)}, requests).collect()] == [(0, "a", None)]
    assert ordered.quantiles_without(frame, ["pool"], "unit", {"q": ("v", 0.5)}, requests.limit(0)).count() == 0


@pytest.mark.parametrize("safe", [1 << 20, 10])
def test_scaled_scores_equal_scores_of_copied_rows(spark, components, monkeypatch, safe):
    rows = health.assign_roles(components, 3, "bucket").where("role = 'train'")
    bounds = health.train_bounds(rows, EXT)
    grid = [(0.0, 1.0), (0.3, 0.7), (1.0, 0.0)]
    want = weights.score_weights(health.scale_by_fold(rows, bounds), ["fold_id", "asset_id"], ["E_norm", "C_norm"], grid, EXT).toPandas()
    monkeypatch.setattr(ordered, "SAFE_GROUP", safe)
    monkeypatch.setattr(weights, "SAFE_GROUP", safe)
    uses = rows.select("fold_id", "asset_id").distinct().join(bounds, "fold_id")
    got = weights.score_scaled(components, uses, grid, EXT).toPandas()
    key = ["fold_id", "asset_id", "w"]
    want, got = (x.sort_values(key).reset_index(drop=True)[[*key, *weights.SCORES]] for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-8)


def test_bounds_by_subtraction_equal_bounds_of_training_rows(components):
    want = health.train_bounds(health.training_rows(components, 3, "bucket", F.pmod("asset_id", F.lit(2))), EXT).orderBy("fold_id").toPandas()
    got = health.fold_bounds(components, 3, F.pmod("asset_id", F.lit(2))).orderBy("fold_id").toPandas()
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)


def test_leave_one_out_plan_copies_no_rows(components):
    left = components.select("dataset", "grp").distinct().select("dataset", F.concat_ws("/", "dataset", "grp").alias("fold_id"), F.array("grp").alias("without"))
    fitted = health.fit_left_out(components, left, EXT, steps=5).toPandas()
    assert len(fitted) == 18 and (fitted["n_train"] == 16).all()
    one = components.where("dataset = 'd0' AND grp <> 4").withColumn("fold_id", F.lit(0))
    want = health.fit_on(one, EXT).collect()[0]
    own = fitted[fitted["fold_id"] == "d0/4"].iloc[0]
    assert np.isclose(own["E_hi"], want.E_hi) and np.isclose(own["C_lo"], want.C_lo)


def test_criteria_and_weight_scores_agree_on_missing_values(spark):
    from vigilspark.operators import quality

    rng = np.random.default_rng(9)
    rows = [(0, a, p, 24, None if (p * 7 + a) % 4 == 0 else float(rng.random()), 0.0) for a in range(3) for p in range(24)]
    frame = spark.createDataFrame(rows, "fold_id int, asset_id long, pos long, n long, u double, v double")
    crit = quality.asset_criteria(frame, ["asset_id"], "u", EXT).orderBy("asset_id").toPandas()
    got = weights.score_weights(frame, ["fold_id", "asset_id"], ["u", "v"], [(1.0, 1.0)], EXT).orderBy("asset_id").toPandas()
    assert (crit["n"] == 18).all()
    for a, b in (("monotonicity", "mono"), ("rho", "rho"), ("trendability", "trend"), ("first_value", "first_value"), ("last_value", "last_value")):
        assert np.allclose(crit[a], got[b], atol=1e-8)


def test_left_out_sums_equal_scores_of_every_fold_and_asset(spark, components, monkeypatch):
    left = spark.createDataFrame([("d0", "a", [0, 1]), ("d0", "b", [2]), ("d1", "c", [0])], "dataset string, fold_id string, without array<long>")
    wanted = {"E_lo": ("E", 0.01), "E_hi": ("E", 0.99), "C_lo": ("C", 0.01), "C_hi": ("C", 0.99)}
    bounds = ordered.quantiles_without(components, ["dataset"], "grp", wanted, left).where("E_lo IS NOT NULL")
    asked = left.join(bounds, ["dataset", "fold_id"])
    grid = [(0.0, 1.0), (0.4, 0.6), (1.0, 0.0)]
    monkeypatch.setattr(weights, "SERIES_BLOCK", 2)
    monkeypatch.setattr(weights, "FOLD_BLOCK", 1)
    groups = components.select("asset_id").distinct().count()
    sums = weights.mean_left_out(components, asked, grid, ordered.Extent(EXT.rows, EXT.longest, groups), "dataset", "grp")
    got = {(r.fold_id, r.w): (r.n, r.s) for r in sums.groupBy("fold_id", "w").agg(F.sum("_n").alias("n"), F.sum("_sum").alias("s")).collect()}
    uses = components.select("dataset", "grp", "asset_id").distinct().join(asked, "dataset").where(~F.array_contains("without", F.col("grp")))
    each = weights.score_scaled(components, uses.drop("dataset", "grp", "without"), grid, EXT)
    want = {(r.fold_id, r.w): (r.n, r.s) for r in each.groupBy("fold_id", "w").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mono") + F.col("rho")).alias("s")).collect()}
    assert got and set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_series_are_scored_in_blocks_and_ties_share_their_rank(spark):
    """Many short series go to one Arrow group; ranks of rounded values equal pandas' mean ranks."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 12, 300)
    rows = [(int(k), int(p), int(n), float(rng.integers(0, 4)) / 3, float(rng.integers(0, 3)) / 2) for k, n in enumerate(lengths) for p in range(n)]
    frame = spark.createDataFrame(rows, "asset_id long, pos long, n long, E double, C double")
    uses = spark.createDataFrame([(f, k, 0.1, 0.9, 0.0, 1.0) for f in (0, 1) for k in range(f, 300, 2 - f)], "fold_id int, asset_id long, E_lo double, E_hi double, C_lo double, C_hi double")
    out = weights.score_scaled(frame, uses, [(0.3, 0.7), (1.0, 0.0)], Extent(len(rows), 11, 300))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [_s" in plan
    got = {(r.fold_id, r.asset_id, r.w): r for r in out.collect()}
    assert len(got) == 2 * uses.count()
    own = pd.DataFrame(rows, columns=["asset_id", "pos", "n", "E", "C"])
    for asset in (1, 5, 17, 298):
        s = own[own.asset_id == asset].sort_values("pos")
        e = np.clip((s.E - 0.1) / (0.8 + 1e-9), 0, 1)
        v = (0.3 * e + 0.7 * np.clip(s.C / (1 + 1e-9), 0, 1)).round(9)
        rho = np.corrcoef(v.rank(), s.pos)[0, 1] if len(v) >= 3 and v.std(ddof=0) >= 1e-12 else 0.0
        mono = abs(np.sign(v.diff().round(9)).sum()) / (len(v) - 1) if len(v) > 1 else 0.0
        row = got[(1, asset, 0)]
        assert np.isclose(row.rho, rho, atol=1e-12) and np.isclose(row.mono, mono, atol=1e-12)


def test_values_without_room_beside_a_place_are_ranked_all_the_same():
    x = np.array([[1e9, 3e9, 2e9, 2e9, 5e9]])
    got = weights.score_series(x, np.array([[1.0], [1e-9], [-1.0]]))
    ranks = np.array([1, 4, 2.5, 2.5, 5])
    rho = np.corrcoef(ranks, np.arange(5))[0, 1]
    assert np.allclose(got["rho"], [rho, rho, -rho]) and np.allclose(got["mono"], 0.25)


def test_weights_of_many_series_are_scored_in_blocks(spark):
    """Also without known groups no block takes all rows, and a NULL in the first key keeps its own series."""
    assert weights._blocks(Extent(10 * weights.SAFE_GROUP, 50)) == 10 and weights._blocks(Extent(6000, 60, 300)) == 3
    rows = [(None if k % 3 == 0 else k % 3, k, p, 4, float((p * 7 + k) % 5), 1.0) for k in range(60) for p in range(4)]
    frame = spark.createDataFrame(rows, "fold_id int, asset_id long, pos long, n long, u double, v double")
    out = weights.score_weights(frame, ["fold_id", "asset_id"], ["u", "v"], [(1.0, 0.0), (0.5, 0.5)], Extent(240, 4, 60))
    assert "FlatMapGroupsInPandas [_s" in out._jdf.queryExecution().executedPlan().toString()
    got = out.where("w = 0").toPandas()
    assert len(got) == 60 and got["fold_id"].isna().sum() == 20
    for r in got.itertuples():
        x = [float((p * 7 + r.asset_id) % 5) for p in range(4)]
        assert (r.first_value, r.last_value) == (x[0], x[-1]) and np.isclose(r.mono, abs(np.sign(np.diff(x)).sum()) / 3)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 17, 66, 150])
def test_fitness_of_many_folds_equals_ranks_of_every_fold(monkeypatch, n):
    """Clipped rows, equal rows, rounding to ties and whole numbers, against the sort of every fold and weight."""
    rng = np.random.default_rng(n)
    table = np.array([(round(k / 100, 6), 1.0 - round(k / 100, 6)) for k in range(101)])
    ranked = [0]
    plain = weights.criteria
    for case in range(12):
        x = rng.random((2, n))
        x[1, :2] = x[1, 0]
        if case % 4 == 1:
            x = np.round(x, 1)
        if case % 4 == 2:
            x = 0.5 + np.round(x, 1) * 1e-8 + (rng.random((2, n)) > 0.7)
        lo = np.column_stack([0.05 + 0.01 * rng.random(6), 0.04 + 0.01 * rng.random(6)])
        hi = np.column_stack([0.9 + 0.05 * rng.random(6), 0.9 + 0.05 * rng.random(6)])
        if case % 4 == 3:
            hi -= 0.6
        for mono_only in (False, True):
            want = []
            for f in range(6):
                got = weights.score_series(np.clip((x - lo[f][:, None]) / (hi[f] - lo[f] + weights.EPS)[:, None], 0, 1), table, trend=False)
                want.append(got["mono"] if mono_only else got["mono"] + got["rho"])
            monkeypatch.setattr(weights, "criteria", lambda v, trend=True: ranked.append(len(v)) or plain(v, trend))
            assert np.allclose(weights.fitness_of_folds(x, lo, hi, table, mono_only), want, rtol=0, atol=1e-12)
            if case % 4 == 0 and n > 2:
                assert sum(ranked) < 6 * 30
            monkeypatch.setattr(weights, "criteria", plain)
            ranked.clear()


def test_conditioning_rows_are_exchanged_before_there_is_one_per_fold(spark, components):
    from vigilspark.operators import controls

    rows = components.withColumns({"x": F.col("E"), "y": F.col("C")})
    out = controls.conditioning_table(rows, ["x", "y"], 3, EXT, dataset=F.pmod("asset_id", F.lit(2)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset_id" in plan and "hashpartitioning(fold_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(fold_id" in line and "asset_id" in line]
    assert out.count() == 3 * 36 * 40


def test_both_forms_of_the_shuffle_agree(spark, components):
    from vigilspark.operators import controls

    got = []
    for ext in (EXT, Extent(10_000, 1 << 21)):
        out = controls.shuffled(components.select("dataset", "asset_id", "pos", "E"), ["dataset", "asset_id"], "E", "s", ext)
        got.append(sorted(map(tuple, out.select("dataset", "asset_id", "pos", "E", "s").collect())))
    assert got[0] == got[1] and len(got[0]) == 36 * 40
