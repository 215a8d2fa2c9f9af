"""Histogram trees: planted signals, partitionings, bounds on what is learned from, kernel machines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import regress, trees

FEATURES = ["a", "b", "c"]


def table(n=3000, assets=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.clip(0.5 + 0.3 * np.sign(x[:, 0]) * (x[:, 1] > 0) + 0.05 * rng.normal(size=n), 0, 1)
    return [(int(k % assets), int(k // assets), *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(table(), "asset_id long, pos long, a double, b double, c double, y double")


@pytest.mark.parametrize("kind,n", [("boosted", 60), ("forest", 30)])
def test_trees_find_a_planted_signal_on_any_partitioning(spark, planted, kind, n):
    got = []
    for parts in (1, 8):
        out = regress.tree_predictions(planted.repartition(parts), FEATURES, "y", 5, kind, n).orderBy("asset_id", "pos")
        got.append(np.array([(r.asset_id, r.pos, r.fold_id, r.y, r.y_pred) for r in out.collect()]))
    assert np.array_equal(*got) and len(got[0]) == 3000 and (got[0][:, 2] == got[0][:, 0] % 5).all()
    y, p = got[0][:, 3], got[0][:, 4]
    mean_error = np.abs(y - y.mean()).mean()
    assert np.abs(y - p).mean() < 0.4 * mean_error


def test_held_out_rows_do_not_teach(spark, planted):
    changed = planted.withColumn("y", F.when(F.col("asset_id") % 5 == 2, 0.0).otherwise(F.col("y")))
    for frame in (planted, changed):
        out = regress.tree_predictions(frame, FEATURES, "y", 5, "boosted", 20).where("fold_id = 2").orderBy("asset_id", "pos")
        seen = [r.y_pred for r in out.collect()]
        if frame is planted:
            first = seen
    assert first == seen


def test_what_is_learned_from_is_bounded(spark, planted, monkeypatch):
    whole = trees.learn_from(planted.withColumn("fold", F.col("asset_id") % 5), FEATURES, "y", "fold")
    assert len(whole.target) == 3000 and whole.codes.max() < trees.BINS
    monkeypatch.setattr(trees, "FIT_ROWS", 500)
    some = trees.learn_from(planted.withColumn("fold", F.col("asset_id") % 5), FEATURES, "y", "fold")
    assert 400 < len(some.target) < 600
    again = trees.learn_from(planted.repartition(7).withColumn("fold", F.col("asset_id") % 5), FEATURES, "y", "fold")
    assert np.array_equal(some.codes, again.codes) and np.array_equal(some.target, again.target)
    assert regress.tree_predictions(planted, FEATURES, "y", 5, "boosted", 10).count() == 3000


def test_an_unpruned_tree_repeats_what_it_saw():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 100, (400, 3)).astype(np.uint8)
    y = rng.random(400)
    grower = trees._Grower()
    trees._forest_tree(grower, codes, y, np.ones(400))
    own = grower.done()
    _, place = np.unique(codes, axis=0, return_inverse=True)
    mean = np.bincount(place, y) / np.bincount(place)
    assert np.allclose(own.predict(codes), mean[place], atol=1e-6)


def test_the_first_split_of_a_boosted_tree_equals_search():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 20, (300, 2)).astype(np.uint8)
    y = (codes[:, 1] > 7) * 1.0 + rng.normal(0, 0.1, 300)
    _, own = trees.boost(codes, y, 1, 1, 1.0, 1.0, 1.0, False, [1])
    g = y.mean() - y
    gain = {(f, c): g[codes[:, f] <= c].sum() ** 2 / ((codes[:, f] <= c).sum() + 1) + g[codes[:, f] > c].sum() ** 2 / ((codes[:, f] > c).sum() + 1) for f in (0, 1) for c in range(19)}
    assert (own.feature[0], own.cut[0]) == max(gain, key=gain.get)
    left = codes[:, own.feature[0]] <= own.cut[0]
    assert np.isclose(own.value[1], -g[left].sum() / (left.sum() + 1), rtol=1e-5)


def test_missing_features_and_targets(spark):
    rows = [(k, 0, None if k % 7 == 0 else float(k), 1.0, 2.0, None if k % 5 == 0 else float(k > 20)) for k in range(60)]
    frame = spark.createDataFrame(rows, "asset_id long, pos long, a double, b double, c double, y double")
    out = regress.tree_predictions(frame, FEATURES, "y", 3, "forest", 5)
    assert out.count() == 60 and out.where("y_pred IS NULL").count() == 0
    assert regress.tree_predictions(frame.limit(0), FEATURES, "y", 3, "boosted", 5).count() == 0


@pytest.mark.parametrize("kind", ["forest", "boosted", "kernel"])
def test_chronological_models_on_a_ring(spark, kind):
    """A ring around a disc: no line parts them, a kernel and trees do."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 2))
    ring = (np.hypot(x[:, 0], x[:, 1]) > 1.1).astype(int)
    rows = [(0, k, float(a), float(b), int(r), float(0.2 + 0.6 * r), "train" if k < 900 else "test") for k, ((a, b), r) in enumerate(zip(x, ring))]
    frame = spark.createDataFrame(rows, "asset_id long, pos long, a double, b double, stage int, rul double, role string")
    out = regress.chronological_models(frame, ["a", "b"], "stage", "rul", kind, 40).toPandas()
    assert len(out) == 600
    assert (out["stage"] == out["stage_pred"]).mean() > 0.93 and np.abs(out["rul"] - out["target_pred"]).mean() < (0.15 if kind == "kernel" else 0.1)
    one = regress.chronological_models(frame.withColumn("stage", F.lit(1)), ["a", "b"], "stage", "rul", kind, 5).toPandas()
    assert one["stage_pred"].isna().all() and one["target_pred"].notna().all()


def test_every_model_is_fitted_once(spark, planted):
    """A sort behind the fit samples its input first and so fits everything twice."""
    data = trees.learn_from(planted.withColumn("fold", F.col("asset_id") % 5), FEATURES, "y", "fold")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit-once", "fit")
    try:
        models = trees.fit(spark, data, {f: [f] for f in range(3)}, "forest", 5)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("fit-once")]
    assert sorted(models) == [0, 1, 2] and len(jobs) == 1
    assert [tracker.getStageInfo(s).numTasks for s in jobs[0].stageIds] == [3]


def test_prediction_and_growth_equal_a_plain_walk():
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 100, (9000, 3)).astype(np.uint8)
    own = trees.forest(codes[:500], rng.random(500), 4, [3])
    want = np.zeros(len(codes))
    for root in own.root:
        for k, row in enumerate(codes):
            node = root
            while own.feature[node] >= 0:
                node = own.left[node] + (row[own.feature[node]] > own.cut[node])
            want[k] += own.value[node]
    assert np.array_equal(own.predict(codes), want)
    grower = trees._Grower()
    root = grower.node()
    kids = grower.split_all(np.array([root]), np.array([2]), np.array([7]))
    assert kids.tolist() == [1, 2] and (grower.left[0], grower.feature[0], grower.cut[0], len(grower.value)) == (1, 2, 7, 3)


def test_queries_learn_from_every_row(spark, planted, monkeypatch):
    def both():
        out = [regress.tree_predictions(planted, FEATURES, "y", 5, kind, 10).orderBy("asset_id", "pos").collect() for kind in ("forest", "boosted")]
        rows = planted.withColumns({"role": F.when(F.col("pos") < 100, "train").otherwise("test"), "stage": (F.col("y") > 0.5).cast("int")})
        return [*out, regress.chronological_models(rows, FEATURES, "stage", "y", "forest", 10).orderBy("asset_id", "pos").collect()]

    want = both()
    monkeypatch.setattr(trees, "FIT_ROWS", 500)
    assert both() == want and len(want[0]) == 3000 and len(want[2]) == 1000
    whole = trees.learn_from(planted.withColumn("fold", F.col("asset_id") % 5), FEATURES, "y", "fold", whole=True)
    assert len(whole.target) == 3000 and whole.rows.count() == 3000


def test_a_forest_tree_draws_as_many_rows_as_there_are():
    rng = np.random.default_rng(13)
    codes = np.stack([np.arange(30_000) // 300, np.arange(30_000) % 300 // 3, np.arange(30_000) % 3], axis=1).astype(np.uint8)
    own = trees.forest(codes, rng.random(30_000), 1, [1])
    # 1 - 1/e of the rows are drawn, each a leaf of its own
    assert abs((own.feature < 0).sum() - 30_000 * (1 - np.exp(-1))) < 300


def test_large_nodes_are_cut_like_small_ones(monkeypatch):
    rng = np.random.default_rng(17)
    codes = rng.integers(0, 100, (4000, 3)).astype(np.uint8)
    y = np.round(rng.random(4000), 3)
    assert trees.NODE_ROWS > len(codes)
    want = trees.forest(codes, y, 3, [5]).predict(codes)
    monkeypatch.setattr(trees, "NODE_ROWS", 100)
    got = trees.forest(codes, y, 3, [5]).predict(codes)
    # equally good cuts of two or three rows may be told apart by the last digit
    assert (np.abs(got - want) > 1e-6).mean() < 0.03


@pytest.mark.parametrize("parts", [1, 7])
def test_cuts_of_scattered_rows_are_exact(spark, monkeypatch, parts):
    rng = np.random.default_rng(19)
    x = np.column_stack([rng.normal(size=4000), np.round(rng.normal(size=4000), 1), rng.integers(0, 5, 4000), np.full(4000, np.nan), np.where(rng.random(4000) < 0.9, 1.5, rng.random(4000))])
    x[::9, 0] = np.nan
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double").repartition(parts)
    monkeypatch.setattr(trees, "EDGES", trees.BINS)  # fewer could not tell whether a task has told every value
    monkeypatch.setattr(trees, "TASK_VALUES", 500)
    for got, v in zip(trees.exact_cuts(frame, "abcde"), x.T):
        assert np.array_equal(got, trees.cuts_of(v[~np.isnan(v)]))
    assert [len(c) for c in trees.exact_cuts(frame.limit(0), "ab")] == [0, 0]
