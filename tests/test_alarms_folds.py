"""Alarms, labels, folds and splits against loops, including groups that are split over tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import alarms, errors, folds, health, joins, labels
from vigilspark.operators.ordered import Extent

EXT = Extent(1000, 200)


def series(seed=1, lengths=(45, 9, 3, 2, 1)):
    rng = np.random.default_rng(seed)
    rows = [(a, k, n, float(rng.random() ** 0.5)) for a, n in enumerate(lengths) for k in range(n)]
    return pd.DataFrame(rows, columns=["asset_id", "pos", "n", "v"])


def loop_flags(v, tau, q, back_fill):
    out, run = np.zeros(len(v), int), 0
    for i, x in enumerate(v):
        run = run + 1 if x > tau else 0
        if run >= q:
            if back_fill:
                out[i - q + 1 : i + 1] = 1
            else:
                out[i] = 1
    return out


@pytest.mark.parametrize("split", [False, True])
def test_flags_and_first(spark, split, request):
    ext = request.getfixturevalue("split_groups") if split else EXT
    pdf = series()
    df = spark.createDataFrame(pdf)
    for back in (True, False):
        got = alarms.persistent_flags(df, ["asset_id"], "v", F.lit(0.5), ext, back_fill=back).toPandas()
        assert len(got) == len(pdf)
        for a, g in got.groupby("asset_id"):
            g = g.sort_values("pos")
            assert (g.flag.to_numpy() == loop_flags(g.v.to_numpy(), 0.5, 3, back)).all()
    first = alarms.first_persistent(alarms.with_run_minimum(df, ["asset_id"], "v", ext), ["asset_id"], F.lit(0.5)).toPandas()
    for r in first.itertuples():
        f = loop_flags(pdf[pdf.asset_id == r.asset_id].v.to_numpy(), 0.5, 3, True)
        assert r.first == (int(np.argmax(f)) if f.any() else -1)


def test_alarm_scores_closed_form(spark):
    rows = [(f, n, o) for n in (1, 5, 12) for o in range(1, n + 1) for f in range(-1, n)]
    got = alarms.alarm_scores(spark.createDataFrame(rows, "first long, n long, o long"), F.col("o")).toPandas()
    for r in got.itertuples():
        if r.first < 0:
            assert r.precision == r.recall == 0 and r.lead != r.lead
            continue
        pred, true = np.zeros(r.n, bool), np.zeros(r.n, bool)
        pred[r.first :], true[r.o :] = True, True
        tp = (pred & true).sum()
        assert np.isclose(r.precision, tp / max(pred.sum(), 1)) and np.isclose(r.recall, tp / max(true.sum(), 1)) and r.lead == r.o - r.first


def test_labels_edges(spark):
    df = spark.createDataFrame(series(lengths=(1, 2, 21)))
    got = labels.label_table(df, ["asset_id"], "v", EXT, F.lit(3600.0)).toPandas()
    one = got[got.asset_id == 0].iloc[0]
    assert one.H_fail == 1 and one.rul == 1 and one.deg == 0
    g = got[got.asset_id == 2].sort_values("pos")
    assert g.rul.iloc[-1] == 0 and g.deg.iloc[-1] == 1 and g.stage_time.iloc[-1] == 3
    assert np.allclose(g.rul_capped, np.minimum(1, (20 - g.pos) / 12.0)) and np.allclose(g.life_hours, 20)


def loop_folds(names, group):
    names = sorted(names)
    out = {}
    for i, ho in enumerate(names):
        val = next((names[(i + k) % len(names)] for k in range(1, len(names)) if group[names[(i + k) % len(names)]] != group[ho]), None)
        out[ho] = (val, sum(group[x] not in (group[ho], group[val] if val else None) for x in names))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_leave_one_out(spark, split, request):
    ext = request.getfixturevalue("split_groups") if split else EXT
    for names in (
        ["Test1_Bearing3", "Test1_Bearing4", "Test2_Bearing1", "Bearing9_9"],
        ["Test1_Bearing1", "Test2_Bearing1", "Test2_Bearing2", "Test1_Bearing5"],
        [f"Test{g}_Bearing{i}" for i, g in enumerate([1, 1, 2, 2, 2, 3, 1, 1, 3, 3, 2, 1])] + ["Learning_set_Bearing1_1", "B2"],
    ):
        man = spark.createDataFrame([("d", n, 20) for n in names], "dataset string, asset string, n_snapshots long")
        got = folds.leave_one_out(man, ext).toPandas()
        keys = spark.createDataFrame([(n,) for n in names], "asset string").select("asset", folds.group_key(F.col("asset")).alias("g")).toPandas()
        want = loop_folds(names, dict(zip(keys.asset, keys.g)))
        assert len(got) == len(names)
        for r in got.itertuples():
            assert (r.val, r.n_train) == want[r.holdout]


def test_identity_and_dedup(spark):
    man = spark.createDataFrame(
        [("p", 1, "Full_Test_Set_Bearing1_3", 50), ("p", 2, "Test_set_Bearing1_3", 90), ("p", 3, "Learning_set_Bearing1_1", 10), ("p", 4, "35Hz12kN_Bearing1_1", 10)],
        "dataset string, asset_id long, asset string, n_snapshots long",
    )
    kept = {r.asset for r in folds.deduplicate(man).collect()}
    assert kept == {"Full_Test_Set_Bearing1_3", "Learning_set_Bearing1_1", "35Hz12kN_Bearing1_1"}
    assert folds.duplicate_audit(man).first().copies == 2
    with pytest.raises(ValueError):
        folds.require_groups(man.where("asset_id <= 2"))
    folds.require_groups(man)


def test_leakage_guard(spark):
    rows = spark.createDataFrame([(a, a // 2) for a in range(10)], "asset_id long, grp long")
    clean = health.assign_roles(rows, 5, "grp")
    folds.require_no_leakage(clean)
    with pytest.raises(ValueError):
        folds.require_no_leakage(health.assign_roles(rows, 5, "asset_id"))
    with pytest.raises(ValueError):
        folds.require_no_leakage(clean, spark.createDataFrame([(0, 99)], "fold_id int, n_train long"))


def test_chronological_split(spark):
    df = spark.createDataFrame(series(lengths=(10, 7)))
    got = folds.chronological(df, 0.6, 0.2).toPandas()
    assert (got[got.asset_id == 0].sort_values("pos").role.tolist()) == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    assert (got[got.asset_id == 1].sort_values("pos").role.tolist()) == ["train"] * 4 + ["val"] + ["test"] * 2


def test_replaced_columns_fail_on_a_missing_partner(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k long, x double")
    b = spark.createDataFrame([(1, 7.0)], "k long, x double")
    assert joins.replace_columns(a.where("k = 1"), b, ["k"], ["x"]).first().x == 7.0
    with pytest.raises(Exception, match="no fresh value"):
        joins.replace_columns(a, b, ["k"], ["x"]).collect()


@pytest.mark.parametrize("split", [False, True])
def test_conformal_quantile(spark, split, request):
    ext = request.getfixturevalue("split_groups") if split else EXT
    pdf = series(4, (30, 5, 1)).rename(columns={"v": "res"})
    got = errors.conformal_quantile(spark.createDataFrame(pdf), ["asset_id"], "res", (0.2, 0.1), ext).toPandas()
    assert len(got) == 6
    for r in got.itertuples():
        v = pdf[pdf.asset_id == r.asset_id].res.to_numpy()
        m = len(v)
        assert np.isclose(r.q, np.quantile(v, min(np.ceil(round((m + 1) * (1 - r.alpha), 9)) / m, 1.0)))


def test_prognostic_horizon(spark):
    rng = np.random.default_rng(0)
    rows = [(a, k, min(1.0, (19 - k) / 12), min(1.0, (19 - k) / 12) + float(rng.normal(0, 0.08))) for a in range(6) for k in range(20)]
    pdf = pd.DataFrame(rows, columns=["asset_id", "pos", "y_true", "y_pred"])
    got = errors.prognostic_metrics(spark.createDataFrame(pdf), ["asset_id"]).toPandas().set_index("asset_id")
    for a, g in pdf.groupby("asset_id"):
        d = g[g.y_true < 1]
        ok = (np.abs(d.y_pred - d.y_true).round(9) <= 0.1).to_numpy()
        run = 0
        for v in ok[::-1]:
            if not v:
                break
            run += 1
        assert np.isclose(got.loc[a, "prognostic_horizon"], run / len(d))


def test_majority_vote_and_classification(spark):
    rows = [("m", 1, 0, 2, 2), ("m", 1, 1, 1, 2), ("m", 1, 2, 1, 2), ("m", 2, 3, 3, 0), ("m", 2, 4, 0, 0)]
    df = spark.createDataFrame(rows, "model string, snap long, pos long, p int, t int")
    s = errors.to_snapshots(df, ["model", "snap"], votes=["p"], firsts=["t"])
    assert {r.snap: r.p for r in s.collect()} == {1: 1, 2: 0}
    m = errors.classification_metrics(s, ["model"], "t", "p").first()
    assert m.accuracy == 0.5 and np.isclose(m.macro_f1, 1 / 3) and m.balanced_accuracy == 0.5


def test_grid_of_thresholds_equals_one_threshold_at_a_time(spark):
    grid = [-1.0, 0.1, 0.25, 0.25, 0.5, 0.7, 2.0]
    values = [None, 0.2, 0.5, 0.5, 0.9, None, 0.1, 0.25, float("nan"), 0.0]
    rows = [(g, p, len(values), values[(p + k) % len(values)]) for k, g in enumerate(["a", "b", None]) for p in range(len(values))]
    df = spark.createDataFrame(rows + [("quiet", 0, 1, None)], "g string, pos long, n long, run_min double")
    literal = F.array(*[F.lit(x) for x in grid])
    got = alarms.first_over_grid(df, ["g"], literal, lambda p: p, len(grid), "p", q=1).collect()
    want = []
    for x in grid:
        want += [(r.g, x, r["first"], r.n) for r in alarms.first_persistent(df, ["g"], F.lit(x), q=1).collect()]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_cadence_of_listed_and_unlisted_programmes(spark):
    df = spark.createDataFrame([("ims",), ("other",), (None,)], "p string")
    assert [r[0] for r in df.select(labels.cadence_of(F.col("p"), 2.0)).collect()] == [600.0, 2.0, 2.0]
