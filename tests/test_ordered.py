"""The split-group forms against plain pandas, with one asset holding most rows and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import ordered
from vigilspark.operators.ordered import Extent

SMALL = Extent(100, 100)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    rows = []
    for asset, n in ((1, 61), (2, 7), (3, 1), (4, 2), (5, 16)):
        for k in range(n):
            rows.append((asset, k, float(np.round(rng.normal(), 1)) if k % 3 else 0.0, n))
    return pd.DataFrame(rows, columns=["asset_id", "pos", "v", "n"])



def test_position_matches_sort(spark, frame, split_groups):
    df = spark.createDataFrame(frame.drop(columns="n").sample(frac=1, random_state=1))
    for ext in (Extent(3, 3), split_groups):
        got = ordered.position(df, ["asset_id"], ["v", "pos"], ext, "k").toPandas()
        want = frame.sort_values(["asset_id", "v", "pos"]).assign(k=lambda d: d.groupby("asset_id").cumcount())
        m = got.merge(want, on=["asset_id", "pos"], suffixes=("", "_w"))
        assert len(m) == len(frame) and (m.k == m.k_w).all() and (m.n == m.n_w).all()


def test_neighbours_cross_tiles(spark, frame, split_groups):
    df = spark.createDataFrame(frame)
    for ext in (Extent(3, 3), split_groups):
        got = ordered.neighbours(df, ["asset_id"], {"a": ("v", 1), "b": ("v", 3), "c": ("v", -2)}, ext).toPandas()
        g = frame.groupby("asset_id")["v"]
        want = frame.assign(a=g.shift(1), b=g.shift(3), c=g.shift(-2))
        m = got.merge(want, on=["asset_id", "pos"], suffixes=("", "_w"))
        assert len(got) == len(frame)
        for c in "abc":
            pd.testing.assert_series_equal(m[c], m[c + "_w"], check_names=False)


def test_running_total(spark, frame, split_groups):
    df = spark.createDataFrame(frame.assign(v=frame.v * 10))
    got = ordered.running_total(df, ["asset_id"], "v", "t", split_groups).toPandas()
    want = frame.assign(t=(frame.v * 10).groupby(frame.asset_id).cumsum())
    m = got.merge(want, on=["asset_id", "pos"])
    assert len(m) == len(frame) and np.allclose(m.t_x, m.t_y)


def test_average_rank(spark, frame, split_groups):
    df = spark.createDataFrame(frame)
    want = frame.assign(r=frame.groupby("asset_id")["v"].rank())
    for ext in (Extent(3, 3), split_groups):
        got = ordered.average_rank(df, ["asset_id"], "v", "r", ext).toPandas()
        m = got.merge(want, on=["asset_id", "pos"])
        assert len(m) == len(frame) and (m.r_x == m.r_y).all()


def test_quantiles(spark, frame, split_groups):
    with_null = frame.copy()
    with_null.loc[with_null.pos % 5 == 4, "v"] = np.nan
    df = spark.createDataFrame(with_null).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for ext in (Extent(3, 3), split_groups):
        got = ordered.quantiles(
            df, ["asset_id"], {"q1": ("v", 0.25), "q2": ("v", 0.5), "q9": ("v", 0.99)}, ext, also=[F.count(F.lit(1)).alias("c")]
        ).toPandas().set_index("asset_id").sort_index()
        g = with_null.groupby("asset_id")["v"]
        for c, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.99)):
            assert np.allclose(got[c], g.quantile(p))
        assert (got.c == with_null.groupby("asset_id").size()).all()


def test_rolling_median(spark, frame, split_groups):
    df = spark.createDataFrame(frame)
    for fraction in (0.05, 0.2):
        for ext in (Extent(3, 3), split_groups):
            got = ordered.rolling_median(df, ["asset_id"], "v", "m", ext, fraction).toPandas()
            parts = []
            for _, g in frame.groupby("asset_id"):
                w = max(3, int(round(fraction * len(g))))
                parts.append(g.assign(m=g.v.rolling(w, center=True, min_periods=1).median()))
            m = got.merge(pd.concat(parts), on=["asset_id", "pos"], suffixes=("", "_w"))
            assert len(m) == len(got) == len(frame) and np.allclose(m.m, m.m_w)


def test_extent_and_partition_invariance(spark, frame):
    df = spark.createDataFrame(frame)
    assert ordered.extent(df, ["asset_id"]) == Extent(len(frame), 61, 5)
    a = ordered.neighbours(df.repartition(1), ["asset_id"], {"p": ("v", 1)}, SMALL).toPandas()
    b = ordered.neighbours(df.repartition(8), ["asset_id"], {"p": ("v", 1)}, SMALL).toPandas()
    key = ["asset_id", "pos"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_checkpoint_dir_is_read_from_the_session(spark):
    ordered.use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()


@pytest.fixture(scope="module")
def gaps():
    """One asset with a third of all rows, NULL values, a NULL key, NaN and ties."""
    rows = []
    for asset, n in ((1, 31), (2, 12), (3, 9), (None, 14), (4, 26)):
        for k in range(n):
            v = None if k % 4 == 1 else float("nan") if k == 6 else float((k * 7) % 5)
            rows.append((asset, k, v, float((k * 3) % 7) if k % 5 else None, n))
    return rows


def both_forms(spark, gaps, split_groups, build):
    """The result of the window form and of the split form on the same rows, as sorted text."""
    df = spark.createDataFrame(gaps, "asset_id int, pos long, v double, u double, n long").repartition(4)
    out = []
    for ext in (Extent(3, 3), split_groups):
        got = build(df, ext)
        out.append(sorted(str([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r]) for r in got.select(*sorted(got.columns)).collect()))
    return out


@pytest.mark.parametrize("block", ["position", "average_rank", "running_total", "quantiles", "criteria", "spearman", "partial", "weights"])
def test_null_rule_is_the_same_in_both_forms(spark, gaps, split_groups, block):
    from vigilspark.operators import quality, weights

    k = ["asset_id"]
    build = {
        "position": lambda df, e: ordered.position(df.drop("n"), k, ["v", "pos"], e, "at"),
        "average_rank": lambda df, e: ordered.average_rank(df, k, "v", "r", e),
        "running_total": lambda df, e: ordered.running_total(df, k, "u", "t", e),
        "quantiles": lambda df, e: ordered.quantiles(df, k, {"q": ("u", 0.3)}, e),
        "criteria": lambda df, e: quality.asset_criteria(df, k, "u", e),
        "spearman": lambda df, e: quality.spearman(df, k, "u", "pos", e),
        "partial": lambda df, e: quality.partial_spearman(df, k, "u", "n", "pos", e),
        "weights": lambda df, e: weights.score_weights(df.where("asset_id IS NOT NULL").withColumns({"f": F.lit(0), "v": F.nanvl("v", F.lit(9.0))}), ["f", "asset_id"], ["u", "v"], [(0.2, 0.8), (1.0, 0.0)], e),
    }[block]
    short, long = both_forms(spark, gaps, split_groups, build)
    assert short and short == long


def test_null_values_keep_their_row_without_a_rank(spark, gaps, split_groups):
    df = spark.createDataFrame(gaps, "asset_id int, pos long, v double, u double, n long")
    for ext in (Extent(3, 3), split_groups):
        got = ordered.average_rank(df, ["asset_id"], "u", "r", ext).toPandas()
        assert len(got) == len(gaps) and (got.r.isna() == got.u.isna()).all()
        want = got.groupby("asset_id", dropna=False).u.rank()
        assert np.allclose(got.r.dropna(), want.dropna())


def test_kept_tables_do_not_multiply_in_plans(spark):
    rows = spark.range(20).withColumn("v", F.col("id") % 3)
    sizes = []
    for _ in range(5):
        rows = ordered.keep(rows.join(rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v").select("id", "v", (F.col("c") * 0 + F.col("id")).alias("w")).drop("w"))
        sizes.append(len(rows._jdf.queryExecution().executedPlan().toString()))
    assert sorted(r.id for r in rows.collect()) == list(range(20))
    assert max(sizes) < 2 * sizes[0]


def test_rolling_median_of_many_short_series_is_one_group_of_rows(spark):
    """Series of several widths share an Arrow group and stay apart in it; NULL values and a NULL key included."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(None if k == 3 else k, p, n, None if rng.random() < 0.1 else float(rng.normal())) for k, n in enumerate(rng.integers(1, 200, 40).tolist()) for p in range(n)]
    frame = spark.createDataFrame(rows, "asset_id long, pos long, n long, v double")
    out = ordered.rolling_median(frame, ["asset_id"], "v", "m", ordered.Extent(len(rows), 200, 40))
    assert "FlatMapGroupsInPandas [_block" in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas()
    assert len(got) == len(rows)
    for _, s in got.groupby("asset_id", dropna=False):
        s = s.sort_values("pos")
        want = s["v"].rolling(max(3, round(len(s) * 0.05)), center=True, min_periods=1).median()
        assert s["pos"].tolist() == list(range(len(s)))
        pd.testing.assert_series_equal(s["m"], want, check_names=False)
