"""Queries over the health-index operators, on the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import health, ordered, quality
from ..sources.tables import KEY, dataset_number, event_series
from .pipelines import FEATURES, event_components, event_index, event_roles, long_indicators
from .registry import query
from .sqlkit import FOLDS, criteria, sql

ID = ["asset_id", "pos"]


@query(
    "indicator_quality",
    sql(
        """
SELECT indicator, round(median(monotonicity), 6) AS monotonicity_median, round(median(trendability), 6) AS trendability_median,
       round(min(trendability), 6) AS trendability_min, round(median(rho), 6) AS rho_median,
       round(exp(-stddev_pop(last_value) / (avg(abs(first_value - last_value)) + 1e-12)), 6) AS prognosability, count(*) AS n_assets
FROM crit GROUP BY indicator""",
        long="""
SELECT asset_id, pos, 'abnormality' AS indicator, en AS v0 FROM held UNION ALL
SELECT asset_id, pos, 'index', idx FROM held UNION ALL
SELECT asset_id, pos, 'value_x', x FROM held UNION ALL
SELECT asset_id, pos, 'value_y', y FROM held""",
        **criteria("long", "indicator, asset_id", "v0"),
    ),
)
def indicator_quality(spark, folder):
    """Flagship: the fold-fitted index against simple indicators, on held-out assets."""
    held, _, ext = event_index(spark, folder)
    rows = long_indicators(
        held, ["asset_id", "pos", "n"], {"abnormality": "E_norm", "index": "index", "value_x": "x", "value_y": "y"}
    )
    crit = quality.asset_criteria(rows, ["indicator", "asset_id"], "value", ext)
    table = quality.quality_table(crit, ["indicator"], ext.assets)
    return table.select(
        "indicator",
        *rounded(["monotonicity_median", "trendability_median", "trendability_min", "rho_median", "prognosability"]),
        "n_assets",
    )


@query("baseline_length", sql("SELECT asset_id, max(n) AS n, max(n_base) AS n_base FROM nb GROUP BY asset_id"))
def baseline_length(spark, folder):
    series, _ = event_series(spark, folder)
    return health.with_baseline(series, 2).groupBy("asset_id").agg(F.max("n").alias("n"), F.max("n_base").alias("n_base"))


@query("robust_scaling", sql("SELECT asset_id, pos, round(zx, 6) AS z_x, round(zy, 6) AS z_y FROM zz"))
def robust_scaling(spark, folder):
    series, ext = event_series(spark, folder)
    z = health.robust_scale(health.with_baseline(series, 2), KEY, FEATURES, ext)
    return z.select(*ID, *rounded(["z_x", "z_y"]))


def _scaled(spark, folder):
    series, ext = event_series(spark, folder)
    return health.robust_scale(health.with_baseline(series, 2), KEY, FEATURES, ext), ext


@query(
    "mahalanobis_diagonal",
    sql("""
SELECT asset_id, pos, round(sqrt(power(zx - mx, 2) / (vx + 1e-6) + power(zy - my, 2) / (vy + 1e-6) + 1e-9), 6) AS e
FROM zz JOIN zmom USING (asset_id)"""),
)
def mahalanobis_diagonal(spark, folder):
    z, _ = _scaled(spark, folder)
    return health.mahalanobis(z, KEY, FEATURES, "diagonal").select(*ID, F.round("E", 6).alias("e"))


SHRUNK_SQL = sql(
    """
SELECT asset_id, pos, nbr AS n_base, round(s, 6) AS shrinkage,
       round(sqrt(GREATEST((s22 * dx * dx - 2 * s12 * dx * dy + s11 * dy * dy) / (s11 * s22 - s12 * s12), 0) + 1e-9), 6) AS e
FROM (SELECT zz.asset_id, pos, nbr, s, zx - mx AS dx, zy - my AS dy,
             (1 - s) * vx + s * mu AS s11, (1 - s) * vy + s * mu AS s22, (1 - s) * cxy AS s12
      FROM zz JOIN shrink USING (asset_id))""",
        fourth="SELECT asset_id, sum(power(power(zx - mx, 2) + power(zy - my, 2), 2)) AS q FROM zz JOIN zmom USING (asset_id) WHERE pos < n_base GROUP BY asset_id",
        parts="""
SELECT zmom.*, (vx + vy) / 2 AS mu, (q / nbr - (vx * vx + vy * vy + 2 * cxy * cxy)) / (nbr * 2) AS beta,
       ((vx * vx + vy * vy + 2 * cxy * cxy) - 2 * ((vx + vy) / 2) * (vx + vy) + 2 * power((vx + vy) / 2, 2)) / 2 AS delta
FROM zmom JOIN fourth USING (asset_id)""",
        shrink="SELECT *, CASE WHEN beta <= 0 OR delta <= 0 THEN 0 ELSE LEAST(beta, delta) / delta END AS s FROM parts",
)


@query("mahalanobis_shrunk", SHRUNK_SQL)
def mahalanobis_shrunk(spark, folder):
    """Ledoit-Wolf covariance of the healthy prefix; two features, so SQL has the closed inverse."""
    z, _ = _scaled(spark, folder)
    out = health.mahalanobis(z, KEY, FEATURES, "auto")
    return out.select(*ID, "n_base", *rounded(["shrinkage"]), F.round("E", 6).alias("e"))


@query("shrunk_components", SHRUNK_SQL)
def shrunk_components(spark, folder):
    """The same distances from the pipeline that gathers all healthy-prefix statistics at once."""
    comp, _ = event_components(spark, folder, "auto", log_compress=False)
    return comp.select(*ID, "n_base", *rounded(["shrinkage"]), F.round("E", 6).alias("e"))


@query(
    "mahalanobis_empirical",
    sql("""
SELECT asset_id, pos, round(sqrt(GREATEST((b * dx * dx - 2 * o * dx * dy + a * dy * dy) / (a * b - o * o), 0) + 1e-9), 6) AS e
FROM (SELECT zz.asset_id, pos, zx - mx AS dx, zy - my AS dy, vx * nbr / (nbr - 1) + 1e-6 AS a, vy * nbr / (nbr - 1) + 1e-6 AS b,
             cxy * nbr / (nbr - 1) AS o FROM zz JOIN zmom USING (asset_id))"""),
)
def mahalanobis_empirical(spark, folder):
    z, _ = _scaled(spark, folder)
    return health.mahalanobis(z, KEY, FEATURES, "empirical", ridge=1e-6).select(*ID, F.round("E", 6).alias("e"))


@query("state_change", sql("SELECT asset_id, pos, round(c, 6) AS c FROM changes"))
def state_change(spark, folder):
    z, ext = _scaled(spark, folder)
    return health.state_change(z, KEY, FEATURES, ext).select(*ID, F.round("C", 6).alias("c"))


@query("raw_components", sql("SELECT asset_id, pos, n_base, round(n_base / n::DOUBLE, 4) AS effective_fraction, round(e, 6) AS e, round(c, 6) AS c FROM comp"))
def raw_components(spark, folder):
    comp, _ = event_components(spark, folder)
    return comp.select(
        *ID,
        "n_base",
        F.round(F.col("n_base") / F.col("n"), 4).alias("effective_fraction"),
        F.round("E", 6).alias("e"),
        F.round("C", 6).alias("c"),
    )


@query("fold_bounds", sql("SELECT fold_id, round(e_lo, 6) AS e_lo, round(e_hi, 6) AS e_hi, round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi FROM bounds"))
def fold_bounds(spark, folder):
    comp, ext = event_components(spark, folder)
    b = health.fold_bounds(comp, FOLDS, dataset_number())
    return b.select("fold_id", *[F.round(c, 6).alias(c.lower()) for c in ("E_lo", "E_hi", "C_lo", "C_hi")])


def _scores(spark, folder):
    comp, ext = event_components(spark, folder)
    return health.fold_scores(comp, health.fold_bounds(comp, FOLDS, dataset_number()), FOLDS, ext, dataset_number())


@query("weight_fit", sql("SELECT fold_id, a, b, round(fitness, 6) AS fitness, n_train FROM picked"))
def weight_fit(spark, folder):
    best = health.pick_weight(health.weight_sweep(_scores(spark, folder)))
    return best.select("fold_id", "a", "b", *rounded(["fitness"]), "n_train")


@query("weight_fit_label_free", sql("SELECT fold_id, am AS a, bm AS b, round(fitness_mono, 6) AS fitness FROM picked_mono"))
def weight_fit_label_free(spark, folder):
    best = health.pick_weight(health.weight_sweep(_scores(spark, folder), "mono"))
    return best.select("fold_id", "a", "b", *rounded(["fitness"]))


@query("weight_sweep_curve", sql("SELECT fold_id, a, round(fitness, 6) AS fitness FROM sweep"))
def weight_sweep_curve(spark, folder):
    return health.weight_sweep(_scores(spark, folder)).select("fold_id", "a", *rounded(["fitness"]))


@query("index_apply", sql("SELECT fold_id, asset_id, pos, round(en, 6) AS e_norm, round(cn, 6) AS c_norm, round(idx, 9) AS index FROM held"))
def index_apply(spark, folder):
    held, _, _ = event_index(spark, folder)
    return held.select("fold_id", *ID, F.round("E_norm", 6).alias("e_norm"), F.round("C_norm", 6).alias("c_norm"), F.round("index", 9).alias("index"))


@query(
    "index_saturation",
    sql("SELECT fold_id, asset_id, round(avg(CASE WHEN e_lin > 1 OR e_lin < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS sat_frac FROM normed WHERE role = 'test' GROUP BY ALL"),
)
def index_saturation(spark, folder):
    comp, ext = event_components(spark, folder)
    rows = event_roles(comp.select("asset_id", "bucket", "pos", "n", "E", "C")).where("role = 'test'")
    scaled = health.scale_by_fold(rows, health.fold_bounds(comp, FOLDS, dataset_number()))
    return health.saturation(scaled, ["fold_id", "asset_id"]).select("fold_id", "asset_id", *rounded(["sat_frac"]))


LEFT_OUT = {
    "loo_groups": "SELECT dataset, grp, row_number() OVER (PARTITION BY dataset ORDER BY grp) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS g FROM (SELECT DISTINCT dataset, asset_id // 4 AS grp FROM ev)",
    "loo": "SELECT a.dataset, a.grp, b.grp AS vgrp, a.dataset || '/' || a.grp AS fold_id FROM loo_groups a JOIN loo_groups b ON a.dataset = b.dataset AND b.r = (a.r + 1) % a.g",
    "loo_rows": "SELECT l.fold_id, c.* FROM comp c JOIN loo l ON l.dataset = c.dataset AND c.asset_id // 4 <> l.grp AND c.asset_id // 4 <> l.vgrp",
    "loo_bounds": "SELECT fold_id, quantile_cont(e, 0.01) AS e_lo, quantile_cont(e, 0.99) AS e_hi, quantile_cont(c, 0.01) AS c_lo, quantile_cont(c, 0.99) AS c_hi FROM loo_rows GROUP BY fold_id",
}


def _left_out(comp):
    """One fold per independence group of a dataset: the group and, for validation, the next one (cyclic) stay out."""
    from ..operators.folds import leave_one_out

    name = F.format_string("Test%08d_Bearing%d", "grp", F.pmod("asset_id", F.lit(4)))
    manifest = comp.select("dataset", name.alias("asset")).distinct()
    made = leave_one_out(manifest, ordered.extent(manifest, ["dataset"])).select("dataset", "holdout_group", "val_group").distinct()
    number = lambda c: F.substring(c, 5, 8).cast("bigint")
    return made.select("dataset", F.concat_ws("/", "dataset", number("holdout_group")).alias("fold_id"), F.array(number("holdout_group"), number("val_group")).alias("without"))


@query("leave_one_out_bounds", sql("SELECT fold_id, round(e_lo, 6) AS e_lo, round(e_hi, 6) AS e_hi, round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi FROM loo_bounds", **LEFT_OUT))
def leave_one_out_bounds(spark, folder):
    """Percentile bounds of every leave-one-group-out fold, by subtraction from the counts of all."""
    comp, _ = event_components(spark, folder)
    wanted = {"e_lo": ("E", 0.01), "e_hi": ("E", 0.99), "c_lo": ("C", 0.01), "c_hi": ("C", 0.99)}
    out = ordered.quantiles_without(comp, ["dataset"], "grp", wanted, _left_out(comp)).where("e_lo IS NOT NULL")
    return out.select("fold_id", *rounded(list(wanted)))


@query(
    "leave_one_out_fit",
    sql(
        """
SELECT fold_id, a, round(1 - a, 6) AS b, round(fitness, 6) AS fitness, n_train FROM (
  SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY fitness DESC, a) AS r FROM loo_sweep) WHERE r = 1""",
        **LEFT_OUT,
        loo_blended="""
SELECT fold_id, asset_id, pos, k, round(round(k / 100.0::DOUBLE, 6) * LEAST(GREATEST((e - e_lo) / (e_hi - e_lo + 1e-9), 0), 1)
       + (1 - round(k / 100.0::DOUBLE, 6)) * LEAST(GREATEST((c - c_lo) / (c_hi - c_lo + 1e-9), 0), 1), 9) AS v
FROM loo_rows JOIN loo_bounds USING (fold_id), generate_series(0, 100) g(k)""",
        loo_ranked="""
SELECT *, rank() OVER r + (count(*) OVER (PARTITION BY fold_id, asset_id, k, v) - 1) / 2.0::DOUBLE AS rk,
       sign(v - lag(v) OVER (PARTITION BY fold_id, asset_id, k ORDER BY pos)) AS sg
FROM loo_blended WINDOW r AS (PARTITION BY fold_id, asset_id, k ORDER BY v)""",
        loo_asset="""
SELECT fold_id, asset_id, k, CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END AS mono,
       CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS rho
FROM loo_ranked GROUP BY fold_id, asset_id, k""",
        loo_sweep="SELECT fold_id, round(k / 100.0::DOUBLE, 6) AS a, round(avg(mono + rho), 9) AS fitness, count(*) AS n_train FROM loo_asset GROUP BY fold_id, k",
    ),
)
def leave_one_out_fit(spark, folder):
    """The studied protocol: every group held out once, its index fitted on all groups but it and its validation group."""
    comp, ext = event_components(spark, folder)
    fitted = health.guarded(health.fit_left_out(comp, _left_out(comp), ext), comp)
    return fitted.select("fold_id", "a", "b", *rounded(["fitness"]), "n_train")
