"""Queries over controls, the per-asset composite index and data-driven directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import alarms, composite, controls, directions, health, labels, ordered, quality
from ..operators.ordered import keep
from ..sources.tables import KEY, dataset_number, event_runs, event_series
from .pipelines import FEATURES, event_components, event_index, event_roles, long_indicators
from .registry import query
from .sqlkit import FOLDS, criteria, define, sql

ID = ["asset_id", "pos"]


@query(
    "temperature_slope",
    sql("""
SELECT asset_id, pos, round(CASE WHEN pos = 0 THEN 0 WHEN pos < 5 THEN (y - first_value(y) OVER w) / pos ELSE (y - lag(y, 5) OVER w) / 5 END, 6) AS slope
FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY pos)"""),
)
def temperature_slope(spark, folder):
    series, ext = event_series(spark, folder)
    return health.trailing_slope(series, KEY, "y", "slope", ext).select(*ID, *rounded(["slope"]))


@query(
    "velocity_acceleration",
    sql("""
SELECT asset_id, pos, round(coalesce(idx - lag(idx) OVER w, 0), 9) AS index_vel, round(coalesce(idx - 2 * lag(idx) OVER w + lag(idx, 2) OVER w, 0), 9) AS index_acc
FROM held WINDOW w AS (PARTITION BY asset_id ORDER BY pos)"""),
)
def velocity_acceleration(spark, folder):
    held, _, ext = event_index(spark, folder)
    return health.velocity_acceleration(held, KEY, "index", ext).select(*ID, *rounded(["index_vel", "index_acc"], 9))


@query(
    "central_gradient",
    sql("""
SELECT asset_id, pos, round(coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0), 6) AS gradient
FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY pos)"""),
)
def central_gradient(spark, folder):
    series, ext = event_series(spark, folder)
    return health.central_gradient(series, KEY, "y", "gradient", ext).select(*ID, *rounded(["gradient"]))


# ------------------------------------------------------------------ per-asset composite index
define("c_nb", "SELECT ev.*, GREATEST(2, floor(0.2::DOUBLE * n))::BIGINT AS nbase FROM ev")
define("c_scale", """
SELECT asset_id, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.5) AS x2, quantile_cont(x, 0.75) AS x3, quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.5) AS y2, quantile_cont(y, 0.75) AS y3
FROM c_nb WHERE pos < nbase GROUP BY asset_id""")
define("c_z", "SELECT c_nb.*, (x - x2) / (x3 - x1 + 1e-9) AS zx, (y - y2) / (y3 - y1 + 1e-9) AS zy FROM c_nb JOIN c_scale USING (asset_id)")
define("c_mom", "SELECT asset_id, avg(zx) AS mx, avg(zy) AS my, var_samp(zx) + 1e-9 AS a, var_samp(zy) + 1e-9 AS b, covar_samp(zx, zy) AS o FROM c_z WHERE pos < nbase GROUP BY asset_id")
define("c_e", """
SELECT c_z.*, sqrt(GREATEST((b * power(zx - mx, 2) - 2 * o * (zx - mx) * (zy - my) + a * power(zy - my, 2)) / (a * b - o * o), 0) + 1e-9) AS e,
       sqrt(power(zx - lag(zx) OVER w, 2) + power(zy - lag(zy) OVER w, 2) + 1e-9) AS s,
       CASE WHEN pos = 0 THEN 0 WHEN pos < 5 THEN (y - first_value(y) OVER w) / pos ELSE (y - lag(y, 5) OVER w) / 5 END AS g
FROM c_z JOIN c_mom USING (asset_id) WINDOW w AS (PARTITION BY asset_id ORDER BY pos)""")
define("c_raw", "SELECT *, coalesce(s, lead(s) OVER (PARTITION BY asset_id ORDER BY pos), 0) AS c, pos < GREATEST(nbase, floor(0.6::DOUBLE * n)) AS tr FROM c_e")
define("c_lim", """
SELECT asset_id, min(e) AS e0, max(e) AS e1, min(c) AS c0, max(c) AS c1, min(g) AS g0, max(g) AS g1 FROM c_raw WHERE tr GROUP BY asset_id""")
define("c_norm", """
SELECT r.dataset, r.asset_id, pos, n, e, c, g, LEAST(GREATEST((e - e0) / (e1 - e0 + 1e-9), 0), 1) AS en, LEAST(GREATEST((c - c0) / (c1 - c0 + 1e-9), 0), 1) AS cn,
       LEAST(GREATEST((g - g0) / (g1 - g0 + 1e-9), 0), 1) AS gn FROM c_raw r JOIN c_lim USING (asset_id)""")
define("c_mix", """
SELECT asset_id, pos, w, wa, wb, wc, round(wa * en + wb * cn + wc * gn, 9) AS v FROM c_norm,
  (SELECT row_number() OVER (ORDER BY i, j) - 1 AS w, round(i * 0.05, 6)::DOUBLE AS wa, round(j * 0.05, 6)::DOUBLE AS wb, round((20 - i - j) * 0.05, 6)::DOUBLE AS wc
   FROM generate_series(0, 20) a(i), generate_series(0, 20) b(j) WHERE i + j <= 20)""")
define("c_rank", """
SELECT *, rank() OVER (PARTITION BY asset_id, w ORDER BY v) + (count(*) OVER (PARTITION BY asset_id, w, v) - 1) / 2.0::DOUBLE AS rk,
       sign(v - lag(v) OVER (PARTITION BY asset_id, w ORDER BY pos)) AS sg FROM c_mix""")
define("c_fit", """
SELECT asset_id, wa, wb, wc, f FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY f DESC, w) AS r FROM (
  SELECT asset_id, w, any_value(wa) AS wa, any_value(wb) AS wb, any_value(wc) AS wc,
         round(CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END + CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN abs(corr(rk, pos)) ELSE 0 END, 9) AS f
  FROM c_rank GROUP BY asset_id, w)) WHERE r = 1""")


def _composite(spark, folder):
    series, ext = event_series(spark, folder)
    return keep(composite.composite_components(series, KEY, FEATURES, "y", ext)), ext


@query("prefix_minmax", sql("SELECT asset_id, pos, round(en, 6) AS e_norm, round(cn, 6) AS c_norm, round(gn, 6) AS g_norm FROM c_norm"))
def prefix_minmax(spark, folder):
    rows, _ = _composite(spark, folder)
    return rows.select(*ID, *[F.round(f"{c}_norm", 6).alias(f"{c.lower()}_norm") for c in "ECG"])


@query(
    "fixed_weight_index",
    sql("""
SELECT asset_id, pos, round(0.5::DOUBLE * en + 0.3::DOUBLE * cn + 0.2::DOUBLE * gn, 6) AS index_fixed, round(0.625::DOUBLE * en + 0.375::DOUBLE * cn, 6) AS index_vibration,
       round(1 / (1 + exp(-(0.5::DOUBLE * en + 0.3::DOUBLE * cn + 0.2::DOUBLE * gn))), 6) AS index_sigmoid FROM c_norm"""),
)
def fixed_weight_index(spark, folder):
    rows, _ = _composite(spark, folder)
    return rows.select(
        *ID,
        F.round(composite.combine(composite.FIXED_WITH_TEMPERATURE), 6).alias("index_fixed"),
        F.round(composite.combine(composite.FIXED_VIBRATION_ONLY), 6).alias("index_vibration"),
        F.round(composite.combine(composite.FIXED_WITH_TEMPERATURE, sigmoid=True), 6).alias("index_sigmoid"),
    )


@query("simplex_weight_fit", sql("SELECT asset_id, wa AS w_e, wb AS w_c, wc AS w_g, round(f, 6) AS fitness FROM c_fit"))
def simplex_weight_fit(spark, folder):
    rows, ext = _composite(spark, folder)
    fit = composite.fit_simplex(rows, KEY, ext)
    return fit.select("asset_id", *[F.col(f"w{c}").alias(f"w_{c.lower()}") for c in "ECG"], *rounded(["fitness"]))


@query(
    "component_ablation",
    sql("""
SELECT asset_id, pos, round(wa * en + wb * cn + wc * gn, 6) AS index_fitted,
       round(coalesce(CASE WHEN wb + wc >= 1e-9 THEN wb / (wb + wc) * cn + wc / (wb + wc) * gn END, wa * en + wb * cn + wc * gn), 6) AS index_wo_e,
       round(coalesce(CASE WHEN wa + wc >= 1e-9 THEN wa / (wa + wc) * en + wc / (wa + wc) * gn END, wa * en + wb * cn + wc * gn), 6) AS index_wo_c,
       round(coalesce(CASE WHEN wa + wb >= 1e-9 THEN wa / (wa + wb) * en + wb / (wa + wb) * cn END, wa * en + wb * cn + wc * gn), 6) AS index_wo_g
FROM c_norm JOIN c_fit USING (asset_id)"""),
)
def component_ablation(spark, folder):
    rows, ext = _composite(spark, folder)
    out = composite.with_indices(rows, composite.fit_simplex(rows, KEY, ext), KEY)
    return out.select(*ID, *rounded(["index_fitted"]), *[F.round(f"index_wo_{c}", 6).alias(f"index_wo_{c.lower()}") for c in "ECG"])


@query(
    "composite_index_table",
    sql("""
SELECT asset_id, pos, round(e, 5) AS e, round(c, 5) AS c, round(g, 5) AS g, round(en, 5) AS e_norm, round(cn, 5) AS c_norm, round(gn, 5) AS g_norm,
       round(0.5::DOUBLE * en + 0.3::DOUBLE * cn + 0.2::DOUBLE * gn, 5) AS index_fixed, round(wa * en + wb * cn + wc * gn, 5) AS index_fitted,
       round(pos / GREATEST(n - 1, 1)::DOUBLE, 5) AS deg_ref
FROM c_norm JOIN c_fit USING (asset_id)"""),
)
def composite_index_table(spark, folder):
    rows, ext = _composite(spark, folder)
    out = composite.with_indices(rows, composite.fit_simplex(rows, KEY, ext), KEY)
    deg = labels.degradation(F.col("pos"), F.col("n"))
    low = [F.round(c, 5).alias(c.lower()) for c in ("E", "C", "G", "E_norm", "C_norm", "G_norm")]
    return out.select(*ID, *low, *rounded(["index_fixed", "index_fitted"], 5), F.round(deg, 5).alias("deg_ref"))


@query(
    "cross_dataset_index_quality",
    sql(
        "SELECT dataset, count(*) AS n_assets, round(median(monotonicity), 6) AS monotonicity, round(median(abs(rho)), 6) AS rho FROM crit GROUP BY dataset",
        fixed="SELECT dataset, asset_id, pos, round(0.5::DOUBLE * en + 0.3::DOUBLE * cn + 0.2::DOUBLE * gn, 9) AS v0 FROM c_norm",
        **criteria("fixed", "dataset, asset_id", "v0"),
    ),
)
def cross_dataset_index_quality(spark, folder):
    """Quality of the fixed-weight index, whose weights saw no lifetime, per dataset."""
    rows, ext = _composite(spark, folder)
    rows = rows.select("dataset", *ID, "n", F.round(composite.combine(composite.FIXED_WITH_TEMPERATURE), 9).alias("v"))
    crit = quality.asset_criteria(rows, ["dataset", "asset_id"], "v", ext).withColumn("rho", F.abs("rho"))
    out = ordered.quantiles(crit, ["dataset"], {"monotonicity_m": ("monotonicity", 0.5), "rho_m": ("rho", 0.5)}, ext.assets, also=[F.count(F.lit(1)).alias("n_assets")])
    return out.select("dataset", "n_assets", F.round("monotonicity_m", 6).alias("monotonicity"), F.round("rho_m", 6).alias("rho"))


@query(
    "weight_collection",
    sql("""
SELECT dataset, count(*) AS n_sources, round(avg(wa), 6) AS w_e_mean, round(stddev_samp(wa), 6) AS w_e_std, round(avg(wb), 6) AS w_c_mean, round(stddev_samp(wb), 6) AS w_c_std,
       round(avg(wc), 6) AS w_g_mean, round(stddev_samp(wc), 6) AS w_g_std FROM c_fit JOIN (SELECT DISTINCT asset_id, dataset FROM ev) USING (asset_id) GROUP BY dataset"""),
)
def weight_collection(spark, folder):
    rows, ext = _composite(spark, folder)
    fit = composite.fit_simplex(rows, ["dataset", "asset_id"], ext)
    aggs = [F.round(f(f"w{c}"), 6).alias(f"w_{c.lower()}_{t}") for c in "ECG" for f, t in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return fit.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_sources"), *aggs)


define("hi_long", """
SELECT asset_id, n, pos, 'x' AS indicator, x AS v FROM c_norm JOIN (SELECT asset_id, pos, x, y FROM ev) USING (asset_id, pos) UNION ALL
SELECT asset_id, n, pos, 'y', y FROM ev UNION ALL
SELECT asset_id, n, pos, 'y_slope', coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0) FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY pos) UNION ALL
SELECT asset_id, n, pos, 'abnormality', round(e, 9) FROM c_norm UNION ALL
SELECT asset_id, n, pos, 'state_change', round(c, 9) FROM c_norm UNION ALL
SELECT asset_id, n, pos, 'index_fixed', round(0.5::DOUBLE * en + 0.3::DOUBLE * cn + 0.2::DOUBLE * gn, 9) FROM c_norm""")
define("hi_unit", "SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9) AS u FROM hi_long WINDOW w AS (PARTITION BY indicator, asset_id)")
define("hi_run", "SELECT *, CASE WHEN u > 0.6 THEN 1 ELSE 0 END AS hot, sum(CASE WHEN u > 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY indicator, asset_id ORDER BY pos) AS run FROM hi_unit")
define("hi_flag", "SELECT *, CASE WHEN hot = 1 AND sum(hot) OVER (PARTITION BY indicator, asset_id, run) >= 3 THEN 1 ELSE 0 END AS flag FROM hi_run")
define("hi_ew", """
SELECT indicator, asset_id, coalesce(max(n) - 1 - min(CASE WHEN flag = 1 THEN pos END), 0) AS lead_time,
       avg(CASE WHEN pos < GREATEST(floor(0.6::DOUBLE * (n - 1)), 1) THEN flag::DOUBLE END) AS far FROM hi_flag GROUP BY indicator, asset_id""")


@query(
    "indicator_comparison",
    sql(
        """
SELECT indicator, asset_id, round(monotonicity, 6) AS monotonicity, round(abs(rho), 6) AS spearman_with_rul, round(smoothness, 4) AS smoothness, lead_time, round(far, 6) AS false_alarm_rate
FROM crit JOIN (SELECT indicator, asset_id, CASE WHEN count(*) >= 3 THEN 1 / (avg(b * b) + 1e-12) ELSE 0 END AS smoothness FROM bends GROUP BY ALL) USING (indicator, asset_id) JOIN hi_ew USING (indicator, asset_id)""",
        bends="SELECT indicator, asset_id, u - 2 * lag(u) OVER w + lag(u, 2) OVER w AS b FROM hi_unit WINDOW w AS (PARTITION BY indicator, asset_id ORDER BY pos)",
        **{k: v.replace("smoothness", "rough") for k, v in criteria("hi_long", "indicator, asset_id", "v").items()},
    ),
)
def indicator_comparison(spark, folder):
    """Per-asset table of every indicator: quality criteria plus alarms on its unit-scaled form."""
    rows, ext = _composite(spark, folder)
    rows = health.central_gradient(rows, KEY, "y", "y_slope", ext)
    rows = rows.withColumns({"e9": F.round("E", 9), "c9": F.round("C", 9), "f9": F.round(composite.combine(composite.FIXED_WITH_TEMPERATURE), 9)})
    longs = long_indicators(rows, ["asset_id", "pos", "n"], {"x": "x", "y": "y", "y_slope": "y_slope", "abnormality": "e9", "state_change": "c9", "index_fixed": "f9"})
    keys = ["indicator", "asset_id"]
    lim = longs.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    longs = keep(longs.join(lim, keys).withColumn("unit", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)))
    raw = quality.asset_criteria(longs, keys, "value", ext).select(*keys, "monotonicity", F.abs("rho").alias("spearman_with_rul"))
    unit = quality.asset_criteria(longs, keys, "unit", ext).select(*keys, "smoothness")
    flagged = alarms.persistent_flags(longs, keys, "unit", F.lit(0.6), ext)
    first = F.min(F.when(F.col("flag") == 1, F.col("pos")))
    healthy = F.col("pos") < F.greatest(F.floor((F.col("n") - 1) * F.lit(0.6)), F.lit(1))
    ew = flagged.groupBy(*keys).agg(
        F.coalesce(F.max("n") - 1 - first, F.lit(0)).alias("lead_time"),
        F.avg(F.when(healthy, F.col("flag").cast("double"))).alias("false_alarm_rate"),
    )
    out = raw.join(unit, keys).join(ew, keys)
    return out.select(*keys, *rounded(["monotonicity", "spearman_with_rul"]), F.round("smoothness", 4).alias("smoothness"), "lead_time", *rounded(["false_alarm_rate"]))


# ------------------------------------------------------------------ controls
define("fstat", "SELECT fold_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, max(n) AS hmax FROM roles WHERE role = 'train' GROUP BY fold_id")
define("perm", """
SELECT a.fold_id, a.asset_id, a.pos, b.idx AS shuf FROM applied a JOIN (
  SELECT fold_id, asset_id, idx, row_number() OVER (PARTITION BY fold_id, asset_id ORDER BY ('0x' || substr(md5(fold_id || '|' || asset_id || '|' || pos || '|shuf'), 1, 8))::BIGINT, pos) - 1 AS tgt FROM applied) b
ON a.fold_id = b.fold_id AND a.asset_id = b.asset_id AND a.pos = b.tgt""")


@query(
    "conditioning_columns",
    sql("""
SELECT a.fold_id, a.asset_id, a.pos, round(en, 6) AS e_norm, round(cn, 6) AS c_norm, round(idx, 9) AS index,
       round(coalesce(idx - lag(idx) OVER w, 0), 9) AS index_vel, round(coalesce(idx - 2 * lag(idx) OVER w + lag(idx, 2) OVER w, 0), 9) AS index_acc,
       round(am * en + bm * cn, 6) AS index_mono, round(ar * en + (1 - ar) * cn, 6) AS index_rand, round(shuf, 9) AS index_shuf,
       round(a.pos / GREATEST(hmax, 1)::DOUBLE, 6) AS elapsed_norm, round(a.pos / GREATEST(n - 1, 1)::DOUBLE, 6) AS deg_oracle,
       round(LEAST(GREATEST((x - mx) / (sx + 1e-9), -5), 5), 6) AS hc_x, round(LEAST(GREATEST((y - my) / (sy + 1e-9), -5), 5), 6) AS hc_y,
       round(avg(CASE WHEN e_lin > 1 OR e_lin < 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY a.fold_id, a.asset_id), 6) AS sat_frac
FROM (SELECT *, ('0x' || substr(md5(fold_id || '|' || asset_id || '|rand'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS ar FROM applied) a
JOIN picked_mono USING (fold_id) JOIN fstat USING (fold_id) JOIN perm ON a.fold_id = perm.fold_id AND a.asset_id = perm.asset_id AND a.pos = perm.pos
WINDOW w AS (PARTITION BY a.fold_id, a.asset_id ORDER BY a.pos)"""),
)
def conditioning_columns(spark, folder):
    """Index, its derivatives and every control, for all assets in all folds."""
    comp, ext = event_components(spark, folder)
    out = controls.conditioning_table(comp, FEATURES, FOLDS, ext, dataset=dataset_number())
    exact = rounded(["index", "index_vel", "index_acc", "index_shuf"], 9)
    names = ["index_mono", "index_rand", "elapsed_norm", "deg_oracle", "hc_x", "hc_y", "sat_frac"]
    return out.select("fold_id", *ID, F.round("E_norm", 6).alias("e_norm"), F.round("C_norm", 6).alias("c_norm"), *exact, *rounded(names))


@query("random_weight_index", sql("""
SELECT fold_id, asset_id, pos, round(ar * en + (1 - ar) * cn, 6) AS index_rand
FROM (SELECT *, ('0x' || substr(md5(fold_id || '|' || asset_id || '|rand'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS ar FROM normed WHERE role = 'test')"""))
def random_weight_index(spark, folder):
    comp, ext = event_components(spark, folder)
    rows = event_roles(comp.select(*ID, "bucket", "n", "E", "C"))
    held = health.scale_by_fold(rows.where("role = 'test'"), health.fold_bounds(comp, FOLDS, dataset_number()))
    a = controls.random_weight(F.col("fold_id"), F.col("asset_id"))
    return held.select("fold_id", *ID, F.round(a * F.col("E_norm") + (F.lit(1.0) - a) * F.col("C_norm"), 6).alias("index_rand"))


@query("shuffled_series", sql("""
SELECT a.asset_id, a.pos, b.x AS shuffled FROM ev a JOIN (
  SELECT asset_id, x, row_number() OVER (PARTITION BY asset_id ORDER BY ('0x' || substr(md5(asset_id || '|' || pos || '|shuf'), 1, 8))::BIGINT, pos) - 1 AS tgt FROM ev) b ON a.asset_id = b.asset_id AND a.pos = b.tgt"""))
def shuffled_series(spark, folder):
    series, ext = event_series(spark, folder)
    return controls.shuffled(series, KEY, "x", "shuffled", ext).select(*ID, "shuffled")


@query("elapsed_and_life_fraction", sql("""
SELECT fold_id, asset_id, pos, round(pos / GREATEST(hmax, 1)::DOUBLE, 6) AS elapsed_norm, round(pos / GREATEST(n - 1, 1)::DOUBLE, 6) AS deg_oracle FROM roles JOIN fstat USING (fold_id) WHERE role = 'test'"""))
def elapsed_and_life_fraction(spark, folder):
    series, _ = event_runs(spark, folder, FOLDS)
    rows = event_roles(series.select(*ID, "bucket", "n"))
    longest = F.broadcast(rows.where("role = 'train'").groupBy("fold_id").agg(F.max("n").alias("h")))  # one row per fold
    out = rows.where("role = 'test'").join(longest, "fold_id")
    return out.select(
        "fold_id", *ID,
        F.round(F.col("pos") / F.greatest(F.col("h"), F.lit(1)), 6).alias("elapsed_norm"),
        F.round(labels.degradation(F.col("pos"), F.col("n")), 6).alias("deg_oracle"),
    )


@query("scored_features", sql("""
SELECT fold_id, asset_id, pos, round(LEAST(GREATEST((x - mx) / (sx + 1e-9), -5), 5), 6) AS hc_x, round(LEAST(GREATEST((y - my) / (sy + 1e-9), -5), 5), 6) AS hc_y
FROM roles JOIN fstat USING (fold_id) WHERE role = 'test'"""))
def scored_features(spark, folder):
    """Features on the training scale of the fold, clipped at five deviations."""
    series, _ = event_runs(spark, folder, FOLDS)
    rows = event_roles(series.select(*ID, "bucket", "n", "x", "y"))
    stats = F.broadcast(controls.fold_feature_stats(rows.where("role = 'train'"), FEATURES))  # one row per fold
    out = rows.where("role = 'test'").join(stats, "fold_id")
    return out.select("fold_id", *ID, *[F.round(controls.clipped_score(c), 6).alias(f"hc_{c}") for c in FEATURES])


@query("fold_parameter_record", sql("""
SELECT p.fold_id, n_train, hmax AS h_max_train, a, b, round(p.fitness, 6) AS fitness, am AS a_mono, bm AS b_mono, round(e_lo, 6) AS e_lo, round(e_hi, 6) AS e_hi, round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi,
       round(sat, 6) AS holdout_sat_frac, nb AS holdout_n_baseline
FROM picked p JOIN picked_mono USING (fold_id) JOIN bounds USING (fold_id) JOIN fstat USING (fold_id)
JOIN (SELECT fold_id, avg(CASE WHEN e_lin > 1 OR e_lin < 0 THEN 1.0::DOUBLE ELSE 0 END) AS sat, max(n_base) AS nb FROM normed WHERE role = 'test' GROUP BY fold_id) USING (fold_id)"""))
def fold_parameter_record(spark, folder):
    comp, ext = event_components(spark, folder)
    r = controls.fold_record(comp, FOLDS, ext, dataset=dataset_number())
    return r.select(
        "fold_id", "n_train", F.col("H_max_train").alias("h_max_train"), "a", "b", *rounded(["fitness"]), "a_mono", "b_mono",
        *[F.round(c, 6).alias(c.lower()) for c in ("E_lo", "E_hi", "C_lo", "C_hi")], *rounded(["holdout_sat_frac"]), "holdout_n_baseline",
    )


@query("weight_distribution", sql("""
SELECT count(*) AS n_folds, round(median(a), 6) AS a_median, round(quantile_cont(a, 0.25), 6) AS a_q25, round(quantile_cont(a, 0.75), 6) AS a_q75, min(a) AS a_min, max(a) AS a_max,
       round(median(b), 6) AS b_median, round(median(p.fitness), 6) AS fitness_median, round(median(am), 6) AS a_mono_median FROM picked p JOIN picked_mono USING (fold_id)"""))
def weight_distribution(spark, folder):
    comp, ext = event_components(spark, folder)
    r = controls.fold_record(comp, FOLDS, ext, dataset=dataset_number(), held_out="left").withColumn("_all", F.lit(0))
    out = ordered.quantiles(
        r, ["_all"],
        {"a_median": ("a", 0.5), "a_q25": ("a", 0.25), "a_q75": ("a", 0.75), "b_median": ("b", 0.5), "fitness_median": ("fitness", 0.5), "a_mono_median": ("a_mono", 0.5)},
        ordered.Extent(2 * FOLDS, 2 * FOLDS), also=[F.count(F.lit(1)).alias("n_folds"), F.min("a").alias("a_min"), F.max("a").alias("a_max")],
    )
    return out.select("n_folds", *rounded(["a_median", "a_q25", "a_q75"]), "a_min", "a_max", *rounded(["b_median", "fitness_median", "a_mono_median"]))


@query("weight_sweep_summary", sql("""
SELECT a, round(avg(fitness), 6) AS mean, round(stddev_samp(fitness), 6) AS std, count(*) AS count, (round(avg(fitness), 9) >= max(round(avg(fitness), 9)) OVER () - 0.02)::INT AS plateau FROM sweep GROUP BY a"""))
def weight_sweep_summary(spark, folder):
    """Mean and spread of the sweep over folds; the plateau lies within 0.02 of the best mean."""
    comp, ext = event_components(spark, folder)
    scores = health.fold_scores(comp, health.fold_bounds(comp, FOLDS, dataset_number()), FOLDS, ext, dataset_number())
    sweep = health.weight_sweep(scores)
    agg = sweep.groupBy("a").agg(F.round(F.avg("fitness"), 9).alias("_m"), F.round(F.stddev_samp("fitness"), 6).alias("std"), F.count(F.lit(1)).alias("count"))
    best = F.broadcast(agg.agg(F.max("_m").alias("_best")))  # a single row
    return agg.join(best).select("a", F.round("_m", 6).alias("mean"), "std", "count", (F.col("_m") >= F.col("_best") - 0.02).cast("int").alias("plateau"))


@query("realised_range", sql("""
SELECT dataset, quantity, round(median(q3 - q1), 6) AS iqr_median, round(median(hi), 6) AS range_median, round(avg(sat), 6) AS sat_frac_mean, count(*) AS n
FROM (SELECT dataset, asset_id, quantity, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(CASE WHEN v >= 0.999 THEN 1.0::DOUBLE ELSE 0 END) AS sat FROM (
  SELECT dataset, asset_id, 'e_norm' AS quantity, en AS v FROM held UNION ALL SELECT dataset, asset_id, 'c_norm', cn FROM held UNION ALL SELECT dataset, asset_id, 'index', idx FROM held) GROUP BY ALL)
GROUP BY dataset, quantity"""))
def realised_range(spark, folder):
    held, _, ext = event_index(spark, folder)
    longs = long_indicators(held, ["dataset", "asset_id"], {"e_norm": "E_norm", "c_norm": "C_norm", "index": "index"}).withColumnRenamed("indicator", "quantity")
    per = ordered.quantiles(
        longs, ["dataset", "asset_id", "quantity"], {"q1": ("value", 0.25), "q3": ("value", 0.75)}, ext,
        also=[F.max("value").alias("hi"), F.avg((F.col("value") >= 0.999).cast("double")).alias("sat")],
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    out = ordered.quantiles(
        per, ["dataset", "quantity"], {"iqr_median": ("iqr", 0.5), "range_median": ("hi", 0.5)}, ext.assets,
        also=[F.avg("sat").alias("sat_frac_mean"), F.count(F.lit(1)).alias("n")],
    )
    return out.select("dataset", "quantity", *rounded(["iqr_median", "range_median", "sat_frac_mean"]), "n")


# ------------------------------------------------------------------ directions
define("f_std", "SELECT r.*, (x - mx) / sx AS s1, (y - my) / sy AS s2 FROM roles r JOIN fstat USING (fold_id)")
define("f_pc", """
SELECT h.*, (s1 + sg * s2) / sqrt(2::DOUBLE) AS pc1 FROM f_std h JOIN (SELECT fold_id, CASE WHEN covar_pop(s1, s2) >= 0 THEN 1 ELSE -1 END AS sg FROM f_std WHERE role = 'train' GROUP BY fold_id) USING (fold_id) WHERE role = 'test'""")


@query(
    "principal_component_index_by_fold",
    sql("""
SELECT fold_id, asset_id, pos, round(CASE WHEN rho < 0 THEN -pc1 ELSE pc1 END, 6) AS pca_index FROM f_pc JOIN (
  SELECT asset_id, CASE WHEN count(*) >= 3 AND stddev_pop(pc1) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS rho FROM (
    SELECT asset_id, pos, pc1, rank() OVER (PARTITION BY asset_id ORDER BY pc1) + (count(*) OVER (PARTITION BY asset_id, pc1) - 1) / 2.0::DOUBLE AS rk FROM f_pc) GROUP BY asset_id) USING (asset_id)"""),
)
def principal_component_index_by_fold(spark, folder):
    series, ext = event_runs(spark, folder, FOLDS)
    rows = keep(event_roles(series.select(*ID, "bucket", "n", "x", "y")))
    return directions.pca_index_by_fold(rows, FEATURES, ext).select("fold_id", *ID, *rounded(["pca_index"]))


define("a_std", "SELECT ev.*, GREATEST(2, floor(0.2::DOUBLE * n)) AS nbase, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8) AS s1, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8) AS s2 FROM ev WINDOW w AS (PARTITION BY asset_id)")
define("a_cov", "SELECT asset_id, a, b, o, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + o * o) AS l FROM (SELECT asset_id, var_pop(s1) AS a, var_pop(s2) AS b, covar_pop(s1, s2) AS o FROM a_std WHERE pos < nbase GROUP BY asset_id)")
define("a_pc", "SELECT s.asset_id, pos, nbase, (CASE WHEN abs(o) < 1e-15 THEN (CASE WHEN a >= b THEN s1 ELSE s2 END) ELSE (o * s1 + (l - a) * s2) / sqrt(o * o + power(l - a, 2)) END) AS sc FROM a_std s JOIN a_cov USING (asset_id)")


@query(
    "principal_component_index_by_asset",
    sql("SELECT asset_id, pos, round(abs(sc - m), 6) AS pca_index FROM a_pc JOIN (SELECT asset_id, median(sc) AS m FROM a_pc WHERE pos < nbase GROUP BY asset_id) USING (asset_id)"),
)
def principal_component_index_by_asset(spark, folder):
    series, ext = event_series(spark, folder)
    stats = series.groupBy("asset_id").agg(*[f(c).alias(f"_{t}_{c}") for c in FEATURES for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))])
    rows = series.join(stats, "asset_id").withColumns({f"s_{c}": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8) for c in FEATURES})
    rows = rows.withColumn("n_base", F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(0.2))))
    return directions.pca_index_by_asset(rows, KEY, ["s_x", "s_y"], ext).select(*ID, *rounded(["pca_index"]))


def _standard_train(spark, folder):
    series, ext = event_runs(spark, folder, FOLDS)
    rows = event_roles(series.select(*ID, "bucket", "n", "x", "y"))
    return keep(directions.standardise_by_fold(rows.where("role = 'train'"), rows.where("role = 'train'"), FEATURES)), ext


define("draws", """
SELECT k, g1 / sqrt(g1 * g1 + g2 * g2) AS w1, g2 / sqrt(g1 * g1 + g2 * g2) AS w2 FROM (
  SELECT k, sqrt(-2 * ln((('0x' || substr(md5('w|' || k || '|0|r'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (('0x' || substr(md5('w|' || k || '|0|t'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS g1,
         sqrt(-2 * ln((('0x' || substr(md5('w|' || k || '|1|r'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (('0x' || substr(md5('w|' || k || '|1|t'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS g2
  FROM generate_series(0, 299) g(k))""")
define("drawn", "SELECT fold_id, asset_id, pos, k, round(w1 * s1 + w2 * s2, 9) AS v FROM f_std CROSS JOIN draws WHERE role = 'train'")
define("draw_asset", """
SELECT fold_id, asset_id, k, CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END AS mono,
       CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN abs(corr(v, pos)) ELSE 0 END AS trend, arg_min(v, pos) AS v0, arg_max(v, pos) AS v1
FROM (SELECT *, sign(v - lag(v) OVER (PARTITION BY fold_id, asset_id, k ORDER BY pos)) AS sg FROM drawn) GROUP BY fold_id, asset_id, k""")


@query(
    "random_weight_reference",
    sql("""
SELECT fold_id, count(*) AS n_draws, round(avg(f), 6) AS fitness_mean, round(max(f), 6) AS fitness_max, round(stddev_samp(f), 6) AS fitness_sd FROM (
  SELECT fold_id, k, round(avg(mono) + avg(trend) + exp(-stddev_pop(v1) / (avg(abs(v0 - v1)) + 1e-12)), 9) AS f FROM draw_asset GROUP BY fold_id, k) GROUP BY fold_id"""),
)
def random_weight_reference(spark, folder):
    """Fitness of 300 random unit-norm weight vectors per fold, as a reference for the search."""
    train, ext = _standard_train(spark, folder)
    fit = directions.linear_parameter_fitness(train, ["s_x", "s_y"], directions.random_directions(300, 2), ext)
    return fit.groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.round(F.avg("fitness"), 6).alias("fitness_mean"),
        F.round(F.max("fitness"), 6).alias("fitness_max"),
        F.round(F.stddev_samp("fitness"), 6).alias("fitness_sd"),
    )


@query("optimal_linear_parameter")
def optimal_linear_parameter(spark, folder):
    """Unit-norm weights per fold found by a narrowing candidate search."""
    train, ext = _standard_train(spark, folder)
    return directions.best_linear_parameter(train, ["s_x", "s_y"], ext)


@query("tie_and_bound_diagnostics", sql("""
SELECT dataset, series, round(median(tie), 6) AS frac_tie, round(median(at0), 6) AS frac_at_0, round(median(at1), 6) AS frac_at_1, median(np)::DOUBLE AS n_pos, median(nn)::DOUBLE AS n_neg FROM (
  SELECT dataset, asset_id, series, sum(CASE WHEN sg = 0 THEN 1 ELSE 0 END) / NULLIF(count(*) - 1, 0)::DOUBLE AS tie, avg(CASE WHEN v <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS at0, avg(CASE WHEN v >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS at1,
         sum(CASE WHEN sg > 0 THEN 1 ELSE 0 END)::DOUBLE AS np, sum(CASE WHEN sg < 0 THEN 1 ELSE 0 END)::DOUBLE AS nn
  FROM (SELECT *, sign(round(v - lag(v) OVER (PARTITION BY asset_id, series ORDER BY pos), 9)) AS sg FROM (
    SELECT dataset, asset_id, pos, 'abnormality' AS series, en AS v FROM held UNION ALL SELECT dataset, asset_id, pos, 'state_change', cn FROM held UNION ALL SELECT dataset, asset_id, pos, 'index', idx FROM held)) GROUP BY ALL) GROUP BY ALL"""))
def tie_and_bound_diagnostics(spark, folder):
    held, _, ext = event_index(spark, folder)
    longs = long_indicators(held, ["dataset", "asset_id", "pos", "n"], {"abnormality": "E_norm", "state_change": "C_norm", "index": "index"}).withColumnRenamed("indicator", "series")
    keys = ["dataset", "asset_id", "series"]
    rows = ordered.neighbours(longs, keys, {"_p": ("value", 1)}, ext)
    s = F.signum(F.round(F.col("value") - F.col("_p"), 9))
    per = rows.groupBy(*keys).agg(
        (F.sum((s == 0).cast("double")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("tie"),
        F.avg((F.col("value") <= 0).cast("double")).alias("at0"), F.avg((F.col("value") >= 1).cast("double")).alias("at1"),
        F.coalesce(F.sum((s > 0).cast("double")), F.lit(0.0)).alias("np"), F.coalesce(F.sum((s < 0).cast("double")), F.lit(0.0)).alias("nn"),
    )
    out = ordered.quantiles(per, ["dataset", "series"], {"frac_tie": ("tie", 0.5), "frac_at_0": ("at0", 0.5), "frac_at_1": ("at1", 0.5), "n_pos": ("np", 0.5), "n_neg": ("nn", 0.5)}, ext.assets)
    return out.select("dataset", "series", *rounded(["frac_tie", "frac_at_0", "frac_at_1"]), "n_pos", "n_neg")
