"""Queries that repeat the index under other settings, and its smoothed quality table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import directions, health, labels, ordered, quality
from ..operators.ordered import keep
from ..sources.tables import KEY, dataset_number, event_runs, event_series
from .pipelines import FEATURES, event_components, event_index, event_roles, long_indicators
from .registry import query
from .sqlkit import FOLDS, criteria, define, sql

SETTINGS = [("beta", 0.1, 1.0, 99.0), ("beta", 0.2, 1.0, 99.0), ("beta", 0.3, 1.0, 99.0), ("bounds", 0.2, 0.0, 100.0), ("bounds", 0.2, 5.0, 95.0)]

_raw = criteria("q_long", "indicator, asset_id", "v0")
_smooth = criteria("q_smooth", "indicator, asset_id", "v0")
define("q_long", """
SELECT asset_id, pos, n, 'abnormality' AS indicator, round(en, 9) AS v0 FROM held UNION ALL SELECT asset_id, pos, n, 'index', idx FROM held UNION ALL SELECT asset_id, pos, n, 'value_x', x FROM held""")
define("q_smooth", """
SELECT a.indicator, a.asset_id, a.pos, round(median(b.v0), 9) AS v0 FROM (SELECT *, GREATEST(3, CAST(round_even(0.05::DOUBLE * n, 0) AS BIGINT)) AS w FROM q_long) a
JOIN q_long b ON a.indicator = b.indicator AND a.asset_id = b.asset_id AND b.pos BETWEEN a.pos - a.w // 2 AND a.pos + (a.w - 1) // 2 GROUP BY ALL""")


@query(
    "indicator_quality_smoothed",
    sql(
        """
SELECT r.indicator, r.n, r.mono, r.trend, r.progn, s.mono AS mono_smooth, s.trend AS trend_smooth, s.progn AS progn_smooth FROM
  (SELECT indicator, count(*) AS n, round(median(monotonicity), 6) AS mono, round(median(trendability), 6) AS trend, round(exp(-stddev_pop(last_value) / (avg(abs(first_value - last_value)) + 1e-12)), 6) AS progn FROM raw_crit GROUP BY indicator) r JOIN
  (SELECT indicator, round(median(monotonicity), 6) AS mono, round(median(trendability), 6) AS trend, round(exp(-stddev_pop(last_value) / (avg(abs(first_value - last_value)) + 1e-12)), 6) AS progn FROM smooth_crit GROUP BY indicator) s ON r.indicator = s.indicator""",
        raw_rows=_raw["crit_rows"],
        raw_crit=_raw["crit"].replace("crit_rows", "raw_rows"),
        smooth_rows=_smooth["crit_rows"],
        smooth_crit=_smooth["crit"].replace("crit_rows", "smooth_rows"),
    ),
)
def indicator_quality_smoothed(spark, folder):
    """Quality of each indicator raw and after the centred rolling median over five per cent of a life."""
    held, _, ext = event_index(spark, folder)
    held = held.withColumn("e9", F.round("E_norm", 9))
    rows = long_indicators(held, ["asset_id", "pos", "n"], {"abnormality": "e9", "index": "index", "value_x": "x"})
    keys = ["indicator", "asset_id"]
    smooth = keep(ordered.rolling_median(rows, keys, "value", "_s", ext).withColumn("smooth", F.round("_s", 9)).drop("_s"))
    parts = []
    for column, tail in (("value", ""), ("smooth", "_smooth")):
        t = quality.quality_table(quality.asset_criteria(smooth, keys, column, ext), ["indicator"], ext.assets)
        names = {"monotonicity_median": f"mono{tail}", "trendability_median": f"trend{tail}", "prognosability": f"progn{tail}"}
        parts.append(t.select("indicator", F.col("n_assets").alias(f"n{tail}"), *[F.round(k, 6).alias(v) for k, v in names.items()]))
    return parts[0].join(parts[1].drop("n_smooth"), "indicator")


_LABEL_FREE = "SELECT n.*, p.am, p.bm FROM normed n JOIN picked_mono p USING (fold_id) WHERE role = 'test'"
_t_raw, _t_smooth = criteria("t_long", "dataset, indicator, asset_id", "v0"), criteria("t_smooth", "dataset, indicator, asset_id", "v0")
_SUMMARY = """SELECT dataset, indicator, round(median(monotonicity), 6) AS mono, round(min(trendability), 6) AS trend_min, round(median(trendability), 6) AS trend, round(median(rho), 6) AS rho,
  round(exp(-stddev_pop(last_value) / (avg(abs(first_value - last_value)) + 1e-12)), 6) AS progn, count(*) AS n_assets"""


@query(
    "indicator_table",
    sql(
        """
SELECT r.dataset, r.indicator, r.mono, r.trend_min, r.trend, r.rho, r.progn, r.n_assets, s.mono AS mono_smooth, s.trend_min AS trend_min_smooth, s.trend AS trend_smooth, s.rho AS rho_smooth, s.progn AS progn_smooth
FROM t_raw_summary r JOIN t_smooth_summary s ON r.dataset = s.dataset AND r.indicator = s.indicator""",
        t_free=_LABEL_FREE,
        t_pc_turn="""
SELECT asset_id, CASE WHEN count(*) >= 3 AND stddev_pop(pc1) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS rho FROM (
  SELECT asset_id, pos, pc1, rank() OVER (PARTITION BY asset_id ORDER BY pc1) + (count(*) OVER (PARTITION BY asset_id, pc1) - 1) / 2.0::DOUBLE AS rk FROM f_pc) GROUP BY asset_id""",
        t_long="""
SELECT dataset, asset_id, pos, n, 'index' AS indicator, idx AS v0 FROM held UNION ALL
SELECT dataset, asset_id, pos, n, 'index_label_free', round(am * en + bm * cn, 9) FROM t_free UNION ALL
SELECT dataset, asset_id, pos, n, 'abnormality', round(en, 9) FROM held UNION ALL
SELECT dataset, asset_id, pos, n, 'principal_component', round(CASE WHEN rho < 0 THEN -pc1 ELSE pc1 END, 9) FROM f_pc JOIN t_pc_turn USING (asset_id) UNION ALL
SELECT dataset, asset_id, pos, n, 'value_x', x FROM held UNION ALL
SELECT dataset, asset_id, pos, n, 'value_y', y FROM held""",
        t_smooth="""
SELECT a.dataset, a.indicator, a.asset_id, a.pos, round(median(b.v0), 9) AS v0 FROM (SELECT *, GREATEST(3, CAST(round_even(0.05::DOUBLE * n, 0) AS BIGINT)) AS w FROM t_long) a
JOIN t_long b ON a.indicator = b.indicator AND a.asset_id = b.asset_id AND b.pos BETWEEN a.pos - a.w // 2 AND a.pos + (a.w - 1) // 2 GROUP BY ALL""",
        t_raw_rows=_t_raw["crit_rows"],
        t_raw_crit=_t_raw["crit"].replace("crit_rows", "t_raw_rows"),
        t_smooth_rows=_t_smooth["crit_rows"],
        t_smooth_crit=_t_smooth["crit"].replace("crit_rows", "t_smooth_rows"),
        t_raw_summary=_SUMMARY + " FROM t_raw_crit GROUP BY dataset, indicator",
        t_smooth_summary=_SUMMARY + " FROM t_smooth_crit GROUP BY dataset, indicator",
    ),
)
def indicator_table(spark, folder):
    """Every indicator by dataset, raw and after the centred rolling median: index, label-free index, abnormality, PC1, features."""
    comp, ext = event_components(spark, folder)
    params = keep(health.fit_both_index(comp, FOLDS, ext, dataset_number()))
    rows = event_roles(comp.select("dataset", "asset_id", "bucket", "pos", "n", "x", "y", "E", "C"))
    # the held-out rows keep their columns through the principal component, so they meet themselves in no join
    held = health.apply_index(directions.pca_index_by_fold(rows, FEATURES, ext), params)
    free = F.round(F.col("a_mono") * F.col("E_norm") + F.col("b_mono") * F.col("C_norm"), 9)
    held = held.withColumns({"free": free, "e9": F.round("E_norm", 9), "pc": F.round("pca_index", 9)})
    ids = ["dataset", "asset_id", "pos", "n"]
    columns = {"index": "index", "index_label_free": "free", "abnormality": "e9", "principal_component": "pc", "value_x": "x", "value_y": "y"}
    return _raw_and_smooth(long_indicators(held, ids, columns), ["dataset", "indicator", "asset_id"], ext)


def _raw_and_smooth(longs, keys, ext):
    smooth = keep(ordered.rolling_median(longs, keys, "value", "_s", ext).withColumn("smooth", F.round("_s", 9)).drop("_s"))
    names = {"monotonicity_median": "mono", "trendability_min": "trend_min", "trendability_median": "trend", "rho_median": "rho", "prognosability": "progn"}
    parts = []
    for column, tail in (("value", ""), ("smooth", "_smooth")):
        t = quality.quality_table(quality.asset_criteria(smooth, keys, column, ext), keys[:2], ext.assets)
        parts.append(t.select(*keys[:2], *[F.round(k, 6).alias(v + tail) for k, v in names.items()], *([] if tail else ["n_assets"])))
    return parts[0].join(parts[1], keys[:2])


@query("waveform_indicator_table")
def waveform_indicator_table(spark, folder):
    """The same table for the ten window features: RMS, kurtosis, abnormality, PC1, best linear parameter, both indices.

    Directions and weights are fitted per fold on the training assets of the fold's dataset.
    """
    from .artifacts import FEATURES as TEN
    from .waveform_queries import waveform_components

    comp, ext = waveform_components(spark, folder)
    params = keep(health.fit_both_index(comp, FOLDS, ext, dataset_number()))
    rows = health.assign_roles(comp.select("asset_id", "pos", "n", "E", "C", *TEN), FOLDS, dataset=dataset_number())
    rows = keep(rows.withColumn("dataset", F.concat(F.lit("d"), dataset_number())))
    held = health.apply_index(rows.where("role = 'test'"), params)
    std = keep(directions.standardise_by_fold(rows, rows.where("role = 'train'"), TEN))
    scaled = [f"s_{c}" for c in TEN]
    best = directions.best_linear_parameter(std.where("role = 'train'"), scaled, ext)
    linear = std.where("role = 'test'").join(F.broadcast(best), "fold_id")  # one row per fold
    linear = linear.select("asset_id", "pos", sum((F.col("weights")[k] * F.col(c) for k, c in enumerate(scaled)), F.lit(0.0)).alias("optimal"))
    pc = directions.pca_index_by_fold(rows, TEN, ext).select("asset_id", "pos", F.col("pca_index").alias("pc"))
    held = held.withColumns({"free": F.col("a_mono") * F.col("E_norm") + F.col("b_mono") * F.col("C_norm"), "rms": F.col("rms_x") + F.col("rms_y"), "kurtosis": F.col("kurt_x") + F.col("kurt_y")})
    held = held.join(pc, ["asset_id", "pos"]).join(linear, ["asset_id", "pos"])
    columns = {"rms": "rms", "kurtosis": "kurtosis", "abnormality": "E_norm", "principal_component": "pc", "optimal_parameter": "optimal", "index_label_free": "free", "index": "index"}
    return _raw_and_smooth(long_indicators(held, ["dataset", "asset_id", "pos", "n"], columns), ["dataset", "indicator", "asset_id"], ext)


@query("index_sensitivity")
def index_sensitivity(spark, folder):
    """Index quality for other baseline fractions and bounds, with how often the fallbacks applied."""
    parts, (series, ext) = None, event_runs(spark, folder, FOLDS)
    runs = keep(series), ext
    # the components depend on the baseline fraction alone, so settings with other bounds share them
    made = {beta: event_components(spark, folder, "auto", runs, fraction=beta)[0] for beta in dict.fromkeys(s[1] for s in SETTINGS)}
    for setting, beta, lo, hi in SETTINGS:
        comp = made[beta]
        params = keep(health.fit_index(comp, FOLDS, ext, lo=lo, hi=hi, dataset=dataset_number()))
        held = health.apply_index(event_roles(comp.select("asset_id", "bucket", "pos", "n", "E", "C")).where("role = 'test'"), params)
        longs = long_indicators(held, ["asset_id", "pos", "n"], {"index": "index", "abnormality": "E_norm"})
        t = quality.quality_table(quality.asset_criteria(longs, ["indicator", "asset_id"], "value", ext), ["indicator"], ext.assets)
        head = comp.where("pos = 0")
        info = head.agg(
            F.sum((F.col("estimator") == "diagonal").cast("bigint")).alias("n_diagonal"),
            F.sum((F.col("n_base") / F.col("n") > beta + 0.005).cast("bigint")).alias("n_baseline_enlarged"),
        ).join(params.agg(F.percentile("a", F.lit(0.5)).alias("a_median")))
        one = t.join(F.broadcast(info)).select(  # a single row
            F.lit(setting).alias("setting"), F.lit(beta).alias("beta"), F.lit(f"{lo:g}/{hi:g}").alias("bounds"), "indicator",
            *rounded(["monotonicity_median", "trendability_median", "prognosability", "a_median"]), "n_diagonal", "n_baseline_enlarged", "n_assets",
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


define("h0_rows", """
SELECT h::DOUBLE AS h0, dataset, asset_id, pos, n, x, y, LEAST(1, (GREATEST(n - 1, 1) - pos) / GREATEST(0.6::DOUBLE * GREATEST(n - 1, 1), 1)) AS rul, pos < GREATEST(5, floor(h::DOUBLE * n)) AS base FROM ev, (VALUES (0.1), (0.2), (0.3)) t(h) WHERE n >= 12""")
define("h0_mom", "SELECT h0, asset_id, avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS a, var_samp(y) + 1e-6 AS b, covar_samp(x, y) AS o FROM h0_rows WHERE base GROUP BY ALL")
define("h0_e", "SELECT r.*, round(sqrt(GREATEST((b * power(x - mx, 2) - 2 * o * (x - mx) * (y - my) + a * power(y - my, 2)) / (a * b - o * o), 0) + 1e-9), 9) AS e FROM h0_rows r JOIN h0_mom m ON r.h0 = m.h0 AND r.asset_id = m.asset_id")
define("h0_rank", """
SELECT *, rank() OVER (PARTITION BY h0, asset_id ORDER BY e) + (count(*) OVER (PARTITION BY h0, asset_id, e) - 1) / 2.0::DOUBLE AS re, rank() OVER (PARTITION BY h0, asset_id ORDER BY rul) + (count(*) OVER (PARTITION BY h0, asset_id, rul) - 1) / 2.0::DOUBLE AS rr FROM h0_e""")


@query(
    "healthy_fraction_sensitivity",
    sql("""
SELECT h0, dataset, round(median(rho), 6) AS median_abs_rho, count(*) AS n_assets FROM (
  SELECT h0, dataset, asset_id, CASE WHEN stddev_pop(e) >= 1e-12 AND stddev_pop(rul) >= 1e-12 THEN abs(corr(re, rr)) ELSE 0 END AS rho FROM h0_rank GROUP BY ALL) GROUP BY h0, dataset"""),
)
def healthy_fraction_sensitivity(spark, folder):
    """Rank correlation of plain-covariance abnormality with capped life for several healthy fractions."""
    series, ext = event_series(spark, folder)
    rows = series.where("n >= 12").withColumn("h0", F.explode(F.array(*[F.lit(h) for h in (0.1, 0.2, 0.3)])))
    rows = rows.withColumns(
        {"n_base": F.greatest(F.lit(5), F.floor(F.col("n") * F.col("h0"))), "z_x": F.col("x"), "z_y": F.col("y"), "rul": labels.capped_rul(F.col("pos"), F.col("n"))}
    )
    keys = ["h0", *KEY]
    e = health.mahalanobis(rows, keys, FEATURES, "empirical", ridge=1e-6).withColumn("E", F.round("E", 9))
    rho = quality.spearman(e, ["dataset", *keys], "E", "rul", ext).withColumn("rho", F.abs("rho"))
    out = ordered.quantiles(rho, ["h0", "dataset"], {"m": ("rho", 0.5)}, ext.assets, also=[F.count(F.lit(1)).alias("n_assets")])
    return out.select("h0", "dataset", F.round("m", 6).alias("median_abs_rho"), "n_assets")


@query("position_and_ends", sql("""
SELECT asset_id, max(n) AS n, arg_min(x, pos) AS first_value, arg_max(x, pos) AS last_value, round(max(pos / GREATEST(n - 1, 1)::DOUBLE), 6) AS last_fraction FROM ev GROUP BY asset_id"""))
def position_and_ends(spark, folder):
    series, _ = event_series(spark, folder)
    return series.groupBy("asset_id").agg(
        F.max("n").alias("n"), F.min_by("x", "pos").alias("first_value"), F.max_by("x", "pos").alias("last_value"),
        F.round(F.max(labels.degradation(F.col("pos"), F.col("n"))), 6).alias("last_fraction"),
    )
