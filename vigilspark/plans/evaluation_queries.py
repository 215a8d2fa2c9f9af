"""Queries over predictions, their errors and the paired statistics, on the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import errors, folds, health, inference, joins, labels, ordered, regress
from ..operators.ordered import keep
from ..sources.tables import event_series, table
from .registry import query
from .sqlkit import FOLDS, define, sql
from .waveform_queries import FEATURES, waveform_components

SEEDS = 3
CONFIGS = {"mean": [], "x_only": ["x"], "xy": ["x", "y"], "clock": ["pos"], "xy_clock": ["x", "y", "pos"]}
PROPOSED = "xy"
DAK = ["dataset", "asset_id", "config"]
DAKS = [*DAK, "seed"]


# ------------------------------------------------------------------ SQL for the prediction table
define("target", "SELECT dataset, condition, asset_id, pos, n, x, y AS t, LEAST(1, (GREATEST(n - 1, 1) - pos) / GREATEST(0.6::DOUBLE * GREATEST(n - 1, 1), 1)) AS yt FROM ev")
define("dealt", f"SELECT *, CAST(s AS INT) AS seed, CAST((asset_id // (s + 1)) % {FOLDS} AS INT) AS fold_id FROM target, generate_series(0, {SEEDS - 1}) g(s)")
define("mom", f"""
SELECT d.seed, f::INT AS fold_id, count(*) AS m, avg(x) AS ax, avg(t) AS am, avg(pos) AS ap, avg(yt) AS ay, var_pop(x) AS vx, var_pop(t) AS vt, var_pop(pos) AS vp,
       covar_pop(x, t) AS cxt, covar_pop(x, pos) AS cxp, covar_pop(t, pos) AS ctp, covar_pop(x, yt) AS cxy, covar_pop(t, yt) AS cty, covar_pop(pos, yt) AS cpy
FROM dealt d, generate_series(0, {FOLDS - 1}) g(f) WHERE d.fold_id <> f GROUP BY d.seed, f""")
define("rid", """
SELECT *, m + 1 AS dg, m * cxt / sqrt(vx * vt) AS r12, m * cxp / sqrt(vx * vp) AS r13, m * ctp / sqrt(vt * vp) AS r23, m * cxy / sqrt(vx) AS c1, m * cty / sqrt(vt) AS c2, m * cpy / sqrt(vp) AS c3 FROM mom""")
define("coef", """
SELECT *, c1 / dg / sqrt(vx) AS b1, (dg * c1 - r12 * c2) / (dg * dg - r12 * r12) / sqrt(vx) AS b2x, (dg * c2 - r12 * c1) / (dg * dg - r12 * r12) / sqrt(vt) AS b2t, c3 / dg / sqrt(vp) AS b3,
       (c1 * (dg * dg - r23 * r23) - r12 * (c2 * dg - r23 * c3) + r13 * (c2 * r23 - dg * c3)) / det / sqrt(vx) AS bx,
       (dg * (c2 * dg - r23 * c3) - c1 * (r12 * dg - r23 * r13) + r13 * (r12 * c3 - c2 * r13)) / det / sqrt(vt) AS bt,
       (dg * (dg * c3 - c2 * r23) - r12 * (r12 * c3 - c2 * r13) + c1 * (r12 * r23 - dg * r13)) / det / sqrt(vp) AS bp
FROM (SELECT *, dg * (dg * dg - r23 * r23) - r12 * (r12 * dg - r23 * r13) + r13 * (r12 * r23 - dg * r13) AS det FROM rid)""")
_P = "round(LEAST(GREATEST({}, 0), 1), 9)"
define("pred", " UNION ALL ".join(
    f"SELECT d.seed, d.fold_id, dataset, condition, asset_id, pos, n, yt, '{name}' AS config, {_P.format(expr)} AS p FROM dealt d JOIN coef c ON c.seed = d.seed AND c.fold_id = d.fold_id"
    for name, expr in (
        ("mean", "ay"),
        ("x_only", "ay + b1 * (x - ax)"),
        ("xy", "ay + b2x * (x - ax) + b2t * (t - am)"),
        ("clock", "ay + b3 * (pos - ap)"),
        ("xy_clock", "ay + bx * (x - ax) + bt * (t - am) + bp * (pos - ap)"),
    )
))
define("fact", """
SELECT dataset, config, asset_id, seed, avg(abs(p - yt)) AS mae, sqrt(avg(power(p - yt, 2))) AS rmse, 1 - sum(power(p - yt, 2)) / (var_pop(yt) * count(*) + 1e-12) AS r2, max(n) AS n,
       avg(2 * GREATEST(p - yt, 0) + GREATEST(yt - p, 0)) AS asym_score, avg(abs(p - yt)) * ((GREATEST(max(n) - 1, 1)) * 10 / 3600.0::DOUBLE * 0.6::DOUBLE) AS mae_hours FROM pred GROUP BY ALL""")
define("sa", "SELECT dataset, config, asset_id, avg(mae) AS err, avg(mae_hours) AS hours, max(n) AS n FROM fact GROUP BY ALL")


def _predictions(spark, folder):
    series, ext = event_series(spark, folder)
    rows = series.withColumn("y_true", labels.capped_rul(F.col("pos"), F.col("n")))
    cols = ["dataset", "condition", "asset_id", "pos", "n", "x", "y", "y_true"]
    out = regress.predictions(rows.select(*cols), ["x", "y", "pos"], "y_true", CONFIGS, FOLDS, SEEDS)
    return out, ext


def _facts(spark, folder):
    """Per (asset, config, seed) errors: small, read by every statistic."""
    pred, ext = _predictions(spark, folder)
    keys = ["dataset", "config", "asset_id", "seed"]
    f = errors.regression_metrics(pred, keys)
    hours = labels.fail_at(F.col("n")) * F.lit(10.0) / F.lit(3600.0) * F.lit(0.6)
    return keep(f.withColumn("mae_hours", F.col("mae") * hours)), ext


def _seed_mean(spark, folder, metric="mae"):
    facts, ext = _facts(spark, folder)
    return inference.seed_average(facts, ["dataset", "config", "asset_id"], metric), ext


@query("ridge_predictions", sql("SELECT seed, asset_id, pos, config, round(yt, 6) AS y_true, p AS y_pred FROM pred".replace("p AS y_pred", "round(p, 9) AS y_pred")))
def ridge_predictions(spark, folder):
    """Held-out predictions of the train mean and of ridge fits solved from merged moments."""
    pred, _ = _predictions(spark, folder)
    return pred.select("seed", "asset_id", "pos", "config", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 9).alias("y_pred"))


@query("train_mean_predictor", sql("SELECT seed, fold_id, m AS n_rows, round(ay, 6) AS prediction FROM mom"))
def train_mean_predictor(spark, folder):
    series, _ = event_series(spark, folder)
    rows = series.withColumn("y_true", labels.capped_rul(F.col("pos"), F.col("n"))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    rows = rows.withColumn("bucket", F.pmod(F.floor(F.col("asset_id") / (F.col("seed") + 1)), F.lit(FOLDS)))
    parts = regress.moments(rows, ["seed", "bucket"], [], "y_true")
    train = regress.merge_moments(health.assign_roles(parts, FOLDS, "bucket").where("role <> 'test'"), ["seed", "fold_id"], 0)
    return train.select("seed", "fold_id", F.col("rows").cast("bigint").alias("n_rows"), F.round(F.col("mean")[0], 6).alias("prediction"))


@query("regression_errors", sql("SELECT dataset, config, asset_id, seed, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) + 0.0::DOUBLE AS r2, round(asym_score, 6) AS asym_score, round(mae_hours, 6) AS mae_hours FROM fact"))
def regression_errors(spark, folder):
    f, _ = _facts(spark, folder)
    return f.select("dataset", "config", "asset_id", "seed", "n", *rounded(["mae", "rmse", "r2", "asym_score", "mae_hours"]))


@query("phm_score", sql("""
SELECT seed, asset_id, config, round(sum(CASE WHEN d < 0 THEN exp(-d / 13) - 1 ELSE exp(d / 10) - 1 END), 6) AS phm FROM (SELECT seed, asset_id, config, (p - yt) * (GREATEST(n - 1, 1) * 10 / 3600.0::DOUBLE * 0.6::DOUBLE) AS d FROM pred) GROUP BY ALL"""))
def phm_score(spark, folder):
    pred, _ = _predictions(spark, folder)
    hours = (F.col("y_pred") - F.col("y_true")) * (labels.fail_at(F.col("n")) * F.lit(10.0) / F.lit(3600.0) * F.lit(0.6))
    return pred.groupBy("seed", "asset_id", "config").agg(F.round(F.sum(errors.phm_score(hours)), 6).alias("phm"))


@query("interval_coverage", sql("SELECT dataset, config, round(avg(CASE WHEN yt >= p - 0.25 AND yt <= p + 0.25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS picp, round(avg((p + 0.25) - (p - 0.25)), 6) AS mpiw FROM pred GROUP BY ALL"))
def interval_coverage(spark, folder):
    pred, _ = _predictions(spark, folder)
    rows = pred.withColumns({"lo": F.col("y_pred") - 0.25, "hi": F.col("y_pred") + 0.25})
    return errors.interval_metrics(rows, ["dataset", "config"], "lo", "hi").select("dataset", "config", *rounded(["picp", "mpiw"]))


@query("pinball_loss", sql("""
SELECT config, round((avg(GREATEST(0.1::DOUBLE * (yt - p + 0.2), -0.9::DOUBLE * (yt - p + 0.2))) + avg(GREATEST(0.5::DOUBLE * (yt - p), -0.5::DOUBLE * (yt - p))) + avg(GREATEST(0.9::DOUBLE * (yt - p - 0.2), -0.1::DOUBLE * (yt - p - 0.2)))) / 3, 6) AS pinball FROM pred GROUP BY config"""))
def pinball_loss(spark, folder):
    pred, _ = _predictions(spark, folder)
    parts = [errors.pinball(F.col("y_true"), F.col("y_pred") + shift, q) for q, shift in ((0.1, -0.2), (0.5, 0.0), (0.9, 0.2))]
    return pred.groupBy("config").agg(F.round((F.avg(parts[0]) + F.avg(parts[1]) + F.avg(parts[2])) / 3, 6).alias("pinball"))


define("prog", """
SELECT seed, dataset, config, asset_id, avg(CASE WHEN p >= 0.8::DOUBLE * yt AND p <= 1.2::DOUBLE * yt THEN 1.0::DOUBLE ELSE 0 END) AS alpha_lambda,
       (max(pos) - coalesce(max(CASE WHEN round(abs(p - yt), 9) > 0.1 THEN pos END), min(pos) - 1)) / count(*)::DOUBLE AS horizon FROM pred WHERE yt < 1 GROUP BY ALL""")


@query("prognostic_metrics", sql("SELECT seed, dataset, config, count(*) AS n, round(avg(alpha_lambda), 6) AS alpha_lambda, round(avg(horizon), 6) AS prognostic_horizon FROM prog GROUP BY ALL"))
def prognostic_metrics(spark, folder):
    pred, _ = _predictions(spark, folder)
    per = errors.prognostic_metrics(pred, DAKS)
    return per.groupBy("seed", "dataset", "config").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("alpha_lambda"), 6).alias("alpha_lambda"), F.round(F.avg("prognostic_horizon"), 6).alias("prognostic_horizon")
    )


def _stage(v: str) -> str:
    return f"CASE WHEN {v} >= 0.95::DOUBLE THEN 3 WHEN {v} >= 0.8::DOUBLE THEN 2 WHEN {v} >= 0.6::DOUBLE THEN 1 ELSE 0 END"


define("staged", f"SELECT seed, config, dataset, asset_id, pos, n, yt, p, {_stage('pos / GREATEST(n - 1, 1)::DOUBLE')} AS st, {_stage('round(1 - 0.6::DOUBLE * p, 9)')} AS sp FROM pred")
define("snapped", """
SELECT seed, config, dataset, asset_id, pos // 3 AS snapshot_id, arg_min(st, pos) AS st, avg(p) AS p, arg_min(yt, pos) AS yt, count(*) AS n_windows FROM staged GROUP BY ALL""")
define("votes", """
SELECT seed, config, asset_id, snapshot_id, sp FROM (SELECT *, row_number() OVER (PARTITION BY seed, config, asset_id, snapshot_id ORDER BY c DESC, sp) AS r FROM (SELECT seed, config, asset_id, pos // 3 AS snapshot_id, sp, count(*) AS c FROM staged GROUP BY ALL)) WHERE r = 1""")
define("snapv", "SELECT s.*, v.sp FROM snapped s JOIN votes v USING (seed, config, asset_id, snapshot_id)")


def _snapshots(spark, folder):
    pred, _ = _predictions(spark, folder)
    rows = pred.withColumns(
        {
            "stage_true": labels.staged(labels.degradation(F.col("pos"), F.col("n")), labels.STAGE_LIFE),
            "stage_pred": labels.staged(F.round(1 - F.lit(0.6) * F.col("y_pred"), 9), labels.STAGE_LIFE),
            "snapshot_id": F.floor(F.col("pos") / 3),
        }
    )
    return errors.to_snapshots(rows, ["seed", "config", "dataset", "asset_id", "snapshot_id"], votes=["stage_pred"], firsts=["stage_true", "y_true"], means=["y_pred"])


@query("snapshot_predictions", sql("SELECT seed, config, asset_id, snapshot_id, sp AS stage_pred, st AS stage_true, round(p, 10) AS y_pred, round(yt, 6) AS y_true, n_windows FROM snapv"))
def snapshot_predictions(spark, folder):
    s = _snapshots(spark, folder)
    return s.select("seed", "config", "asset_id", "snapshot_id", "stage_pred", "stage_true", *rounded(["y_pred"], 10), *rounded(["y_true"]), "n_windows")


define("cls", """
SELECT seed, config, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT seed, config, st AS label, (st = sp)::INT AS tp, 0 AS fp, (st <> sp)::INT AS fn FROM snapv UNION ALL SELECT seed, config, sp, 0, (st <> sp)::INT, 0 FROM snapv) GROUP BY ALL""")


@query("stage_classification", sql("""
SELECT seed, config, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS accuracy, round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS macro_f1, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END), 6) AS balanced_accuracy FROM cls GROUP BY seed, config"""))
def stage_classification(spark, folder):
    m = errors.classification_metrics(_snapshots(spark, folder), ["seed", "config"], "stage_true", "stage_pred")
    return m.select("seed", "config", *rounded(["accuracy", "macro_f1", "balanced_accuracy"]))


@query("evaluation_record", sql("""
SELECT f.seed, f.dataset, f.config, f.asset_id, round(f.mae, 6) AS mae, round(f.rmse, 6) AS rmse, round(f.r2, 6) + 0.0::DOUBLE AS r2, round(f.mae_hours, 6) AS mae_hours, round(s.acc, 6) AS stage_acc, round(q.alpha_lambda, 6) AS alpha_lambda, round(q.horizon, 6) AS prognostic_horizon
FROM fact f JOIN (SELECT seed, config, asset_id, avg((st = sp)::INT) AS acc FROM snapv GROUP BY ALL) s ON s.seed = f.seed AND s.config = f.config AND s.asset_id = f.asset_id LEFT JOIN prog q ON q.seed = f.seed AND q.config = f.config AND q.asset_id = f.asset_id"""))
def evaluation_record(spark, folder):
    """One wide record per (asset, configuration, seed)."""
    facts, _ = _facts(spark, folder)
    pred, _ = _predictions(spark, folder)
    acc = errors.classification_metrics(_snapshots(spark, folder), DAKS, "stage_true", "stage_pred").select(*DAKS, F.col("accuracy").alias("stage_acc"))
    prog = errors.prognostic_metrics(pred, DAKS)
    out = facts.join(acc, DAKS).join(prog, DAKS, "left")
    return out.select(*DAKS, *rounded(["mae", "rmse", "r2", "mae_hours", "stage_acc", "alpha_lambda", "prognostic_horizon"]))


# ------------------------------------------------------------------ summaries
_S = "round(median({0}), 6) AS {1}_median, round(quantile_cont({0}, 0.25), 6) AS {1}_q25, round(quantile_cont({0}, 0.75), 6) AS {1}_q75, round(max({0}), 6) AS {1}_worst, round(avg({0}), 6) AS {1}_mean, round(coalesce(stddev_samp({0}), 0), 6) AS {1}_std"


@query("main_results", sql(f"SELECT s.dataset, s.config, 3 AS n_seeds, count(*) AS n_assets, {_S.format('err', 'norm')}, {_S.format('hours', 'hours')}, any_value(r) AS rmse_mean FROM sa s JOIN (SELECT dataset, config, round(avg(rmse), 6) AS r FROM fact GROUP BY ALL) q ON q.dataset = s.dataset AND q.config = s.config GROUP BY s.dataset, s.config"))
def main_results(spark, folder):
    facts, ext = _facts(spark, folder)
    keys = ["dataset", "config"]
    size = ext.assets
    norm = inference.summary(inference.seed_average(facts, [*keys, "asset_id"], "mae"), keys, "err", size, "norm")
    hours = inference.summary(inference.seed_average(facts, [*keys, "asset_id"], "mae_hours"), keys, "err", size, "hours")
    other = facts.groupBy(*keys).agg(F.countDistinct("seed").cast("int").alias("n_seeds"), F.avg("rmse").alias("rmse_mean"))
    out = norm.withColumnRenamed("norm_n", "n_assets").join(hours, keys).join(other, keys)
    names = [f"{p}_{c}" for p in ("norm", "hours") for c in ("median", "q25", "q75", "worst", "mean", "std")]
    return out.select(*keys, "n_seeds", "n_assets", *rounded([*names, "rmse_mean"]))


@query("fold_metric_summary", sql("""
SELECT dataset, config, seed, count(*) AS n, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std, round(median(mae), 6) AS mae_median, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std, round(avg(asym_score), 6) AS asym_score_mean, round(stddev_samp(asym_score), 6) AS asym_score_std FROM fact GROUP BY ALL"""))
def fold_metric_summary(spark, folder):
    facts, ext = _facts(spark, folder)
    aggs = [f(m).alias(f"{m}_{t}") for m in ("mae", "rmse", "r2", "asym_score") for f, t in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    out = ordered.quantiles(facts, ["dataset", "config", "seed"], {"mae_median": ("mae", 0.5)}, ext.assets, also=[F.count(F.lit(1)).alias("n"), *aggs])
    return out.select("dataset", "config", "seed", "n", *rounded([c for c in out.columns if c not in ("dataset", "config", "seed", "n")]))


@query("seed_variability", sql("""
SELECT dataset, config, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max FROM (SELECT dataset, config, seed, avg(mae) AS m FROM fact GROUP BY ALL) GROUP BY ALL"""))
def seed_variability(spark, folder):
    facts, _ = _facts(spark, folder)
    per = facts.groupBy("dataset", "config", "seed").agg(F.avg("mae").alias("m"))
    return per.groupBy("dataset", "config").agg(*[F.round(f("m"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))])


@query("pivoted_errors", sql("""
SELECT dataset, asset_id, round(max(CASE WHEN config = 'mean' THEN err END), 6) AS mean, round(max(CASE WHEN config = 'x_only' THEN err END), 6) AS x_only, round(max(CASE WHEN config = 'xy' THEN err END), 6) AS xy, round(max(CASE WHEN config = 'clock' THEN err END), 6) AS clock, round(max(CASE WHEN config = 'xy_clock' THEN err END), 6) AS xy_clock FROM sa GROUP BY ALL"""))
def pivoted_errors(spark, folder):
    sa, _ = _seed_mean(spark, folder)
    return sa.groupBy("dataset", "asset_id").pivot("config", list(CONFIGS)).agg(F.round(F.first("err"), 6))


@query("failure_cases", sql("""
SELECT dataset, asset_id, n, round(err, 6) AS mae, kind, place FROM (
  SELECT *, CASE WHEN d <= 3 THEN 'WORST' WHEN u <= 2 THEN 'BEST' END AS kind, CASE WHEN d <= 3 THEN d ELSE u END AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY e9 DESC, asset_id DESC) AS d, row_number() OVER (PARTITION BY dataset ORDER BY e9, asset_id) AS u FROM (SELECT *, round(err, 9) AS e9 FROM sa WHERE config = 'xy'))) WHERE kind IS NOT NULL"""))
def failure_cases(spark, folder):
    facts, ext = _facts(spark, folder)
    sa = facts.where(F.col("config") == PROPOSED).groupBy("dataset", "asset_id").agg(F.round(F.avg("mae"), 9).alias("err"), F.max("n").alias("n"))
    out = joins.extreme_rows(sa, ["dataset"], "err", 3, 2, "asset_id", ext.assets)
    return out.select("dataset", "asset_id", "n", F.round("err", 6).alias("mae"), "kind", "place")


@query("error_vs_lifetime", sql("""
SELECT dataset, round(corr(re, rn), 6) AS rho FROM (
  SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY e9) + (count(*) OVER (PARTITION BY dataset, e9) - 1) / 2.0::DOUBLE AS re, rank() OVER (PARTITION BY dataset ORDER BY n) + (count(*) OVER (PARTITION BY dataset, n) - 1) / 2.0::DOUBLE AS rn
  FROM (SELECT *, round(err, 9) AS e9 FROM sa WHERE config = 'xy')) GROUP BY dataset"""))
def error_vs_lifetime(spark, folder):
    from ..operators import quality

    facts, ext = _facts(spark, folder)
    sa = facts.where(F.col("config") == PROPOSED).groupBy("dataset", "asset_id").agg(F.round(F.avg("mae"), 9).alias("err"), F.max("n").alias("life"))
    return quality.spearman(sa, ["dataset"], "err", "life", ext.assets).select("dataset", *rounded(["rho"]))


@query("per_condition_errors", sql("""
SELECT coalesce(regexp_extract(name, '^(.*)_', 1), 'ALL') AS condition, count(*) AS n, round(avg(e), 6) AS mae FROM (SELECT dataset || '_' || asset_id AS name, err AS e FROM sa WHERE config = 'xy') GROUP BY ROLLUP (regexp_extract(name, '^(.*)_', 1))"""))
def per_condition_errors(spark, folder):
    """Condition parsed from the asset name, with an overall row."""
    sa, _ = _seed_mean(spark, folder)
    named = sa.where(F.col("config") == PROPOSED).withColumn("condition", F.regexp_extract(F.concat_ws("_", "dataset", "asset_id"), "^(.*)_", 1))
    out = named.rollup("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("err"), 6).alias("mae"))
    return out.withColumn("condition", F.coalesce("condition", F.lit("ALL")))


@query("formatted_report", sql("""
SELECT dataset, config, printf('%.3f±%.3f', m, s) AS mae FROM (SELECT dataset, config, round(avg(err), 6) AS m, round(stddev_samp(err), 6) AS s FROM sa GROUP BY ALL)"""))
def formatted_report(spark, folder):
    sa, _ = _seed_mean(spark, folder)
    out = sa.groupBy("dataset", "config").agg(F.round(F.avg("err"), 6).alias("m"), F.round(F.stddev_samp("err"), 6).alias("s"))
    return out.select("dataset", "config", F.format_string("%.3f±%.3f", "m", "s").alias("mae"))


@query("per_asset_appendix", sql("SELECT dataset, asset_id, config, n, round(err, 6) AS mae, round(hours, 6) AS mae_hours FROM sa"))
def per_asset_appendix(spark, folder):
    facts, _ = _facts(spark, folder)
    out = facts.groupBy("dataset", "asset_id", "config").agg(F.max("n").alias("n"), F.avg("mae").alias("mae"), F.avg("mae_hours").alias("mae_hours"))
    return out.select("dataset", "asset_id", "config", "n", *rounded(["mae", "mae_hours"])).orderBy("dataset", "asset_id", "config")


@query("distinct_and_value_counts", sql("SELECT seed, config, count(DISTINCT asset_id) AS assets, count(DISTINCT sp) AS stages, sum((sp = 0)::INT)::BIGINT AS n_stage0, sum((sp = 3)::INT)::BIGINT AS n_stage3, sum((sp = st)::INT)::BIGINT || '/' || count(*) AS hits FROM snapv GROUP BY seed, config"))
def distinct_and_value_counts(spark, folder):
    s = _snapshots(spark, folder)
    hit = F.sum((F.col("stage_pred") == F.col("stage_true")).cast("bigint"))
    return s.groupBy("seed", "config").agg(
        F.countDistinct("asset_id").alias("assets"), F.countDistinct("stage_pred").alias("stages"),
        F.sum((F.col("stage_pred") == 0).cast("bigint")).alias("n_stage0"), F.sum((F.col("stage_pred") == 3).cast("bigint")).alias("n_stage3"),
        F.concat_ws("/", hit.cast("string"), F.count(F.lit(1)).cast("string")).alias("hits"),
    )


@query("trajectory_penalties", sql("""
SELECT seed, config, round(avg(rough), 6) AS roughness, round(avg(down), 6) AS mean_decrease, round(avg(up), 6) AS mean_increase FROM (
  SELECT seed, config, asset_id, coalesce(avg(b * b), 0) AS rough, coalesce(avg(GREATEST(-d, 0)), 0) AS down, coalesce(avg(GREATEST(d, 0)), 0) AS up FROM (
    SELECT seed, config, asset_id, p - lag(p) OVER w AS d, p - 2 * lag(p) OVER w + lag(p, 2) OVER w AS b FROM snapped WINDOW w AS (PARTITION BY seed, config, asset_id ORDER BY snapshot_id))
  GROUP BY ALL) GROUP BY seed, config""".replace("GREATEST(-d, 0)", "CASE WHEN d IS NOT NULL THEN GREATEST(-d, 0) END").replace("GREATEST(d, 0))", "CASE WHEN d IS NOT NULL THEN GREATEST(d, 0) END)")))
def trajectory_penalties(spark, folder):
    """Roughness and monotonicity penalties of the snapshot-level predicted trajectory."""
    from ..operators import quality

    s = _snapshots(spark, folder).withColumnRenamed("snapshot_id", "pos")
    _, ext = event_series(spark, folder)
    per = quality.trajectory_penalties(s, ["seed", "config", "asset_id"], "y_pred", ext)
    return per.groupBy("seed", "config").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("roughness", "mean_decrease", "mean_increase")])


# ------------------------------------------------------------------ constants, conformal, hours
@query("constant_predictors", sql("""
SELECT seed, dataset, predictor, round(avg(mae), 6) AS mae_mean, round(median(mae), 6) AS mae_median, round(avg(rmse), 6) AS rmse_mean FROM (
  SELECT seed, dataset, asset_id, 'constant_half' AS predictor, avg(abs(yt - 0.5)) AS mae, sqrt(avg(power(yt - 0.5, 2))) AS rmse FROM pred WHERE config = 'mean' GROUP BY ALL
  UNION ALL SELECT seed, dataset, asset_id, config, mae, rmse FROM fact) GROUP BY ALL"""))
def constant_predictors(spark, folder):
    facts, ext = _facts(spark, folder)
    series, _ = event_series(spark, folder)
    half = series.select("dataset", "asset_id", "pos", labels.capped_rul(F.col("pos"), F.col("n")).alias("y_true")).withColumn("y_pred", F.lit(0.5))
    half = errors.regression_metrics(half, ["dataset", "asset_id"]).withColumn("predictor", F.lit("constant_half"))
    half = half.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))  # the same for every seed
    keys = ["seed", "dataset", "predictor"]
    cols = [*keys, "mae", "rmse"]
    both = half.select(*cols).unionByName(facts.withColumnRenamed("config", "predictor").select(*cols))
    out = ordered.quantiles(both, keys, {"mae_median": ("mae", 0.5)}, ext.assets, also=[F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean")])
    return out.select(*keys, *rounded(["mae_mean", "mae_median", "rmse_mean"]))


define("ring", "SELECT a.dataset, a.asset_id, b.asset_id AS cal FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY asset_id) - 1 AS p, count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT DISTINCT dataset, asset_id FROM ev)) a JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY asset_id) - 1 AS p FROM (SELECT DISTINCT dataset, asset_id FROM ev)) b ON a.dataset = b.dataset AND b.p = (a.p + 1) % a.m AND a.asset_id <> b.asset_id")
define("cq", """
SELECT seed, asset_id AS cal, al::DOUBLE AS alpha, count(*) AS m, max(CASE WHEN k = lo THEN r END) + (max(CASE WHEN k = hi THEN r END) - max(CASE WHEN k = lo THEN r END)) * max(ix - lo) AS q FROM (
  SELECT *, floor(ix) AS lo, ceil(ix) AS hi FROM (SELECT *, round(LEAST(ceil(round((m + 1) * (1 - al::DOUBLE), 9)) / m, 1) * (m - 1), 9) AS ix FROM (
    SELECT seed, asset_id, abs(p - yt) AS r, row_number() OVER (PARTITION BY seed, asset_id ORDER BY abs(p - yt), pos) - 1 AS k, count(*) OVER (PARTITION BY seed, asset_id) AS m FROM pred WHERE config = 'xy'), (VALUES (0.2), (0.1)) t(al)))
GROUP BY ALL""")


@query("conformal_intervals", sql("""
SELECT seed, dataset, round(1 - alpha, 2) AS nominal, round(avg(picp), 6) AS picp_mean, round(median(picp), 6) AS picp_median, round(min(picp), 6) AS picp_min, round(avg(mpiw), 6) AS mpiw_mean, count(*) AS n FROM (
  SELECT p.seed, r.dataset, r.asset_id, alpha, avg(CASE WHEN round(abs(p.p - yt), 9) <= round(q, 9) THEN 1.0::DOUBLE ELSE 0 END) AS picp, avg(2 * q) AS mpiw FROM ring r JOIN cq USING (cal) JOIN pred p ON p.asset_id = r.asset_id AND p.seed = cq.seed AND p.config = 'xy' GROUP BY ALL) GROUP BY ALL"""))
def conformal_intervals(spark, folder):
    """Split-conformal half-widths from the next asset's own held-out residuals."""
    pred, ext = _predictions(spark, folder)
    rows = keep(pred.where(F.col("config") == PROPOSED).withColumn("res", F.abs(F.col("y_pred") - F.col("y_true"))))
    pairs = errors.next_in_order(rows.where("pos = 0 AND seed = 0").select("dataset", "asset_id"), ["dataset"], ext.assets)
    q = errors.conformal_quantile(rows.select("seed", F.col("asset_id").alias("cal_asset"), "pos", "res"), ["seed", "cal_asset"], "res", (0.2, 0.1), ext)
    mine = pairs.join(q, "cal_asset").select("seed", "asset_id", "alpha", "q")
    inside = F.round("res", 9) <= F.round("q", 9)
    per = rows.join(mine, ["seed", "asset_id"]).groupBy("seed", "dataset", "asset_id", "alpha").agg(F.avg(inside.cast("double")).alias("picp"), F.avg(2 * F.col("q")).alias("mpiw"))
    out = ordered.quantiles(
        per.withColumn("nominal", F.round(1 - F.col("alpha"), 2)), ["seed", "dataset", "nominal"], {"picp_median": ("picp", 0.5)}, ext.assets,
        also=[F.avg("picp").alias("picp_mean"), F.min("picp").alias("picp_min"), F.avg("mpiw").alias("mpiw_mean"), F.count(F.lit(1)).alias("n")],
    )
    return out.select("seed", "dataset", "nominal", *rounded(["picp_mean", "picp_median", "picp_min", "mpiw_mean"]), "n")


define("lives", "SELECT asset_id, max(n) AS n, (GREATEST(max(n) - 1, 1)) * 10 / 3600.0::DOUBLE AS life FROM ev GROUP BY asset_id")


@query("deployable_hours", sql(f"""
SELECT seed, dataset, round(avg(err), 6) AS mae_norm_mean, round(median(err), 6) AS mae_norm_median, round(avg(err * life * 0.6::DOUBLE), 6) AS retrospective_mean, round(median(err * life * 0.6::DOUBLE), 6) AS retrospective_median,
       round(avg(err * dep * 0.6::DOUBLE), 6) AS deployable_mean, round(median(err * dep * 0.6::DOUBLE), 6) AS deployable_median
FROM (SELECT f.seed, f.dataset, f.asset_id, mae AS err, life, dep FROM fact f JOIN lives USING (asset_id) JOIN (SELECT s AS seed, g AS fold_id, avg(life) AS dep FROM lives, generate_series(0, {SEEDS - 1}) q(s), generate_series(0, {FOLDS - 1}) t(g) WHERE (asset_id // (s + 1)) % {FOLDS} <> g AND (asset_id // (s + 1)) % {FOLDS} <> (g + 1) % {FOLDS} GROUP BY s, g) d ON d.seed = f.seed AND d.fold_id = (f.asset_id // (f.seed + 1)) % {FOLDS} WHERE config = 'xy')
GROUP BY seed, dataset"""))
def deployable_hours(spark, folder):
    """Errors in hours on the true life scale and on the mean training life, which is known online."""
    facts, ext = _facts(spark, folder)
    series, _ = event_series(spark, folder)
    lives = series.groupBy("asset_id").agg((labels.fail_at(F.max("n")) * F.lit(10.0) / F.lit(3600.0)).alias("life"))
    dealt = lives.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    dealt = dealt.withColumn("bucket", F.pmod(F.floor(F.col("asset_id") / (F.col("seed") + 1)), F.lit(FOLDS)).cast("int"))
    roles = health.assign_roles(dealt, FOLDS, "bucket")
    dep = F.broadcast(roles.where("role = 'train'").groupBy("seed", "fold_id").agg(F.avg("life").alias("dep")))  # one row per seed and fold
    per = facts.where(F.col("config") == PROPOSED).join(roles.where("role = 'test'"), ["seed", "asset_id"]).join(dep, ["seed", "fold_id"])
    per = per.withColumns({"retro": F.col("mae") * F.col("life") * 0.6, "deploy": F.col("mae") * F.col("dep") * 0.6})
    names = {"mae_norm": "mae", "retrospective": "retro", "deployable": "deploy"}
    out = ordered.quantiles(
        per, ["seed", "dataset"], {f"{k}_median": (v, 0.5) for k, v in names.items()}, ext.assets, also=[F.avg(v).alias(f"{k}_mean") for k, v in names.items()]
    )
    return out.select("seed", "dataset", *rounded([f"{k}_{t}" for k in names for t in ("mean", "median")]))


@query("classical_hours_comparison", sql("""
SELECT dataset, config, round(avg(hours), 6) AS mae_hours_mean, round(stddev_samp(hours), 6) AS mae_hours_std, sum((round(err - e2, 9) > 0)::INT)::BIGINT || '/' || count(*) AS proposed_wins FROM (SELECT s.*, q.err AS e2 FROM sa s JOIN sa q ON q.asset_id = s.asset_id AND q.config = 'xy') GROUP BY ALL"""))
def classical_hours_comparison(spark, folder):
    facts, _ = _facts(spark, folder)
    sa = facts.groupBy(*DAK).agg(F.avg("mae").alias("err"), F.avg("mae_hours").alias("hours"))
    best = sa.where(F.col("config") == PROPOSED).select("asset_id", F.col("err").alias("e2"))
    wins = F.sum((F.round(F.col("err") - F.col("e2"), 9) > 0).cast("bigint"))
    return sa.join(best, "asset_id").groupBy("dataset", "config").agg(
        F.round(F.avg("hours"), 6).alias("mae_hours_mean"), F.round(F.stddev_samp("hours"), 6).alias("mae_hours_std"),
        F.concat_ws("/", wins.cast("string"), F.count(F.lit(1)).cast("string")).alias("proposed_wins"),
    )


# ------------------------------------------------------------------ paired tests
define("dif", "SELECT a.dataset, a.config AS arm, a.asset_id, a.err AS ea, b.err AS eb, round(a.err - b.err, 9) AS d FROM sa a JOIN sa b ON a.dataset = b.dataset AND a.asset_id = b.asset_id AND b.config = 'xy' WHERE a.config <> 'xy'")
define("sr", "SELECT *, rank() OVER (PARTITION BY dataset, arm ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, arm, abs(d)) - 1) / 2.0::DOUBLE AS r FROM dif WHERE d <> 0")
define("srs", "SELECT dataset, arm, count(*) AS nu, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm FROM sr GROUP BY ALL")


def _differences(spark, folder):
    """Seed-averaged error of each arm beside the proposal, paired by asset."""
    sa, ext = _seed_mean(spark, folder)
    base = sa.where(F.col("config") == PROPOSED).select("dataset", "asset_id", F.col("err").alias("b"))
    arms = sa.where(F.col("config") != PROPOSED).select("dataset", "asset_id", F.col("config").alias("arm"), F.col("err").alias("a"))
    return arms.join(base, ["dataset", "asset_id"]).withColumn("diff", F.round(F.col("a") - F.col("b"), 9)), ext.assets


@query("signed_rank_sums", sql("""
SELECT d.dataset, d.arm, count(*) AS n, round(avg(ea), 6) AS mean_a, round(avg(eb), 6) AS mean_b, round(median(d), 6) AS median_diff, any_value(wp) AS w_plus, any_value(wm) AS w_minus, round(any_value((wp - wm) / (wp + wm)), 6) AS rank_biserial, sum((d > 0)::INT)::BIGINT || '/' || count(*) AS wins_of
FROM dif d JOIN srs s ON s.dataset = d.dataset AND s.arm = d.arm GROUP BY d.dataset, d.arm"""))
def signed_rank_sums(spark, folder):
    diffs, ext = _differences(spark, folder)
    out = inference.paired_differences(diffs, ["dataset", "arm"], ext)
    return out.select("dataset", "arm", F.col("pairs").alias("n"), *rounded(["mean_a", "mean_b", "median_diff"]), "w_plus", "w_minus", *rounded(["rank_biserial"]), "wins_of")


@query("wilcoxon_tests")
def wilcoxon_tests(spark, folder):
    """Signed-rank p-values per dataset with the step-down adjustment over that dataset's arms."""
    diffs, ext = _differences(spark, folder)
    tests = inference.with_wilcoxon_p(inference.paired_differences(diffs, ["dataset", "arm"], ext))
    return inference.holm(tests, ["dataset"], "p_value", tie="arm").select("dataset", "arm", "n_used", *rounded(["p_value", "holm_p", "rank_biserial"]))


@query("holm_adjustment", sql("""
SELECT s_nationkey AS family, s_suppkey AS test, round(LEAST(1, max(s) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey)), 9) AS holm_p FROM (
  SELECT *, (count(*) OVER (PARTITION BY s_nationkey) - row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) + 1) * p AS s FROM (
    SELECT s_nationkey, s_suppkey, ('0x' || substr(md5(s_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE / 10 AS p FROM supplier))"""))
def holm_adjustment(spark, folder):
    from ..functions.scalars import uniform

    tests = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("test"), (uniform(F.col("s_name")) / 10).alias("p"))
    return inference.holm(tests, ["family"], "p", tie="test").select("family", "test", F.round("holm_p", 9).alias("holm_p"))


@query("mean_difference_t", sql("""
SELECT dataset, arm, count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round((avg(d) + 0.01) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_lo, round((avg(d) - 0.01) / (stddev_samp(d) / sqrt(count(*))), 4) AS t_hi FROM dif GROUP BY ALL"""))
def mean_difference_t(spark, folder):
    diffs, _ = _differences(spark, folder)
    out = inference.mean_difference(diffs, ["dataset", "arm"])
    return out.select("dataset", "arm", "n", *rounded(["mean_diff", "se"]), *rounded(["t_lo", "t_hi"], 4))


@query("bootstrap_interval", sql(
    "SELECT dataset, arm, round(quantile_cont(m, 0.025), 6) AS boot_lo, round(quantile_cont(m, 0.975), 6) AS boot_hi FROM replicate_means GROUP BY dataset, arm",
    hashed="SELECT dataset, arm, d, ('0x' || substr(md5('0|' || dataset || '|' || arm || '|' || asset_id), 1, 8))::BIGINT AS h FROM dif",
    first_mix="SELECT dataset, arm, d, b, (h * 48271 + b * 69621 + 1) % 2147483647 AS x FROM hashed, generate_series(0, 19999) t(b)",
    second_mix="SELECT dataset, arm, d, b, (x * x + 40692 * x + b) % 2147483647 AS x FROM first_mix",
    third_mix="SELECT dataset, arm, d, b, (x * x + 16807 * x + 7) % 2147483647 AS x FROM second_mix",
    counted="SELECT dataset, arm, d, b, " + " + ".join(f"(x >= {t})::INT" for t in inference.POISSON_LIMITS) + " AS k FROM third_mix",
    replicate_means="SELECT dataset, arm, b, sum(k * d) / sum(k) AS m FROM counted GROUP BY dataset, arm, b HAVING sum(k) > 0",
))
def bootstrap_interval(spark, folder):
    """95 % interval of the mean difference from 20,000 replicates."""
    diffs, _ = _differences(spark, folder)
    return inference.bootstrap_mean(diffs, ["dataset", "arm"]).select("dataset", "arm", *rounded(["boot_lo", "boot_hi"]))


@query("equivalence_tests")
def equivalence_tests(spark, folder):
    """Two one-sided t and signed-rank tests against a margin of 0.01, 90 and 95 % intervals, Holm over the arms."""
    diffs, ext = _differences(spark, folder)
    diffs = keep(diffs)
    keys = ["dataset", "arm"]
    out = inference.mean_difference(diffs, keys)
    out = out.withColumn("p_tost_t", inference.tost_p("n", "t_lo", "t_hi"))
    out = inference.with_interval(inference.with_interval(out, 0.90, "ci90_lo", "ci90_hi"), 0.95, "ci95_lo", "ci95_hi")
    up = inference.with_wilcoxon_p(inference.signed_ranks(diffs, keys, ext, shift=0.01), "greater", "_g").select(*keys, "_g")
    down = inference.with_wilcoxon_p(inference.signed_ranks(diffs, keys, ext, shift=-0.01), "less", "_l").select(*keys, "_l")
    out = out.join(up, keys).join(down, keys).withColumn("p_tost_wilcoxon", F.greatest("_g", "_l"))
    out = inference.holm(out, ["dataset"], "p_tost_t", "p_tost_holm", tie="arm")
    names = ["mean_diff", "ci90_lo", "ci90_hi", "ci95_lo", "ci95_hi", "p_tost_t", "p_tost_wilcoxon", "p_tost_holm"]
    return out.select(*keys, "n", *rounded(names), (F.col("p_tost_holm") < 0.05).alias("equivalent"))


@query("mean_with_t_interval")
def mean_with_t_interval(spark, folder):
    """Mean error with a 95 % t-interval per dataset and configuration."""
    sa, _ = _seed_mean(spark, folder)
    out = inference.mean_difference(sa.withColumn("diff", F.col("err")), ["dataset", "config"])
    return inference.with_interval(out, 0.95, "lo", "hi").select("dataset", "config", "n", *rounded(["mean_diff", "lo", "hi"]))


@query("factorial_effects", sql("""
SELECT dataset, round((m3 + m4) / 2 - (m1 + m2) / 2, 6) AS effect_first, round((m2 + m4) / 2 - (m1 + m3) / 2, 6) AS effect_second, round(m4 - m3 - m2 + m1, 6) AS interaction FROM (
  SELECT dataset, avg(CASE WHEN config = 'mean' THEN err END) AS m1, avg(CASE WHEN config = 'xy' THEN err END) AS m2, avg(CASE WHEN config = 'clock' THEN err END) AS m3, avg(CASE WHEN config = 'xy_clock' THEN err END) AS m4 FROM sa GROUP BY dataset)"""))
def factorial_effects(spark, folder):
    """Clock feature (first factor) crossed with sensor features (second factor)."""
    sa, _ = _seed_mean(spark, folder)
    cells = sa.groupBy("dataset", "config").agg(F.avg("err").alias("mean")).where("config != 'x_only'")
    cells = cells.withColumns(
        {"first": F.when(F.col("config").contains("clock"), "on").otherwise("off"), "second": F.when(F.col("config").startswith("xy"), "on").otherwise("off")}
    )
    return inference.factorial_effects(cells, ["dataset"]).select("dataset", *rounded(["effect_first", "effect_second", "interaction"]))


@query("control_battery", sql("""
SELECT s.dataset, s.config, count(*) AS n, round(avg(s.err), 6) AS mean, round(median(s.err), 6) AS median, (round(avg(s.err), 9) <= round(any_value(p.m), 9) * 1.02)::INT AS fails, sum((round(s.err - q.err, 9) > 0)::INT)::BIGINT || '/' || count(*) AS proposed_wins
FROM sa s JOIN (SELECT dataset, avg(err) AS m FROM sa WHERE config = 'xy' GROUP BY dataset) p ON p.dataset = s.dataset JOIN sa q ON q.config = 'xy' AND q.asset_id = s.asset_id AND q.dataset = s.dataset WHERE s.config <> 'xy' GROUP BY s.dataset, s.config"""))
def control_battery(spark, folder):
    diffs, ext = _differences(spark, folder)
    wins = F.sum((F.col("diff") > 0).cast("bigint"))
    out = ordered.quantiles(
        diffs, ["dataset", "arm"], {"median": ("a", 0.5)}, ext,
        also=[F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean"), F.avg("b").alias("_p"), wins.alias("_w")],
    )
    fails = inference.fails_as_control(F.round("mean", 9), F.round("_p", 9))
    return out.select("dataset", F.col("arm").alias("config"), "n", *rounded(["mean", "median"]), fails.alias("fails"), F.format_string("%d/%d", "_w", "n").alias("proposed_wins"))


@query("paired_configurations", sql("SELECT dataset, asset_id, round(max(CASE WHEN config = 'mean' THEN err END), 6) AS a, round(max(CASE WHEN config = 'xy' THEN err END), 6) AS b FROM sa GROUP BY ALL"))
def paired_configurations(spark, folder):
    sa, _ = _seed_mean(spark, folder)
    return joins.paired(sa, ["dataset", "asset_id"], "config", "err", "mean", PROPOSED).select("dataset", "asset_id", *rounded(["a", "b"]))


@query("variant_wins", sql("""
SELECT dataset, config, round(quantile_cont(err, 0.25), 6) AS q25, round(quantile_cont(err, 0.75), 6) AS q75, sum((err <= best)::INT)::BIGINT AS times_best FROM (SELECT *, min(err) OVER (PARTITION BY dataset, asset_id) AS best FROM (SELECT dataset, asset_id, config, round(err, 9) AS err FROM sa)) GROUP BY ALL"""))
def variant_wins(spark, folder):
    sa, ext = _seed_mean(spark, folder)
    sa = sa.withColumn("err", F.round("err", 9))
    best = sa.groupBy("dataset", "asset_id").agg(F.min("err").alias("best"))
    rows = sa.join(best, ["dataset", "asset_id"])
    out = ordered.quantiles(rows, ["dataset", "config"], {"q25": ("err", 0.25), "q75": ("err", 0.75)}, ext.assets, also=[F.sum((F.col("err") <= F.col("best")).cast("bigint")).alias("times_best")])
    return out.select("dataset", "config", *rounded(["q25", "q75"]), "times_best")


@query("correlation_distribution", sql("""
SELECT round(median(partial), 6) AS median, round(quantile_cont(partial, 0.75) - quantile_cont(partial, 0.25), 6) AS iqr, round(min(partial), 6) AS min, sum((partial < 0)::INT)::BIGINT AS n_negative, count(*) AS n FROM (
  SELECT asset_id, round((xy - xz * yz) / (sqrt((1 - xz * xz) * (1 - yz * yz)) + 1e-12), 9) AS partial FROM (
    SELECT asset_id, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry) + 1e-12) AS xy, covar_pop(rx, rz) / (stddev_pop(rx) * stddev_pop(rz) + 1e-12) AS xz, covar_pop(ry, rz) / (stddev_pop(ry) * stddev_pop(rz) + 1e-12) AS yz
    FROM (SELECT asset_id, rank() OVER (PARTITION BY asset_id ORDER BY x) + (count(*) OVER (PARTITION BY asset_id, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY asset_id ORDER BY y) + (count(*) OVER (PARTITION BY asset_id, y) - 1) / 2.0::DOUBLE AS ry, pos + 1 AS rz FROM ev) GROUP BY asset_id))"""))
def correlation_distribution(spark, folder):
    from ..operators import quality

    series, ext = event_series(spark, folder)
    per = quality.partial_spearman(series, ["asset_id"], "x", "y", "pos", ext).withColumns({"partial": F.round("partial", 9), "_all": F.lit(0)})
    out = ordered.quantiles(
        per, ["_all"], {"q1": ("partial", 0.25), "q2": ("partial", 0.5), "q3": ("partial", 0.75)}, ext.assets,
        also=[F.min("partial").alias("lo"), F.sum((F.col("partial") < 0).cast("bigint")).alias("n_negative"), F.count(F.lit(1)).alias("n")],
    )
    return out.select(F.round("q2", 6).alias("median"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"), F.round("lo", 6).alias("min"), "n_negative", "n")


# ------------------------------------------------------------------ Spark ML predictors
def _tabular(spark, folder):
    return _tabular_sized(spark, folder)[0]


def _tabular_sized(spark, folder):
    comp, ext = waveform_components(spark, folder)
    return keep(comp.select("asset_id", "pos", "n", *FEATURES, labels.capped_rul(F.col("pos"), F.col("n")).alias("y_true"))), ext


def _tree_errors(pred):
    return errors.regression_metrics(pred, ["asset_id"]).select("asset_id", *rounded(["mae", "rmse"]))


@query("random_forest_errors")
def random_forest_errors(spark, folder):
    """Forest of 200 unpruned trees on the ten window features: error of each held-out asset."""
    return _tree_errors(regress.tree_predictions(_tabular(spark, folder), FEATURES, "y_true", FOLDS, "forest", trees=200))


@query("boosted_trees_errors")
def boosted_trees_errors(spark, folder):
    return _tree_errors(regress.tree_predictions(_tabular(spark, folder), FEATURES, "y_true", FOLDS, "boosted", trees=300, depth=4))


@query("stage_classifier")
def stage_classifier(spark, folder):
    """Stage forest on a chronological split, majority vote per snapshot of four windows.

    Stages come from the unit-scaled abnormality, so every stage can occur early and late in a life.
    """
    comp, _ = waveform_components(spark, folder)
    lim = comp.groupBy("asset_id").agg(F.min("E").alias("lo"), F.max("E").alias("hi"))
    unit = (F.col("E") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)
    rows = comp.select("asset_id", "pos", "n", "E", *FEATURES).join(lim, "asset_id")
    rows = keep(folds.chronological(rows.withColumn("stage_true", labels.staged(unit, labels.STAGE_INDEX)).drop("E", "lo", "hi")))
    got = regress.stage_classifier(rows, FEATURES, "stage_true").withColumn("snapshot_id", F.floor(F.col("pos") / 4))
    snaps = errors.to_snapshots(got, ["asset_id", "snapshot_id"], votes=["stage_pred"], firsts=["stage_true"]).withColumn("model", F.lit("forest"))
    return errors.classification_metrics(snaps, ["model"], "stage_true", "stage_pred").select("model", *rounded(["accuracy", "macro_f1", "balanced_accuracy"]))


@query("chronological_models")
def chronological_models(spark, folder):
    """Forest, boosted trees and a kernel machine on a chronological split: stage and remaining life of snapshots of four windows.

    The stage of a snapshot is the vote of its windows, its remaining life their mean. Stage scores are NULL when training
    has one stage only.
    """
    comp, _ = waveform_components(spark, folder)
    lim = comp.groupBy("asset_id").agg(F.min("E").alias("lo"), F.max("E").alias("hi"))
    unit = (F.col("E") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)
    rows = comp.join(lim, "asset_id").select("asset_id", "pos", "n", *FEATURES, labels.staged(unit, labels.STAGE_INDEX).alias("stage_true"), labels.capped_rul(F.col("pos"), F.col("n")).alias("rul_true"))
    rows = keep(folds.chronological(rows))
    out = None
    for name, kind, trees in (("forest", "forest", 200), ("boosted", "boosted", 300), ("kernel", "kernel", 0)):
        got = regress.chronological_models(rows, FEATURES, "stage_true", "rul_true", kind, trees)
        got = got.select("asset_id", "pos", F.floor(F.col("pos") / 4).alias("snapshot_id"), "stage_true", "stage_pred", "rul_true", "target_pred", F.lit(name).alias("model"))
        out = got if out is None else out.unionByName(got)
    key = ["model", "asset_id", "snapshot_id"]
    out = keep(out)
    votes = errors.to_snapshots(out, key, votes=["stage_pred"], firsts=["stage_true"])
    stages = errors.classification_metrics(votes.where("stage_pred IS NOT NULL"), ["model"], "stage_true", "stage_pred")
    lives = out.groupBy(*key).agg(F.avg("rul_true").alias("y_true"), F.avg("target_pred").alias("y_pred"))
    lives = errors.regression_metrics(lives, ["model"])
    return lives.join(stages, "model", "left").select("model", *rounded(["accuracy", "macro_f1", "balanced_accuracy", "mae", "rmse"]))


@query("tabular_models")
def tabular_models(spark, folder):
    """Tabular predictors per dataset beside the ten-feature ridge: mean and deviation of the assets' errors, its wins, paired p.

    Naive mean, ridge on the two RMS features, ridge, forest and boosted trees on all ten; every asset is held out once, and
    fits learn from the other assets of its dataset only.
    """
    data = _tabular(spark, folder)
    sets = {"naive_mean": [], "rms_ridge": ["rms_x", "rms_y"], "ridge": FEATURES}
    facts = None
    for k in (0, 1):
        own = data.where(F.pmod("asset_id", F.lit(2)) == k)
        bucket = F.pmod(F.floor(F.col("asset_id") / 2), F.lit(FOLDS)).cast("int")
        linear = regress.predictions(own.withColumn("asset_id", F.floor(F.col("asset_id") / 2).cast("bigint")), FEATURES, "y_true", sets, FOLDS, 1)
        linear = linear.select((F.col("asset_id") * 2 + k).alias("asset_id"), "config", "y_true", "y_pred")
        for name, kind, trees in (("forest", "forest", 200), ("boosted", "boosted", 300)):
            got = regress.tree_predictions(own, FEATURES, "y_true", FOLDS, kind, trees, bucket=bucket)
            linear = linear.unionByName(got.select("asset_id", F.lit(name).alias("config"), "y_true", "y_pred"))
        errs = errors.regression_metrics(linear, ["config", "asset_id"]).select(F.lit(f"d{k}").alias("dataset"), "config", "asset_id", F.col("mae").alias("err"))
        facts = errs if facts is None else facts.unionByName(errs)
    facts = keep(facts)
    base = facts.where("config = 'ridge'").select("dataset", "asset_id", F.col("err").alias("b"))
    diffs = facts.withColumnRenamed("err", "a").join(base, ["dataset", "asset_id"]).withColumn("diff", F.round(F.col("a") - F.col("b"), 9)).withColumnRenamed("config", "arm")
    keys = ["dataset", "arm"]
    table = diffs.groupBy(*keys).agg(F.avg("a").alias("mae_mean"), F.stddev_samp("a").alias("mae_std"), F.count(F.lit(1)).alias("n"), F.sum((F.col("diff") > 0).cast("bigint")).alias("w"))
    n = facts.count()
    tests = inference.with_wilcoxon_p(inference.paired_differences(diffs.where("arm <> 'ridge'"), keys, ordered.Extent(n, n, 1))).select(*keys, "p_value")
    out = table.join(tests, keys, "left")
    return out.select("dataset", F.col("arm").alias("predictor"), *rounded(["mae_mean", "mae_std"]), "n", F.format_string("%d/%d", "w", "n").alias("ridge_wins"), F.round("p_value", 6).alias("p_value"))


@query("healthy_fraction_ten_features")
def healthy_fraction_ten_features(spark, folder):
    """Rank correlation of the plain-covariance abnormality of all ten features with capped life, for several healthy fractions.

    Assets with fewer than twelve snapshots carry no such correlation; they are counted beside the others.
    """
    from ..operators import health, quality

    data, ext = _tabular_sized(spark, folder)
    data = data.withColumn("dataset", F.concat(F.lit("d"), F.pmod("asset_id", F.lit(2))))
    short = data.where("n < 12").groupBy("dataset").agg(F.countDistinct("asset_id").alias("n_short"))
    rows = data.where("n >= 12").withColumn("h0", F.explode(F.array(*[F.lit(h) for h in (0.1, 0.2, 0.3)])))
    rows = rows.withColumns({"n_base": F.greatest(F.lit(5), F.floor(F.col("n") * F.col("h0"))), **{f"z_{c}": F.col(c) for c in FEATURES}})
    keys = ["h0", "asset_id"]
    e = health.mahalanobis(rows, keys, FEATURES, "empirical", ridge=1e-6)
    # ranks are within an asset, the median is over assets
    rho = quality.spearman(e, ["dataset", *keys], "E", "y_true", ordered.Extent(3 * ext.rows, ext.longest, 3 * ext.groups)).withColumn("rho", F.abs("rho"))
    out = ordered.quantiles(rho, ["h0", "dataset"], {"m": ("rho", 0.5)}, ext.assets, also=[F.count(F.lit(1)).alias("n_assets")])
    return out.join(short, "dataset", "left").select("h0", "dataset", F.round("m", 6).alias("median_abs_rho"), "n_assets", F.coalesce("n_short", F.lit(0)).alias("n_short"))
