"""Queries over alarms and labels, on the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import linspace_grid, rounded
from ..operators import alarms, labels, ordered, quality
from ..operators.ordered import keep
from ..sources.tables import KEY, event_series
from .pipelines import event_index, long_indicators
from .registry import query
from .sqlkit import define, sql

ID = ["asset_id", "pos"]
# start, count, step of the threshold grids
TAU = (0.3, 13, 0.05)
SIGMA = (0.5, 31, 0.25)
ONSETS = (0.5, 0.6, 0.7, 0.8)


def _normed(spark, folder):
    """Per-asset min-max of x, a bounded series to raise alarms on."""
    series, ext = event_series(spark, folder)
    lim = series.groupBy("asset_id").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    out = series.join(lim, "asset_id")
    return out.withColumn("v", (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi"), ext


define("unit", """
SELECT asset_id, pos, n, dataset, condition, x, y, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-9) AS v
FROM ev WINDOW w AS (PARTITION BY asset_id)""")
define("above", "SELECT *, CASE WHEN v > 0.2 THEN 1 ELSE 0 END AS hot, sum(CASE WHEN v > 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY pos) AS run FROM unit")
define("flags", """
SELECT *, CASE WHEN hot = 1 AND sum(hot) OVER (PARTITION BY asset_id, run) >= 3 THEN 1 ELSE 0 END AS flag,
       CASE WHEN sum(hot) OVER (PARTITION BY asset_id ORDER BY pos ROWS 2 PRECEDING) = 3 THEN 1 ELSE 0 END AS flag_late
FROM above""")


@query("alarm_flags_back_filled", sql("SELECT asset_id, pos, flag FROM flags"))
def alarm_flags_back_filled(spark, folder):
    rows, ext = _normed(spark, folder)
    return alarms.persistent_flags(rows, KEY, "v", F.lit(0.2), ext).select(*ID, "flag")


@query("alarm_flags_from_qth_step", sql("SELECT asset_id, pos, flag_late AS flag FROM flags"))
def alarm_flags_from_qth_step(spark, folder):
    rows, ext = _normed(spark, folder)
    return alarms.persistent_flags(rows, KEY, "v", F.lit(0.2), ext, back_fill=False).select(*ID, "flag")


@query("first_persistent_exceedance", sql("SELECT asset_id, coalesce(min(CASE WHEN flag_late = 1 THEN pos - 2 END), -1) AS first, max(n) AS n FROM flags GROUP BY asset_id"))
def first_persistent_exceedance(spark, folder):
    rows, ext = _normed(spark, folder)
    return alarms.first_persistent(alarms.with_run_minimum(rows, KEY, "v", ext), KEY, F.lit(0.2))


define("healthy", "SELECT asset_id, avg(x) AS lx, stddev_pop(x) AS sx, avg(y) AS ly, stddev_pop(y) AS sy FROM ev WHERE pos < GREATEST(5, floor(0.2::DOUBLE * n)) GROUP BY asset_id")


@query("sigma_threshold", sql("SELECT asset_id, round(lx + 3 * sx + 1e-9, 6) AS threshold FROM healthy"))
def sigma_threshold(spark, folder):
    series, _ = event_series(spark, folder)
    return alarms.healthy_level(series, KEY, "x").select("asset_id", F.round(alarms.sigma_threshold(F.lit(3.0)), 6).alias("threshold"))


@query(
    "early_warning_single_run",
    sql("""
SELECT asset_id, coalesce(min(CASE WHEN flag = 1 THEN pos END), -1) AS first_warning,
       coalesce(max(n) - 1 - min(CASE WHEN flag = 1 THEN pos END), 0) AS lead_time,
       round(avg(CASE WHEN pos < GREATEST(floor(0.6::DOUBLE * (n - 1)), 1) THEN flag::DOUBLE END), 6) AS false_alarm_rate
FROM flags GROUP BY asset_id"""),
)
def early_warning_single_run(spark, folder):
    """Lead counted back from failure; false alarms counted before the default onset."""
    rows, ext = _normed(spark, folder)
    flagged = alarms.persistent_flags(rows, KEY, "v", F.lit(0.2), ext)
    healthy = F.col("pos") < F.greatest(F.floor((F.col("n") - 1) * F.lit(0.6)), F.lit(1))
    first = F.min(F.when(F.col("flag") == 1, F.col("pos")))
    return flagged.groupBy("asset_id").agg(
        F.coalesce(first, F.lit(-1)).alias("first_warning"),
        F.coalesce(F.max("n") - 1 - first, F.lit(0)).alias("lead_time"),
        F.round(F.avg(F.when(healthy, F.col("flag").cast("double"))), 6).alias("false_alarm_rate"),
    )


define("stage_ev", "SELECT *, CASE WHEN pos / GREATEST(n - 1, 1) >= 0.95::DOUBLE THEN 3 WHEN pos / GREATEST(n - 1, 1) >= 0.8::DOUBLE THEN 2 WHEN pos / GREATEST(n - 1, 1) >= 0.6::DOUBLE THEN 1 ELSE 0 END AS stage FROM flags")


@query(
    "model_alarm_evaluation",
    sql("""
SELECT dataset, count(*) AS n_assets, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(far), 6) AS far,
       round(avg(lead_h), 6) AS lead_time_h, round(avg(before::DOUBLE), 6) AS warned_before_onset
FROM (SELECT dataset, asset_id,
        sum(CASE WHEN flag_late = 1 AND stage >= 1 THEN 1.0::DOUBLE ELSE 0 END) / NULLIF(sum(flag_late), 0) AS precision,
        sum(CASE WHEN flag_late = 1 AND stage >= 1 THEN 1.0::DOUBLE ELSE 0 END) / NULLIF(sum(CASE WHEN stage >= 1 THEN 1 ELSE 0 END), 0) AS recall,
        sum(CASE WHEN flag_late = 1 AND stage = 0 THEN 1.0::DOUBLE ELSE 0 END) / NULLIF(sum(CASE WHEN stage = 0 THEN 1 ELSE 0 END), 0) AS far,
        CASE WHEN max(flag_late) = 1 AND max(n) > 1 THEN (max(n) - 1 - min(CASE WHEN flag_late = 1 THEN pos END)) * ((max(n) - 1) * 10 / 3600.0::DOUBLE * 0.6::DOUBLE) / (max(n) - 1) ELSE 0 END AS lead_h,
        CASE WHEN min(CASE WHEN flag_late = 1 THEN pos END) <= min(CASE WHEN stage >= 1 THEN pos END) THEN 1 ELSE 0 END AS before
      FROM stage_ev GROUP BY dataset, asset_id)
GROUP BY dataset"""),
)
def model_alarm_evaluation(spark, folder):
    """Late alarm flags against the true stage: precision, recall, false-alarm rate, lead in hours."""
    rows, ext = _normed(spark, folder)
    rows = labels.with_hours(rows, F.lit(10.0))
    rows = alarms.persistent_flags(rows, KEY, "v", F.lit(0.2), ext, back_fill=False)
    rows = rows.withColumn("stage", labels.staged(labels.degradation(F.col("pos"), F.col("n")), labels.STAGE_LIFE))
    keys = ["dataset", "asset_id"]
    m = alarms.flag_metrics(rows, keys, "flag", F.col("stage") >= 1)
    ends = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("flag") == 1, F.col("pos"))).alias("first"),
        F.min(F.when(F.col("stage") >= 1, F.col("pos"))).alias("onset"),
        (F.max("n") - 1).alias("fail"),
        F.max("rul_scale_hours").alias("scale"),
    )
    lead = F.when(F.col("first").isNotNull() & (F.col("fail") > 0), (F.col("fail") - F.col("first")) * F.col("scale") / F.col("fail"))
    m = m.join(ends, keys).withColumns(
        {"lead_h": F.coalesce(lead, F.lit(0.0)), "before": F.coalesce((F.col("first") <= F.col("onset")).cast("double"), F.lit(0.0))}
    )
    return m.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_assets"),
        *[F.round(F.avg(c), 6).alias(a) for c, a in [("precision", "precision"), ("recall", "recall"), ("far", "far"), ("lead_h", "lead_time_h"), ("before", "warned_before_onset")]],
    )


define("first_simple", """
SELECT asset_id, dataset, max(n) AS n, fam, coalesce(min(CASE WHEN m > thr AND pos >= 2 THEN pos - 2 END), -1) AS first FROM (
  SELECT u.asset_id, dataset, n, pos, 'fixed' AS fam, min(v) OVER (PARTITION BY u.asset_id ORDER BY pos ROWS 2 PRECEDING) AS m, 0.2::DOUBLE AS thr FROM unit u UNION ALL
  SELECT u.asset_id, dataset, n, pos, 'x_3sigma', min(x) OVER (PARTITION BY u.asset_id ORDER BY pos ROWS 2 PRECEDING), lx + 3 * sx + 1e-9 FROM unit u JOIN healthy h ON u.asset_id = h.asset_id UNION ALL
  SELECT u.asset_id, dataset, n, pos, 'y_3sigma', min(y) OVER (PARTITION BY u.asset_id ORDER BY pos ROWS 2 PRECEDING), ly + 3 * sy + 1e-9 FROM unit u JOIN healthy h ON u.asset_id = h.asset_id)
GROUP BY asset_id, dataset, fam""")


@query(
    "detector_comparison_v1",
    sql("""
SELECT dataset, fam AS detector, round(avg(CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - first)::DOUBLE END), 6) AS precision,
       round(avg(CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - onset)::DOUBLE ELSE 0 END), 6) AS recall,
       round(avg(CASE WHEN first >= 0 THEN (onset - first)::DOUBLE ELSE 0 END), 6) AS lead
FROM (SELECT f.*, o.onset FROM first_simple f JOIN (SELECT asset_id, min(pos) AS onset FROM stage_ev WHERE stage >= 1 GROUP BY asset_id) o USING (asset_id))
GROUP BY dataset, fam"""),
)
def detector_comparison_v1(spark, folder):
    """Onset taken from the stage label; undefined precision stays NULL, a silent detector has lead 0."""
    rows, ext = _normed(spark, folder)
    rows = rows.withColumn("stage", labels.staged(labels.degradation(F.col("pos"), F.col("n")), labels.STAGE_LIFE))
    onset = rows.where("stage >= 1").groupBy("asset_id").agg(F.min("pos").alias("onset"))
    longs = long_indicators(rows, ["dataset", "asset_id", "pos", "n"], {"fixed": "v", "x_3sigma": "x", "y_3sigma": "y"})
    keys = ["dataset", "asset_id", "indicator"]
    level = alarms.healthy_level(longs, ["asset_id", "indicator"], "value")
    longs = alarms.with_run_minimum(longs, keys, "value", ext).join(level, ["asset_id", "indicator"])
    thr = F.when(F.col("indicator") == "fixed", F.lit(0.2)).otherwise(alarms.sigma_threshold(F.lit(3.0)))
    first = alarms.first_persistent(longs, keys, thr).join(onset, "asset_id")
    scored = alarms.alarm_scores(first, F.col("onset"))
    return scored.groupBy("dataset", F.col("indicator").alias("detector")).agg(
        F.round(F.avg(F.when(F.col("fired") == 1, F.col("precision"))), 6).alias("precision"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.col("lead"), F.lit(0)).cast("double")), 6).alias("lead"),
    )


@query(
    "pooled_pr_curve",
    sql("""
SELECT tau, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall
FROM (SELECT round(0.05 + 0.05 * k, 6)::DOUBLE AS tau, sum(CASE WHEN v > round(0.05 + 0.05 * k, 6)::DOUBLE AND stage >= 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN v > round(0.05 + 0.05 * k, 6)::DOUBLE AND stage = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT v > round(0.05 + 0.05 * k, 6)::DOUBLE AND stage >= 1 THEN 1 ELSE 0 END) AS fn
      FROM stage_ev, generate_series(0, 18) g(k) GROUP BY k)"""),
)
def pooled_pr_curve(spark, folder):
    rows, _ = _normed(spark, folder)
    stage = labels.staged(labels.degradation(F.col("pos"), F.col("n")), labels.STAGE_LIFE)
    grid = linspace_grid(0.05, 19, 0.05)
    rows = alarms.with_grid_place(rows.select("v", (stage >= 1).alias("ill")), "v", grid, lambda tau: tau, 19)
    counts = rows.groupBy("_place", "ill").agg(F.count(F.lit(1)).alias("w"))
    counts = counts.select("*", F.posexplode(grid).alias("_at", "tau")).withColumn("hit", (F.col("_place") > F.col("_at")).cast("int"))
    m = alarms.flag_metrics(counts, ["tau"], "hit", F.col("ill"), F.col("w"))
    return m.select("tau", F.round(F.coalesce("precision", F.lit(1.0)), 6).alias("precision"), F.round(F.coalesce("recall", F.lit(0.0)), 6).alias("recall"))


# ------------------------------------------------------------------ train-selected thresholds
define("idx_first", """
SELECT fold_id, role, dataset, asset_id, max(n) AS n, tau AS p, coalesce(min(CASE WHEN m > tau AND pos >= 2 THEN pos - 2 END), -1) AS first
FROM (SELECT fold_id, role, dataset, asset_id, n, pos, min(idx) OVER (PARTITION BY fold_id, asset_id ORDER BY pos ROWS 2 PRECEDING) AS m FROM applied),
     (SELECT round(0.3 + 0.05 * k, 6)::DOUBLE AS tau FROM generate_series(0, 12) g(k))
GROUP BY ALL""")
define("sig_first", """
SELECT asset_id, fam, max(n) AS n, k AS p, coalesce(min(CASE WHEN m > lvl + k * spr + 1e-9 AND pos >= 2 THEN pos - 2 END), -1) AS first
FROM (SELECT e.asset_id, n, pos, 'x' AS fam, min(x) OVER (PARTITION BY e.asset_id ORDER BY pos ROWS 2 PRECEDING) AS m, lx AS lvl, sx AS spr FROM ev e JOIN healthy h ON e.asset_id = h.asset_id
      UNION ALL
      SELECT e.asset_id, n, pos, 'y', min(y) OVER (PARTITION BY e.asset_id ORDER BY pos ROWS 2 PRECEDING), ly, sy FROM ev e JOIN healthy h ON e.asset_id = h.asset_id),
     (SELECT round(0.5 + 0.25 * j, 6)::DOUBLE AS k FROM generate_series(0, 30) g(j))
GROUP BY ALL""")
define("fold_assets", "SELECT DISTINCT fold_id, role, dataset, asset_id FROM roles")
define("all_first", """
SELECT fold_id, role, dataset, asset_id, n, 'index' AS fam, p, first FROM idx_first UNION ALL
SELECT fold_id, role, dataset, s.asset_id, n, fam, p, first FROM sig_first s JOIN fold_assets f ON s.asset_id = f.asset_id""")
define("train_scores", """
SELECT *, CASE WHEN first < 0 OR pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM (
SELECT *, (n - GREATEST(first, onset)) / (n - first)::DOUBLE AS pr, (n - GREATEST(first, onset)) / (n - onset)::DOUBLE AS rc FROM (
SELECT *, GREATEST(1, floor(0.6::DOUBLE * n))::BIGINT AS onset FROM all_first WHERE role = 'train'))""")
define("chosen", """
SELECT fold_id, fam, p, f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold_id, fam ORDER BY f1 DESC, p) AS r FROM (
  SELECT fold_id, fam, p, round(avg(f1), 9) AS f1 FROM train_scores GROUP BY ALL)) WHERE r = 1""")


def _fanned(spark, folder):
    """First alarm per (fold, role, asset, family, parameter), for the index and both simple signals."""
    rows, _, ext = event_index(spark, folder, role=None)
    rows = keep(rows.select("fold_id", "role", "dataset", "asset_id", "pos", "n", "x", "y", "index"))
    ids = ["fold_id", "role", "dataset", "asset_id"]
    idx = alarms.with_run_minimum(rows.drop("x", "y"), ["fold_id", "asset_id"], "index", ext)
    idx = alarms.first_over_grid(idx, ids, linspace_grid(*TAU), lambda p: p, TAU[1], "p").withColumn("family", F.lit("index"))
    series, _ = event_series(spark, folder)
    longs = long_indicators(series, ["asset_id", "pos", "n"], {"x": "x", "y": "y"}).withColumnRenamed("indicator", "family")
    level = alarms.healthy_level(longs, ["asset_id", "family"], "value")
    longs = alarms.with_run_minimum(longs, ["asset_id", "family"], "value", ext).join(level, ["asset_id", "family"])
    sig = alarms.first_over_grid(longs, ["asset_id", "family"], linspace_grid(*SIGMA), alarms.sigma_threshold, SIGMA[1], "p")
    roles = rows.where("pos = 0").select(*ids)
    sig = sig.join(roles, "asset_id")
    return idx.unionByName(sig)


def _selected(fanned):
    train = alarms.alarm_scores(fanned.where("role = 'train'"), alarms.onset_at(F.col("n"), F.lit(0.6)))
    return alarms.select_parameter(train, ["fold_id", "family"], "p")


@query("threshold_selection", sql("SELECT fold_id, fam AS family, p, round(f1, 6) AS train_f1 FROM chosen"))
def threshold_selection(spark, folder):
    return _selected(_fanned(spark, folder)).select("fold_id", "family", "p", *rounded(["train_f1"]))


define("detectors", """
SELECT a.fold_id, a.dataset, a.asset_id, a.n, a.fam || '_selected' AS detector, a.first FROM all_first a JOIN chosen c ON a.fold_id = c.fold_id AND a.fam = c.fam AND a.p = c.p WHERE role = 'test'
UNION ALL SELECT fold_id, dataset, asset_id, n, 'index_fixed', first FROM all_first WHERE role = 'test' AND fam = 'index' AND p = 0.6::DOUBLE
UNION ALL SELECT fold_id, dataset, asset_id, n, fam || '_3sigma', first FROM all_first WHERE role = 'test' AND fam <> 'index' AND p = 3""")
define("onsets", """
SELECT d.*, o AS onset_kind, GREATEST(1, floor(o::DOUBLE * n))::BIGINT AS onset FROM detectors d, (VALUES (0.5), (0.6), (0.7), (0.8)) t(o)
UNION ALL SELECT d.*, -1, r.first FROM detectors d JOIN detectors r ON r.asset_id = d.asset_id AND r.detector = 'x_3sigma' AND r.first > 0 WHERE d.detector IN ('index_fixed', 'y_3sigma')""")
define("ew", """
SELECT *, CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - first)::DOUBLE ELSE 0 END AS pr,
       CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - onset)::DOUBLE ELSE 0 END AS rc,
       CASE WHEN first >= 0 THEN onset - first END AS lead FROM onsets""")


def _early_warning(spark, folder):
    fanned = keep(_fanned(spark, folder))
    best = F.broadcast(_selected(fanned).select("fold_id", "family", F.col("p").alias("_p")))  # one row per fold and family
    test = fanned.where("role = 'test'").join(best, ["fold_id", "family"])
    name = F.array_compact(
        F.array(
            F.when(F.col("p") == F.col("_p"), F.concat("family", F.lit("_selected"))),
            F.when((F.col("family") == "index") & (F.col("p") == 0.6), F.lit("index_fixed")),
            F.when((F.col("family") != "index") & (F.col("p") == 3.0), F.concat("family", F.lit("_3sigma"))),
        )
    )
    det = test.withColumn("detector", F.explode(name)).select("fold_id", "dataset", "asset_id", "n", "detector", "first")
    fixed = det.withColumn("onset_kind", F.explode(F.array(*[F.lit(o) for o in ONSETS])))
    fixed = fixed.withColumn("onset", alarms.onset_at(F.col("n"), F.col("onset_kind")))
    driven = det.where("detector = 'x_3sigma' and first > 0").select("asset_id", F.col("first").alias("onset"))
    data = det.where(F.col("detector").isin("index_fixed", "y_3sigma")).join(driven, "asset_id").withColumn("onset_kind", F.lit(-1.0))
    return alarms.alarm_scores(fixed.unionByName(data), F.col("onset"))


@query(
    "early_warning_table",
    sql("""
SELECT dataset, detector, onset_kind::DOUBLE AS onset_kind, count(*) AS n, sum(CASE WHEN first >= 0 THEN 1 ELSE 0 END)::BIGINT AS fired, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall,
       round(median(lead), 6) AS lead, CAST(sum(CASE WHEN first >= 0 THEN 1 ELSE 0 END) AS BIGINT) || '/' || count(*) AS fired_on
FROM ew GROUP BY ALL"""),
)
def early_warning_table(spark, folder):
    """Six detectors at four onsets, plus a data-driven onset (kind -1) where the x rule fires first."""
    scored = _early_warning(spark, folder)
    _, ext = event_series(spark, folder)
    out = ordered.quantiles(
        scored.withColumn("lead", F.col("lead").cast("double")),
        ["dataset", "detector", "onset_kind"],
        {"lead_med": ("lead", 0.5)},
        ext.assets,
        also=[F.count(F.lit(1)).alias("n"), F.sum("fired").alias("fired"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall")],
    )
    return out.select("dataset", "detector", "onset_kind", "n", "fired", "precision", "recall", F.round("lead_med", 6).alias("lead"), F.format_string("%d/%d", "fired", "n").alias("fired_on"))


@query(
    "onset_sensitivity",
    sql("SELECT detector, onset_kind::DOUBLE AS onset_kind, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(median(lead), 6) AS lead FROM ew WHERE onset_kind > 0 GROUP BY ALL"),
)
def onset_sensitivity(spark, folder):
    scored = _early_warning(spark, folder).where("onset_kind > 0").withColumn("lead", F.col("lead").cast("double"))
    _, ext = event_series(spark, folder)
    out = ordered.quantiles(
        scored, ["detector", "onset_kind"], {"m": ("lead", 0.5)}, ext.assets,
        also=[F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall")],
    )
    return out.select("detector", "onset_kind", "precision", "recall", F.round("m", 6).alias("lead"))


# ------------------------------------------------------------------ curves
define("curve_first", """
SELECT asset_id, dataset, fam, p, max(n) AS n, coalesce(min(CASE WHEN m > thr AND pos >= 2 THEN pos - 2 END), -1) AS first FROM (
  SELECT asset_id, dataset, n, pos, 'index' AS fam, p, p AS thr, m FROM (SELECT asset_id, dataset, n, pos, min(idx) OVER (PARTITION BY asset_id ORDER BY pos ROWS 2 PRECEDING) AS m FROM held),
       (SELECT round(0.05 + 0.025 * k, 6)::DOUBLE AS p FROM generate_series(0, 37) g(k))
  UNION ALL
  SELECT asset_id, dataset, n, pos, 'x', p, lx + p * sx + 1e-9, m FROM (SELECT e.asset_id, e.dataset, n, pos, lx, sx, min(x) OVER (PARTITION BY e.asset_id ORDER BY pos ROWS 2 PRECEDING) AS m FROM ev e JOIN healthy h ON e.asset_id = h.asset_id),
       (SELECT round(0.25 + 0.25 * k, 6)::DOUBLE AS p FROM generate_series(0, 159) g(k)))
GROUP BY asset_id, dataset, fam, p""")
define("curve", """
SELECT dataset, fam, p, avg(CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - first)::DOUBLE ELSE 0 END) AS pr, avg(CASE WHEN first >= 0 THEN (n - GREATEST(first, onset)) / (n - onset)::DOUBLE ELSE 0 END) AS rc
FROM (SELECT *, GREATEST(1, floor(0.6::DOUBLE * n))::BIGINT AS onset FROM curve_first) GROUP BY dataset, fam, p""")


def _curves(spark, folder):
    held, _, ext = event_index(spark, folder)
    longs = long_indicators(held, ["dataset", "asset_id", "pos", "n"], {"index": "index", "x": "x"}).withColumnRenamed("indicator", "family")
    keys = ["dataset", "asset_id", "family"]
    level = alarms.healthy_level(longs, keys, "value")
    longs = alarms.with_run_minimum(longs, keys, "value", ext).join(level, keys)
    grid = F.when(F.col("family") == "index", linspace_grid(0.05, 38, 0.025)).otherwise(linspace_grid(0.25, 160, 0.25))
    thr = lambda p: F.when(F.col("family") == "index", p).otherwise(alarms.sigma_threshold(p))
    scored = alarms.alarm_scores(alarms.first_over_grid(longs, keys, grid, thr, 160, "param"), alarms.onset_at(F.col("n"), F.lit(0.6)))
    return scored.groupBy("dataset", "family", "param").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


@query("family_pr_curves", sql("SELECT dataset, fam AS family, p AS param, round(pr, 6) AS precision, round(rc, 6) AS recall FROM curve"))
def family_pr_curves(spark, folder):
    return _curves(spark, folder).select("dataset", "family", "param", *rounded(["precision", "recall"]))


@query(
    "precision_at_matched_recall",
    sql("SELECT dataset, fam AS family, t::DOUBLE AS recall_target, round(max(CASE WHEN round(rc, 9) >= t::DOUBLE THEN pr END), 6) AS precision FROM curve, (VALUES (0.4), (0.6), (0.8)) v(t) GROUP BY ALL"),
)
def precision_at_matched_recall(spark, folder):
    curve = _curves(spark, folder).withColumn("recall", F.round("recall", 9))
    return alarms.precision_at_recall(curve, ["dataset", "family"], (0.4, 0.6, 0.8)).withColumn("precision", F.round("precision", 6))


@query(
    "precision_recall_area",
    sql("""
SELECT dataset, family, round(sum((e0 + e1) / 2) / 1000, 6) AS auprc FROM (
  SELECT dataset, family, e AS e1, lag(e) OVER (PARTITION BY dataset, family ORDER BY i) AS e0 FROM (
    SELECT dataset, fam AS family, i, coalesce(max(CASE WHEN round(rc, 9) >= i / 1000.0::DOUBLE THEN pr END), 0) AS e FROM curve, generate_series(0, 1000) g(i) GROUP BY ALL))
WHERE e0 IS NOT NULL GROUP BY dataset, family"""),
)
def precision_recall_area(spark, folder):
    curve = _curves(spark, folder).withColumn("recall", F.round("recall", 9))
    return alarms.envelope_area(curve, ["dataset", "family"]).select("dataset", "family", *rounded(["auprc"]))


# ------------------------------------------------------------------ smoothing, labels
define("width", "SELECT asset_id, pos, n, v, GREATEST(3, CAST(round_even(0.05::DOUBLE * n, 0) AS BIGINT)) AS w FROM unit")


@query(
    "rolling_median",
    sql("""
SELECT a.asset_id, a.pos, round(median(b.v), 6) AS smoothed FROM width a JOIN width b ON a.asset_id = b.asset_id AND b.pos BETWEEN a.pos - a.w // 2 AND a.pos + (a.w - 1) // 2
GROUP BY a.asset_id, a.pos"""),
)
def rolling_median(spark, folder):
    rows, ext = _normed(spark, folder)
    return ordered.rolling_median(rows.select(*ID, "n", "v"), KEY, "v", "smoothed", ext).select(*ID, *rounded(["smoothed"]))


@query(
    "label_table",
    sql("""
SELECT asset_id, pos, GREATEST(n - 1, 1) AS h_fail, round((GREATEST(n - 1, 1) - pos) / GREATEST(n - 1, 1)::DOUBLE, 6) AS rul, round(pos / GREATEST(n - 1, 1)::DOUBLE, 6) AS deg,
       round(LEAST(1, (GREATEST(n - 1, 1) - pos) / GREATEST(0.6::DOUBLE * GREATEST(n - 1, 1), 1)), 6) AS rul_capped,
       stage AS stage_time, CASE WHEN v >= 0.8::DOUBLE THEN 3 WHEN v >= 0.5::DOUBLE THEN 2 WHEN v >= 0.2::DOUBLE THEN 1 ELSE 0 END AS stage_index,
       flag AS warning_label, round(GREATEST(n - 1, 1) * 10 / 3600.0::DOUBLE, 6) AS life_hours, round((GREATEST(n - 1, 1) - pos) * 10 / 3600.0::DOUBLE, 6) AS rul_hours,
       round(GREATEST(n - 1, 1) * 10 / 3600.0::DOUBLE * 0.6::DOUBLE, 6) AS rul_scale_hours
FROM stage_ev"""),
)
def label_table(spark, folder):
    """Every label column; the index here is the per-asset unit series, the cadence 10 s."""
    rows, ext = _normed(spark, folder)
    out = labels.label_table(rows, KEY, "v", ext, F.lit(10.0), tau=0.2)
    return out.select(
        *ID, F.col("H_fail").alias("h_fail"), *rounded(["rul", "deg", "rul_capped"]), "stage_time", "stage_index", "warning_label",
        *rounded(["life_hours", "rul_hours", "rul_scale_hours"]),
    )


@query(
    "label_hours_by_cadence",
    sql("""
SELECT asset_id, pos, programme, cadence_s, round(GREATEST(n - 1, 1) * cadence_s / 3600.0::DOUBLE, 6) AS life_hours, round((GREATEST(n - 1, 1) - pos) * cadence_s / 3600.0::DOUBLE, 6) AS rul_hours
FROM (SELECT *, CASE programme WHEN 'pronostia' THEN 10.0::DOUBLE WHEN 'xjtu_sy' THEN 60.0 WHEN 'mendeley' THEN 3600.0 WHEN 'ims' THEN 600.0 ELSE 1.0 END AS cadence_s FROM (
  SELECT *, CASE condition WHEN 'click' THEN 'pronostia' WHEN 'view' THEN 'xjtu_sy' WHEN 'purchase' THEN 'ims' ELSE 'unlisted' END AS programme FROM ev WHERE condition IS NOT NULL))"""),
)
def label_hours_by_cadence(spark, folder):
    """Absolute hours at the cadence of each recording programme; the programme here goes by the kind of event."""
    rows, _ = event_series(spark, folder)
    programme = F.lit("unlisted")
    for kind, name in {"click": "pronostia", "view": "xjtu_sy", "purchase": "ims"}.items():
        programme = F.when(F.col("condition") == kind, F.lit(name)).otherwise(programme)
    rows = rows.where("condition IS NOT NULL").withColumn("programme", programme)
    rows = rows.withColumn("cadence_s", labels.cadence_of(F.col("programme")))
    out = labels.with_hours(rows, F.col("cadence_s"))
    return out.select(*ID, "programme", "cadence_s", *rounded(["life_hours", "rul_hours"]))


@query(
    "monotonicity_mechanism",
    sql(
        """
SELECT dataset, count(*) AS n_assets, sum(steps)::BIGINT AS steps, sum(flips)::BIGINT AS flips, sum(r2f)::BIGINT AS rise_to_fall, sum(f2r)::BIGINT AS fall_to_rise,
       round(median(net0 / NULLIF(steps, 0)), 6) AS signed_abnormality, round(median(net1 / NULLIF(steps, 0)), 6) AS signed_index,
       round(sum(flips) / NULLIF(sum(steps), 0)::DOUBLE, 6) AS flip_share, round(sum(r2f) / NULLIF(sum(flips), 0)::DOUBLE, 6) AS rise_to_fall_share,
       sum(CASE WHEN net1 < 0 THEN 1 ELSE 0 END)::BIGINT AS n_fall_excess
FROM (SELECT dataset, asset_id, count(*) - 1 AS steps, sum(CASE WHEN s0 <> s1 THEN 1 ELSE 0 END) AS flips, sum(CASE WHEN s0 <> s1 AND s1 < 0 THEN 1 ELSE 0 END) AS r2f,
        sum(CASE WHEN s0 <> s1 AND s1 > 0 THEN 1 ELSE 0 END) AS f2r, sum(s0)::DOUBLE AS net0, sum(s1)::DOUBLE AS net1 FROM signs GROUP BY dataset, asset_id)
GROUP BY dataset""",
        signs="SELECT dataset, asset_id, sign(round(en - lag(en) OVER w, 9)) AS s0, sign(round(idx - lag(idx) OVER w, 9)) AS s1 FROM held WINDOW w AS (PARTITION BY asset_id ORDER BY pos)",
    ),
)
def monotonicity_mechanism(spark, folder):
    held, _, ext = event_index(spark, folder)
    f = quality.sign_flips(held, ["dataset", "asset_id"], "E_norm", "index", ext)
    steps = F.nullif(F.col("n_steps"), F.lit(0))
    f = f.withColumns({"s_e": F.col("net_before") / steps, "s_i": F.col("net_after") / steps})
    out = ordered.quantiles(
        f, ["dataset"], {"signed_abnormality": ("s_e", 0.5), "signed_index": ("s_i", 0.5)}, ext.assets,
        also=[
            F.count(F.lit(1)).alias("n_assets"), F.sum("n_steps").alias("steps"), F.sum("flips").alias("flips"),
            F.sum("rise_to_fall").alias("rise_to_fall"), F.sum("fall_to_rise").alias("fall_to_rise"),
            F.sum((F.col("net_after") < 0).cast("bigint")).alias("n_fall_excess"),
        ],
    )
    return out.select(
        "dataset", "n_assets", "steps", "flips", "rise_to_fall", "fall_to_rise", *rounded(["signed_abnormality", "signed_index"]),
        F.round(F.col("flips") / F.nullif(F.col("steps"), F.lit(0)), 6).alias("flip_share"),
        F.round(F.col("rise_to_fall") / F.nullif(F.col("flips"), F.lit(0)), 6).alias("rise_to_fall_share"),
        "n_fall_excess",
    )
