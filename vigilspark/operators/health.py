"""Transparent health index: label-free raw components, fold-fitted weights, frozen application."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import EPS, clip, rescale
from .folds import guarded_fit
from .ordered import SAFE_GROUP, Extent, keep, neighbours, quantiles, quantiles_without
from .weights import mean_left_out, score_scaled, score_weights

GRID_STEPS = 101


# ------------------------------------------------------------------ raw components
def baseline_length(n: Column, dims: int, fraction: float = 0.2, mult: float = 3.0) -> Column:
    """Snapshots of the healthy prefix: large enough for a covariance, at most half a life."""
    want = F.floor(F.greatest(F.lit(mult * dims), n * F.lit(float(fraction))))
    half = F.greatest(F.floor(n / 2), F.lit(5))
    return F.least(F.greatest(want, F.lit(5)), half, n).cast("bigint")


def with_baseline(series: DataFrame, dims: int, fraction: float = 0.2, mult: float = 3.0) -> DataFrame:
    return series.withColumn("n_base", baseline_length(F.col("n"), dims, fraction, mult))


def robust_scale(series: DataFrame, keys, features, ext: Extent) -> DataFrame:
    """Add z_<f> = (f - median) / (IQR + eps), both taken over the healthy prefix of each asset."""
    base = series.where(F.col("pos") < F.col("n_base"))
    wanted = {}
    for f in features:
        wanted |= {f"_q1_{f}": (f, 0.25), f"_q2_{f}": (f, 0.5), f"_q3_{f}": (f, 0.75)}
    stats = quantiles(base, keys, wanted, ext)
    z = {
        f"z_{f}": (F.col(f) - F.col(f"_q2_{f}")) / (F.col(f"_q3_{f}") - F.col(f"_q1_{f}") + EPS) for f in features
    }
    return series.join(stats, list(keys)).withColumns(z).drop(*wanted)


def _pairs(d: int):
    return [(i, j) for i in range(d) for j in range(i, d)]


def _precision_udf(d: int, estimator: str, min_ratio: float, ridge: float):
    """Inverse covariance per asset from its pre-aggregated moments (one small matrix per row)."""
    schema = T.StructType(
        [
            T.StructField("m", T.ArrayType(T.DoubleType())),
            T.StructField("estimator", T.StringType()),
            T.StructField("shrinkage", T.DoubleType()),
        ]
    )
    idx = _pairs(d)

    @F.pandas_udf(schema)
    def precision(n: pd.Series, second: pd.Series, fourth: pd.Series) -> pd.DataFrame:
        mats, names, shrinks = [], [], []
        for count, flat, q in zip(n, second, fourth):
            s = np.zeros((d, d))
            for v, (i, j) in zip(flat, idx):
                s[i, j] = s[j, i] = v
            shrink = None
            if estimator == "diagonal" or (estimator == "auto" and count < min_ratio * d):
                inv, name = np.diag(1.0 / (np.diag(s) + 1e-6)), "diagonal"
            elif estimator == "empirical":
                cov = s * (count / max(count - 1, 1)) + ridge * np.eye(d)
                inv, name = np.linalg.pinv(cov), "empirical"
            else:
                mu = np.trace(s) / d
                spread = float((s * s).sum())
                beta = (q / count - spread) / (count * d)
                delta = (spread - 2.0 * mu * np.trace(s) + d * mu * mu) / d
                shrink = 0.0 if beta <= 0 or delta <= 0 else min(beta, delta) / delta
                inv = np.linalg.pinv((1.0 - shrink) * s + shrink * mu * np.eye(d))
                name = "ledoit_wolf"
            mats.append([inv[i, j] for i, j in idx])
            names.append(name)
            shrinks.append(shrink)
        return pd.DataFrame({"m": mats, "estimator": names, "shrinkage": pd.Series(shrinks, dtype="float64")})

    return precision


def mahalanobis(
    scaled: DataFrame, keys, features, estimator: str = "auto", min_ratio: float = 3.0, ridge: float = 1e-9, name: str = "E"
) -> DataFrame:
    """Distance of every snapshot from its own healthy prefix.

    ``auto`` shrinks the covariance (Ledoit-Wolf) and falls back to a diagonal one when the prefix
    has fewer than ``min_ratio`` rows per feature. Moments are plain aggregates; only the small
    matrix inverse of each asset runs in Python.
    """
    keys, d = list(keys), len(features)
    z = [f"z_{f}" for f in features]
    base = scaled.where(F.col("pos") < F.col("n_base"))
    means = base.groupBy(*keys).agg(*[F.avg(c).alias(f"_mu_{c}") for c in z])
    dev = [F.col(c) - F.col(f"_mu_{c}") for c in z]
    if estimator == "diagonal":
        spread = base.groupBy(*keys).agg(*[F.avg(c).alias(f"_mu_{c}") for c in z], *[F.var_pop(c).alias(f"_v_{c}") for c in z])
        quad = sum((dev[i] * dev[i] / (F.col(f"_v_{z[i]}") + 1e-6) for i in range(d)), F.lit(0.0))
        out = scaled.join(spread, keys).withColumn(name, F.sqrt(quad + EPS))
        out = out.withColumns({"estimator": F.lit("diagonal"), "shrinkage": F.lit(None).cast("double")})
        return out.drop(*[f"_mu_{c}" for c in z], *[f"_v_{c}" for c in z])
    centred = base.join(means, keys).select(*keys, *[v.alias(f"_d{i}") for i, v in enumerate(dev)])
    norm2 = sum((F.col(f"_d{i}") * F.col(f"_d{i}") for i in range(d)), F.lit(0.0))
    moments = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in _pairs(d)]).alias("_s"),
        F.sum(norm2 * norm2).alias("_q"),
    )
    fitted = moments.select(*keys, _precision_udf(d, estimator, min_ratio, ridge)("_n", "_s", "_q").alias("_inv"))
    fitted = fitted.join(means, keys)
    quad = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs(d)):
        quad = quad + dev[i] * dev[j] * F.col("_inv.m")[k] * (1.0 if i == j else 2.0)
    out = scaled.join(fitted, keys).withColumn(name, F.sqrt(F.greatest(quad, F.lit(0.0)) + EPS))
    out = out.withColumns({"estimator": F.col("_inv.estimator"), "shrinkage": F.col("_inv.shrinkage")})
    return out.drop("_inv", *[f"_mu_{c}" for c in z])


def state_change(scaled: DataFrame, keys, features, ext: Extent, name: str = "C") -> DataFrame:
    """Euclidean step between consecutive snapshots; the first one repeats the second."""
    z = [f"z_{f}" for f in features]
    out = neighbours(scaled, keys, {f"_l_{c}": (c, 1) for c in z}, ext)
    total = sum(((F.col(c) - F.col(f"_l_{c}")) * (F.col(c) - F.col(f"_l_{c}")) for c in z), F.lit(0.0))
    out = out.withColumn("_step", F.when(F.col("pos") > 0, F.sqrt(total + EPS)))
    out = neighbours(out, keys, {"_next": ("_step", -1)}, ext)
    step = F.coalesce(F.col("_step"), F.when(F.col("pos") == 0, F.col("_next")), F.lit(0.0))
    return out.withColumn(name, step).drop("_step", "_next", *[f"_l_{c}" for c in z])


def _healthy_moments(series: DataFrame, keys, features, ext: Extent, estimator: str, min_ratio: float) -> DataFrame:
    """Per asset, in one pass over the healthy prefix: medians, scales, and means and covariances of z.

    z is a linear map of the feature, so its moments follow from those of the raw feature. Only the
    shrinkage intensity needs a second pass, for the fourth moment of the centred z.
    """
    d = len(features)
    base = series.where(F.col("pos") < F.col("n_base"))
    wanted = {}
    for i, f in enumerate(features):
        wanted |= {f"_q1_{i}": (f, 0.25), f"_q2_{i}": (f, 0.5), f"_q3_{i}": (f, 0.75)}
    stats = quantiles(
        base, keys, wanted, ext,
        also=[
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(f).alias(f"_m_{i}") for i, f in enumerate(features)],
            *[F.covar_pop(features[i], features[j]).alias(f"_c_{i}_{j}") for i, j in _pairs(d)],
        ],
    )
    scale = [F.col(f"_q3_{i}") - F.col(f"_q1_{i}") + EPS for i in range(d)]
    stats = stats.select(
        *keys,
        "_n",
        *[F.col(f"_q2_{i}").alias(f"_mid_{i}") for i in range(d)],
        *[scale[i].alias(f"_scale_{i}") for i in range(d)],
        *[F.col(f"_m_{i}").alias(f"_mean_{i}") for i in range(d)],
        F.array(*[F.col(f"_c_{i}_{j}") / (scale[i] * scale[j]) for i, j in _pairs(d)]).alias("_s"),
    )
    if estimator != "auto":
        return stats.withColumn("_q", F.lit(0.0))
    # the branch is decided by the prefix length, so only assets that shrink are read again
    shrinks = stats.where(F.col("_n") >= min_ratio * d)
    dev = [(F.col(f) - F.col(f"_mean_{i}")) / F.col(f"_scale_{i}") for i, f in enumerate(features)]
    norm2 = sum((x * x for x in dev), F.lit(0.0))
    fourth = base.join(shrinks, list(keys)).groupBy(*keys).agg(F.sum(norm2 * norm2).alias("_q"))
    return stats.join(fourth, list(keys), "left").na.fill({"_q": 0.0})


def raw_components(
    series: DataFrame,
    keys,
    features,
    ext: Extent,
    estimator: str = "auto",
    fraction: float = 0.2,
    mult: float = 3.0,
    log_compress: bool = True,
    ridge: float = 1e-9,
) -> DataFrame:
    """Abnormality E and state change C of every snapshot; no label or lifetime enters.

    The same numbers as robust_scale, mahalanobis and state_change in turn, with their per-asset
    statistics gathered together and joined to the rows once.
    """
    keys, d = list(keys), len(features)
    rows = with_baseline(series, d, fraction, mult)
    stats = _healthy_moments(rows, keys, features, ext, estimator, mult)
    if estimator == "diagonal":
        diagonal = [F.lit(1.0) / (F.col("_s")[k] + 1e-6) if i == j else F.lit(0.0) for k, (i, j) in enumerate(_pairs(d))]
        inverse = F.struct(F.array(*diagonal).alias("m"), F.lit("diagonal").alias("estimator"), F.lit(None).cast("double").alias("shrinkage"))
    else:
        inverse = _precision_udf(d, estimator, mult, ridge)("_n", "_s", "_q")
    stats = stats.withColumn("_inv", inverse).drop("_n", "_s", "_q")
    out = rows.join(stats, keys)
    out = out.withColumns({f"z_{f}": (F.col(f) - F.col(f"_mid_{i}")) / F.col(f"_scale_{i}") for i, f in enumerate(features)})
    dev = [(F.col(f) - F.col(f"_mean_{i}")) / F.col(f"_scale_{i}") for i, f in enumerate(features)]
    quad = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs(d)):
        if i == j or estimator != "diagonal":
            quad = quad + dev[i] * dev[j] * F.col("_inv.m")[k] * (1.0 if i == j else 2.0)
    out = out.withColumns(
        {"E": F.sqrt(F.greatest(quad, F.lit(0.0)) + EPS), "estimator": F.col("_inv.estimator"), "shrinkage": F.col("_inv.shrinkage")}
    )
    out = out.drop("_inv", *[f"_{t}_{i}" for t in ("mid", "scale", "mean") for i in range(d)])
    out = state_change(out, keys, features, ext)
    if log_compress:
        out = out.withColumns({"E": F.log1p("E"), "C": F.log1p("C")})
    return out


# ------------------------------------------------------------------ fold fit
def assign_roles(rows: DataFrame, folds: int, group: str = "asset_id", dataset: Column | None = None) -> DataFrame:
    """Fan each row out to its role in every fold: one bucket held out, the next for validation.

    ``dataset`` numbers the datasets from 0. Each then has folds of its own, numbered from
    ``dataset * folds``, and nothing fitted by fold sees another dataset's rows.
    """
    bucket = F.pmod(F.col(group), F.lit(folds))
    out = rows.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = (
        F.when(bucket == F.col("fold_id"), "test")
        .when(bucket == F.pmod(F.col("fold_id") + 1, F.lit(folds)), "val")
        .otherwise("train")
    )
    out = out.withColumn("role", role)
    if dataset is None:
        return out
    return out.withColumn("fold_id", (dataset * F.lit(folds) + F.col("fold_id")).cast("int"))


def train_bounds(train: DataFrame, ext: Extent, lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    """Percentile bounds of E and C over the pooled training rows of each fold."""
    wanted = {"E_lo": ("E", lo / 100), "E_hi": ("E", hi / 100), "C_lo": ("C", lo / 100), "C_hi": ("C", hi / 100)}
    return quantiles(train.select("fold_id", "E", "C"), ["fold_id"], wanted, ext.pooled)


def training_rows(components: DataFrame, folds: int, group: str = "asset_id", dataset: Column | None = None) -> DataFrame:
    cols = dict.fromkeys(["asset_id", group, "pos", "n", "E", "C"])
    return assign_roles(components.select(*cols), folds, group, dataset).where("role = 'train'")


def _small(params: DataFrame) -> DataFrame:
    """Fold parameters: one row per fold, so always safe to broadcast."""
    return F.broadcast(params)


def scale_by_fold(rows: DataFrame, params: DataFrame) -> DataFrame:
    """E and C on the frozen fold scale: unclipped (E_lin, C_lin) and clipped (E_norm, C_norm)."""
    out = rows.join(_small(params), "fold_id")
    out = out.withColumns(
        {
            "E_lin": rescale(F.col("E"), F.col("E_lo"), F.col("E_hi")),
            "C_lin": rescale(F.col("C"), F.col("C_lo"), F.col("C_hi")),
        }
    )
    return out.withColumns({"E_norm": clip(F.col("E_lin"), 0, 1), "C_norm": clip(F.col("C_lin"), 0, 1)})


def fitness_per_asset(train: DataFrame, ext: Extent, steps: int = GRID_STEPS) -> DataFrame:
    """Monotonicity and signed Spearman against life for every (fold, asset, weight of E)."""
    grid = [round(i / (steps - 1), 6) for i in range(steps)]
    scored = score_weights(train, ["fold_id", "asset_id"], ["E_norm", "C_norm"], [(a, 1.0 - a) for a in grid], ext)
    return scored.select("fold_id", "asset_id", F.round(F.col("w") / F.lit(float(steps - 1)), 6).alias("a"), "mono", "rho")


def weight_sweep(scores: DataFrame, objective: str = "mono+corr") -> DataFrame:
    """Mean fitness over the training assets for every fold and weight."""
    f = F.col("mono") if objective == "mono" else F.col("mono") + F.col("rho")
    return scores.groupBy("fold_id", "a").agg(F.round(F.avg(f), 9).alias("fitness"), F.count(F.lit(1)).alias("n_train"))


def pick_weight(sweep: DataFrame) -> DataFrame:
    """First maximum of the sweep (the smallest weight among equals)."""
    best = F.max_by("a", F.struct(F.col("fitness"), -F.col("a")))
    return sweep.groupBy("fold_id").agg(
        best.alias("a"), F.max("fitness").alias("fitness"), F.max("n_train").alias("n_train")
    ).withColumn("b", F.round(F.lit(1.0) - F.col("a"), 6))


def fit_on(train: DataFrame, ext: Extent, objective: str = "mono+corr", lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    """Frozen parameters per fold from training rows: percentile bounds and the selected weight."""
    bounds = train_bounds(train, ext, lo, hi)
    scores = fitness_per_asset(scale_by_fold(train, bounds), ext)
    return pick_weight(weight_sweep(scores, objective)).join(bounds, "fold_id")


def fit_both(train: DataFrame, ext: Extent) -> DataFrame:
    """Parameters of the default objective, with the label-free weights beside them (a_mono, b_mono)."""
    bounds = train_bounds(train, ext)
    scores = keep(fitness_per_asset(scale_by_fold(train, bounds), ext))
    mono = pick_weight(weight_sweep(scores, "mono")).select("fold_id", F.col("a").alias("a_mono"), F.col("b").alias("b_mono"))
    return pick_weight(weight_sweep(scores)).join(mono, "fold_id").join(bounds, "fold_id")


def bucket_of(rows: DataFrame) -> str:
    """Folds follow the buckets that groups were dealt to, where rows carry them, else the asset's number."""
    return "bucket" if "bucket" in rows.columns else "asset_id"


def fold_bounds(components: DataFrame, folds: int, dataset: Column | None = None, lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    """Percentile bounds of E and C over each fold's training rows, from all rows minus the fold's two buckets."""
    pool = (F.lit(0) if dataset is None else dataset).cast("int").alias("_pool")
    rows = components.select(pool, F.pmod(F.col(bucket_of(components)), F.lit(folds)).cast("int").alias("_bucket"), "E", "C")
    f = F.col("_f")
    requests = rows.select("_pool").distinct().withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    requests = requests.select("_pool", (F.col("_pool") * folds + f).cast("int").alias("fold_id"), F.array(f, F.pmod(f + 1, F.lit(folds))).alias("without"))
    wanted = {"E_lo": ("E", lo / 100), "E_hi": ("E", hi / 100), "C_lo": ("C", lo / 100), "C_hi": ("C", hi / 100)}
    out = quantiles_without(rows, ["_pool"], "_bucket", wanted, requests)
    return out.where("E_lo IS NOT NULL").drop("_pool")


def fold_scores(components: DataFrame, bounds: DataFrame, folds: int, ext: Extent, dataset: Column | None = None, steps: int = GRID_STEPS) -> DataFrame:
    """Monotonicity and Spearman of every (fold, training asset, weight of E); each asset's rows go out once."""
    key = bucket_of(components)
    assets = components.select(*dict.fromkeys(["asset_id", key])).distinct()
    uses = assign_roles(assets, folds, key, dataset).where("role = 'train'").join(_small(bounds), "fold_id")
    return score_grid(components, uses, ext, steps)


def score_grid(components: DataFrame, uses: DataFrame, ext: Extent, steps: int = GRID_STEPS) -> DataFrame:
    grid = [round(i / (steps - 1), 6) for i in range(steps)]
    scored = score_scaled(components, uses, [(a, 1.0 - a) for a in grid], ext)
    return scored.select("fold_id", "asset_id", F.round(F.col("w") / F.lit(float(steps - 1)), 6).alias("a"), "mono", "rho")


def guarded(params: DataFrame, components: DataFrame) -> DataFrame:
    """Parameters that raise when a group of ``components`` lies in two buckets; without groups there is nothing to check."""
    if {"dataset", "grp", "bucket"} <= set(components.columns):
        return guarded_fit(params, components)
    return params


def fit_index(components: DataFrame, folds: int, ext: Extent, objective: str = "mono+corr", lo: float = 1.0, hi: float = 99.0, dataset: Column | None = None) -> DataFrame:
    """Frozen parameters of every fold: percentile bounds and the selected weight, behind the leak guard."""
    bounds = keep(fold_bounds(components, folds, dataset, lo, hi))
    scores = fold_scores(components, bounds, folds, ext, dataset)
    return guarded(pick_weight(weight_sweep(scores, objective)).join(bounds, "fold_id"), components)


def fit_both_index(components: DataFrame, folds: int, ext: Extent, dataset: Column | None = None) -> DataFrame:
    """Parameters of the default objective with the label-free weights beside them (a_mono, b_mono)."""
    bounds = keep(fold_bounds(components, folds, dataset))
    scores = keep(fold_scores(components, bounds, folds, ext, dataset))
    mono = pick_weight(weight_sweep(scores, "mono")).select("fold_id", F.col("a").alias("a_mono"), F.col("b").alias("b_mono"))
    return guarded(pick_weight(weight_sweep(scores)).join(mono, "fold_id").join(bounds, "fold_id"), components)


def fit_left_out(components: DataFrame, left_out: DataFrame, ext: Extent, pool: str = "dataset", unit: str = "grp", objective: str = "mono+corr", steps: int = GRID_STEPS) -> DataFrame:
    """Fits that each leave some units of their pool out: ``left_out`` has (pool, fold_id, without) with an array of units.

    Bounds come from counts by subtraction; weights are scored on every asset of the pool outside ``without``, which is what
    leaving one out asks for: folds x assets scores, of which only sums leave a task. Beyond ``SAFE_GROUP`` rows a series is
    scored by distributed ranks for each fold.
    """
    wanted = {"E_lo": ("E", 0.01), "E_hi": ("E", 0.99), "C_lo": ("C", 0.01), "C_hi": ("C", 0.99)}
    left_out = keep(left_out)
    bounds = keep(quantiles_without(components, [pool], unit, wanted, left_out).where("E_lo IS NOT NULL"))
    if ext.longest <= SAFE_GROUP:
        grid = [round(i / (steps - 1), 6) for i in range(steps)]
        sums = mean_left_out(components, left_out.join(bounds, [pool, "fold_id"]), [(a, 1.0 - a) for a in grid], ext, pool, unit, objective == "mono")
        sweep = sums.groupBy("fold_id", F.round(F.col("w") / F.lit(float(steps - 1)), 6).alias("a"))
        sweep = sweep.agg(F.round(F.sum("_sum") / F.sum("_n"), 9).alias("fitness"), F.sum("_n").alias("n_train"))
        return pick_weight(sweep).join(bounds, "fold_id")
    assets = components.select(pool, unit, "asset_id").distinct()
    uses = assets.join(left_out, pool).where(~F.array_contains("without", F.col(unit))).select("asset_id", "fold_id").join(bounds.drop(pool), "fold_id")
    best = pick_weight(weight_sweep(score_grid(components, uses, ext, steps), objective))
    return best.join(bounds, "fold_id")


def apply_index(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Frozen index on any role's rows (needs fold_id)."""
    out = scale_by_fold(rows, params)
    return out.withColumn("index", F.round(F.col("a") * F.col("E_norm") + F.col("b") * F.col("C_norm"), 9))


def outside() -> Column:
    """1 where the unclipped E falls outside the training range."""
    return ((F.col("E_lin") > 1.0) | (F.col("E_lin") < 0.0)).cast("double")


def saturation(applied: DataFrame, keys) -> DataFrame:
    """Share of snapshots whose unclipped E falls outside the training range."""
    return applied.groupBy(*keys).agg(F.avg(outside()).alias("sat_frac"))


def velocity_acceleration(rows: DataFrame, keys, column: str, ext: Extent) -> DataFrame:
    """Backward first and second differences, zero where the history is too short."""
    out = neighbours(rows, keys, {"_b1": (column, 1), "_b2": (column, 2)}, ext)
    x = F.col(column)
    return out.withColumns(
        {
            f"{column}_vel": F.coalesce(x - F.col("_b1"), F.lit(0.0)),
            f"{column}_acc": F.coalesce(x - 2 * F.col("_b1") + F.col("_b2"), F.lit(0.0)),
        }
    ).drop("_b1", "_b2")


def central_gradient(rows: DataFrame, keys, column: str, name: str, ext: Extent) -> DataFrame:
    """Central differences with one-sided ends; zero for a single snapshot."""
    out = neighbours(rows, keys, {"_b": (column, 1), "_f": (column, -1)}, ext)
    x = F.col(column)
    g = F.coalesce((F.col("_f") - F.col("_b")) / 2, F.col("_f") - x, x - F.col("_b"), F.lit(0.0))
    return out.withColumn(name, g).drop("_b", "_f")


def trailing_slope(rows: DataFrame, keys, column: str, name: str, ext: Extent, k: int = 5) -> DataFrame:
    """Mean slope over the last ``k`` snapshots; over the available ones early in life, 0 at the first."""
    out = neighbours(rows, keys, {f"_s{i}": (column, i) for i in range(1, k + 1)}, ext)
    slope = F.lit(0.0)
    for i in range(1, k + 1):
        reach = F.col("pos") >= i
        slope = F.when(reach, (F.col(column) - F.col(f"_s{i}")) / F.lit(float(i))).otherwise(slope)
    return out.withColumn(name, slope).drop(*[f"_s{i}" for i in range(1, k + 1)])
