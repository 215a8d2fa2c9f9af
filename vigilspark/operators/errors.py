"""Prediction-error metrics over (keys, pos, y_true, y_pred) rows; every metric is a plain aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Extent, position



def regression_metrics(rows: DataFrame, keys, true: str = "y_true", pred: str = "y_pred", late: float = 2.0, early: float = 1.0) -> DataFrame:
    """MAE, RMSE, R2 and the asymmetric linear score (late predictions cost more)."""
    e = F.col(pred) - F.col(true)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(true) * F.count(F.lit(1))).alias("_sst"),
        F.avg(late * F.greatest(e, F.lit(0.0)) + early * F.greatest(-e, F.lit(0.0))).alias("asym_score"),
    )
    return out.withColumn("r2", 1 - F.col("_sse") / (F.col("_sst") + 1e-12)).drop("_sse", "_sst")


def phm_score(error_hours: Column, early: float = 13.0, late: float = 10.0) -> Column:
    """Exponential penalty of one prediction error in hours; sum it per asset."""
    return F.when(error_hours < 0, F.exp(-error_hours / early) - 1).otherwise(F.exp(error_hours / late) - 1)


def interval_metrics(rows: DataFrame, keys, lo: str, hi: str, true: str = "y_true") -> DataFrame:
    inside = (F.col(true) >= F.col(lo)) & (F.col(true) <= F.col(hi))
    return rows.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("picp"), F.avg(F.col(hi) - F.col(lo)).alias("mpiw"))


def pinball(true: Column, quantile: Column, level: float) -> Column:
    e = true - quantile
    return F.greatest(F.lit(level) * e, F.lit(level - 1) * e)


def prognostic_metrics(rows: DataFrame, keys, cone: float = 0.2, band: float = 0.1, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy inside the relative cone and the reliable share counted back from failure.

    Both look at the degradation phase (y < 1) and are NULL when there is none. The run counted back
    from the end is what follows the last failing position, so no ordering is needed.
    """
    y, p = F.col(true), F.col(pred)
    down = rows.where(y < 1.0)
    in_cone = (p >= (1 - cone) * y) & (p <= (1 + cone) * y)
    ok = F.round(F.abs(p - y), 9) <= band
    per = down.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_m"),
        F.avg(in_cone.cast("double")).alias("alpha_lambda"),
        F.max("pos").alias("_last"),
        F.min("pos").alias("_first"),
        F.max(F.when(~ok, F.col("pos"))).alias("_bad"),
    )
    run = F.col("_last") - F.coalesce(F.col("_bad"), F.col("_first") - 1)
    return per.select(*keys, "alpha_lambda", (run / F.col("_m")).alias("prognostic_horizon"))


def classification_metrics(rows: DataFrame, keys, true: str, pred: str) -> DataFrame:
    """Accuracy, macro F1 over true and predicted labels, balanced accuracy over true labels."""
    keys = list(keys)
    cells = rows.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("_c"))
    same = F.col(true) == F.col(pred)
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.when(same, F.col("_c")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(same, 0).otherwise(F.col("_c")).alias("fn")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(same, 0).otherwise(F.col("_c")).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    per = cells.select(*keys, F.explode(sides).alias("_s")).select(*keys, "_s.*")
    per = per.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum(tp + fn)).alias("accuracy"),
        F.avg(2 * tp / (2 * tp + fp + fn)).alias("macro_f1"),
        F.avg(F.when(tp + fn > 0, tp / (tp + fn))).alias("balanced_accuracy"),
    )


def to_snapshots(windows: DataFrame, keys, votes=(), firsts=(), means=(), order: str = "pos") -> DataFrame:
    """Window rows to snapshot rows: majority vote (ties to the smallest label), first value, mean."""
    keys = list(keys)
    base = windows.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in firsts], *[F.avg(c).alias(c) for c in means], F.count(F.lit(1)).alias("n_windows"))
    for v in votes:
        tally = windows.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_c"))
        base = base.join(tally.groupBy(*keys).agg(F.max_by(v, F.struct(F.col("_c"), -F.col(v))).alias(v)), keys)
    return base


def conformal_quantile(residuals: DataFrame, keys, value: str, alphas, ext: Extent) -> DataFrame:
    """Residual quantile at level min(ceil((m+1)(1-alpha))/m, 1) per group and alpha, linearly interpolated.

    The level depends on the group size, so the two neighbouring order statistics are picked by position.
    """
    keys = list(keys)
    rows = position(residuals.select(*keys, value, "pos"), keys, [value, "pos"], ext, "_k", "_m")
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    m = F.col("_m")
    level = F.least(F.ceil(F.round((m + 1) * (1 - F.col("alpha")), 9)) / m, F.lit(1.0))
    at = F.round(level * (m - 1), 9)
    rows = rows.withColumns({"_lo": F.floor(at), "_hi": F.ceil(at), "_w": at - F.floor(at)})
    out = rows.groupBy(*keys, "alpha").agg(
        F.max(F.when(F.col("_k") == F.col("_lo"), F.col(value))).alias("_a"),
        F.max(F.when(F.col("_k") == F.col("_hi"), F.col(value))).alias("_b"),
        F.max("_w").alias("_w"),
        F.max("_m").alias("n_cal"),
    )
    return out.select(*keys, "alpha", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("q"), "n_cal")


def next_in_order(assets: DataFrame, keys, ext: Extent, name: str = "cal_asset") -> DataFrame:
    """Pair each asset with the next one of its group, cyclically; assets without a partner drop out."""
    keys = list(keys)
    at = position(assets.select(*keys, "asset_id").distinct(), keys, ["asset_id"], ext)
    nxt = at.select(*keys, F.col("pos").alias("_to"), F.col("asset_id").alias(name))
    out = at.withColumn("_to", F.pmod(F.col("pos") + 1, F.col("n"))).join(nxt, [*keys, "_to"])
    return out.where(F.col("asset_id") != F.col(name)).select(*keys, "asset_id", name)


