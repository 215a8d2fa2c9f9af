"""Per-asset composite index (first generation): prefix scaling, fixed and fitted weights, ablations.

It fits on the asset's own lifetime, so it describes a run and does not predict one; the fold index
of :mod:`health` is the leakage-free form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip
from .health import mahalanobis, robust_scale, state_change, trailing_slope
from .ordered import Extent
from .weights import score_weights

# Hand-set component weights with and without a temperature channel.
FIXED_WITH_TEMPERATURE = (0.5, 0.3, 0.2)
FIXED_VIBRATION_ONLY = (0.625, 0.375, 0.0)


def prefix_minmax(rows: DataFrame, keys, columns, prefix: Column) -> DataFrame:
    """Min-max of each column over the rows where ``prefix`` holds, clipped to [0, 1]."""
    keys = list(keys)
    lim = rows.groupBy(*keys).agg(
        *[f(F.when(prefix, F.col(c))).alias(f"_{t}_{c}") for c in columns for f, t in ((F.min, "lo"), (F.max, "hi"))]
    )
    scaled = {
        f"{c}_norm": clip((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + EPS), 0, 1) for c in columns
    }
    return rows.join(lim, keys).withColumns(scaled).drop(*[f"_{t}_{c}" for c in columns for t in ("lo", "hi")])


def combine(weights, sigmoid: bool = False, parts=("E_norm", "C_norm", "G_norm")) -> Column:
    total = F.lit(0.0)
    for w, c in zip(weights, parts):
        total = total + (w if isinstance(w, Column) else F.lit(float(w))) * F.col(c)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if sigmoid else total


def composite_components(series: DataFrame, keys, features, temperature: str, ext: Extent, baseline: float = 0.2, train: float = 0.6, k: int = 5) -> DataFrame:
    """E (plain covariance), C (state change) and G (temperature slope), raw and prefix-scaled."""
    n_base = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(float(baseline)))).cast("bigint")
    out = series.withColumn("n_base", n_base)
    out = robust_scale(out, keys, features, ext)
    out = mahalanobis(out, keys, features, "empirical")
    out = state_change(out, keys, features, ext)
    out = trailing_slope(out, keys, temperature, "G", ext, k)
    prefix = F.col("pos") < F.greatest(F.col("n_base"), F.floor(F.col("n") * F.lit(float(train))))
    return prefix_minmax(out, keys, ["E", "C", "G"], prefix)


def simplex_grid(step: float = 0.05, temperature: bool = True) -> list[tuple[float, float, float]]:
    k = round(1 / step)
    grid = [(round(i * step, 6), round(j * step, 6), round((k - i - j) * step, 6)) for i in range(k + 1) for j in range(k + 1 - i)]
    return grid if temperature else [g for g in grid if g[2] == 0.0]


def fit_simplex(rows: DataFrame, keys, ext: Extent, step: float = 0.05, temperature: bool = True) -> DataFrame:
    """Per-asset weights on the simplex that maximise monotonicity + |Spearman|; first maximum wins."""
    keys = list(keys)
    grid = simplex_grid(step, temperature)
    scored = score_weights(rows, keys, ["E_norm", "C_norm", "G_norm"], grid, ext)
    fit = F.round(F.col("mono") + F.abs("rho"), 9)
    best = scored.groupBy(*keys).agg(F.max_by("w", F.struct(fit, -F.col("w"))).alias("_w"), F.max(fit).alias("fitness"))
    table = F.array(*[F.array(*[F.lit(x) for x in g]) for g in grid])
    picked = best.withColumn("_wt", table[F.col("_w")])
    return picked.select(*keys, *[F.col("_wt")[i].alias(n) for i, n in enumerate(("wE", "wC", "wG"))], "fitness")


def without_component(drop: str, temperature: bool = True) -> Column:
    """Index with one weight removed and the rest renormalised; NULL when nothing would be left."""
    w = {c: (F.lit(0.0) if c == drop else F.col(f"w{c}")) for c in "ECG"}
    total = w["E"] + w["C"] + w["G"]
    value = combine([w[c] / total for c in "ECG"])
    if drop == "G" and not temperature:
        return F.lit(None).cast("double")
    return F.when(total >= 1e-9, value)


def with_indices(rows: DataFrame, fitted: DataFrame, keys, temperature: bool = True) -> DataFrame:
    """Fixed, fitted and ablated indices; an ablation that does not apply repeats the fitted index."""
    fixed = FIXED_WITH_TEMPERATURE if temperature else FIXED_VIBRATION_ONLY
    out = rows.join(fitted, list(keys)).withColumns(
        {"index_fixed": combine(fixed), "index_fitted": combine([F.col("wE"), F.col("wC"), F.col("wG")])}
    )
    return out.withColumns(
        {f"index_wo_{c}": F.coalesce(without_component(c, temperature), F.col("index_fitted")) for c in "ECG"}
    )
