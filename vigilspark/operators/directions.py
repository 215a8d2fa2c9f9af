"""Linear health indicators found from the data: principal component and best linear parameter."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Extent, quantiles
from .quality import spearman_vs_life
from .weights import score_weights


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leading_vector(cov: pd.Series) -> pd.Series:
    """First eigenvector of a symmetric matrix from its lower triangle by rows, its largest entry positive."""
    out = []
    for flat in cov:
        d = int(round((math.sqrt(8 * len(flat) + 1) - 1) / 2))
        m = np.zeros((d, d))
        m[np.tril_indices(d)] = np.array(flat, float)  # eigh reads the lower triangle alone
        v = np.linalg.eigh(m)[1][:, -1]
        out.append((v if v[np.argmax(np.abs(v))] >= 0 else -v).tolist())
    return pd.Series(out)


def leading_direction(rows: DataFrame, keys, columns) -> DataFrame:
    """First principal direction per group from pre-aggregated covariances."""
    cov = F.array(*[F.covar_pop(columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1)])
    return rows.groupBy(*keys).agg(cov.alias("_cov")).select(*keys, _leading_vector("_cov").alias("pc"))


def _project(columns, vector: str):
    return sum((F.col(vector)[i] * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))


def standardise_by_fold(rows: DataFrame, train: DataFrame, features) -> DataFrame:
    """s_<f>: features on the training scale of each fold (population deviation)."""
    aggs = [f(c).alias(f"_{t}_{c}") for c in features for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]
    stats = F.broadcast(train.groupBy("fold_id").agg(*aggs))  # one row per fold
    scale = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in features}
    out = rows.join(stats, "fold_id").withColumns({f"s_{c}": (F.col(c) - F.col(f"_m_{c}")) / scale[c] for c in features})
    return out.drop(*[f"_{t}_{c}" for c in features for t in ("m", "s")])


def pca_index_by_fold(rows: DataFrame, features, ext: Extent) -> DataFrame:
    """PC1 fitted on training rows, applied to the rest; turned so that it rises over each life.

    The turn looks at the held-out life itself, so the sign (only) is label-aware.
    """
    std = standardise_by_fold(rows, rows.where("role = 'train'"), features)
    s = [f"s_{c}" for c in features]
    pc = F.broadcast(leading_direction(std.where("role = 'train'"), ["fold_id"], s))  # one row per fold
    held = std.where("role = 'test'").join(pc, "fold_id").withColumn("_pc1", _project(s, "pc"))
    keys = ["fold_id", "asset_id"]
    turn = spearman_vs_life(held, keys, "_pc1", ext, "_rho")
    sign = F.when(F.col("_rho") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return held.join(turn, keys).withColumn("pca_index", sign * F.col("_pc1")).drop("_pc1", "_rho", "pc")


def pca_index_by_asset(rows: DataFrame, keys, columns, ext: Extent) -> DataFrame:
    """Distance of the baseline-fitted PC1 score from its baseline median."""
    keys = list(keys)
    base = F.col("pos") < F.col("n_base")
    pc = leading_direction(rows.where(base), keys, columns)
    scored = rows.join(pc, keys).withColumn("_score", _project(columns, "pc"))
    mid = quantiles(scored.where(base), keys, {"_mid": ("_score", 0.5)}, ext)
    return scored.join(mid, keys).withColumn("pca_index", F.abs(F.col("_score") - F.col("_mid"))).drop("_score", "_mid", "pc")


# ------------------------------------------------------------------ best linear parameter
def _gauss(*parts) -> float:
    u = [int(hashlib.md5("|".join(map(str, (*parts, t))).encode()).hexdigest()[:8], 16) for t in ("r", "t")]
    return math.sqrt(-2.0 * math.log((u[0] + 0.5) / 4294967296.0)) * math.cos(2.0 * math.pi * u[1] / 4294967296.0)


def random_directions(count: int, dims: int, tag: str = "w") -> list[tuple[float, ...]]:
    """Unit vectors that depend only on (tag, index)."""
    out = []
    for k in range(count):
        v = [_gauss(tag, k, d) for d in range(dims)]
        norm = math.sqrt(sum(x * x for x in v))
        out.append(tuple(x / norm for x in v))
    return out


def linear_parameter_fitness(std_train: DataFrame, columns, weights, ext: Extent) -> DataFrame:
    """Mean monotonicity + mean trendability + prognosability per (fold, weight)."""
    scored = score_weights(std_train, ["fold_id", "asset_id"], columns, weights, ext)
    span = F.avg(F.abs(F.col("first_value") - F.col("last_value"))) + 1e-12
    fit = F.avg("mono") + F.avg("trend") + F.exp(-F.stddev_pop("last_value") / span)
    return scored.groupBy("fold_id", "w").agg(F.round(fit, 9).alias("fitness"))


def best_linear_parameter(std_train: DataFrame, columns, ext: Extent, candidates: int = 200, rounds: int = 3, shrink: float = 0.3) -> DataFrame:
    """Search unit-norm weights in rounds of candidates; each round narrows around the best so far.

    Only the winning vector of each fold returns to the driver between rounds.
    """
    spark = std_train.sparkSession
    d = len(columns)
    table: dict | list = random_directions(candidates, d)
    best: dict[int, tuple[float, tuple[float, ...]]] = {}
    for r in range(rounds):
        scores = linear_parameter_fitness(std_train, columns, table, ext)
        top = scores.groupBy("fold_id").agg(F.max_by("w", F.struct("fitness", -F.col("w"))).alias("w"), F.max("fitness").alias("fitness"))
        for row in top.collect():  # one row per fold
            pool = table[row.fold_id] if isinstance(table, dict) else table
            if row.fold_id not in best or row.fitness > best[row.fold_id][0]:
                best[row.fold_id] = (row.fitness, pool[row.w])
        radius = shrink ** (r + 1)
        table = {}
        for fold, (_, centre) in best.items():
            near = []
            for k in range(candidates):
                v = [c + radius * _gauss("near", r, k, i) for i, c in enumerate(centre)]
                norm = math.sqrt(sum(x * x for x in v))
                near.append(tuple(x / norm for x in v))
            table[fold] = near
    rows = [(int(f), float(fit), [float(x) for x in w]) for f, (fit, w) in sorted(best.items())]
    return spark.createDataFrame(rows, "fold_id int, fitness double, weights array<double>")
