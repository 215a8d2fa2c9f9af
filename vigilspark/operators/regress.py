"""Tabular predictors per fold: train mean, ridge from mergeable moments, histogram trees, kernel machines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clip
from . import trees as trees_
from .health import assign_roles


def moments(rows: DataFrame, keys, features, target: str) -> DataFrame:
    """Means and scatter that determine every least-squares fit on the features: one small row per group.

    Groups are fold buckets, so a fold's training scatter is merged from its buckets and the data
    is read once however many folds there are. Scatter is centred, so large offsets cost no digits.
    """
    d = len(features)
    cols = [F.col(f) for f in features] + [F.col(target)]
    n = F.count(F.lit(1)).cast("double")
    cross = [F.covar_pop(cols[i], cols[j]) * n for i in range(d + 1) for j in range(i, d + 1)]
    return rows.groupBy(*keys).agg(n.alias("rows"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(*cross).alias("scatter"))


def merge_moments(parts: DataFrame, keys, features: int) -> DataFrame:
    """Merge the rows of each key (a fold's buckets, so few): scatter within plus scatter between them."""
    d = features + 1
    w = Window.partitionBy(*keys)
    centre = F.array(*[F.sum(F.col("rows") * F.col("mean")[i]).over(w) / F.sum("rows").over(w) for i in range(d)])
    off = [F.col("mean")[i] - F.col("_centre")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    return parts.withColumn("_centre", centre).groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.array(*[F.max(F.col("_centre")[i]) for i in range(d)]).alias("mean"),
        F.array(*[F.sum(F.col("scatter")[k] + F.col("rows") * off[i] * off[j]) for k, (i, j) in enumerate(pairs)]).alias("scatter"),
    )


def _ridge_udf(chosen: tuple[int, ...], d: int, alpha: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(rows: pd.Series, means: pd.Series, scatters: pd.Series) -> pd.Series:
        out = []
        for n, mean, scatter in zip(rows, means, scatters):
            mean = np.asarray(mean, float)
            full = np.zeros((d + 1, d + 1))
            full[np.triu_indices(d + 1)] = scatter
            cov = full + np.triu(full, 1).T
            k = list(chosen)
            std = np.sqrt(np.maximum(np.diag(cov)[k], 0.0) / n)
            std = np.where(std > 0, std, 1.0)
            gram = cov[np.ix_(k, k)] / np.outer(std, std) + alpha * np.eye(len(k))
            beta = np.linalg.solve(gram, cov[k, d] / std) / std if k else np.zeros(0)
            out.append([float(mean[d] - beta @ mean[k]), *beta.tolist()])
        return pd.Series(out)

    return solve


def ridge_by_fold(train: DataFrame, features, chosen, alpha: float = 1.0, name: str = "model") -> DataFrame:
    """Intercept and slopes per row of merged moments; features are standardised inside the penalty."""
    at = tuple(list(features).index(c) for c in chosen)
    return train.withColumn(name, _ridge_udf(at, len(features), alpha)("rows", "mean", "scatter"))


def linear_prediction(model: str, chosen) -> Column:
    out = F.col(model)[0]
    for i, c in enumerate(chosen):
        out = out + F.col(model)[i + 1] * F.col(c)
    return clip(out, 0, 1)


def predictions(rows: DataFrame, features, target: str, configs: dict[str, list[str]], folds: int, seeds: int, alpha: float = 1.0) -> DataFrame:
    """Held-out predictions of every configuration and seed, long form (config, y_true, y_pred).

    A seed re-deals assets to buckets; these fits choose nothing, so they learn from every asset but the held-out
    ones. An empty feature list is the training mean.
    """
    dealt = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    dealt = dealt.withColumn("bucket", F.pmod(F.floor(F.col("asset_id") / (F.col("seed") + 1)), F.lit(folds)).cast("int"))
    parts = moments(dealt, ["seed", "bucket"], features, target)
    train = merge_moments(assign_roles(parts, folds, "bucket").where("role <> 'test'"), ["seed", "fold_id"], len(features))
    for name, chosen in configs.items():
        train = ridge_by_fold(train, features, chosen, alpha, f"m_{name}")
    models = F.broadcast(train.drop("rows", "mean", "scatter"))  # seeds x folds rows
    out = dealt.withColumnRenamed("bucket", "fold_id").join(models, ["seed", "fold_id"])
    each = [F.struct(F.lit(n).alias("config"), F.round(linear_prediction(f"m_{n}", c), 9).alias("y_pred")) for n, c in configs.items()]
    keep = [c for c in rows.columns if c not in features or c == "pos"]
    return out.select("seed", "fold_id", *keep, F.explode(F.array(*each)).alias("_p")).select(
        "seed", "fold_id", *keep, "_p.config", "_p.y_pred"
    )


def tree_predictions(rows: DataFrame, features, target: str, folds: int, kind: str, trees: int, depth: int = 4, seed: int = 42, bucket: Column | None = None) -> DataFrame:
    """Held-out predictions of a forest or of boosted trees, fitted on all but the held-out bucket of each fold.

    The row of bucket b is scored by fold b, so every row goes out once; all rows with a target are learned from.
    """
    dealt = rows.withColumn("fold_id", (F.pmod(F.col("asset_id"), F.lit(folds)) if bucket is None else bucket).cast("int"))
    data = trees_.learn_from(dealt, features, target, "fold_id", whole=True)
    models = trees_.fit(rows.sparkSession, data, {f: [f] for f in range(folds)}, kind, trees, depth, seed=seed)
    out = trees_.scored(data, models)
    return out.withColumn("y_pred", clip(F.col("y_pred"), 0, 1)).drop(*features)


def _cosines(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Random cosines whose inner products approach a Gaussian kernel, what an RBF machine sees, of width 1 / number of features."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2.0 / d), (d, size)), rng.uniform(0, 2 * np.pi, size)
    return np.sqrt(2.0 / size) * np.cos(x @ w + b)


def kernel_fit(rows: DataFrame, features, targets: dict[str, Column], size: int = 192, penalty: float = 1e-3, seed: int = 42) -> dict[str, tuple[float, np.ndarray]]:
    """Least-squares kernel machines for all ``targets`` from one pass: {name: (intercept, weights)}.

    A task sums the products of its rows' cosines and targets; these matrices of fixed size are added cell by cell, and
    only their sum reaches the driver. Rows with a missing feature or target are left out.
    """
    names = list(targets)
    picked = rows.select(*features, *[t.cast("double").alias(f"_t{k}") for k, t in enumerate(targets.values())]).dropna()
    width = size + 1 + len(names)

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(features) + len(names))])
            m = np.column_stack([_cosines(x[:, : len(features)], size, seed), np.ones(len(x)), x[:, len(features) :]])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    cells = picked.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r.v for r in cells]).reshape(width, width) if cells else np.zeros((width, width))
    n = max(total[size, size], 1.0)
    mean, means = total[:size, size] / n, total[size + 1 :, size] / n
    gram = total[:size, :size] / n - np.outer(mean, mean) + penalty * np.eye(size) / size
    cross = total[:size, size + 1 :] / n - np.outer(mean, means)
    w = np.linalg.solve(gram, cross)
    return {name: (float(means[k] - mean @ w[:, k]), w[:, k]) for k, name in enumerate(names)}


def kernel_scores(rows: DataFrame, features, machines: dict[str, tuple[float, np.ndarray]], seed: int = 42) -> DataFrame:
    """Every row with one column per machine; NULL where a feature is missing."""
    names = list(machines)
    start, w = np.array([machines[k][0] for k in names]), np.column_stack([machines[k][1] for k in names])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T.DoubleType()) for k in names]])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            out = _cosines(x, len(w), seed) @ w + start
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(out[:, k], from_pandas=True) for k in range(len(names))]], names=schema.names)

    return rows.mapInArrow(run, schema)


def unit_scaled(rows: DataFrame, features, learn: Column) -> DataFrame:
    """Features with the mean and deviation of the rows that ``learn`` marks."""
    stats = rows.where(learn).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / (F.col(f"_s_{f}") + 1e-8) for f in features}).drop(*[f"_{k}_{f}" for f in features for k in "ms"])


def chronological_models(rows: DataFrame, features, label: str, target: str, kind: str, trees: int = 200, seed: int = 42) -> DataFrame:
    """Test rows of a chronological split (``role``) with a predicted stage and a predicted target.

    ``kind``: forest, boosted (depth 5, whole rows and columns) or kernel (least-squares machines on random cosines, one
    against the rest for stages). Stages are NULL when training has only one.
    """
    train = F.col("role") == "train"
    stages = sorted(r[0] for r in rows.where(train & F.col(label).isNotNull()).select(label).distinct().collect())
    if kind == "kernel":
        data = unit_scaled(rows, features, train)
        learn, test = data.where(train), data.where("role = 'test'")
        wanted = {f"_is_{k}": F.when(F.col(label) == c, 1.0).otherwise(-1.0) for k, c in enumerate(stages)} if len(stages) > 1 else {}
        out = kernel_scores(test, features, kernel_fit(learn, features, {"target_pred": F.col(target), **wanted}, seed=seed), seed)
        if wanted:
            best = F.array_max(F.array(*[F.struct(F.col(k).alias("s"), F.lit(c).alias("c")) for k, c in zip(wanted, stages)]))["c"]
            out = out.withColumn("stage_pred", best).drop(*wanted)
        else:
            out = out.withColumn("stage_pred", F.lit(None).cast("int"))
        return out.drop(*features).withColumn("stage_pred", F.col("stage_pred").cast("int"))
    # a row of any other role is neither learned from nor scored
    out = rows.withColumn("fold_id", F.when(train, 0).when(F.col("role") == "test", 1).otherwise(2))
    options = dict(kind=kind, trees=trees, depth=5, rate=0.3, share=1.0, seed=seed)
    data = trees_.learn_from(out, features, target, "fold_id", whole=True)
    out = trees_.scored(data, trees_.fit(rows.sparkSession, data, {1: [1, 2]}, **options), "target_pred")
    if len(stages) > 1:
        data = trees_.learn_from(out, features, label, "fold_id", whole=True)
        out = trees_.scored(data, trees_.fit(rows.sparkSession, data, {1: [1, 2]}, classes=stages, **options), "stage_pred")
    else:
        out = out.withColumn("stage_pred", F.lit(None).cast("double"))
    return out.where("role = 'test'").drop("fold_id", *features).withColumn("stage_pred", F.col("stage_pred").cast("int"))


def stage_classifier(rows: DataFrame, features, label: str, kind: str = "forest", trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Stage classifier on a chronological split (rows carry ``role``); empty when training has one class."""
    from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows)
    train, test = data.where("role = 'train'"), data.where("role = 'test'")
    if train.select(label).distinct().limit(2).count() < 2:
        return test.withColumn("stage_pred", F.lit(None).cast("int")).drop("_v").limit(0)
    if kind == "forest":
        model = RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    else:
        scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(train)
        train, test = scaler.transform(train), scaler.transform(test)
        model = OneVsRest(classifier=LinearSVC(featuresCol="_s"), featuresCol="_s", labelCol=label)
    got = model.fit(train).transform(test)
    return got.select(*rows.columns, F.col("prediction").cast("int").alias("stage_pred"))
