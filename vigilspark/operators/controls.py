"""Negative and oracle controls that accompany the fold index, and the conditioning table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip, hash32, uniform
from .health import apply_index, assign_roles, bucket_of, fit_both_index, outside, saturation, velocity_acceleration
from .ordered import SAFE_GROUP, Extent, keep, position, spread


def random_weight(fold: Column, asset: Column) -> Column:
    return uniform(fold, asset, "rand")


def shuffled(rows: DataFrame, keys, column: str, name: str, ext: Extent) -> DataFrame:
    """Permute a column inside each group, in an order hashed from group and position.

    While groups are small, a row and the value that goes to its place meet in windows of the group, so rows that already lie
    together by some of ``keys`` are not exchanged.
    """
    keys = list(keys)
    if ext.longest <= SAFE_GROUP:
        order = Window.partitionBy(*keys).orderBy(hash32(*[F.col(k) for k in keys], F.col("pos"), "shuf"), "pos")
        kind = rows.schema["pos"].dataType
        both = rows.withColumn("_to", (F.row_number().over(order) - 1).cast(kind))
        value = F.lit(None).cast(rows.schema[column].dataType)
        twice = F.array(F.struct(F.col("pos").alias("at"), F.lit(True).alias("own"), value.alias("v")), F.struct(F.col("_to").alias("at"), F.lit(False).alias("own"), F.col(column).alias("v")))
        both = both.withColumn("_x", F.explode(twice)).withColumns({"_at": F.col("_x.at"), "_own": F.col("_x.own"), "_v": F.col("_x.v")}).drop("_to", "_x")
        found = both.withColumn(name, F.max("_v").over(Window.partitionBy(*keys, "_at")))
        return found.where("_own").drop("_at", "_own", "_v")
    draw = rows.select(*keys, "pos", F.col(column).alias(name), hash32(*[F.col(k) for k in keys], F.col("pos"), "shuf").alias("_h"))
    drawn = position(draw, keys, ["_h", "pos"], ext, "_to", None).select(*keys, F.col("_to").alias("pos"), name)
    return rows.join(drawn, [*keys, "pos"])


def fold_feature_stats(train: DataFrame, features) -> DataFrame:
    """Population mean and deviation of each feature over the training rows of each fold."""
    aggs = [f(c).alias(f"_{t}_{c}") for c in features for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]
    return train.groupBy("fold_id").agg(*aggs, F.max("n").alias("H_max_train"))


def clipped_score(c: str) -> Column:
    return clip((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + EPS), -5, 5)


def conditioning_table(components: DataFrame, features, folds: int, ext: Extent, dataset: Column | None = None) -> DataFrame:
    """Every conditioning column of every asset in every fold, fitted on training assets only."""
    key = bucket_of(components)
    cols = list(dict.fromkeys(["dataset", "asset_id", key, "pos", "n", "E", "C", *features]))
    params = keep(fit_both_index(components, folds, ext, dataset))
    train = assign_roles(components.select(*cols), folds, key, dataset).where("role = 'train'")
    stats = F.broadcast(fold_feature_stats(train, features))  # one row per fold
    keys = ["fold_id", "asset_id"]
    # exchanged once, before there is a row per fold; what follows by (fold, asset) then finds its rows together
    rows = components.select(*cols)
    if ext.longest <= SAFE_GROUP:
        rows = spread(rows, "asset_id", rows=2 * folds * ext.rows)
    rows = assign_roles(rows, folds, key, dataset)
    out = apply_index(rows, params).select(*rows.columns, "index")
    out = velocity_acceleration(out, keys, "index", ext)
    out = shuffled(out, keys, "index", "index_shuf", ext)
    # the columns that follow from a row and its fold are made last, so they are neither exchanged nor sorted
    out = apply_index(out.drop("index"), params).join(stats, "fold_id")
    a_r = random_weight(F.col("fold_id"), F.col("asset_id"))
    out = out.withColumns(
        {
            "index_mono": F.col("a_mono") * F.col("E_norm") + F.col("b_mono") * F.col("C_norm"),
            "index_rand": a_r * F.col("E_norm") + (F.lit(1.0) - a_r) * F.col("C_norm"),
            "elapsed_norm": F.col("pos") / F.greatest(F.col("H_max_train"), F.lit(1)),
            "deg_oracle": F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1)),
            **{f"hc_{c}": clipped_score(c) for c in features},
        }
    )
    if ext.longest <= SAFE_GROUP:
        return out.withColumn("sat_frac", F.avg(outside()).over(Window.partitionBy(*keys)))
    return out.join(saturation(out, keys), keys)


def fold_record(components: DataFrame, folds: int, ext: Extent, dataset: Column | None = None, held_out: str = "inner") -> DataFrame:
    """One record per fold: frozen parameters of both objectives, training size, held-out saturation.

    A fold whose bucket holds no asset has no record; with ``held_out="left"`` it has one without saturation.
    """
    key = bucket_of(components)
    rows = assign_roles(components.select(*dict.fromkeys(["asset_id", key, "pos", "n", "n_base", "E", "C"])), folds, key, dataset)
    train = rows.where("role = 'train'")
    params = fit_both_index(components, folds, ext, dataset)
    longest = train.groupBy("fold_id").agg(F.max("n").alias("H_max_train"))
    held = apply_index(rows.where("role = 'test'"), params)
    out_of_range = ((F.col("E_lin") > 1.0) | (F.col("E_lin") < 0.0)).cast("double")
    sat = held.groupBy("fold_id").agg(F.avg(out_of_range).alias("holdout_sat_frac"), F.max("n_base").alias("holdout_n_baseline"))
    return params.join(longest, "fold_id").join(sat, "fold_id", held_out)
