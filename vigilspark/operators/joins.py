"""Join and set helpers with the conventions of the analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Extent, position


def replace_columns(rows: DataFrame, fresh: DataFrame, keys, columns) -> DataFrame:
    """Swap stale columns for freshly computed ones; a row without a partner fails the job."""
    keys = list(keys)
    out = rows.drop(*[c for c in columns if c in rows.columns]).join(fresh.select(*keys, *columns), keys, "left")
    message = F.lit("no fresh value after the merge")
    return out.withColumns({c: F.coalesce(F.col(c), F.raise_error(message).cast(fresh.schema[c].dataType)) for c in columns})


def lookup(rows: DataFrame, dimension: DataFrame, keys, defaults: dict[str, object]) -> DataFrame:
    """Left join to a dimension with defaults for missing keys; Spark broadcasts it while it is small."""
    out = rows.join(dimension, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def remaining(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Work that has no finished key yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keep_keys(rows: DataFrame, chosen: DataFrame, keys) -> DataFrame:
    return rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def common_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def paired(facts: DataFrame, keys, config: str, value: str, a: str, b: str) -> DataFrame:
    """Two configurations side by side: one pass and one shuffle instead of a self-join."""
    pick = {side: F.max(F.when(F.col(config) == name, F.col(value))).alias(side) for side, name in (("a", a), ("b", b))}
    return facts.where(F.col(config).isin(a, b)).groupBy(*keys).agg(*pick.values()).where("a is not null and b is not null")


def reconcile(claims: DataFrame, results: DataFrame, keys, claimed: str = "claimed", value: str = "value", tolerance: str = "tolerance") -> DataFrame:
    """Status of each claimed number against the result table: ok, mismatch or missing."""
    out = claims.join(results, list(keys), "left")
    close = F.abs(F.col(value) - F.col(claimed)) <= F.col(tolerance)
    status = F.when(F.col(value).isNull(), "missing").when(close, "ok").otherwise("mismatch")
    return out.withColumn("status", status)


def manifest_of(windows: DataFrame, keys, snapshot: str = "snapshot_id", temperature: str = "temperature") -> DataFrame:
    """Snapshots, windows and sensor flag per asset."""
    return windows.groupBy(*keys).agg(
        F.countDistinct(snapshot).alias("n_snapshots"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max(F.col(temperature).isNotNull()).alias("has_temp"),
    )


def ordered_by_category(rows: DataFrame, column: str, order) -> DataFrame:
    """Sort by a custom category order; unknown categories come last."""
    rank = F.coalesce(*[F.when(F.col(column) == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))
    return rows.withColumn("_o", rank).orderBy("_o", column).drop("_o")


def extreme_rows(rows: DataFrame, keys, value: str, worst: int, best: int, tie: str, ext: Extent) -> DataFrame:
    """The ``worst`` largest and ``best`` smallest rows of each group, ranked from their end."""
    out = position(rows, keys, [value, tie], ext, "_up", "_n")
    down = F.col("_n") - 1 - F.col("_up")
    kind = F.when(down < worst, "WORST").when(F.col("_up") < best, "BEST")
    return out.withColumns({"kind": kind, "place": F.when(down < worst, down + 1).otherwise(F.col("_up") + 1)}).where("kind is not null").drop("_up", "_n")


def flag(c: Column) -> Column:
    return c.cast("int")
