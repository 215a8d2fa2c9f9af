"""Pipelines shared by several queries, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health
from ..operators.ordered import Extent, keep
from ..sources.tables import KEY, dataset_number, event_runs
from .sqlkit import FOLDS

FEATURES = ["x", "y"]


def event_components(spark, folder, estimator: str = "diagonal", runs: tuple[DataFrame, Extent] | None = None, **options) -> tuple[DataFrame, Extent]:
    """Raw components of the event series; ``runs`` may bring the series and its extent, where several settings share them."""
    series, ext = runs or event_runs(spark, folder, FOLDS)
    return keep(health.raw_components(series, KEY, FEATURES, ext, estimator=estimator, **options)), ext


def event_roles(rows: DataFrame) -> DataFrame:
    """Rows of the event assets in every fold of their dataset; groups were dealt to the buckets whole."""
    return health.assign_roles(rows, FOLDS, "bucket", dataset_number()).drop("bucket")


def event_index(spark, folder, role: str | None = "test", objective: str = "mono+corr"):
    """Frozen index of every asset on its held-out fold (or all roles), with its parameters."""
    comp, ext = event_components(spark, folder)
    params = keep(health.fit_index(comp, FOLDS, ext, objective, dataset=dataset_number()))
    cols = ["dataset", "asset_id", "bucket", "pos", "n", "n_base", "x", "y", "E", "C"]
    rows = event_roles(comp.select(*cols))
    if role:
        rows = rows.where(F.col("role") == role)
    return health.apply_index(rows, params), params, ext


def long_indicators(rows: DataFrame, ids, columns: dict[str, str]) -> DataFrame:
    """Unpivot indicator columns: ``{label: column}`` becomes (indicator, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(c).cast("double").alias("value")) for k, c in columns.items()]))
    return rows.select(*ids, pairs.alias("_p")).select(*ids, "_p.indicator", "_p.value")
