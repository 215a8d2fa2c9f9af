"""Persistent alarms: ``q`` consecutive snapshots above a threshold.

A run of ``q`` values above the threshold is the same as their minimum being above it, so the
rolling minimum is computed once and serves every threshold of a grid. A grid never multiplies
rows: a value gets its place in the grid, rows are aggregated by place, and only those sums are
spread over the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Extent, neighbours, trailing_count


def persistent_flags(rows: DataFrame, keys, value: str, threshold: Column, ext: Extent, q: int = 3, name: str = "flag", back_fill: bool = True) -> DataFrame:
    """0/1 alarm per snapshot; with ``back_fill`` the whole run is flagged, else only from its q-th step."""
    keys = list(keys)
    out = trailing_count(rows.withColumn("_thr", threshold), keys, F.col(value) > F.col("_thr"), q, "_run", ext)
    out = out.withColumn("_hit", (F.col("_run") == q).cast("int"))
    flag = F.col("_hit")
    extra = []
    if back_fill and q > 1:
        out = neighbours(out, keys, {f"_h{i}": ("_hit", -i) for i in range(1, q)}, ext)
        extra = [f"_h{i}" for i in range(1, q)]
        flag = F.greatest(flag, *[F.coalesce(F.col(c), F.lit(0)) for c in extra])
    return out.withColumn(name, flag).drop("_thr", "_run", "_hit", *extra)


def with_run_minimum(rows: DataFrame, keys, value: str, ext: Extent, q: int = 3, name: str = "run_min") -> DataFrame:
    """Minimum of the last ``q`` values; NULL before the q-th snapshot."""
    out = neighbours(rows, list(keys), {f"_m{i}": (value, i) for i in range(1, q)}, ext)
    low = F.least(F.col(value), *[F.col(f"_m{i}") for i in range(1, q)]) if q > 1 else F.col(value)
    return out.withColumn(name, F.when(F.col("pos") >= q - 1, low)).drop(*[f"_m{i}" for i in range(1, q)])


def first_persistent(rows: DataFrame, keys, threshold: Column, q: int = 3, run_min: str = "run_min") -> DataFrame:
    """First index of a persistent exceedance per group, -1 when there is none.

    Rows need ``run_min`` and ``n``. For a grid of thresholds use ``first_over_grid``.
    """
    start = F.when(F.col(run_min) > threshold, F.col("pos") - (q - 1))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(start), F.lit(-1)).cast("bigint").alias("first"), F.max("n").alias("n"))


def with_grid_place(rows: DataFrame, value: str, grid: Column, threshold, most: int, name: str = "_place") -> DataFrame:
    """How many of the grid's thresholds lie below ``value``; NULL for a NULL value.

    ``threshold`` maps a grid value to a threshold and must not fall along the grid, which holds at
    most ``most`` values. A bisection with the very comparisons of the grid, so no rounding enters.
    """
    out = rows.withColumn(name, F.when(F.col(value).isNotNull(), F.lit(0)))
    for bit in reversed(range(most.bit_length())):
        step = 1 << bit
        above = F.col(value) > threshold(F.get(grid, F.col(name) + F.lit(step - 1)))
        out = out.withColumn(name, F.when(above, F.col(name) + F.lit(step)).otherwise(F.col(name)))
    return out


def first_over_grid(rows: DataFrame, keys, grid: Column, threshold, most: int, param: str, q: int = 3, run_min: str = "run_min") -> DataFrame:
    """``first_persistent`` for every value of a grid, as one row per group and ``param``.

    A threshold is passed at the earliest of the rows whose place lies beyond it: the shuffle carries
    at most one row per group and place, whatever the length of the series. ``grid`` may depend on ``keys``.
    """
    keys = list(keys)
    placed = with_grid_place(rows, run_min, grid, threshold, most)
    ends = placed.groupBy(*keys, "_place").agg(F.min(F.col("pos") - (q - 1)).alias("_start"), F.max("n").alias("_n"))
    ends = ends.groupBy(*keys).agg(F.collect_list(F.struct("_place", "_start")).alias("_ends"), F.max("_n").alias("n"))
    out = ends.select(*keys, "n", "_ends", F.posexplode(grid).alias("_at", param))
    beyond = F.filter("_ends", lambda e: e["_place"] > F.col("_at"))
    first = F.coalesce(F.array_min(F.transform(beyond, lambda e: e["_start"])), F.lit(-1)).cast("bigint")
    return out.select(*keys, param, first.alias("first"), "n")


def healthy_level(rows: DataFrame, keys, value: str, fraction: float = 0.2) -> DataFrame:
    """Mean and population deviation of the healthy prefix (at least five snapshots)."""
    healthy = F.col("pos") < F.greatest(F.lit(5), F.floor(F.col("n") * F.lit(float(fraction))))
    v = F.when(healthy, F.col(value))
    return rows.groupBy(*keys).agg(F.avg(v).alias("level"), F.stddev_pop(v).alias("spread"))


def sigma_threshold(k: Column) -> Column:
    return F.col("level") + k * F.col("spread") + F.lit(1e-9)


def onset_at(n: Column, fraction: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * fraction)).cast("bigint")


def alarm_scores(firsts: DataFrame, onset: Column) -> DataFrame:
    """Precision, recall, lead and F1 of an alarm that stays on from ``first`` to the end.

    A detector that never fires scores zero precision and recall and has no lead.
    """
    fired = F.col("first") >= 0
    hits = F.col("n") - F.greatest(F.col("first"), F.col("onset"))
    out = firsts.withColumn("onset", onset).withColumns(
        {
            "fired": fired.cast("int"),
            "precision": F.when(fired, hits / F.greatest(F.col("n") - F.col("first"), F.lit(1))).otherwise(F.lit(0.0)),
            "recall": F.when(fired, hits / F.greatest(F.col("n") - F.col("onset"), F.lit(1))).otherwise(F.lit(0.0)),
            "lead": F.when(fired, F.col("onset") - F.col("first")),
        }
    )
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total))


def select_parameter(scores: DataFrame, keys, param: str) -> DataFrame:
    """Parameter with the best mean F1 per group; the smallest one among equals."""
    keys = list(keys)
    mean = scores.groupBy(*keys, param).agg(F.round(F.avg("f1"), 9).alias("_f1"))
    best = F.max_by(param, F.struct(F.col("_f1"), -F.col(param)))
    return mean.groupBy(*keys).agg(best.alias(param), F.max("_f1").alias("train_f1"))


def flag_metrics(rows: DataFrame, keys, flag: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Snapshot-level precision, recall (NULL when undefined) and false-alarm rate of alarm flags.

    ``weight``: how many snapshots a row stands for.
    """
    on, pos = F.col(flag) == 1, positive
    n = lambda c: F.sum(c.cast("bigint") if weight is None else c.cast("bigint") * weight)
    agg = rows.groupBy(*keys).agg(
        n(on & pos).alias("tp"), n(on & ~pos).alias("fp"), n(~on & pos).alias("fn"), n(~pos).alias("healthy")
    )
    return agg.withColumns(
        {
            "precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))),
            "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))),
            "far": F.when(F.col("healthy") > 0, F.col("fp") / F.col("healthy")),
        }
    )


def precision_at_recall(curve: DataFrame, keys, targets) -> DataFrame:
    """Best precision among operating points that reach each recall target; NULL if none does."""
    cols = [
        F.struct(F.lit(float(t)).alias("recall_target"), F.max(F.when(F.col("recall") >= t, F.col("precision"))).alias("precision"))
        for t in targets
    ]
    out = curve.groupBy(*keys).agg(F.array(*cols).alias("_t")).withColumn("_t", F.explode("_t"))
    return out.select(*keys, "_t.recall_target", "_t.precision")


def envelope_area(curve: DataFrame, keys, points: int = 1001) -> DataFrame:
    """Area under the upper precision envelope on an even recall grid (trapezoid rule).

    The envelope at recall r is the best precision with recall >= r: each operating point is
    offered to every grid step it reaches, and the maximum is taken map-side.
    """
    keys = list(keys)
    last = points - 1
    step = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_i")
    reach = curve.select(*keys, "precision", "recall", step)
    value = F.when(F.col("recall") >= F.col("_i") / F.lit(float(last)), F.col("precision"))
    env = reach.groupBy(*keys, "_i").agg(F.coalesce(F.max(value), F.lit(0.0)).alias("_e"))
    edge = F.when(F.col("_i").isin(0, last), F.lit(0.5)).otherwise(F.lit(1.0))
    return env.groupBy(*keys).agg((F.sum(F.col("_e") * edge) / F.lit(float(last))).alias("auprc"))
