"""Indicator-quality criteria over long series: rows of (keys, pos, n, value).

A NULL value keeps its place: it has no rank and makes no step, and rank correlations are over complete rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import correlation, guarded
from . import ordered
from .ordered import Extent, average_rank, neighbours, position, quantiles, series_codes, spread

CRITERIA = ["monotonicity", "signed_monotonicity", "trendability", "rho", "smoothness", "n_pos", "n_neg", "n_tie", "first_value", "last_value"]


def _complete(rows: DataFrame, columns) -> DataFrame:
    """Blank all of ``columns`` in rows where one of them is NULL; the rows stay, so no group is lost."""
    columns = list(dict.fromkeys(columns))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return rows.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def spearman(rows: DataFrame, keys, x: str, y: str, ext: Extent, name: str = "rho", min_rows: int = 3) -> DataFrame:
    """Signed rank correlation per group, 0 for short or constant series."""
    keys = list(keys)
    ranked = average_rank(_complete(rows.select(*keys, x, y), [x, y]), keys, x, "_rx", ext)
    ranked = average_rank(ranked, keys, y, "_ry", ext)
    out = ranked.groupBy(*keys).agg(
        correlation("_rx", "_ry").alias("_c"),
        F.count("_rx").alias("_n"),
        F.stddev_pop(x).alias("_sx"),
        F.stddev_pop(y).alias("_sy"),
    )
    ok = (F.col("_n") >= min_rows) & (F.col("_sx") >= 1e-12) & (F.col("_sy") >= 1e-12)
    return out.select(*keys, guarded(ok, F.col("_c")).alias(name))


def spearman_vs_life(rows: DataFrame, keys, value: str, ext: Extent, name: str = "rho", min_rows: int = 3) -> DataFrame:
    """Same against the position, whose rank is the position itself: only one ranking is needed."""
    keys = list(keys)
    ranked = average_rank(rows.select(*keys, "pos", value), keys, value, "_r", ext)
    out = ranked.groupBy(*keys).agg(
        correlation("_r", "pos").alias("_c"), F.count("_r").alias("_n"), F.stddev_pop(value).alias("_s")
    )
    ok = (F.col("_n") >= min_rows) & (F.col("_s") >= 1e-12)
    return out.select(*keys, guarded(ok, F.col("_c")).alias(name))


def partial_spearman(rows: DataFrame, keys, x: str, y: str, z: str, ext: Extent, name: str = "partial") -> DataFrame:
    """Rank correlation of x and y with z held fixed."""
    keys = list(keys)
    ranked = _complete(rows.select(*keys, x, y, z), [x, y, z])
    for c, r in ((x, "_rx"), (y, "_ry"), (z, "_rz")):
        ranked = average_rank(ranked, keys, c, r, ext)

    def pearson(a, b):
        top = F.covar_pop(a, b)
        return top / (F.stddev_pop(a) * F.stddev_pop(b) + 1e-12)

    out = ranked.groupBy(*keys).agg(
        pearson("_rx", "_ry").alias("_xy"), pearson("_rx", "_rz").alias("_xz"), pearson("_ry", "_rz").alias("_yz")
    )
    bottom = F.sqrt(F.greatest((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")), F.lit(0.0))) + 1e-12
    return out.select(*keys, ((F.col("_xy") - F.col("_xz") * F.col("_yz")) / bottom).alias(name), F.col("_xy").alias("raw"))


def series_criteria(starts: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Criteria of every series of ``v``, which lie one after another in order of position and begin at ``starts``.

    NaN is the largest value and a step from or to it a rise, as in the distributed form.
    """
    n = np.diff(starts, append=len(v))
    place = np.arange(len(v)) - np.repeat(starts, n)
    total = lambda x: np.add.reduceat(x, starts)
    with np.errstate(all="ignore"):
        # a step counts when it does not round to zero at nine places
        step = np.diff(v, prepend=v[:1])
        known, lost = place >= 1, np.isnan(step)
        rises, falls = known & ((step >= 5e-10) | lost), known & (step <= -5e-10)
        up, down = total(rises.astype(np.int64)), total(falls.astype(np.int64))
        net = np.where(total((known & lost).astype(np.int64)) > 0, np.nan, (up - down).astype(float))
        bend = np.zeros(len(v))
        bend[2:] = np.where(place[2:] >= 2, v[2:] - 2 * v[1:-1] + v[:-2], 0.0)
        t, of_t = place - np.repeat((n - 1) / 2.0, n), n * (n * n - 1.0) / 12
        off = v - np.repeat(v[starts], n)
        off = off - np.repeat(total(off) / n, n)
        of_v = total(off * off)
        order = np.lexsort((v, np.repeat(np.arange(len(n)), n)))
        s = v[order]
        run = np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]
        run[starts] = True
        first = np.flatnonzero(run)
        size = np.diff(first, append=len(v))
        rank = np.empty(len(v))
        rank[order] = np.repeat(first + (size - 1) / 2.0, size)
        rank -= np.repeat(starts + (n - 1) / 2.0, n)
        deviation = np.sqrt(of_v / n)
        moving = (n >= 3) & ((deviation >= 1e-12) | np.isnan(deviation))
        return {
            "n": n,
            "monotonicity": np.where(n > 1, np.abs(net) / np.maximum(n - 1, 1), 0.0),
            "signed_monotonicity": np.where(n > 1, net / np.maximum(n - 1, 1), 0.0),
            "trendability": np.where(moving, np.abs(total(off * t) / np.sqrt(of_v * of_t)), 0.0),
            "rho": np.where(moving, total(rank * t) / np.sqrt(total(rank * rank) * of_t), 0.0),
            "smoothness": np.where(n >= 3, 1.0 / (total(bend * bend) / np.maximum(n - 2, 1) + 1e-12), 0.0),
            "n_pos": up,
            "n_neg": down,
            "n_tie": n - 1 - up - down,
            "first_value": v[starts],
            "last_value": v[starts + n - 1],
        }


def _criteria_in_blocks(rows: DataFrame, keys, value: str, ext: Extent) -> DataFrame:
    cols = rows.where(F.col(value).isNotNull()).select(*keys, "pos", F.col(value).cast("double").alias("_v"))
    kinds = {name: T.LongType() if name.startswith("n") else T.DoubleType() for name in ["n", *CRITERIA]}
    schema = T.StructType([*[cols.schema[k] for k in keys], *[T.StructField(name, kind) for name, kind in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def score(own: pa.Table) -> pa.Table:
        code = series_codes(own, keys)
        order = np.lexsort((own["pos"].to_numpy(), code))
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        got = series_criteria(starts, own["_v"].to_numpy()[order])
        heads = own.select(keys).take(pa.array(order[starts]))
        return pa.table([*heads.columns, *[pa.array(got[name]) for name in kinds]], schema=arrow)

    dealt = cols.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(ordered.blocks_of(ext))))
    return spread(dealt, "_block", rows=ext.rows).groupBy("_block").applyInArrow(score, schema)


def asset_criteria(rows: DataFrame, keys, value: str, ext: Extent) -> DataFrame:
    """Every per-series criterion in one pass.

    Monotonicity (absolute and signed), trendability, rank correlation with life, smoothness, first
    and last value, and counts of rising, falling and flat steps. As where weights are scored, rows without a
    value are left out and the others move up; a series without any value has no row. Series short enough for one
    task go in Arrow groups of many series; only longer ones take distributed positions, ranks and neighbours.
    """
    keys = list(keys)
    if ext.longest <= ordered.SAFE_GROUP:
        return _criteria_in_blocks(rows, keys, value, ext)
    rows = position(rows.where(F.col(value).isNotNull()), keys, ["pos"], ext, "pos", None)
    out = average_rank(rows, keys, value, "_rank", ext)
    out = neighbours(out, keys, {"_b1": (value, 1), "_b2": (value, 2)}, ext)
    v = F.col(value)
    step = F.round(v - F.col("_b1"), 9)
    bend = v - 2 * F.col("_b1") + F.col("_b2")

    def tally(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    agg = out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.signum(step)), F.lit(0.0)).alias("_net"),
        tally(step > 0).alias("n_pos"),
        tally(step < 0).alias("n_neg"),
        tally(step == 0).alias("n_tie"),
        correlation(value, "pos").alias("_corr"),
        correlation("_rank", "pos").alias("_rho"),
        F.stddev_pop(value).alias("_sd"),
        F.avg(bend * bend).alias("_bend"),
        F.min_by(value, "pos").alias("first_value"),
        F.max_by(value, "pos").alias("last_value"),
    )
    steps = F.col("n") - 1
    moving = (F.col("n") >= 3) & (F.col("_sd") >= 1e-12)
    return agg.select(
        *keys,
        "n",
        guarded(F.col("n") > 1, F.abs("_net") / steps).alias("monotonicity"),
        guarded(F.col("n") > 1, F.col("_net") / steps).alias("signed_monotonicity"),
        guarded(moving, F.abs("_corr")).alias("trendability"),
        guarded(moving, F.col("_rho")).alias("rho"),
        guarded(F.col("n") >= 3, F.lit(1.0) / (F.col("_bend") + 1e-12)).alias("smoothness"),
        "n_pos",
        "n_neg",
        "n_tie",
        "first_value",
        "last_value",
    )


def prognosability_of(first: str = "first_value", last: str = "last_value"):
    """Aggregate: how tightly the final values cluster, relative to the mean travelled range."""
    span = F.avg(F.abs(F.col(first) - F.col(last))) + 1e-12
    return F.exp(-F.stddev_pop(last) / span)


def quality_table(criteria: DataFrame, keys, assets: Extent) -> DataFrame:
    """Summary per indicator from per-asset criteria; ``assets`` sizes that table."""
    return quantiles(
        criteria,
        keys,
        {
            "monotonicity_median": ("monotonicity", 0.5),
            "trendability_median": ("trendability", 0.5),
            "rho_median": ("rho", 0.5),
        },
        assets,
        also=[
            F.min("trendability").alias("trendability_min"),
            prognosability_of().alias("prognosability"),
            F.count(F.lit(1)).alias("n_assets"),
        ],
    )


def sign_flips(rows: DataFrame, keys, before: str, after: str, ext: Extent) -> DataFrame:
    """Steps whose direction changes between two versions of a series."""
    keys = list(keys)
    out = neighbours(rows, keys, {"_p": (before, 1), "_q": (after, 1)}, ext)
    s0 = F.signum(F.round(F.col(before) - F.col("_p"), 9))
    s1 = F.signum(F.round(F.col(after) - F.col("_q"), 9))

    def tally(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    return out.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("n_steps"),
        tally(s0 != s1).alias("flips"),
        tally((s0 != s1) & (s1 < 0)).alias("rise_to_fall"),
        tally((s0 != s1) & (s1 > 0)).alias("fall_to_rise"),
        tally(s0 == 0).alias("ties_before"),
        tally(s1 == 0).alias("ties_after"),
        F.coalesce(F.sum(s0), F.lit(0.0)).alias("net_before"),
        F.coalesce(F.sum(s1), F.lit(0.0)).alias("net_after"),
    )


def trajectory_penalties(rows: DataFrame, keys, value: str, ext: Extent) -> DataFrame:
    """Roughness, mean decrease and mean increase of each trajectory."""
    out = neighbours(rows, list(keys), {"_b1": (value, 1), "_b2": (value, 2)}, ext)
    v = F.col(value)
    bend = v - 2 * F.col("_b1") + F.col("_b2")
    zero = F.lit(0.0)
    per = lambda c: F.coalesce(F.avg(c), zero)
    down = F.when(F.col("_b1").isNotNull(), F.greatest(F.col("_b1") - v, zero))
    up = F.when(F.col("_b1").isNotNull(), F.greatest(v - F.col("_b1"), zero))
    return out.groupBy(*keys).agg(
        per(bend * bend).alias("roughness"), per(down).alias("mean_decrease"), per(up).alias("mean_increase")
    )
