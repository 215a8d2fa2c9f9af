"""Paired tests and summaries over per-asset results (rows: family keys, asset_id, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as dist
from ..functions.scalars import hash32
from .ordered import Extent, average_rank, position, quantiles


def seed_average(facts: DataFrame, keys, metric: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.avg(metric).alias("err"))


def summary(values: DataFrame, keys, value: str, ext: Extent, prefix: str = "") -> DataFrame:
    """Median, quartiles, worst, mean and sample deviation (0 for a single value)."""
    p = f"{prefix}_" if prefix else ""
    return quantiles(
        values, keys, {f"{p}median": (value, 0.5), f"{p}q25": (value, 0.25), f"{p}q75": (value, 0.75)}, ext,
        also=[
            F.max(value).alias(f"{p}worst"),
            F.avg(value).alias(f"{p}mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{p}std"),
            F.count(F.lit(1)).alias(f"{p}n"),
        ],
    )


def signed_ranks(diffs: DataFrame, keys, ext: Extent, diff: str = "diff", shift: float = 0.0) -> DataFrame:
    """Signed-rank sums of non-zero differences with the tie correction and rank-biserial effect."""
    keys = list(keys)
    d = F.round(F.col(diff) + F.lit(float(shift)), 9)
    rows = diffs.select(*keys, d.alias("_d")).withColumn("_a", F.abs("_d"))
    zeros = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_d") == 0).cast("bigint")).alias("n_zero"))
    live = rows.where("_d != 0")
    ties = live.groupBy(*keys, "_a").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*keys).agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("tie_term")
    )
    ranked = average_rank(live, keys, "_a", "_r", ext)
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_used"),
        F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
    )
    out = zeros.join(sums, keys, "left").join(ties, keys, "left")
    out = out.na.fill({"n_used": 0, "w_plus": 0.0, "w_minus": 0.0, "tie_term": 0.0})
    total = F.col("w_plus") + F.col("w_minus")
    return out.withColumn("rank_biserial", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(0.0))


def _wilcoxon_udf(side: str):
    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, plus: pd.Series, minus: pd.Series, tie: pd.Series, zero: pd.Series) -> pd.Series:
        rows = zip(n, plus, minus, tie, zero)
        return pd.Series([dist.wilcoxon_p(int(a), b, c, t, t == 0 and z == 0, side) for a, b, c, t, z in rows], dtype="float64")

    return p


def with_wilcoxon_p(sums: DataFrame, side: str = "two-sided", name: str = "p_value") -> DataFrame:
    """p-value from the rank sums, one Python call per comparison."""
    return sums.withColumn(name, _wilcoxon_udf(side)("n_used", "w_plus", "w_minus", "tie_term", "n_zero"))


def paired_differences(pairs: DataFrame, keys, ext: Extent, a: str = "a", b: str = "b") -> DataFrame:
    """Means, median difference, wins of ``b`` and rank sums per comparison (needs columns a and b)."""
    keys = list(keys)
    rows = pairs.withColumn("diff", F.round(F.col(a) - F.col(b), 9))
    wins = F.sum((F.col("diff") > 0).cast("bigint"))
    base = quantiles(
        rows, keys, {"median_diff": ("diff", 0.5)}, ext,
        also=[F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), wins.alias("wins"), F.count(F.lit(1)).alias("pairs")],
    )
    base = base.withColumn("wins_of", F.format_string("%d/%d", "wins", "pairs"))
    return base.join(signed_ranks(rows, keys, ext), keys)


def holm(tests: DataFrame, family, p: str, name: str = "holm_p", tie: str | None = None) -> DataFrame:
    """Step-down adjustment inside each family; a family is one list of named comparisons, so it is short."""
    order = [F.col(p)] + ([F.col(tie)] if tie else [])
    ranked = Window.partitionBy(*family).orderBy(*order)
    every = Window.partitionBy(*family)
    scaled = (F.count(p).over(every) - F.row_number().over(ranked) + 1) * F.col(p)
    out = tests.withColumn("_s", scaled)
    running = F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("_s")


def mean_difference(diffs: DataFrame, keys, diff: str = "diff", margin: float = 0.01) -> DataFrame:
    """Mean, standard error and the two one-sided t statistics against +-margin."""
    out = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_diff"), (F.stddev_samp(diff) / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    se = F.nullif(F.col("se"), F.lit(0.0))
    return out.withColumns({"t_lo": (F.col("mean_diff") + margin) / se, "t_hi": (F.col("mean_diff") - margin) / se})


@F.pandas_udf(T.DoubleType())
def tost_p(n: pd.Series, t_lo: pd.Series, t_hi: pd.Series) -> pd.Series:
    """Larger of the two one-sided p-values."""
    return pd.Series([max(dist.t_sf(a, k - 1), dist.t_sf(-b, k - 1)) for k, a, b in zip(n, t_lo, t_hi)], dtype="float64")


def t_factor(level: float):
    """UDF: t quantile for a two-sided interval of the given level, by sample size."""

    @F.pandas_udf(T.DoubleType())
    def run(n: pd.Series) -> pd.Series:
        cache = {int(k): dist.t_quantile(0.5 + level / 2.0, int(k) - 1) for k in set(n)}
        return n.map(lambda k: cache[int(k)]).astype("float64")

    return run


def with_interval(means: DataFrame, level: float, lo: str, hi: str, mean: str = "mean_diff", se: str = "se", n: str = "n") -> DataFrame:
    half = t_factor(level)(n) * F.col(se)
    return means.withColumns({lo: F.col(mean) - half, hi: F.col(mean) + half})


#: Multiplicities are Poisson(1): u below the k-th limit of the modulus gives k.
MODULUS = 2**31 - 1
_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
POISSON_LIMITS = [int(c * MODULUS) for c in _CDF]


def multiplicities(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often rows with hashes ``h`` stand in replicates ``b``: (rows, replicates), by whole-number arithmetic alone."""
    x = (h[:, None] * 48271 + b[None, :] * 69621 + 1) % MODULUS
    x = (x * x + 40692 * x + b[None, :]) % MODULUS
    x = (x * x + 16807 * x + 7) % MODULUS
    return np.searchsorted(POISSON_LIMITS, x, side="right")


def bootstrap_mean(diffs: DataFrame, keys, ext: Extent | None = None, replicates: int = 20_000, level: float = 0.95, diff: str = "diff", seed: int = 0, row: str = "asset_id") -> DataFrame:
    """Percentile interval of the mean; each row stands in each replicate as often as a hash of both says (Poisson, mean 1).

    No draw is looked up and no row is copied: a task keeps ``replicates`` sums and counts per group, and these are merged
    element by element. Rows with a NULL are left out, and so are replicates in which no row of a group stands.
    """
    keys = list(keys)
    rows = diffs.select(*keys, hash32(F.lit(seed), *[F.col(k) for k in keys], F.col(row)).alias("_h"), F.col(diff).cast("double").alias("_x")).where("_x IS NOT NULL AND _h IS NOT NULL")
    block = 1000
    kinds = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_first", T.LongType()), T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("_m", T.ArrayType(T.LongType()))])

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}

        def out():
            made = [(*key, first, s[first : first + block], m[first : first + block]) for key, (s, m) in held.items() for first in range(0, replicates, block)]
            held.clear()
            return pd.DataFrame(made, columns=kinds.names)

        for pdf in batches:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                s, m = held.setdefault(tuple(None if v != v else v for v in key), [np.zeros(replicates), np.zeros(replicates, np.int64)])
                h, x = own["_h"].to_numpy(np.int64), own["_x"].to_numpy(float)
                for k in range(0, len(x), 256):
                    for first in range(0, replicates, block):
                        b = np.arange(first, min(first + block, replicates))
                        n = multiplicities(h[k : k + 256], b)
                        s[b] += x[k : k + 256] @ n
                        m[b] += n.sum(axis=0)
            if len(held) > 64:
                yield out()
        if held:
            yield out()

    parts = rows.mapInPandas(run, kinds)
    cells = parts.select(*keys, "_first", F.posexplode(F.arrays_zip("_s", "_m")).alias("_at", "_c"))
    means = cells.groupBy(*keys, (F.col("_first") + F.col("_at")).alias("_b")).agg(F.sum("_c._s").alias("_s"), F.sum("_c._m").alias("_m")).where("_m > 0")
    means = means.withColumn("_mean", F.col("_s") / F.col("_m"))
    tail = (1.0 - level) / 2.0
    return quantiles(means, keys, {"boot_lo": ("_mean", tail), "boot_hi": ("_mean", 1.0 - tail)}, Extent(replicates, replicates))


def factorial_effects(cells: DataFrame, keys, first: str = "first", second: str = "second", mean: str = "mean") -> DataFrame:
    """Main effects and interaction of a 2x2 design; only where all four cells exist."""
    def cell(a, b):
        return F.max(F.when((F.col(first) == a) & (F.col(second) == b), F.col(mean)))

    wide = cells.groupBy(*keys).agg(*[cell(a, b).alias(f"{a}_{b}") for a in ("off", "on") for b in ("off", "on")])
    wide = wide.dropna(subset=["off_off", "off_on", "on_off", "on_on"])
    c = F.col
    return wide.select(
        *keys,
        ((c("on_off") + c("on_on")) / 2 - (c("off_off") + c("off_on")) / 2).alias("effect_first"),
        ((c("off_on") + c("on_on")) / 2 - (c("off_off") + c("on_off")) / 2).alias("effect_second"),
        (c("on_on") - c("on_off") - c("off_on") + c("off_off")).alias("interaction"),
    )


def fails_as_control(control: Column, proposed: Column, slack: float = 1.02) -> Column:
    """A negative control that does as well as the proposal discredits it."""
    return (control <= proposed * F.lit(slack)).cast("int")
