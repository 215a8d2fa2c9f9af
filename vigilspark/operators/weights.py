"""Scoring of linear combinations: every weight vector of a list against every series.

Rows carry (keys, pos, n, components). Series short enough for one task are scored as one Arrow group per series, which sends each row
once and multiplies inside NumPy. Only longer series are fanned out over the weight list and scored
with distributed neighbours and ranks. Both give the same numbers. Rows with a NULL component are left out
and the others move up, so a series is scored over its complete rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import EPS, correlation, guarded
from .ordered import SAFE_GROUP, Extent, average_rank, neighbours, position, spread

SERIES_BLOCK, FOLD_BLOCK, BLOCK_VALUES = 128, 512, 100_000
#: Series up to this length are scored by their pairs of rows for many folds at once; what counts as a tie; the least reach of a pair.
PAIR_ROWS, TIE, REACH = 1024, 1.1e-9, 1e-3
SCORES = ["mono", "rho", "trend", "first_value", "last_value"]


def mean_ranks(v: np.ndarray) -> np.ndarray:
    """0-based ranks along the last axis, ties sharing their mean."""
    m, n = v.shape
    flat = (np.argsort(v, axis=1, kind="stable") + (np.arange(m) * n)[:, None]).ravel()
    s = v.ravel()[flat]
    new_run = np.ones(m * n, dtype=bool)
    new_run[1:] = s[1:] != s[:-1]
    new_run[::n] = True
    starts = np.flatnonzero(new_run)
    sizes = np.diff(starts, append=m * n)
    ranks = np.empty(m * n)
    ranks[flat] = np.repeat(starts % n + (sizes - 1) / 2.0, sizes)
    return ranks.reshape(m, n)


def _against_time(centred: np.ndarray, t: np.ndarray, moving: np.ndarray) -> np.ndarray:
    size = np.sqrt((centred * centred).sum(axis=1) * (t * t).sum())
    ok = moving & (size > 0)
    return np.where(ok, (centred @ t) / np.where(size > 0, size, 1.0), 0.0)


def _rank_correlation(q: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Rank correlation with time of every row of whole numbers, 0 where it does not move.

    Value and place share one integer, so one plain sort gives the places in order of value. Only runs of equal values are
    looked at again, for their mean rank.
    """
    m, n = q.shape
    bits = max(1, (n - 1).bit_length())
    mixed = (q << bits) | np.arange(n)
    mixed.sort(axis=1)
    place, value = mixed & ((1 << bits) - 1), mixed >> bits
    t = np.arange(n) - (n - 1) / 2.0
    total, spread_of = place @ t, np.full(m, n * (n * n - 1.0) / 12)
    tied = np.zeros((m, n + 1), bool)
    np.equal(value[:, 1:], value[:, :-1], out=tied[:, 1:n])
    edge = np.flatnonzero(np.diff(tied.ravel(), prepend=False))
    if len(edge):
        # a run of equal values starts one place before its first tie and ends with its last one
        first, last = edge[::2] - 1, edge[1::2] - 1
        row, size = first // (n + 1), last - first + 1
        upto = np.zeros((m, n + 1))
        np.cumsum(place, axis=1, out=upto[:, 1:])
        own = np.zeros((m, n + 1))
        np.cumsum(place * t, axis=1, out=own[:, 1:])
        a, b = first - row * (n + 1), last - row * (n + 1) + 1
        mean = (a + b - 1) / 2.0 - (n - 1) / 2.0
        change = mean * (upto[row, b] - upto[row, a]) - (own[row, b] - own[row, a])
        total = total + np.bincount(row, change, m)
        spread_of = spread_of - np.bincount(row, size * (size * size - 1.0) / 12, m)
    size = np.sqrt(spread_of * (t * t).sum())
    ok = moving & (size > 0)
    return np.where(ok, total / np.where(size > 0, size, 1.0), 0.0)


def criteria(v: np.ndarray, trend: bool = True) -> dict[str, np.ndarray]:
    """Criteria of every row of ``v``, a series of its own; ``trend`` may be left out."""
    m, n = v.shape
    out = {name: np.zeros(m) for name in SCORES}
    t = np.arange(n) - (n - 1) / 2.0
    whole = np.rint(v * 1e9)
    top = np.abs(whole).max(initial=0.0)
    v = whole / 1e9 if top < 1e300 else np.round(v, 9)
    out["first_value"], out["last_value"] = v[:, 0], v[:, -1]
    # as whole numbers, beside a place, where they have room in 64 bits (NaN and infinity have not)
    fits = bool(top < 1 << (62 - max(1, (n - 1).bit_length())))
    q = whole.astype(np.int64) if fits else None
    if n > 1:
        if fits:
            rises, falls = (q[:, 1:] > q[:, :-1]).sum(axis=1), (q[:, 1:] < q[:, :-1]).sum(axis=1)
            out["mono"] = np.abs(rises - falls) / (n - 1)
        else:
            out["mono"] = np.abs(np.sign(np.round(np.diff(v, axis=1), 9)).sum(axis=1)) / (n - 1)
    if n >= 3:
        moving = v.std(axis=1) >= 1e-12
        out["rho"] = _rank_correlation(q, moving) if fits else _against_time(mean_ranks(v) - (n - 1) / 2.0, t, moving)
        if trend:
            out["trend"] = np.abs(_against_time(v - v.mean(axis=1, keepdims=True), t, moving))
    return out


def score_series(x: np.ndarray, weights: np.ndarray, trend: bool = True) -> dict[str, np.ndarray]:
    """Criteria of ``weights @ x`` for a (components, length) series, some weights at a time; ``trend`` may be left out."""
    block = max(1, BLOCK_VALUES // max(x.shape[1], 1))
    parts = [criteria(sum(weights[k : k + block, i, None] * x[i] for i in range(len(x))), trend) for k in range(0, len(weights), block)]
    return {name: np.concatenate([p[name] for p in parts]) for name in SCORES}


def score_equal(x: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The same for several series of one length, (series, components, length), in turn; as many at a time as make up a block."""
    count, parts, n = max(1, BLOCK_VALUES // (len(weights) * x.shape[2])), [], x.shape[2]
    for k in range(0, len(x), count):
        some = x[k : k + count]
        if len(some) == 1:
            parts.append(score_series(some[0], weights))
        else:
            parts.append(criteria(sum(weights[:, i, None] * some[:, i, None, :] for i in range(x.shape[1])).reshape(-1, n)))
    return {name: np.concatenate([p[name] for p in parts]) for name in SCORES}


@lru_cache(maxsize=64)
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _inner(table: np.ndarray) -> np.ndarray | None:
    """Places of the weights between the ends of a rising grid of (a, 1 - a); None if it is no such grid."""
    a, b = table.T
    at = np.flatnonzero((a > 0) & (b > 0))
    rising = len(table) > 1 and (np.diff(a) > 0).all() and a[0] >= 0 and b[-1] >= 0 and np.allclose(a + b, 1.0, rtol=0, atol=1e-12)
    return at if rising and len(at) else None


def fitness_of_folds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: np.ndarray, mono_only: bool = False) -> np.ndarray:
    """Monotonicity (and rank correlation) of one series (2, length) for every row of bounds (folds, 2) and every weight.

    The rank correlation's numerator is half the sum, over pairs of rows, of their distance in time times the sign of their
    difference, and this sign changes at most once along the grid. Where neither row is clipped by any fold, that place is a
    ratio which folds only rescale: such pairs are sorted once, and a fold looks up its weights among them. The other pairs
    are placed fold by fold. Values that come near enough to be rounded to a tie, and the ends of the grid, are ranked.
    """
    folds, n, inner = len(lo), x.shape[1], _inner(table)
    scale = hi - lo + EPS
    plain = np.isfinite(x).all() and np.isfinite(scale).all() and (scale > 0).all()
    unit = [np.clip((x[c] - lo[:, c, None]) / scale[:, c, None], 0.0, 1.0) for c in (0, 1)]
    out = np.empty((folds, len(table)))
    if inner is None or not plain or not 3 <= n <= PAIR_ROWS:
        for f in range(folds):
            got = score_series(np.array([unit[0][f], unit[1][f]]), table, trend=False)
            out[f] = got["mono"] if mono_only else got["mono"] + got["rho"]
        return out
    wa, wb = table[inner].T
    small = 4e-9 / min(wa.min(), wb.min(), np.diff(wa).min(initial=1.0))
    ratio, k_all = wa / wb, len(inner)
    i, j = _pairs_of(n)
    apart, near = (j - i).astype(float), (j - i == 1).astype(float)
    de, dc = x[0][j] - x[0][i], x[1][j] - x[1][i]
    sign_e, sign_c = np.sign(de), np.sign(dc)
    # rows that no fold clips, and the least size of the differences over all folds
    safe = ((x >= lo.max(axis=0)[:, None]) & (x <= hi.min(axis=0)[:, None])).all(axis=0)
    size_e, size_c = np.abs(de) / scale[:, 0].max(), np.abs(dc) / scale[:, 1].max()
    both, crossing = safe[i] & safe[j], sign_e * sign_c < 0
    steady = both & ~crossing & (np.maximum(size_e, size_c) >= small)
    turning = both & crossing & (size_e * size_c >= REACH * (size_e + size_c))
    sign = np.where(steady, np.sign(sign_e + sign_c), np.where(turning, -sign_e, 0.0))
    total, net = np.full((folds, k_all), (sign * apart).sum()), np.full((folds, k_all), (sign * near).sum())
    at = np.flatnonzero(turning)
    place = -dc[at] / de[at]
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]
    edge = (ratio[:, None] * (scale[:, 1] / scale[:, 0])).ravel()  # weight by weight, so that neighbours look alike
    idx = np.searchsorted(place, edge)
    for sums, weight in ((total, apart), (net, near)):
        sums += np.append(0.0, np.cumsum(2 * sign_e[at] * weight[at]))[idx].reshape(k_all, folds).T
    band = 2 * TIE / REACH
    close = (np.append(place, np.inf)[idx] <= edge * (1 + band)) | (np.append(-np.inf, place)[idx] >= edge * (1 - band))
    ranked = np.zeros((folds, len(table)), bool)
    ranked[:, inner] = close.reshape(k_all, folds).T
    ranked[:, np.setdiff1d(np.arange(len(table)), inner)] = True
    rest = np.flatnonzero(~(steady | turning))
    spread_of = np.full(folds, n * (n * n - 1.0) / 12)
    i, j, apart, near = i[rest], j[rest], apart[rest], near[rest]
    step = max(1, (1 << 19) // max(len(rest), 1))
    for first in range(0, folds if len(rest) else 0, step):
        some = slice(first, first + step)
        de, dc = (u[some][:, j] - u[some][:, i] for u in unit)
        sign_e, sign_c = np.sign(de), np.sign(dc)
        crossing = sign_e * sign_c < 0
        equal = (sign_e == 0) & (sign_c == 0)
        if equal.any():
            # equal rows stay equal along the grid; a run of c of them lessens the spread by c (c^2 - 1) / 12
            f, r = np.nonzero(equal)
            m = len(de)
            runs = 1 + np.bincount(f * n + i[r], minlength=m * n) + np.bincount(f * n + j[r], minlength=m * n)
            spread_of[some] -= ((runs * runs - 1.0) / 12).reshape(m, n).sum(axis=1)
        ranked[some] |= (~equal & (np.maximum(np.abs(de), np.abs(dc)) < small)).any(axis=1)[:, None]
        sign = np.where(crossing, sign_c, np.sign(sign_e + sign_c))
        total[some] += (sign @ apart)[:, None]
        net[some] += (sign @ near)[:, None]
        f, r = np.nonzero(crossing)
        if len(f):
            e, c = de[f, r], dc[f, r]
            k = np.searchsorted(ratio, -c / e)
            cell, turn, m = f * (k_all + 1) + k, 2 * np.sign(e), len(de)
            for sums, weight in ((total, apart), (net, near)):
                sums[some] += np.bincount(cell, turn * weight[r], m * (k_all + 1)).reshape(m, -1)[:, :k_all].cumsum(axis=1)
            for side in (np.maximum(k - 1, 0), np.minimum(k, k_all - 1)):
                hit = np.flatnonzero(np.abs(wa[side] * e + wb[side] * c) < TIE)
                ranked[first + f[hit], inner[side[hit]]] = True
    t = np.arange(n) - (n - 1) / 2.0
    size = np.sqrt(spread_of * (t * t).sum())[:, None]
    mono = np.abs(net) / (n - 1)
    out[:, inner] = mono if mono_only else mono + np.where(size > 0, total / 2 / np.where(size > 0, size, 1.0), 0.0)
    f, k = np.nonzero(ranked)
    step = max(1, BLOCK_VALUES // n)
    for first in range(0, len(f), step):
        own, w = f[first : first + step], k[first : first + step]
        got = criteria(table[w, 0, None] * unit[0][own] + table[w, 1, None] * unit[1][own], trend=False)
        out[own, w] = got["mono"] if mono_only else got["mono"] + got["rho"]
    return out


def _blocks(ext: Extent) -> int:
    """How many groups the series are dealt to: about ``SERIES_BLOCK`` of them or ``SAFE_GROUP`` rows in each."""
    per = max(1, min(SERIES_BLOCK, SAFE_GROUP // max(min(ext.longest, SAFE_GROUP), 1)))
    return max(-(-max(ext.groups, 1) // per), -(-ext.rows // SAFE_GROUP))


def score_weights(rows: DataFrame, keys, components, weights, ext: Extent) -> DataFrame:
    """One row per series and weight index ``w``: monotonicity, Spearman and trend against time, ends.

    ``weights`` is a list of tuples, or a dict of such lists by the first key (a fold).
    """
    keys = list(keys)
    complete = F.lit(True)
    for c in components:
        complete = complete & F.col(c).isNotNull()
    cols = rows.select(*keys, "pos", "n", *components).where(complete)
    if ext.longest <= SAFE_GROUP:
        return _grouped(cols.drop("n"), keys, components, weights, ext)
    out = _grouped(cols.where(F.col("n") <= SAFE_GROUP).drop("n"), keys, components, weights, ext)
    long = position(cols.where(F.col("n") > SAFE_GROUP).drop("n"), keys, ["pos"], ext, "pos", None)
    split = weights.items() if isinstance(weights, dict) else [(None, weights)]
    for fold, w in split:
        mine = long if fold is None else long.where(F.col(keys[0]) == fold)
        out = out.unionByName(_exploded(mine, keys, components, w, ext))
    return out


def score_scaled(rows: DataFrame, uses: DataFrame, weights, ext: Extent, key: str = "asset_id", pair=("E", "C")) -> DataFrame:
    """One row per (fold, series, weight) for the pair of components, scaled by each fold that learns from the series.

    ``uses`` has a row per (fold_id, series) with that fold's bounds. The rows of a series go out once, whatever number of
    folds learn from it, with a block of about ``SERIES_BLOCK`` series or ``SAFE_GROUP`` rows to an Arrow group. Only series
    beyond ``SAFE_GROUP`` are copied per fold and scored with distributed ranks.
    """
    a, b = pair
    names = ["fold_id", f"{a}_lo", f"{a}_hi", f"{b}_lo", f"{b}_hi"]
    cols = rows.select(key, "pos", "n", a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    table = np.asarray(weights, float)

    blocks = _blocks(ext)
    types = T.StructType([T.StructField("fold_id", uses.schema["fold_id"].dataType), T.StructField(key, rows.schema[key].dataType)])
    schema = T.StructType([*types, T.StructField("w", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in SCORES]])
    arrow = to_arrow_schema(schema)

    def score(own: pa.Table, folds: pa.Table) -> pa.Table:
        named = own[key].combine_chunks().dictionary_encode(null_encoding="encode")
        code, found = named.indices.to_numpy(zero_copy_only=False), {k: j for j, k in enumerate(named.dictionary.to_pylist())}
        order = np.lexsort((own["pos"].to_numpy(), code))
        x, code = np.array([own[c].to_numpy()[order] for c in pair]), code[order]
        edges = np.searchsorted(code, np.arange(len(found) + 1))
        bounds = np.array([[folds[f"{c}_{side}"].to_numpy() for c in pair] for side in ("lo", "hi")])
        of = np.array([found.get(k, len(found)) for k in folds["of"].to_pylist()], int)
        sizes = np.append(np.diff(edges), 0)[of]
        used, got = [], []
        for n in np.unique(sizes[sizes > 0]):
            same = np.flatnonzero(sizes == n)
            step = max(1, SAFE_GROUP // int(n))
            for some in (same[k : k + step] for k in range(0, len(same), step)):
                lo, hi = (side[:, some].T[:, :, None] for side in bounds)
                unit = np.stack([x[:, edges[j] : edges[j + 1]] for j in of[some]])
                got.append(score_equal(np.clip((unit - lo) / (hi - lo + EPS), 0.0, 1.0), table))
                used += some.tolist()
        if not used:
            return arrow.empty_table()
        each = pa.array(np.repeat(used, len(table)))
        columns = [folds["fold_id"].take(each), folds["of"].take(each), pa.array(np.tile(np.arange(len(table), dtype="int32"), len(used)))]
        return pa.table([*columns, *[pa.array(np.concatenate([g[c] for g in got])) for c in SCORES]], schema=arrow)

    short = cols.where(F.col("n") <= SAFE_GROUP).drop("n") if ext.longest > SAFE_GROUP else cols.drop("n")
    each = uses.select(F.col(key).alias("of"), *names)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("_s")
    left, right = short.select(block(key), "*"), each.select(block("of"), "*")
    out = spread(left, "_s").groupBy("_s").cogroup(spread(right, "_s").groupBy("_s")).applyInArrow(score, schema)
    if ext.longest <= SAFE_GROUP:
        return out
    long = position(cols.where(F.col("n") > SAFE_GROUP).drop("n"), [key], ["pos"], ext, "pos", None)
    long = long.join(each, F.col(key) == F.col("of")).drop("of")
    unit = {c: F.least(F.greatest((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo") + EPS), F.lit(0.0)), F.lit(1.0)) for c in pair}
    return out.unionByName(_exploded(long.withColumns(unit).select("fold_id", key, "pos", *pair), ["fold_id", key], list(pair), weights, ext))


def mean_left_out(rows: DataFrame, folds: DataFrame, weights, ext: Extent, pool: str, unit: str, mono_only: bool = False, key: str = "asset_id", pair=("E", "C")) -> DataFrame:
    """(fold_id, w, _sum, _n): the summed fitness over the series of the fold's pool outside ``without``, in partial rows.

    ``folds`` has (pool, fold_id, without) and the bounds. Folds x series scores are what is asked for, but only sums leave a
    task: it holds a block of at most about ``SERIES_BLOCK`` series and of ``FOLD_BLOCK`` folds, and takes a series for all of
    these at once (:func:`fitness_of_folds`). A series must fit into a task.
    """
    a, b = pair
    table, per = np.asarray(weights, float), max(1, min(SERIES_BLOCK, SAFE_GROUP // max(ext.longest, 1)))
    blocks, fold_blocks = -(-max(ext.groups, 1) // per), -(-max(folds.count(), 1) // FOLD_BLOCK)
    whole = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(unit).isNotNull()
    own = rows.where(whole).select(pool, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(fold_blocks - 1))).alias("_f"), F.col(unit).alias("_u"), key, "pos", a, b)
    names = ["fold_id", "without", f"{a}_lo", f"{a}_hi", f"{b}_lo", f"{b}_hi"]
    asked = folds.select(F.col(pool).alias("_pool"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_sb"), F.pmod(F.xxhash64("fold_id"), F.lit(fold_blocks)).cast("int").alias("_fb"), *names)

    def score(mine: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values([key, "pos"])
        x, units = mine[[a, b]].to_numpy(float).T, mine["_u"].to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(mine[key].to_numpy()) != 0]) if len(mine) else np.empty(0, int)
        ends = np.r_[starts[1:], len(mine)]
        lo, hi = (some[[f"{c}_{side}" for c in pair]].to_numpy(float).reshape(-1, 2) for side in ("lo", "hi"))
        gone: dict = {}
        for f, without in enumerate(some["without"]):
            for u in set(without):
                gone.setdefault(u, []).append(f)
        total, n = np.zeros((len(some), len(table))), np.zeros(len(some), np.int64)
        for s, e in zip(starts, ends):
            learns = np.delete(np.arange(len(some)), gone.get(units[s], []))
            for k in range(0, len(learns), FOLD_BLOCK):
                own = learns[k : k + FOLD_BLOCK]
                total[own] += fitness_of_folds(x[:, s:e], lo[own], hi[own], table, mono_only)
                n[own] += 1
        out = [(some["fold_id"].iloc[f], total[f], n[f]) for f in np.flatnonzero(n)]
        if not out:
            return pd.DataFrame({c: pd.Series(dtype=object if c == "fold_id" else float) for c in ("fold_id", "w", "_sum", "_n")})
        ids, sums, counts = zip(*out)
        each = len(table)
        # fold names as plain objects, also without rows: Arrow takes no column in chunks here
        return pd.DataFrame({"fold_id": pd.Series(list(ids), dtype=object).repeat(each).to_numpy(), "w": np.tile(np.arange(each, dtype="int32"), len(out)), "_sum": np.concatenate(sums), "_n": np.repeat(counts, each)}).astype({"fold_id": object})

    schema = T.StructType([T.StructField("fold_id", folds.schema["fold_id"].dataType), T.StructField("w", T.IntegerType()), T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())])
    left, right = spread(own, pool, "_s", "_f").groupBy(pool, "_s", "_f"), spread(asked, "_pool", "_sb", "_fb").groupBy("_pool", "_sb", "_fb")
    return left.cogroup(right).applyInPandas(score, schema)


def _grouped(cols: DataFrame, keys, components, weights, ext: Extent) -> DataFrame:
    table = {k: np.asarray(w, float) for k, w in weights.items()} if isinstance(weights, dict) else np.asarray(weights, float)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["pos"].to_numpy(), part))
        x = pdf[components].to_numpy(float)[order].T
        starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        heads = pdf.iloc[order[starts]]
        got, sizes = [], []
        for j, (s, e) in enumerate(zip(starts, [*starts[1:], len(order)])):
            w = table[heads[keys[0]].iloc[j]] if isinstance(table, dict) else table
            got.append(score_series(x[:, s:e], w))
            sizes.append(len(w))
        out = {k: np.repeat(heads[k].to_numpy(), sizes) for k in keys}
        out["w"] = np.concatenate([np.arange(m, dtype="int32") for m in sizes])
        return pd.DataFrame(out | {name: np.concatenate([g[name] for g in got]) for name in SCORES})

    fields = [cols.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("w", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in SCORES]])
    dealt = cols.withColumn("_s", F.pmod(F.xxhash64(keys[-1]), F.lit(_blocks(ext))))
    return spread(dealt, "_s").groupBy("_s").applyInPandas(score, schema)


def _exploded(cols: DataFrame, keys, components, weights, ext: Extent) -> DataFrame:
    table = F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights])
    rows = cols.select(*cols.columns, F.posexplode(table).alias("w", "_wt"))
    mix = sum((F.col("_wt")[i] * F.col(c) for i, c in enumerate(components)), F.lit(0.0))
    rows = rows.withColumn("_mix", F.round(mix, 9)).drop(*components, "_wt")
    wide = [*keys, "w"]
    rows = neighbours(rows, wide, {"_prev": ("_mix", 1)}, ext)
    rows = average_rank(rows, wide, "_mix", "_r", ext)
    agg = rows.groupBy(*wide).agg(
        F.count(F.lit(1)).alias("_n"),
        F.abs(F.coalesce(F.sum(F.signum(F.round(F.col("_mix") - F.col("_prev"), 9))), F.lit(0.0))).alias("_net"),
        correlation("_r", "pos").alias("_rho"),
        correlation("_mix", "pos").alias("_trend"),
        F.stddev_pop("_mix").alias("_sd"),
        F.min_by("_mix", "pos").alias("first_value"),
        F.max_by("_mix", "pos").alias("last_value"),
    )
    moving = (F.col("_n") >= 3) & (F.col("_sd") >= 1e-12)
    return agg.select(
        *wide,
        guarded(F.col("_n") > 1, F.col("_net") / (F.col("_n") - 1)).alias("mono"),
        guarded(moving, F.col("_rho")).alias("rho"),
        guarded(moving, F.abs("_trend")).alias("trend"),
        "first_value",
        "last_value",
    )
