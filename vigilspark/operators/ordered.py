"""Ordered-series building blocks that never hold one long series in one task.

A group (an asset, a fold, ...) may be a large share of all rows. Callers measure it once with
:func:`extent`; each block then uses a plain window while the longest group is small, and beyond
``SAFE_GROUP`` rows an exact form that splits the group:

* order and ranks: a range partitioning on (keys, order), whose partitions cut through a group;
* neighbours: fixed-width chunks of the dense position, with the few edge rows copied over;
* running totals and quantiles: chunk totals first, then an offset per chunk.

Both forms follow one NULL rule: rows whose key is NULL form a group of their own, and a NULL value keeps its row
and place but has no rank (NULL) and counts in no rank, quantile or total. NaN is the largest value.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAFE_GROUP = 1 << 20
CHUNK = 1 << 18
TASK_ROWS = 1 << 19


@dataclass(frozen=True)
class Extent:
    """Row count of a table, of its largest group, and the number of groups."""

    rows: int
    longest: int
    groups: int = 0

    @property
    def pooled(self) -> "Extent":
        """Extent seen by a grouping that may put every row into one group."""
        return Extent(self.rows, self.rows, 1)

    @property
    def assets(self) -> "Extent":
        """Extent of a table with one row per group, under a grouping that may pool them all."""
        n = self.groups or self.rows
        return Extent(n, n, 1)


def extent(df: DataFrame, keys) -> Extent:
    """One pre-aggregated count per key; only three numbers reach the driver."""
    top = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("c"))
        .agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0)), F.count(F.lit(1)))
        .first()
    )
    return Extent(int(top[0]), int(top[1]), int(top[2]))


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash-partition for a Python stage at the session's full width (small inputs are not coalesced).

    ``rows`` sizes the input: a larger one gets more partitions, so what a task sorts does not grow with it.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, -(-rows // TASK_ROWS)), *keys)


def blocks_of(ext: Extent) -> int:
    """How many Arrow groups the series of ``ext`` are dealt to, by a hash: about ``CHUNK / 4`` rows in each."""
    return -(-max(ext.rows, 1) // max(1, CHUNK // 4))


def series_codes(own, keys):
    """Number of the series of every row of an Arrow table; a NULL key is a value of its own."""
    import numpy as np

    code = np.zeros(own.num_rows, np.int64)
    for k in keys:
        named = own[k].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * len(named.dictionary) + named.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def keep(df: DataFrame) -> DataFrame:
    """Store a result that several branches read in the shared folder, and read it back from there.

    A reader's plan has one scan in place of the lineage. A cached table keeps its own plan inside every plan that reads it,
    so tables cached one from another multiply at each level, until the plans alone fill the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL meets NULL; the key columns are those of ``left``."""
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in right.columns])
    meets = F.lit(True)
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(other, meets, how).drop(*[f"_key_{k}" for k in keys])


def use_checkpoints(spark: SparkSession) -> None:
    """Take the checkpoint folder the cluster names; make one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables a query writes and reads again."""
    use_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def laid_out(df: DataFrame, cols) -> DataFrame:
    """Add ``_place``, the global 0-based position under the order of ``cols`` (unique rows).

    The range bounds come from sampling, so the layout is checkpointed before it is read twice.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = (
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_gid", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_gid", 33))
    )
    # at most ``parts`` rows, so the unpartitioned window and the broadcast are bounded
    before = (
        laid.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("_part", "_before")
    )
    row = F.col("_gid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid.join(F.broadcast(before), "_part")
        .withColumn("_place", F.col("_before") + row)
        .drop("_part", "_before", "_gid")
    )


def position(df: DataFrame, keys, order, ext: Extent, name: str = "pos", size: str | None = "n") -> DataFrame:
    """Dense 0-based position of each row inside its group, and the group size.

    ``order`` must be a total order inside a group.
    """
    keys = list(keys)
    if ext.longest <= SAFE_GROUP:
        w = Window.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint") - 1)
        return out.withColumn(size, F.count(F.lit(1)).over(w)) if size else out
    laid = laid_out(df, [*keys, *order])
    heads = laid.groupBy(*keys).agg(F.min("_place").alias("_head"), F.count(F.lit(1)).alias(size or "_size"))
    out = same_keys(laid, heads, keys).withColumn(name, F.col("_place") - F.col("_head")).drop("_place", "_head")
    return out if size else out.drop("_size")


def neighbours(df: DataFrame, keys, wanted: dict[str, tuple[str, int]], ext: Extent, pos: str = "pos") -> DataFrame:
    """Values a fixed number of rows away: ``{new: (column, k)}``, k > 0 looks back, k < 0 ahead."""
    keys = list(keys)

    def shifted(w):
        return {new: (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(w) for new, (c, k) in wanted.items()}

    if ext.longest <= SAFE_GROUP:
        return df.withColumns(shifted(Window.partitionBy(*keys).orderBy(pos)))
    back = max([k for _, k in wanted.values() if k > 0], default=0)
    ahead = max([-k for _, k in wanted.values() if k < 0], default=0)
    tiled = _with_halo(df, pos, CHUNK, back, ahead)
    w = Window.partitionBy(*keys, "_tile").orderBy(pos)
    out = tiled.withColumns(shifted(w))
    return out.where(F.col("_tile") == F.floor(F.col(pos) / CHUNK)).drop("_tile")


def _with_halo(df: DataFrame, pos: str, width, back, ahead) -> DataFrame:
    """Copy each row into its tile, and into the next or previous tile when it is near the edge.

    ``width``, ``back`` and ``ahead`` may be numbers or columns; the reach must not exceed the width.
    """
    width, back, ahead = [c if isinstance(c, Column) else F.lit(c) for c in (width, back, ahead)]
    home = F.floor(F.col(pos) / width).cast("bigint")
    offset = F.col(pos) - home * width
    tiles = F.array_compact(
        F.array(home, F.when(offset >= width - back, home + 1), F.when((offset < ahead) & (home > 0), home - 1))
    )
    return df.withColumn("_tile", F.explode(tiles))


def trailing_count(df: DataFrame, keys, flag: Column, q: int, name: str, ext: Extent, pos: str = "pos") -> DataFrame:
    """How many of the last ``q`` rows (this one included) satisfy ``flag``."""
    tmp = df.withColumn("_f", F.when(flag, 1).otherwise(0))
    tmp = neighbours(tmp, keys, {f"_f{i}": ("_f", i) for i in range(1, q)}, ext, pos)
    total = F.col("_f")
    for i in range(1, q):
        total = total + F.coalesce(F.col(f"_f{i}"), F.lit(0))
    return tmp.withColumn(name, total).drop("_f", *[f"_f{i}" for i in range(1, q)])


def running_total(df: DataFrame, keys, value: str, name: str, ext: Extent, pos: str = "pos") -> DataFrame:
    """Inclusive running sum in position order."""
    keys = list(keys)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if ext.longest <= SAFE_GROUP:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(*upto)))
    tiled = df.withColumn("_tile", F.floor(F.col(pos) / CHUNK).cast("bigint"))
    totals = tiled.groupBy(*keys, "_tile").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_tile", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_off"))
    inner = F.sum(value).over(Window.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(*upto))
    out = same_keys(tiled.withColumn(name, inner), offsets, [*keys, "_tile"])
    return out.withColumn(name, F.col(name) + F.col("_off")).drop("_tile", "_off")


def _ladder(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values per group with how many rows lie below each one (``_below``) and share it (``_cnt``)."""
    keys = list(keys)
    tally = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    big = Extent(SAFE_GROUP + 1, SAFE_GROUP + 1)
    steps = position(tally, keys, [value], big, "_step", "_steps").drop("_steps")
    steps = running_total(steps, keys, "_cnt", "_upto", big, "_step")
    return steps.withColumn("_below", F.col("_upto") - F.col("_cnt")).drop("_upto", "_step")


def average_rank(df: DataFrame, keys, value: str, name: str, ext: Extent) -> DataFrame:
    """1-based rank of ``value`` inside its group, ties sharing their mean rank; NULL for a NULL value."""
    keys = list(keys)
    if ext.longest <= SAFE_GROUP:
        w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0)))
    ladder = _ladder(df, keys, value)
    ranks = ladder.select(*keys, value, (F.col("_below") + (F.col("_cnt") + 1) / F.lit(2.0)).alias(name))
    return same_keys(df, ranks, [*keys, value], "left")


def quantiles(df: DataFrame, keys, wanted: dict[str, tuple[str, float]], ext: Extent, also=()) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``{new: (column, p)}``; NULLs are ignored.

    ``also`` lists further aggregates (named columns) to compute in the same pass.
    """
    keys = list(keys)
    by_col: dict[str, list[tuple[str, float]]] = {}
    for new, (c, p) in wanted.items():
        by_col.setdefault(c, []).append((new, p))
    if ext.longest <= SAFE_GROUP:
        aggs = [
            F.percentile(F.col(c), F.array(*[F.lit(float(p)) for _, p in items])).alias(f"_p_{i}")
            for i, (c, items) in enumerate(by_col.items())
        ]
        picked = [
            F.col(f"_p_{i}")[j].alias(new)
            for i, items in enumerate(by_col.values())
            for j, (new, _) in enumerate(items)
        ]
        out = df.groupBy(*keys).agg(*aggs, *also)
        return out.select(*keys, *picked, *out.columns[len(keys) + len(aggs) :])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *also).drop("_rows")
    for c, items in by_col.items():
        ladder = _ladder(df.select(*keys, F.col(c).cast("double").alias("_v")), keys, "_v")
        totals = ladder.groupBy(*keys).agg(F.sum("_cnt").alias("_total"))
        ladder = same_keys(ladder, totals, keys)
        aggs, picked = [], []
        for j, (new, p) in enumerate(items):
            at = F.lit(float(p)) * (F.col("_total") - 1)
            for side, fn in (("lo", F.floor), ("hi", F.ceil)):
                hit = (F.col("_below") <= fn(at)) & (fn(at) < F.col("_below") + F.col("_cnt"))
                aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{j}"))
            aggs.append(F.max(at - F.floor(at)).alias(f"_w{j}"))
            picked.append((F.col(f"_lo{j}") + (F.col(f"_hi{j}") - F.col(f"_lo{j}")) * F.col(f"_w{j}")).alias(new))
        out = same_keys(out, ladder.groupBy(*keys).agg(*aggs).select(*keys, *picked), keys, "left")
    return out


def quantiles_without(rows: DataFrame, pool, unit: str, wanted: dict[str, tuple[str, float]], requests: DataFrame, without: str = "without") -> DataFrame:
    """Exact interpolated quantiles of a pool's rows without some of its units, for any number of such requests.

    ``requests`` has a row per request: the pool columns, columns that name it, and an array of units to leave out. The
    result has those columns and ``wanted``; a quantile over nothing is NULL. No row is copied per request: values are
    counted per unit and laid out in order once; a request subtracts its units' counts from the counts of the partitions
    of that layout, and only the partitions that hold a wanted rank are looked into, each as one bounded group.
    NULLs are ignored, NaN is the largest value, NULL units are a unit of their own that can not be left out.
    """
    import pandas as pd

    pool = list(pool)
    named = [c for c in requests.columns if c != without]
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), F.col(c).cast("double").alias("_v")) for k, c in enumerate(columns)]))
    tally = rows.select(*pool, F.col(unit).alias("_u"), cells.alias("_x")).select(*pool, "_u", "_x._c", "_x._v").where("_v IS NOT NULL")
    tally = tally.groupBy(*pool, "_c", "_v", "_u").agg(F.count(F.lit(1)).alias("_k"))
    spark = rows.sparkSession
    use_checkpoints(spark)
    # equal values share a partition, and the partitions are numbered in order of value within (pool, column)
    laid = tally.repartitionByRange(*pool, "_c", "_v").withColumn("_bin", F.spark_partition_id()).checkpoint()
    counts = laid.groupBy(*pool, "_c", "_bin", "_u").agg(F.sum("_k").alias("_k"))
    bins = counts.groupBy(*pool, "_c", "_bin").agg(F.sum("_k").alias("_all"))
    asked = requests.withColumn("_r", F.xxhash64(*named))
    left_out = asked.select(*pool, "_r", F.explode(F.array_distinct(without)).alias("_u"))
    minus = left_out.join(counts, [*pool, "_u"]).groupBy("_r", "_c", "_bin").agg(F.sum("_k").alias("_less"))
    cell = asked.select(*pool, "_r").join(bins, pool).join(minus, ["_r", "_c", "_bin"], "left")
    cell = cell.withColumn("_in", F.col("_all") - F.coalesce("_less", F.lit(0)))
    own = Window.partitionBy("_r", "_c")  # as many rows as there are partitions
    cell = cell.withColumns({"_upto": F.sum("_in").over(own.orderBy("_bin")), "_n": F.sum("_in").over(own)}).where("_n > 0")
    targets = F.array(*[F.struct(F.lit(new).alias("_name"), F.lit(columns.index(c)).alias("_of"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at")) for new, (c, p) in wanted.items()])
    ends = cell.withColumn("_t", F.explode(targets)).where("_t._of = _c").select(*pool, "_r", "_c", "_bin", "_in", "_upto", "_t._name", "_t._at")
    ends = ends.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_rank >= _upto - _in AND _rank < _upto")
    picks = ends.select(*pool, "_c", "_bin", "_r", "_name", "_at", "_rank", (F.col("_rank") - (F.col("_upto") - F.col("_in"))).alias("_inside"))
    picks = picks.join(asked.select("_r", F.col(without).alias("_without")), "_r").withColumnsRenamed({"_c": "_pc", "_bin": "_pbin", **{c: f"_p_{c}" for c in pool}})
    needed = picks.select(*[F.col(f"_p_{c}").alias(c) for c in pool], F.col("_pc").alias("_c"), F.col("_pbin").alias("_bin")).distinct()
    values = laid.join(needed, [*pool, "_c", "_bin"], "left_semi")

    def select(own: pd.DataFrame, picked: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v, place = np.unique(own["_v"].to_numpy(float), return_inverse=True)
        weight, code = own["_k"].to_numpy(np.int64), own["_u"].to_numpy()
        upto = np.cumsum(np.bincount(place, weight, len(v)).astype(np.int64))
        rows_of = {u: np.flatnonzero(code == u) for u in {x for w in picked["_without"] for x in w}}
        out = np.empty(len(picked))
        for k, (gone, inside) in enumerate(zip(picked["_without"], picked["_inside"])):
            at = np.concatenate([rows_of[u] for u in set(gone)]) if len(gone) else np.empty(0, int)
            order = np.argsort(place[at], kind="stable")
            where, less = place[at][order], np.cumsum(weight[at][order])
            lo, hi = 0, len(v) - 1
            while lo < hi:  # the first value up to which more than ``inside`` rows are left
                mid = (lo + hi) // 2
                cut = np.searchsorted(where, mid, side="right")
                if upto[mid] - (less[cut - 1] if cut else 0) > inside:
                    hi = mid
                else:
                    lo = mid + 1
            out[k] = v[lo]
        return picked[["_r", "_name", "_at", "_rank"]].assign(_v=out)

    keys = [*pool, "_c", "_bin"]
    found = values.groupBy(*keys).cogroup(picks.groupBy(*[f"_p_{c}" for c in pool], "_pc", "_pbin")).applyInPandas(select, "_r long, _name string, _at double, _rank long, _v double")
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    value = low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))
    # a rank was found, so what comes back from pandas as NULL was NaN
    value = found.groupBy("_r", "_name").agg(F.coalesce(value, F.lit(float("nan"))).alias("_v"))
    wide = value.groupBy("_r").agg(*[F.max(F.when(F.col("_name") == new, F.col("_v"))).alias(new) for new in wanted])
    return asked.join(wide, "_r", "left").select(*named, *wanted)


def rolling_median(df: DataFrame, keys, value: str, name: str, ext: Extent, fraction: float = 0.05, size: str = "n", pos: str = "pos") -> DataFrame:
    """Centred rolling median whose width is a fraction of the series length (at least 3).

    An Arrow group holds the tiles of as many series as make up about ``CHUNK / 4`` rows of ``ext``, each with the rows its
    windows reach, never a whole long series; tiles are at least as wide as the window. Tiles of equal width are smoothed in one
    call, with a window of missing values between them.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)
    width = F.greatest(F.lit(3), F.bround(F.col(size) * F.lit(float(fraction)), 0).cast("bigint")).cast("bigint")
    reach = F.floor(width / 2).cast("bigint") + 1
    tile = F.greatest(F.lit(CHUNK // 4), width)
    tiled = _with_halo(df.withColumns({"_w": width, "_tw": tile}), pos, F.col("_tw"), reach, reach)
    tiled = tiled.withColumn("_block", F.pmod(F.xxhash64(*keys, "_tile"), F.lit(blocks_of(ext))))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf.groupby([*keys, "_tile"], sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf[pos].to_numpy(), series))
        v, w, series = pdf[value].to_numpy(float)[order], pdf["_w"].to_numpy()[order], series[order]
        smoothed = np.empty(len(v))
        for one in np.unique(w):
            at = np.flatnonzero(w == one)
            place = np.arange(len(at)) + one * np.cumsum(np.diff(series[at], prepend=series[at[0]]) != 0)
            apart = np.full(place[-1] + 1, np.nan)
            apart[place] = v[at]
            smoothed[at] = pd.Series(apart).rolling(int(one), center=True, min_periods=1).median().to_numpy()[place]
        pdf = pdf.iloc[order].assign(**{name: smoothed})
        home = pdf["_tile"].to_numpy() == pdf[pos].to_numpy() // pdf["_tw"].to_numpy()
        return pdf.loc[home, [c for c in pdf.columns if c not in ("_w", "_tw", "_tile", "_block")]]

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return spread(tiled, "_block", rows=ext.rows).groupBy("_block").applyInPandas(smooth, schema)
