"""Splits, asset identity, folds and leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Extent, keep, neighbours, position, running_total

# Recording-set prefixes that name the same physical asset.
SET_PREFIXES = "^(Full_Test_Set_|Test_set_|Learning_set_)"
MIN_SNAPSHOTS = 10


def physical_base(name: Column) -> Column:
    return F.regexp_replace(name, SET_PREFIXES, "")


def group_key(name: Column) -> Column:
    """Smallest independent unit: the shared run for assets on one shaft, else the physical asset."""
    run = F.regexp_extract(name, r"^(Test\d+)_Bearing\d+$", 1)
    return F.when(run != "", run).otherwise(physical_base(name))


def long_enough(manifest: DataFrame, least: int = MIN_SNAPSHOTS) -> DataFrame:
    return manifest.where(F.col("n_snapshots") >= least)


def deduplicate(manifest: DataFrame, keys=("dataset",), tie: str = "asset_id") -> DataFrame:
    """One recording per physical asset: the full run first, then the longest, then the last name and ``tie``.

    Copies of one asset are aggregated, never gathered: a group may hold any number of recordings.
    """
    full = F.col("asset").startswith("Full_Test_Set_").cast("int")
    cols = manifest.columns
    best = F.max_by(F.struct(*cols), F.struct(full, F.col("n_snapshots"), F.col("asset"), F.col(tie))).alias("_best")
    out = manifest.withColumn("_base", physical_base(F.col("asset"))).groupBy(*keys, "_base").agg(best)
    return out.select("_best.*")


def duplicate_audit(manifest: DataFrame, keys=("dataset",)) -> DataFrame:
    """Physical assets recorded more than once, with how many copies each has."""
    base = manifest.withColumn("base", physical_base(F.col("asset")))
    return base.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("copies"), F.min("asset").alias("first_name"), F.max("asset").alias("last_name")).where("copies > 1")


def leave_one_out(manifest: DataFrame, ext: Extent, keys=("dataset",)) -> DataFrame:
    """One fold per asset: the held-out asset, its validation asset and the training size.

    Validation is the next name, cyclically, of another group. Training is everything outside both
    groups and stays implicit - listing it would cost the square of the number of assets. ``ext``
    sizes the manifest by ``keys``.
    """
    keys = list(keys)
    named = manifest.select(*keys, "asset", group_key(F.col("asset")).alias("grp"))
    rows = position(named, keys, ["asset"], ext)
    rows = neighbours(rows, keys, {"_prev": ("grp", 1)}, ext)
    rows = rows.withColumn("_start", F.when(F.col("_prev").eqNullSafe(F.col("grp")), 0).otherwise(1))
    rows = keep(running_total(rows, keys, "_start", "_run", ext))
    heads = rows.where("_start = 1").select(*keys, F.col("_run").alias("_h"), F.col("asset").alias("val"), F.col("grp").alias("val_group"))
    runs = heads.groupBy(*keys).agg(
        F.max("_h").alias("_runs"), F.max_by("val_group", -F.col("_h")).alias("_first_group")
    )
    rows = rows.join(runs, keys)
    wraps = F.col("_run") == F.col("_runs")
    # past the last run comes the first one, or the second when the first is the asset's own group
    target = F.when(wraps & (F.col("_first_group") != F.col("grp")), 1).when(wraps, 2).otherwise(F.col("_run") + 1)
    sizes = rows.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("_size"))
    out = rows.withColumn("_h", target.cast("bigint")).join(heads, [*keys, "_h"], "left")
    out = out.join(sizes, [*keys, "grp"])
    val_sizes = sizes.select(*keys, F.col("grp").alias("val_group"), F.col("_size").alias("_vsize"))
    out = out.join(val_sizes, [*keys, "val_group"], "left")
    n_train = F.col("n") - F.col("_size") - F.coalesce(F.col("_vsize"), F.lit(0))
    return out.select(*keys, F.col("asset").alias("holdout"), F.col("grp").alias("holdout_group"), "val", "val_group", n_train.alias("n_train"))


def deal_groups(manifest: DataFrame, folds: int, ext: Extent, keys=("dataset",), group: str = "grp", size: str = "size") -> DataFrame:
    """(keys, group, bucket): whole independence groups dealt to ``folds`` buckets of about the same size.

    The largest groups go first, forth and back over the buckets, so a bucket differs from another by one group at most.
    ``manifest`` has a row per group and its ``size``; ``ext`` sizes it by ``keys``.
    """
    keys = list(keys)
    ranked = position(manifest.withColumn("_less", -F.col(size)), keys, ["_less", group], ext, "_rank", None)
    turn, at = F.floor(F.col("_rank") / folds), F.pmod(F.col("_rank"), F.lit(folds))
    return ranked.select(*keys, group, F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("bucket"))


def guarded_fit(params: DataFrame, rows: DataFrame, group: str = "grp", bucket: str = "bucket", keys=("dataset",)) -> DataFrame:
    """``params``, unless a group of ``rows`` lies in two buckets: then reading them raises.

    Roles follow from buckets alone, so a group in one bucket cannot be trained on and held out in the same fold. The check is
    part of the plan of the fit, one pre-aggregated row per group, and cannot be left out by a caller.
    """
    split = rows.groupBy(*keys, group).agg((F.min(bucket) != F.max(bucket)).cast("int").alias("_split"))
    bad = split.agg(F.coalesce(F.sum("_split"), F.lit(0)).alias("_bad"))  # one row
    message = F.concat(F.lit("leakage: "), F.col("_bad").cast("string"), F.lit(" groups lie in several buckets"))
    held = F.when(F.col("_bad") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return params.crossJoin(F.broadcast(bad)).where(held).drop("_bad")


def fold_violations(members: DataFrame) -> DataFrame:
    """Groups that appear in more than one role of a fold: (fold_id, grp, role) rows in, leaks out.

    Each (fold, group) is reduced to its set of roles before anything is compared.
    """
    roles = members.groupBy("fold_id", "grp").agg(
        F.max((F.col("role") == "test").cast("int")).alias("_t"),
        F.max((F.col("role") == "val").cast("int")).alias("_v"),
        F.max((F.col("role") == "train").cast("int")).alias("_r"),
    )
    return roles.where(F.col("_t") + F.col("_v") + F.col("_r") > 1).select("fold_id", "grp")


def require_no_leakage(members: DataFrame, params: DataFrame | None = None) -> None:
    """Raise when a group crosses roles or a fit used another number of training assets."""
    bad = fold_violations(members).limit(1).collect()
    if bad:
        raise ValueError(f"leakage: group {bad[0].grp} has several roles in fold {bad[0].fold_id}")
    if params is not None:
        assets = members.where("role = 'train'").groupBy("fold_id").agg(F.countDistinct("asset_id").alias("_n"))
        wrong = assets.join(params.select("fold_id", "n_train"), "fold_id").where("_n != n_train").limit(1).collect()
        if wrong:
            raise ValueError(f"leakage: fold {wrong[0].fold_id} was fitted on {wrong[0].n_train} assets, not {wrong[0]._n}")


def require_groups(manifest: DataFrame, least: int = 2) -> None:
    """Raise when there are too few independent groups to hold one out."""
    found = manifest.select(group_key(F.col("asset")).alias("g")).distinct().limit(least).count()
    if found < least:
        raise ValueError(f"need at least {least} independent groups, found {found}")


def chronological(rows: DataFrame, train: float = 0.6, val: float = 0.2, test_end: float = 1.0) -> DataFrame:
    """train / val / test by position inside each asset; rows past ``test_end`` are dropped."""
    n = F.col("n")
    a = F.floor(n * F.lit(train))
    b = a + F.floor(n * F.lit(val))
    role = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").when(F.col("pos") < F.floor(n * F.lit(test_end)), "test")
    return rows.withColumn("role", role).where("role is not null")


def expanding_rounds(rows: DataFrame, rounds) -> DataFrame:
    """Expanding-window evaluation: ``rounds`` is a list of (train, val, test_end)."""
    table = F.array(*[F.struct(F.lit(i + 1).alias("round"), F.lit(t).alias("t"), F.lit(v).alias("v"), F.lit(e).alias("e")) for i, (t, v, e) in enumerate(rounds)])
    out = rows.withColumn("_r", F.explode(table))
    n = F.col("n")
    a = F.floor(n * F.col("_r.t"))
    b = a + F.floor(n * F.col("_r.v"))
    role = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").when(F.col("pos") < F.floor(n * F.col("_r.e")), "test")
    return out.withColumns({"round": F.col("_r.round"), "role": role}).drop("_r").where("role is not null")


def transfer_split(assets: DataFrame, condition: str, source: Column) -> DataFrame:
    """Source assets train, the first of each condition validates, everything else is the target.

    The first asset per condition is an aggregate, not a sort of the condition's assets.
    """
    first = assets.where(source).groupBy(condition).agg(F.min("asset_id").alias("_first"))
    out = assets.join(first, condition, "left")
    role = F.when(~source, "target").when(F.col("asset_id") == F.col("_first"), "val").otherwise("train")
    return out.withColumn("role", role).drop("_first")


def every_kth(rows: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    return rows.where(F.pmod(F.col(pos), F.lit(k)) == 0)


