"""Queries over sources, joins, asset identity, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import folds, health, joins, labels, ordered, windowing
from ..operators.ordered import Extent, keep
from ..sources.files import concat, from_path
from ..sources.tables import event_runs, event_series, table, table_extent, waveform_samples
from .pipelines import FEATURES, event_components, event_index, event_roles, long_indicators
from .registry import query
from .sqlkit import FOLDS, criteria, define, sql

ID = ["asset_id", "pos"]

define("names", """
SELECT r_name AS dataset, s_suppkey AS asset_id, CASE WHEN s_suppkey % 7 = 0 THEN 'Test' || s_nationkey || '_Bearing' || s_suppkey
         ELSE CASE s_suppkey % 3 WHEN 0 THEN 'Full_Test_Set_' WHEN 1 THEN 'Test_set_' ELSE 'Learning_set_' END || 'Bearing' || s_nationkey || '_' || (s_suppkey // 20) END AS asset
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("lengths", "SELECT l_suppkey AS asset_id, count(*) // 16 AS n_snapshots FROM lineitem GROUP BY l_suppkey")
define("man", "SELECT dataset, asset_id, asset, n_snapshots, regexp_replace(asset, '^(Full_Test_Set_|Test_set_|Learning_set_)', '') AS base FROM names JOIN lengths USING (asset_id) WHERE n_snapshots >= 10")
define("dedup", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, base ORDER BY starts_with(asset, 'Full_Test_Set_')::INT DESC, n_snapshots DESC, asset DESC, asset_id DESC) AS r FROM man) WHERE r = 1")
define("grp", r"SELECT dataset, asset, CASE WHEN regexp_matches(asset, '^Test\d+_Bearing\d+$') THEN regexp_extract(asset, '^(Test\d+)_', 1) ELSE base END AS grp, row_number() OVER (PARTITION BY dataset ORDER BY asset) - 1 AS p, count(*) OVER (PARTITION BY dataset) AS n FROM dedup")


def _manifest(spark, folder):
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    third = F.pmod("s_suppkey", F.lit(3))
    prefix = F.when(third == 0, "Full_Test_Set_").when(third == 1, "Test_set_").otherwise("Learning_set_")
    plain = F.concat(prefix, F.lit("Bearing"), F.col("s_nationkey"), F.lit("_"), F.floor(F.col("s_suppkey") / 20))
    run = F.concat(F.lit("Test"), F.col("s_nationkey"), F.lit("_Bearing"), F.col("s_suppkey"))
    name = F.when(F.pmod("s_suppkey", F.lit(7)) == 0, run).otherwise(plain)
    dims = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    dims = dims.select(F.col("r_name").alias("dataset"), F.col("s_suppkey").alias("asset_id"), name.alias("asset"))
    lengths = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id")).agg(F.floor(F.count(F.lit(1)) / 16).alias("n_snapshots"))
    return folds.long_enough(dims.join(lengths, "asset_id"))


@query("physical_identity", sql("SELECT dataset, asset, base FROM man"))
def physical_identity(spark, folder):
    return _manifest(spark, folder).select("dataset", "asset", folds.physical_base(F.col("asset")).alias("base"))


@query("independence_group", sql(r"SELECT dataset, asset, CASE WHEN regexp_matches(asset, '^Test\d+_Bearing\d+$') THEN regexp_extract(asset, '^(Test\d+)_', 1) ELSE base END AS grp FROM man"))
def independence_group(spark, folder):
    return _manifest(spark, folder).select("dataset", "asset", folds.group_key(F.col("asset")).alias("grp"))


@query("deduplicated_manifest", sql("SELECT dataset, asset_id, asset, n_snapshots FROM dedup"))
def deduplicated_manifest(spark, folder):
    return folds.deduplicate(_manifest(spark, folder)).select("dataset", "asset_id", "asset", "n_snapshots")


@query("manifest_audit", sql("SELECT dataset, base, count(*) AS copies, min(asset) AS first_name, max(asset) AS last_name FROM man GROUP BY dataset, base HAVING count(*) > 1"))
def manifest_audit(spark, folder):
    return folds.duplicate_audit(_manifest(spark, folder))


@query(
    "leave_one_asset_out",
    sql("""
SELECT a.dataset, a.asset AS holdout, a.grp AS holdout_group, arg_min(b.asset, (b.p - a.p + a.n) % a.n) FILTER (b.grp <> a.grp) AS val, arg_min(b.grp, (b.p - a.p + a.n) % a.n) FILTER (b.grp <> a.grp) AS val_group,
       count(*) FILTER (b.grp <> a.grp AND b.grp <> v.val_group) AS n_train
FROM grp a JOIN grp b ON a.dataset = b.dataset JOIN vals v ON v.dataset = a.dataset AND v.asset = a.asset GROUP BY a.dataset, a.asset, a.grp""",
        vals="SELECT a.dataset, a.asset, arg_min(b.grp, (b.p - a.p + a.n) % a.n) FILTER (b.grp <> a.grp) AS val_group FROM grp a JOIN grp b ON a.dataset = b.dataset GROUP BY a.dataset, a.asset"),
)
def leave_one_asset_out(spark, folder):
    man = folds.deduplicate(_manifest(spark, folder))
    n = table_extent(spark, folder, "supplier", "s_suppkey").rows
    return folds.leave_one_out(man, Extent(n, n))


@query("group_disjoint_folds", sql(f"""
SELECT f::INT AS fold_id, sum(CASE WHEN g % {FOLDS} = f THEN 1 ELSE 0 END)::BIGINT AS n_test, sum(CASE WHEN g % {FOLDS} = (f + 1) % {FOLDS} THEN 1 ELSE 0 END)::BIGINT AS n_val,
       sum(CASE WHEN g % {FOLDS} <> f AND g % {FOLDS} <> (f + 1) % {FOLDS} THEN 1 ELSE 0 END)::BIGINT AS n_train FROM (SELECT s_nationkey AS g FROM supplier), generate_series(0, {FOLDS - 1}) t(f) GROUP BY f"""))
def group_disjoint_folds(spark, folder):
    """K folds that keep all assets of a nation together."""
    rows = health.assign_roles(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_nationkey").alias("grp")), FOLDS, "grp")
    n = lambda r: F.sum((F.col("role") == r).cast("bigint")).alias(f"n_{r}")
    return rows.groupBy("fold_id").agg(n("test"), n("val"), n("train"))


@query("leakage_check", sql(f"""
SELECT f::INT AS fold_id, s_nationkey AS grp FROM supplier, generate_series(0, {FOLDS - 1}) t(f) GROUP BY f, s_nationkey
HAVING count(DISTINCT CASE WHEN s_suppkey % {FOLDS} = f THEN 'test' WHEN s_suppkey % {FOLDS} = (f + 1) % {FOLDS} THEN 'val' ELSE 'train' END) > 1"""))
def leakage_check(spark, folder):
    """Folds cut by asset alone leak through shared groups; the check names every leaking group."""
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_nationkey").alias("grp"))
    return folds.fold_violations(health.assign_roles(rows, FOLDS))


@query("chronological_split", sql("""
SELECT asset_id, role, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS rows FROM (
  SELECT *, CASE WHEN pos < floor(0.6::DOUBLE * n) THEN 'train' WHEN pos < floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 'val' ELSE 'test' END AS role FROM ev) GROUP BY asset_id, role"""))
def chronological_split(spark, folder):
    series, _ = event_series(spark, folder)
    return folds.chronological(series).groupBy("asset_id", "role").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("rows"))


@query("expanding_rounds", sql("""
SELECT round, role, count(*) AS rows FROM (
  SELECT r::INT AS round, CASE WHEN pos < floor(t::DOUBLE * n) THEN 'train' WHEN pos < floor(t::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' WHEN pos < floor(e::DOUBLE * n) THEN 'test' END AS role
  FROM ev, (VALUES (1, 0.4, 0.7), (2, 0.6, 0.85), (3, 0.75, 1.0)) v(r, t, e)) WHERE role IS NOT NULL GROUP BY round, role"""))
def expanding_rounds(spark, folder):
    series, _ = event_series(spark, folder)
    rows = folds.expanding_rounds(series.select("pos", "n"), [(0.4, 0.1, 0.7), (0.6, 0.1, 0.85), (0.75, 0.1, 1.0)])
    return rows.groupBy("round", "role").agg(F.count(F.lit(1)).alias("rows"))


@query("every_kth_window", sql("SELECT asset_id, count(*) AS rows FROM ev WHERE pos % 4 = 0 GROUP BY asset_id"))
def every_kth_window(spark, folder):
    series, _ = event_series(spark, folder)
    return folds.every_kth(series, 4).groupBy("asset_id").agg(F.count(F.lit(1)).alias("rows"))


@query("minimum_length", sql("SELECT user_id AS asset_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60"))
def minimum_length(spark, folder):
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.count(F.lit(1)).alias("n"))
    return e.where("n >= 60")


# ------------------------------------------------------------------ transfer
define("t_roles", """
SELECT c.*, 0 AS fold_id, CASE WHEN dataset <> 'd0' THEN 'target' WHEN asset_id = first THEN 'val' ELSE 'train' END AS role
FROM comp c JOIN (SELECT asset_id % 10 AS cond, min(asset_id) AS first FROM comp WHERE dataset = 'd0' GROUP BY asset_id % 10) f ON f.cond = c.asset_id % 10
UNION ALL SELECT c.*, 0, 'target' FROM comp c WHERE asset_id % 2 = 1""")
define("t_bounds", "SELECT quantile_cont(e, 0.01) AS e0, quantile_cont(e, 0.99) AS e1, quantile_cont(c, 0.01) AS c0, quantile_cont(c, 0.99) AS c1 FROM t_roles WHERE role = 'train'")
define("t_norm", "SELECT r.*, LEAST(GREATEST((e - e0) / (e1 - e0 + 1e-9), 0), 1) AS en, LEAST(GREATEST((c - c0) / (c1 - c0 + 1e-9), 0), 1) AS cn FROM t_roles r CROSS JOIN t_bounds")
define("t_mix", "SELECT asset_id, pos, round(k / 100.0::DOUBLE, 6) AS a, round(round(k / 100.0::DOUBLE, 6) * en + (1 - round(k / 100.0::DOUBLE, 6)) * cn, 9) AS v FROM t_norm, generate_series(0, 100) g(k) WHERE role = 'train'")
define("t_rank", "SELECT *, rank() OVER (PARTITION BY asset_id, a ORDER BY v) + (count(*) OVER (PARTITION BY asset_id, a, v) - 1) / 2.0::DOUBLE AS rk, sign(v - lag(v) OVER (PARTITION BY asset_id, a ORDER BY pos)) AS sg FROM t_mix")
define("t_fit", """
SELECT a FROM (SELECT a, round(avg(m + r), 9) AS f FROM (SELECT asset_id, a, CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END AS m, CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS r
  FROM t_rank GROUP BY asset_id, a) GROUP BY a) ORDER BY f DESC, a LIMIT 1""")


@query("transfer_split", sql("SELECT role, count(DISTINCT asset_id) AS assets, count(*) AS rows FROM t_roles GROUP BY role"))
def transfer_split(spark, folder):
    series, _ = event_series(spark, folder)
    assets = series.select("asset_id", "dataset", F.pmod("asset_id", F.lit(10)).alias("cond")).distinct()
    roles = folds.transfer_split(assets, "cond", F.col("dataset") == "d0").select("asset_id", "role")
    return series.join(roles, "asset_id").groupBy("role").agg(F.countDistinct("asset_id").alias("assets"), F.count(F.lit(1)).alias("rows"))


@query(
    "frozen_transfer",
    sql(
        "SELECT count(*) AS n_assets, round(median(monotonicity), 6) AS monotonicity, round(median(trendability), 6) AS trendability, round(median(rho), 6) AS rho FROM crit",
        t_idx="SELECT asset_id, pos, round(a * en + round(1 - a, 6) * cn, 9) AS v0 FROM t_norm CROSS JOIN t_fit WHERE role = 'target'",
        **criteria("t_idx", "asset_id", "v0"),
    ),
)
def frozen_transfer(spark, folder):
    """Index fitted on one dataset, frozen and applied to the assets of another."""
    comp, ext = event_components(spark, folder)
    assets = comp.select("asset_id", "dataset", F.pmod("asset_id", F.lit(10)).alias("cond")).distinct()
    roles = folds.transfer_split(assets, "cond", F.col("dataset") == "d0").select("asset_id", "role")
    rows = comp.select(*ID, "n", "E", "C").join(roles, "asset_id").withColumn("fold_id", F.lit(0))
    params = health.fit_on(rows.where("role = 'train'"), ext)
    target = health.apply_index(rows.where("role = 'target'"), params)
    from ..operators import quality

    crit = quality.asset_criteria(target, ["fold_id", "asset_id"], "index", ext)
    wanted = {f"{c}_m": (c, 0.5) for c in ("monotonicity", "trendability", "rho")}
    out = ordered.quantiles(crit, ["fold_id"], wanted, ext.assets, also=[F.count(F.lit(1)).alias("n_assets")])
    return out.select("n_assets", *[F.round(f"{c}_m", 6).alias(c) for c in ("monotonicity", "trendability", "rho")])


@query("fold_assembly", sql("""
SELECT a.fold_id, a.role, a.asset_id, a.pos, round((x - mx) / (sx + 1e-8), 6) AS z_x, round((y - my) / (sy + 1e-8), 6) AS z_y, round(idx, 9) AS index, round(pos / GREATEST(n - 1, 1)::DOUBLE, 6) AS deg
FROM applied a JOIN (SELECT fold_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM roles WHERE role = 'train' GROUP BY fold_id) USING (fold_id)"""))
def fold_assembly(spark, folder):
    """Stacked rows of every fold with train-only statistics and the fold's own index injected."""
    rows, _, _ = event_index(spark, folder, role=None)
    series, _ = event_runs(spark, folder, FOLDS)
    stats = windowing.channel_stats(series, FEATURES).join(series.select("asset_id", "bucket").distinct(), "asset_id")
    per_asset = event_roles(stats).where("role = 'train'")
    stats = windowing.pooled_stats(per_asset, ["fold_id"], FEATURES).drop("rows")
    z = windowing.zscore(rows, F.broadcast(stats), ["fold_id"], FEATURES)  # one row per fold
    deg = labels.degradation(F.col("pos"), F.col("n"))
    return z.select("fold_id", "role", *ID, *rounded(["z_x", "z_y"]), *rounded(["index"], 9), F.round(deg, 6).alias("deg"))


# ------------------------------------------------------------------ sources and joins
@query("file_name_columns", sql("""
SELECT 'events' AS source, count(*) AS rows FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM supplier"""))
def file_name_columns(spark, folder):
    """Concatenate several files and take the source name from each path."""
    parts = [table(spark, folder, t).select(from_path(r"([a-z]+)\.parquet").alias("source")) for t in ("events", "lineitem", "supplier")]
    return concat(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query("asset_manifest", sql("""
SELECT asset_id, count(DISTINCT win // 4) AS n_snapshots, count(*) AS n_windows, max(has) AS has_temp FROM (SELECT DISTINCT asset_id, win, asset_id % 3 <> 0 AS has FROM cut) GROUP BY asset_id"""))
def asset_manifest(spark, folder):
    samples, _ = waveform_samples(spark, folder)
    cut = windowing.cut_windows(samples.select("asset_id", "pos", "n"), 16, 8)
    wins = cut.where("i = 0").select("asset_id", "win", F.floor(F.col("win") / 4).alias("snapshot_id"), F.when(F.pmod("asset_id", F.lit(3)) != 0, F.lit(1.0)).alias("temperature"))
    return joins.manifest_of(wins, ["asset_id"])


@query("resume_remaining_work", sql("SELECT s_suppkey AS asset_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_tax > 0.07)"))
def resume_remaining_work(spark, folder):
    todo = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"))
    done = table(spark, folder, "lineitem").where("l_quantity > 49.5 and l_tax > 0.07").select(F.col("l_suppkey").alias("asset_id"))
    return joins.remaining(todo, done, ["asset_id"])


@query("keep_selected_snapshots", sql("SELECT asset_id, pos, x FROM ev WHERE asset_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)"))
def keep_selected_snapshots(spark, folder):
    series, _ = event_series(spark, folder)
    chosen = table(spark, folder, "events").where("event_type = 'error' and value > 50").select(F.col("user_id").alias("asset_id"))
    return joins.keep_keys(series.select(*ID, "x"), chosen, ["asset_id"])


@query("common_assets", sql("SELECT user_id AS asset_id FROM events INTERSECT SELECT l_suppkey FROM lineitem"))
def common_assets(spark, folder):
    a = table(spark, folder, "events").select(F.col("user_id").alias("asset_id"))
    b = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("asset_id"))
    return joins.common_keys(a, b, ["asset_id"])


@query("target_table_join", sql("""
SELECT e.asset_id, e.pos, e.y AS temperature, round(c.e, 6) AS e, round(LEAST(1, (GREATEST(e.n - 1, 1) - e.pos) / GREATEST(0.6::DOUBLE * GREATEST(e.n - 1, 1), 1)), 6) AS rul_capped
FROM ev e JOIN comp c ON c.asset_id = e.asset_id AND c.pos = e.pos WHERE e.pos % 2 = 0 AND e.y IS NOT NULL"""))
def target_table_join(spark, folder):
    """Temperature, index component and label tables on their shared key, keeping common snapshots only."""
    series, _ = event_series(spark, folder)
    comp, _ = event_components(spark, folder)
    temp = series.where("y is not null").select(*ID, F.col("y").alias("temperature"))
    lab = folds.every_kth(series, 2).select(*ID, labels.capped_rul(F.col("pos"), F.col("n")).alias("rul_capped"))
    out = temp.join(comp.select(*ID, F.col("E").alias("e")), ID).join(lab, ID)
    return out.select(*ID, "temperature", *rounded(["e", "rul_capped"]))


@query("replaced_columns", sql("SELECT asset_id, pos, round(e, 6) AS x FROM comp"))
def replaced_columns(spark, folder):
    series, _ = event_series(spark, folder)
    comp, _ = event_components(spark, folder)
    out = joins.replace_columns(series.select(*ID, "x"), comp.select(*ID, F.col("E").alias("x")), ID, ["x"])
    return out.select(*ID, *rounded(["x"]))


@query("lookup_with_defaults", sql("""
SELECT user_id AS asset_id, coalesce(max(s_name), 'unknown') AS name, coalesce(max((s_acctbal > 0)::INT), 0) AS has_temp, count(*) AS rows FROM events LEFT JOIN supplier ON user_id = s_suppkey GROUP BY user_id"""))
def lookup_with_defaults(spark, folder):
    """Attributes from a dimension table, with defaults for assets it does not list."""
    counts = table(spark, folder, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.count(F.lit(1)).alias("rows"))
    dim = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).cast("int").alias("has_temp"))
    return joins.lookup(counts, dim, ["asset_id"], {"name": "unknown", "has_temp": 0})


@query("claim_reconciliation", sql("""
SELECT c.condition, c.dataset, round(claimed, 2) AS claimed, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN abs(value - claimed) <= 0.5 THEN 'ok' ELSE 'mismatch' END AS status
FROM (SELECT condition, d.dataset, claimed FROM (SELECT event_type AS condition, round(avg(value), 1) AS claimed FROM events GROUP BY event_type), (VALUES ('d0'), ('d1'), ('d2')) d(dataset)) c
LEFT JOIN (SELECT condition, dataset, avg(x) AS value FROM ev GROUP BY condition, dataset) r ON r.condition = c.condition AND r.dataset = c.dataset"""))
def claim_reconciliation(spark, folder):
    """Overall means as claims about each dataset's cell; one claimed dataset does not exist."""
    series, _ = event_series(spark, folder)
    results = series.groupBy("condition", "dataset").agg(F.avg("x").alias("value"))
    claims = table(spark, folder, "events").groupBy(F.col("event_type").alias("condition")).agg(F.round(F.avg("value"), 1).alias("claimed"))
    claims = claims.withColumns({"dataset": F.explode(F.array(*[F.lit(d) for d in ("d0", "d1", "d2")])), "tolerance": F.lit(0.5)})
    out = joins.reconcile(claims, results, ["condition", "dataset"])
    return out.select("condition", "dataset", F.round("claimed", 2).alias("claimed"), *rounded(["value"]), "status")


@query("trajectory_export", sql("""
SELECT asset_id, pos, series, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-12), 5) AS scaled, round(pos / GREATEST(n - 1, 1)::DOUBLE, 5) AS life_fraction FROM (
  SELECT asset_id, pos, n, 'x' AS series, x AS v FROM ev UNION ALL SELECT asset_id, pos, n, 'y', y FROM ev) WINDOW w AS (PARTITION BY asset_id, series)"""))
def trajectory_export(spark, folder):
    series, _ = event_series(spark, folder)
    longs = long_indicators(series, [*ID, "n"], {"x": "x", "y": "y"}).withColumnRenamed("indicator", "series")
    lim = longs.groupBy("asset_id", "series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = longs.join(lim, ["asset_id", "series"])
    scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)
    return out.select(*ID, "series", F.round(scaled, 5).alias("scaled"), F.round(labels.degradation(F.col("pos"), F.col("n")), 5).alias("life_fraction"))


@query("merged_indicator_tables", sql("""
SELECT indicator, round(avg(v), 6) AS mean_value, extra FROM (
  SELECT 'x' AS indicator, x AS v, NULL AS extra FROM ev UNION ALL SELECT 'abnormality', e, 'component' FROM comp UNION ALL SELECT 'state_change', c, 'component' FROM comp) GROUP BY indicator, extra"""))
def merged_indicator_tables(spark, folder):
    """Union of two summary tables with different columns, the duplicated indicator taken from one only."""
    series, _ = event_series(spark, folder)
    comp = keep(event_components(spark, folder)[0])
    first = long_indicators(series.withColumn("e", F.lit(0.0)), [], {"x": "x", "abnormality": "e"}).where("indicator != 'abnormality'")
    second = long_indicators(comp, [], {"abnormality": "E", "state_change": "C"}).withColumn("extra", F.lit("component"))
    both = concat(first.groupBy("indicator").agg(F.avg("value").alias("m")), second.groupBy("indicator", "extra").agg(F.avg("value").alias("m")))
    both = both.select("indicator", F.round("m", 6).alias("mean_value"), "extra")
    return joins.ordered_by_category(both, "indicator", ["x", "abnormality", "state_change"])
