"""Shared building blocks of the SQL that the registered queries are checked against.

Written independently of the Spark operators: textbook SQL over whole tables, no chunking and no
shortcuts, so that a mistake in an operator cannot repeat itself here.
"""

from __future__ import annotations

import re

CTE: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTE[name] = body.strip()


def sql(select: str, **local: str) -> str:
    """Prepend every named block that ``select`` (or a block it uses) refers to."""
    blocks = {**CTE, **{k: v.strip() for k, v in local.items()}}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in blocks:
            if name not in order and name not in visiting and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visiting.append(name)
                visit(blocks[name])
                order.append(name)

    # a negative value that rounds to zero must not stay -0.0
    select = re.sub(r", ([2-9])\) AS ", r", \1) + 0.0::DOUBLE AS ", select)
    visiting: list[str] = []
    visit(select)
    if not order:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({blocks[n]})" for n in order) + "\n" + select.strip()


FOLDS = 5

define("ev", """
SELECT 'd' || (user_id % 2) AS dataset, user_id AS asset_id, event_type AS condition,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
       count(*) OVER (PARTITION BY user_id) AS n,
       value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y
FROM events""")

define("nb", """
SELECT *, CAST(LEAST(GREATEST(floor(GREATEST(6.0::DOUBLE, 0.2::DOUBLE * n)), 5), GREATEST(n // 2, 5), n) AS BIGINT) AS n_base
FROM ev""")

define("scales", """
SELECT asset_id, quantile_cont(x, 0.25) AS x1, quantile_cont(x, 0.5) AS x2, quantile_cont(x, 0.75) AS x3,
       quantile_cont(y, 0.25) AS y1, quantile_cont(y, 0.5) AS y2, quantile_cont(y, 0.75) AS y3
FROM nb WHERE pos < n_base GROUP BY asset_id""")

define("zz", """
SELECT nb.*, (x - x2) / (x3 - x1 + 1e-9) AS zx, (y - y2) / (y3 - y1 + 1e-9) AS zy
FROM nb JOIN scales USING (asset_id)""")

define("zmom", """
SELECT asset_id, avg(zx) AS mx, avg(zy) AS my, var_pop(zx) AS vx, var_pop(zy) AS vy, covar_pop(zx, zy) AS cxy, count(*) AS nbr
FROM zz WHERE pos < n_base GROUP BY asset_id""")

define("steps", """
SELECT asset_id, pos, sqrt(power(zx - lag(zx) OVER w, 2) + power(zy - lag(zy) OVER w, 2) + 1e-9) AS s
FROM zz WINDOW w AS (PARTITION BY asset_id ORDER BY pos)""")

define("changes", """
SELECT asset_id, pos, coalesce(s, lead(s) OVER (PARTITION BY asset_id ORDER BY pos), 0) AS c FROM steps""")

define("comp", """
SELECT zz.dataset, zz.asset_id, zz.pos, zz.n, zz.n_base, x, y,
       ln(1 + sqrt(power(zx - mx, 2) / (vx + 1e-6) + power(zy - my, 2) / (vy + 1e-6) + 1e-9)) AS e, ln(1 + c) AS c
FROM zz JOIN zmom USING (asset_id) JOIN changes ON changes.asset_id = zz.asset_id AND changes.pos = zz.pos""")

define("runs", f"""
SELECT dataset, grp, CASE WHEN (r // {FOLDS}) % 2 = 0 THEN r % {FOLDS} ELSE {FOLDS - 1} - r % {FOLDS} END AS bucket FROM (
  SELECT dataset, grp, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, grp) - 1 AS r FROM (
    SELECT dataset, asset_id // 4 AS grp, count(*) AS size FROM ev GROUP BY ALL))""")

define("roles", f"""
SELECT comp.*, CAST((asset_id % 2) * {FOLDS} + f AS INT) AS fold_id,
       CASE WHEN bucket = f THEN 'test' WHEN bucket = (f + 1) % {FOLDS} THEN 'val' ELSE 'train' END AS role
FROM comp JOIN runs ON runs.dataset = comp.dataset AND runs.grp = comp.asset_id // 4, generate_series(0, {FOLDS - 1}) g(f)""")

define("bounds", """
SELECT fold_id, quantile_cont(e, 0.01) AS e_lo, quantile_cont(e, 0.99) AS e_hi, quantile_cont(c, 0.01) AS c_lo, quantile_cont(c, 0.99) AS c_hi
FROM roles WHERE role = 'train' GROUP BY fold_id""")

define("normed", """
SELECT roles.*, (e - e_lo) / (e_hi - e_lo + 1e-9) AS e_lin, (c - c_lo) / (c_hi - c_lo + 1e-9) AS c_lin,
       LEAST(GREATEST((e - e_lo) / (e_hi - e_lo + 1e-9), 0), 1) AS en, LEAST(GREATEST((c - c_lo) / (c_hi - c_lo + 1e-9), 0), 1) AS cn
FROM roles JOIN bounds USING (fold_id)""")

define("blended", """
SELECT fold_id, asset_id, pos, n, round(k / 100.0::DOUBLE, 6) AS a,
       round(round(k / 100.0::DOUBLE, 6) * en + (1 - round(k / 100.0::DOUBLE, 6)) * cn, 9) AS v
FROM normed, generate_series(0, 100) g(k) WHERE role = 'train'""")

define("blend_ranked", """
SELECT *, rank() OVER r + (count(*) OVER (PARTITION BY fold_id, asset_id, a, v) - 1) / 2.0::DOUBLE AS rk,
       sign(v - lag(v) OVER (PARTITION BY fold_id, asset_id, a ORDER BY pos)) AS sg
FROM blended WINDOW r AS (PARTITION BY fold_id, asset_id, a ORDER BY v)""")

define("fit_asset", """
SELECT fold_id, asset_id, a, CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END AS mono,
       CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS rho
FROM blend_ranked GROUP BY fold_id, asset_id, a""")

define("sweep", """
SELECT fold_id, a, round(avg(mono + rho), 9) AS fitness, round(avg(mono), 9) AS fitness_mono, count(*) AS n_train
FROM fit_asset GROUP BY fold_id, a""")

define("picked", """
SELECT fold_id, a, round(1 - a, 6) AS b, fitness, n_train FROM (
  SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY fitness DESC, a) AS r FROM sweep) WHERE r = 1""")

define("picked_mono", """
SELECT fold_id, a AS am, round(1 - a, 6) AS bm, fitness_mono FROM (
  SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY fitness_mono DESC, a) AS r FROM sweep) WHERE r = 1""")

define("applied", """
SELECT normed.*, a, b, round(a * en + b * cn, 9) AS idx FROM normed JOIN picked USING (fold_id)""")

define("held", "SELECT * FROM applied WHERE role = 'test'")
define("ev_static", "SELECT * FROM comp")


def criteria(source: str, keys: str, value: str) -> dict[str, str]:
    """Blocks crit_rows / crit for the per-series shape criteria of ``value`` in block ``source``."""
    return {
        "crit_rows": f"""
SELECT {keys}, pos, {value} AS v,
       sign(round({value} - lag({value}) OVER w, 9)) AS sg,
       {value} - 2 * lag({value}) OVER w + lag({value}, 2) OVER w AS bend,
       rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE AS rk
FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)""",
        "crit": f"""
SELECT {keys}, count(*) AS n,
       CASE WHEN count(*) > 1 THEN abs(coalesce(sum(sg), 0)) / (count(*) - 1)::DOUBLE ELSE 0 END AS monotonicity,
       CASE WHEN count(*) > 1 THEN coalesce(sum(sg), 0) / (count(*) - 1)::DOUBLE ELSE 0 END AS signed_monotonicity,
       CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN abs(corr(v, pos)) ELSE 0 END AS trendability,
       CASE WHEN count(*) >= 3 AND stddev_pop(v) >= 1e-12 THEN corr(rk, pos) ELSE 0 END AS rho,
       CASE WHEN count(*) >= 3 THEN 1 / (avg(bend * bend) + 1e-12) ELSE 0 END AS smoothness,
       coalesce(sum(CASE WHEN sg > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_pos,
       coalesce(sum(CASE WHEN sg < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_neg,
       coalesce(sum(CASE WHEN sg = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_tie,
       arg_min(v, pos) AS first_value, arg_max(v, pos) AS last_value
FROM crit_rows GROUP BY {keys}""",
    }
