"""Remaining-life labels from the position alone: linear and capped RUL, stages, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alarms import persistent_flags
from .ordered import Extent

# Seconds between snapshots of each known recording programme.
CADENCE_SECONDS = {"pronostia": 10.0, "xjtu_sy": 60.0, "mendeley": 3600.0, "ims": 600.0}
# Life fractions and index levels where the stage changes.
STAGE_LIFE = (0.60, 0.80, 0.95)
STAGE_INDEX = (0.2, 0.5, 0.8)


def fail_at(n: Column) -> Column:
    return F.greatest(n - 1, F.lit(1)).cast("bigint")


def linear_rul(pos: Column, n: Column) -> Column:
    return (fail_at(n) - pos) / fail_at(n)


def degradation(pos: Column, n: Column) -> Column:
    return pos / fail_at(n)


def capped_rul(pos: Column, n: Column, onset: float = 0.4) -> Column:
    """1 until the onset, then a straight line to 0 at failure."""
    span = F.greatest(F.lit(1.0 - onset) * fail_at(n), F.lit(1.0))
    return F.least(F.lit(1.0), (fail_at(n) - pos) / span)


def staged(value: Column, cuts) -> Column:
    """0..3: how many of the ascending cuts the value has reached."""
    out = F.lit(0)
    for i, cut in enumerate(cuts, start=1):
        out = F.when(value >= F.lit(float(cut)), F.lit(i)).otherwise(out)
    return out.cast("int")


def cadence_of(programme: Column, default: float = 1.0) -> Column:
    """Seconds between snapshots of a recording programme; ``default`` for one that is not listed."""
    known = F.create_map(*[F.lit(x) for pair in CADENCE_SECONDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, programme), F.lit(float(default)))


def with_hours(rows: DataFrame, cadence: Column, onset: float = 0.4) -> DataFrame:
    """Absolute hours and the scale that turns a capped fraction into hours."""
    life = fail_at(F.col("n")) * cadence / F.lit(3600.0)
    return rows.withColumns(
        {
            "life_hours": life,
            "rul_hours": linear_rul(F.col("pos"), F.col("n")) * life,
            "rul_scale_hours": life * F.lit(1.0 - onset),
        }
    )


def label_table(rows: DataFrame, keys, index: str, ext: Extent, cadence: Column, tau: float = 0.6, q: int = 3, onset: float = 0.4) -> DataFrame:
    """All labels of a series; ``index`` names the column that drives the stage and warning labels."""
    pos, n = F.col("pos"), F.col("n")
    out = rows.withColumns(
        {
            "H_fail": fail_at(n),
            "rul": linear_rul(pos, n),
            "deg": degradation(pos, n),
            "rul_capped": capped_rul(pos, n, onset),
            "stage_time": staged(degradation(pos, n), STAGE_LIFE),
            "stage_index": staged(F.col(index), STAGE_INDEX),
        }
    )
    out = with_hours(out, cadence, onset)
    return persistent_flags(out, keys, index, F.lit(float(tau)), ext, q=q, name="warning_label")
