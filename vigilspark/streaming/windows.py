"""Features of event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_features(rows: DataFrame, keys, time: str, value: str, width: str, delay: str) -> DataFrame:
    """(keys, start, rows, rms, kurtosis, crest, median) of tumbling windows; works on a stream and on a table alike.

    On a stream a window is reported once, when the latest event time less ``delay`` has passed its end; rows for a window
    already reported are late, and dropped. Rows without a time or a value belong to no window.
    """
    x = F.col(value)
    own = rows.where(F.col(time).isNotNull() & x.isNotNull()).withWatermark(time, delay)
    moments = [F.avg(F.pow(x, F.lit(k))).alias(f"_m{k}") for k in range(1, 5)]
    out = own.groupBy(*keys, F.window(time, width).alias("_w")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(x)).alias("_top"), F.median(x).alias("median"), *moments)
    m1, m2, m3, m4 = (F.col(f"_m{k}") for k in range(1, 5))
    variance = F.greatest(m2 - m1 * m1, F.lit(0.0))
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    rms = F.sqrt(m2 + 1e-12)
    return out.select(*keys, F.col("_w.start").alias("start"), "rows", rms.alias("rms"), (fourth / (variance * variance + 1e-12)).alias("kurtosis"), (F.col("_top") / (rms + 1e-12)).alias("crest"), "median")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Append all that is there to parquet at ``path`` and stop; a later call goes on from the checkpoint.

    Returns how many rows came too late for their window.
    """
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p.get("stateOperators", []))
