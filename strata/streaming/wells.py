"""Wells that arrive as a stream: counts by type and label per event-time window, late rows dropped by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def well_counts(wells: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, target_type, n_pos, n_neg; works on a stream and on a table alike."""
    counted = wells.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "target_type")
    return counted.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")).select(F.col("w.start").alias("window_start"), "target_type", "n_pos", "n_neg")
