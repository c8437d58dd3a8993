"""Maps without wells: how strong and how scattered a cell's features are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import unit
from strata.operators.ranks import percentiles
from strata.operators.storage import stored


def unit_maps(long: DataFrame) -> DataFrame:
    """row, col, prob, uncertainty from long normalised features: mean of absolute values and population standard deviation
    across a cell's features, each brought to 0 to 1 between its 5th and 95th percentiles."""
    per_cell = long.groupBy("row", "col").agg(F.avg(F.abs("val")).alias("strength"), F.stddev_pop("val").alias("dispersion"))
    # Read three times below.
    per_cell = stored(per_cell, "cells")
    measures = per_cell.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("val")) for m in ("strength", "dispersion")])).alias("m")).select("m.*")
    ends = percentiles(measures, "val", [0.05, 0.95], "measure")
    one = lambda m: F.max(F.when(F.col("measure") == m, F.col("p"))).alias(m[0])
    limits = ends.agg(one("strength"), one("dispersion"))  # one row
    return per_cell.crossJoin(F.broadcast(limits)).select("row", "col", unit(F.col("strength"), F.col("s")[0], F.col("s")[1]).alias("prob"), unit(F.col("dispersion"), F.col("d")[0], F.col("d")[1]).alias("uncertainty"))


def scaled(rows: DataFrame, column: str, name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """rows with `name`: the column between its two percentiles, as 0 to 1."""
    limits = percentiles(rows, column, [low, high]).select(F.col("p").alias(f"{name}_ends"))  # one row
    ends = F.col(f"{name}_ends")
    return rows.crossJoin(F.broadcast(limits)).withColumn(name, unit(F.col(column), ends[0], ends[1])).drop(f"{name}_ends")
