"""The data of the survey's charts, as tables; drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import feature_label, kilometres, score
from strata.operators.grid import Grid
from strata.plans.pipeline import contour_class

#: Targets that a map or a comparison marks, and features that a report shows.
MARKED, SHOWN = 10, 15


def panels(maps: DataFrame, grid: Grid, reference: DataFrame | None = None) -> DataFrame:
    """row, col, x, y, x_km, y_km, reference, prob, level (contours reached), uncertainty, score: the four panels of a type's
    map. reference: row, col, z of a layer on the grid; null without one."""
    out = contour_class(maps).withColumns({"x": F.lit(grid.xmin) + F.col("col") * grid.dx, "y": F.lit(grid.ymin) + F.col("row") * grid.dy, "score": score(F.col("prob"), F.col("uncertainty"))})
    if reference is None:
        out = out.withColumn("reference", F.lit(None).cast("double"))
    else:
        out = out.join(reference.select("row", "col", F.col("z").alias("reference")), ["row", "col"], "left")
    return out.select("row", "col", "x", "y", kilometres(F.col("x")).alias("x_km"), kilometres(F.col("y")).alias("y_km"), "reference", "prob", "level", "uncertainty", "score")


def marks(targets: DataFrame, n: int = MARKED) -> DataFrame:
    """name (T and the rank), x, y, colour (place in a list of ten, the last for all beyond) of the first n targets."""
    return targets.where(F.col("rank") <= n).select(F.concat(F.lit("T"), F.col("rank").cast("string")).alias("name"), "x", "y", F.least(F.col("rank") - 1, F.lit(9)).alias("colour"))


def overlay(wells: DataFrame) -> DataFrame:
    """x, y, marker of the wells: positive ones point up, negative ones down; other labels aren't shown."""
    return wells.where(F.col("label").isin(0, 1)).select("x", "y", F.when(F.col("label") == 1, "up").otherwise("down").alias("marker"))


def bars(targets: DataFrame) -> DataFrame:
    """name, max_probability, max_score, mean_uncertainty of all targets, in the order of their ranks."""
    return targets.orderBy("rank").select(F.concat(F.lit("T"), F.col("rank").cast("string")).alias("name"), "max_probability", "max_score", "mean_uncertainty")


def importance_bars(spark, importances: list[tuple[str, float]], n: int = SHOWN) -> DataFrame:
    """label, importance of the first n features."""
    rows = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(importances[:n])], "i int, name string, importance double")
    return rows.orderBy("i").select(feature_label(F.col("name")).alias("label"), "importance")


def comparison(targets: dict[str, DataFrame], n: int = MARKED) -> DataFrame:
    """target_type, name, x, y, max_probability of each type's first n targets, for one map of all types."""
    out = None
    for kind, t in targets.items():
        part = t.where(F.col("rank") <= n).select(F.lit(kind).alias("target_type"), F.concat(F.lit("T"), F.col("rank").cast("string")).alias("name"), "x", "y", "max_probability")
        out = part if out is None else out.unionByName(part)
    return out
