"""From probability maps to ranked targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import area_km2, score
from strata.operators.graph import components
from strata.operators.grid import Grid
from strata.operators.ranks import percentiles
from strata.operators.storage import stored

TILE = 512
#: Shares of a type's records that are cut to the best before they meet.
SHARES = 64
COLUMNS = ("rank", "x", "y", "row", "col", "max_probability", "mean_probability", "max_score", "mean_uncertainty", "area_km2", "n_pixels", "target_type", "threshold_used")


def hot(maps: DataFrame, min_prob: float, *by: str) -> DataFrame:
    """Cells whose prob reaches both min_prob and the 80th percentile (of their group)."""
    limit = percentiles(maps, "prob", [0.8], *by).select(*by, F.greatest(F.lit(float(min_prob)), F.col("p")[0]).alias("_limit"))
    joined = maps.join(limit, list(by)) if by else maps.crossJoin(F.broadcast(limit))
    return joined.where(F.col("prob") >= F.col("_limit")).drop("_limit")


def _tile_labels(tile: pd.DataFrame, width: int) -> pd.DataFrame:
    """Smallest cell number of each 4-connected component of one tile, by union-find over horizontal runs."""
    rows, cols = tile["row"].to_numpy(np.int64), tile["col"].to_numpy(np.int64)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1] + 1)]
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(rows)] - 1
    # Runs by (row, column) as one number; the runs of the row above that a run touches are neighbours in that order.
    wide = int(cols.max(initial=0)) + 2
    first, last = rows[start] * wide + cols[start], rows[end] * wide + cols[end]
    lo, hi = np.searchsorted(last, first - wide, "left"), np.searchsorted(first, last - wide, "right")
    parent = list(range(len(start)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    touching = np.flatnonzero(hi > lo)
    for k, i, j in zip(touching.tolist(), lo[touching].tolist(), hi[touching].tolist()):
        for other in range(i, j):
            a, b = find(k), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    root = np.array([find(i) for i in range(len(parent))], np.int64)
    number = rows * width + cols
    least = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(least, root[run], number)
    out = tile.iloc[order].copy()
    out["component"] = least[root[run]]
    return out


def label_components(cells: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """cells (row, col and any others) with component: the smallest row * width + col of its 4-connected component.

    Tiles are labelled on their own; only labels that meet at the borders of tiles are then joined to whole components, so
    no task holds more than a tile. Component numbers ascend in raster order."""
    schema = T.StructType([*cells.schema.fields, T.StructField("component", T.LongType())])
    dealt = cells.withColumns({"_tr": F.expr(f"row div {tile}"), "_tc": F.expr(f"col div {tile}")})
    names = cells.columns
    # Read three times below.
    part = stored(dealt.groupBy("_tr", "_tc").applyInPandas(lambda f: _tile_labels(f[names], width), schema), "tiles")
    edge = part.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)).select("row", "col", F.col("component").alias("u"))
    steps = F.array(F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")), F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")))
    near = edge.select(F.col("u").alias("v"), "row", "col", F.explode(steps).alias("s")).select("v", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    whole = components(edge.join(near, ["row", "col"]).where("u <> v").select("u", "v")).withColumnRenamed("component", "_whole")
    joined = part.join(whole, part["component"] == whole["node"], "left")
    return joined.select(*names, F.coalesce("_whole", "component").alias("component"))


def component_stats(cells: DataFrame, grid: Grid, target_type: str, min_prob: float, least: int = 3) -> DataFrame:
    """Target records without rank, one per component of at least `least` cells; the centre is weighted by score and rounded half to even."""
    w = F.greatest(F.col("score"), F.lit(0.0)) + 1e-10
    centre = lambda c, n: F.least(F.greatest(F.rint(F.sum(w * F.col(c)) / F.sum(w)), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    out = cells.withColumn("score", score(F.col("prob"), F.col("uncertainty"))).groupBy("component").agg(
        centre("row", grid.ny).alias("_row"), centre("col", grid.nx).alias("_col"), F.max("prob").alias("max_probability"), F.avg("prob").alias("mean_probability"),
        F.max("score").alias("max_score"), F.avg("uncertainty").alias("mean_uncertainty"), F.count("*").alias("n_pixels"),
    ).where(F.col("n_pixels") >= least)
    return out.select(
        "component", (F.lit(grid.xmin) + F.col("_col") * grid.dx).alias("x"), (F.lit(grid.ymin) + F.col("_row") * grid.dy).alias("y"), F.col("_row").alias("row"), F.col("_col").alias("col"),
        "max_probability", "mean_probability", "max_score", "mean_uncertainty", area_km2(F.col("n_pixels"), grid.dx, grid.dy).alias("area_km2"), F.col("n_pixels").cast("int").alias("n_pixels"),
        F.lit(target_type).alias("target_type"), F.lit(float(min_prob)).alias("threshold_used"),
    )


def _spaced(frame: pd.DataFrame, n: int, distance: int) -> pd.DataFrame:
    kept: list[int] = []
    rows, cols = frame["row"].to_numpy(), frame["col"].to_numpy()
    for i in range(len(frame)):
        if all(abs(rows[i] - rows[k]) >= distance or abs(cols[i] - cols[k]) >= distance for k in kept):
            kept.append(i)
            if len(kept) == n:
                break
    out = frame.iloc[kept].copy()
    out["rank"] = np.arange(1, len(kept) + 1)
    return out


def suppressed(records: DataFrame, n: int = 15, distance: int = 10) -> DataFrame:
    """The first n records by score, equal scores in raster order, that are `distance` rows or columns away from every
    better one kept; ranked from 1.

    Choosing is sequential, but few records can matter: of those with one centre only the best, and around each kept one
    no more centres than its square has, so n squares' worth of the best records of a type is all that matters. They are
    taken from each of SHARES shares of the type's records first, then from what is left of all.
    """
    schema = T.StructType([*records.schema.fields, T.StructField("rank", T.IntegerType())])
    best = Window.partitionBy("target_type", "row", "col").orderBy(F.desc("max_score"), "component")
    few = records.withColumn("_i", F.row_number().over(best)).where("_i = 1").withColumn("_share", F.pmod(F.xxhash64("row", "col"), F.lit(SHARES)))
    for by in (("target_type", "_share"), ("target_type",)):
        first = Window.partitionBy(*by).orderBy(F.desc("max_score"), "component")
        few = few.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= n * (2 * distance - 1) ** 2)
    few = few.drop("_i", "_share")
    return few.groupBy("target_type").applyInPandas(lambda f: _spaced(f.sort_values(["max_score", "component"], ascending=[False, True], kind="stable"), n, distance), schema)


def top_targets(maps: DataFrame, grid: Grid, target_type: str = "generic", n: int = 15, min_prob: float = 0.5, distance: int = 10, tile: int = TILE) -> DataFrame:
    """Ranked target records of one map (row, col, prob, uncertainty)."""
    maps = stored(maps.where("prob is not null"), "maps")
    cells = label_components(hot(maps, min_prob).select("row", "col", "prob", "uncertainty"), grid.nx, tile)
    records = component_stats(cells, grid, target_type, min_prob).where(F.col("max_probability") >= min_prob)
    return suppressed(records, n, distance).select(*COLUMNS)
