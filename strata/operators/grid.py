"""Common grid, resampling, point lookup and filling of missing cells.

layers: layer, xmin, xmax, ymin, ymax, nx, ny, one row each. cells: layer, row, col, z. Axes are even from min to max.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators.scatter import _interpolated, gridded, patch, slopes, triangulate  # noqa: F401
from strata.operators.stencil import _let

MOST = 2000


class Grid(NamedTuple):
    """The grid that all layers are brought to; x(col) = xmin + col * dx."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    nx: int
    ny: int

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / (self.nx - 1) if self.nx > 1 else 1.0

    @property
    def dy(self) -> float:
        return (self.ymax - self.ymin) / (self.ny - 1) if self.ny > 1 else 1.0

    def frame(self, spark: SparkSession) -> DataFrame:
        """row, col, x, y of every cell."""
        cells = spark.range(self.nx * self.ny).select(F.expr(f"cast(id div {self.nx} as int)").alias("row"), (F.col("id") % self.nx).cast("int").alias("col"))
        return cells.select("row", "col", (F.lit(self.xmin) + F.col("col") * self.dx).alias("x"), (F.lit(self.ymin) + F.col("row") * self.dy).alias("y"))


def extent(layers: DataFrame, how: str = "intersection") -> DataFrame:
    """One row: the layers' common extent ("intersection") or joint one ("union"), and their largest nx and ny."""
    low, high = (F.max, F.min) if how == "intersection" else (F.min, F.max)
    return layers.agg(low("xmin").alias("xmin"), high("xmax").alias("xmax"), low("ymin").alias("ymin"), high("ymax").alias("ymax"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))


def common_grid(layers: DataFrame, nx: int | None = None, ny: int | None = None, how: str = "intersection", most: int = MOST) -> Grid:
    """ValueError if the extent is empty; sizes over `most` are cut to it with a warning."""
    e = extent(layers, how).first()
    if e.xmin is None or e.xmin >= e.xmax or e.ymin >= e.ymax:
        raise ValueError("the layers have no common extent")
    nx, ny = nx or e.nx, ny or e.ny
    if max(nx, ny) > most:
        warnings.warn(f"a grid of {nx} x {ny} cells is cut to {most} a side", stacklevel=2)
        nx, ny = min(nx, most), min(ny, most)
    return Grid(float(e.xmin), float(e.xmax), float(e.ymin), float(e.ymax), int(nx), int(ny))


def _source_axis(at, low, high, n):
    """(index below, share of the next) of a coordinate kept inside the axis; the last node belongs to the last interval."""
    t = (F.least(F.greatest(at, low), high) - low) / ((high - low) / (n - 1))
    i = F.greatest(F.lit(0), F.least(F.floor(t).cast("int"), n - 2))
    return F.when(n == 1, 0).otherwise(i), F.when(n == 1, 0.0).otherwise(t - i)


def resample(cells: DataFrame, layers: DataFrame, grid: Grid, method: str = "linear") -> DataFrame:
    """layer, row, col, z on the grid, bilinear or nearest, by an equi-join on indices of cells (nearest) or of whole lines.

    Coordinates outside a layer are taken at its edge. Missing source cells should be filled first; a cell that meets one
    is missing.
    """
    spec = F.broadcast(layers.select("layer", "xmin", "xmax", "ymin", "ymax", "nx", "ny"))
    wanted = grid.frame(cells.sparkSession).crossJoin(spec)  # layers are few: one row each
    (i, ti), (j, tj) = _source_axis(F.col("y"), F.col("ymin"), F.col("ymax"), F.col("ny")), _source_axis(F.col("x"), F.col("xmin"), F.col("xmax"), F.col("nx"))
    wanted = wanted.select("layer", F.col("row").alias("r"), F.col("col").alias("c"), i.alias("i"), ti.alias("ti"), j.alias("j"), tj.alias("tj"))
    if method == "nearest":
        # A point half way between two nodes takes the lower one.
        wanted = wanted.select("layer", "r", "c", (F.col("i") + (F.col("ti") > 0.5).cast("int")).alias("row"), (F.col("j") + (F.col("tj") > 0.5).cast("int")).alias("col"))
        return wanted.join(cells, ["layer", "row", "col"], "left").select("layer", F.col("r").alias("row"), F.col("c").alias("col"), "z")
    # Lines meet, not cells: a line of the grid lies between two of the layer, each an array by column.
    line = F.array_sort(F.collect_list(F.struct("col", "z")))
    lines = cells.groupBy("layer", "row").agg(line.alias("l")).join(spec.select("layer", "nx"), "layer")
    # Cells that aren't there are missing; a full line is read by place.
    whole = F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda c: F.get(F.filter("l", lambda p: p["col"] == c), F.lit(0))["z"])
    lines = lines.select("layer", "row", F.when(F.size("l") == F.col("nx"), F.transform("l", lambda p: p["z"])).otherwise(whole).alias("zs"))
    down = wanted.groupBy("layer", "r", "i", "ti").agg(F.array_sort(F.collect_list(F.struct("c", "j", "tj"))).alias("to"))
    parts = F.array(F.struct(F.col("i").alias("row"), (1 - F.col("ti")).alias("w")), F.struct((F.col("i") + 1).alias("row"), F.col("ti").alias("w")))
    down = down.withColumn("part", F.explode(F.filter(parts, lambda p: p["w"] > 0))).select("layer", "r", "to", "part.*").join(lines, ["layer", "row"], "left")
    term = lambda w, z: F.when(w > 0, w * z).otherwise(0.0)
    across = F.transform("to", lambda t: F.col("w") * (term(1 - t["tj"], F.get("zs", t["j"])) + term(t["tj"], F.get("zs", t["j"] + 1))))
    found = down.groupBy("layer", "r").agg(F.first("to").alias("to"), F.collect_list(F.struct(across.alias("a"))).alias("rows"))
    sums = F.zip_with("to", F.when(F.size("rows") == 1, F.col("rows")[0]["a"]).otherwise(F.zip_with(F.col("rows")[0]["a"], F.col("rows")[1]["a"], lambda x, y: x + y)), lambda t, z: F.struct(t["c"].alias("col"), z.alias("z")))
    return found.select("layer", F.col("r").alias("row"), F.explode(sums).alias("x")).select("layer", "row", "x.col", "x.z")


def locate(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """points with row, col and inside: the first node not below the coordinate, kept on the grid; a point on a node gets it."""

    def index(at, low, step, n):
        near = F.ceil((at - low) / step).cast("int")
        # Rounding may put a node's own coordinate just above it.
        near = F.when(F.lit(low) + (near - 1) * step >= at, near - 1).otherwise(near)
        return F.greatest(F.lit(0), F.least(near, F.lit(n - 1)))

    inside = F.col(x).between(grid.xmin, grid.xmax) & F.col(y).between(grid.ymin, grid.ymax)
    return points.withColumns({"row": index(F.col(y), grid.ymin, grid.dy, grid.ny), "col": index(F.col(x), grid.xmin, grid.dx, grid.nx), "inside": inside})


def _lowest(line, gaps, whole):
    """For each gap of a line (places in it) the place whose column holds the nearest value.

    The places found never go back along the line, so the gap in the middle bounds those of both sides: all gaps of a level,
    every other of the next finer spacing, look at the line once together, and the levels are the logarithm of the gaps.
    """
    n, m = F.size(line), F.size(gaps)

    def nearest(gap, low, high):
        me = F.get(line, gap)
        # The own column's value is so far away; where no column is left out, no farther place can be nearer.
        reach = F.when(whole, F.ceil(F.sqrt(me["best"]["d"])).cast("int"))
        low, high = F.greatest(low, gap - reach), F.least(high, gap + reach)
        away = lambda x: F.coalesce(x["best"]["d"] + (x["col"] - me["col"]).cast("long") * (x["col"] - me["col"]), F.lit((1 << 63) - 1))
        return F.array_min(F.transform(F.slice(line, low + 1, high - low + 1), lambda x, i: F.struct(away(x).alias("d"), x["best"]["r"].alias("r"), (low + i).alias("j"))))["j"]

    def finer(found, level):
        step = F.pow(F.lit(2.0), level).cast("int")

        def one(u):
            before = F.floor((u - 1) / 2).cast("int")  # gaps of the coarser level before this one
            known = F.get(found, (u / 2).cast("int") - 1)
            return F.when(u % 2 == 0, known).otherwise(nearest(F.get(gaps, u * step - 1), F.coalesce(F.get(found, before - 1), F.lit(0)), F.coalesce(F.get(found, before), n - 1)))

        return F.transform(F.sequence(F.lit(1), F.floor(m / step).cast("int")), one)

    top = F.floor(F.log2(m.cast("double"))).cast("int")
    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.array().cast("array<int>"), finer)


def fill_nearest(cells: DataFrame) -> DataFrame:
    """cells with each missing z replaced by the nearest present one of its layer in index space; ties go to the smaller
    row, then column. A layer without values stays as it is. A column has a cell in each of its layer's rows, or in none.

    Each cell first finds the nearest value in its column; squared distances to those of a row's columns are parabolas along
    the row, whose lower envelope is followed in near linear time however wide the gaps.
    """
    line = Window.partitionBy("layer", "col").orderBy("row")
    here = F.when(F.col("z").isNotNull(), F.struct(F.col("row").alias("r"), F.col("z").alias("v")))
    seen = cells.select("layer", "row", "col", "z").withColumns({"_up": F.last(here, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_down": F.first(here, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    away = lambda side: F.when(F.col(side).isNotNull(), F.struct(((F.col(side)["r"] - F.col("row")).cast("long") * (F.col(side)["r"] - F.col("row"))).alias("d"), F.col(side)["r"].alias("r"), F.col(side)["v"].alias("v")))
    seen = seen.select("layer", "row", "col", "z", F.array_min(F.array(away("_up"), away("_down"))).alias("best"))
    rows = seen.groupBy("layer", "row").agg(F.array_sort(F.collect_list(F.struct("col", "z", "best"))).alias("l"))
    l = F.col("l")  # noqa: E741
    whole = F.size(l) == F.element_at(l, -1)["col"] - F.element_at(l, 1)["col"] + 1
    gaps = F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: F.get(l, i)["z"].isNull())
    there = F.transform(F.filter(l, lambda p: p["z"].isNotNull()), lambda p: F.struct(p["col"].alias("col"), p["z"].alias("z")))
    filled = lambda q: _let(_lowest(l, q, whole), lambda found: F.transform(q, lambda g, i: F.struct(F.get(l, g)["col"].alias("col"), F.get(l, F.get(found, i))["best"]["v"].alias("z"))))
    all_ = _let(gaps, lambda q: F.when(F.size(q) == 0, there).otherwise(F.concat(there, filled(q))))
    return rows.select("layer", "row", F.explode(all_).alias("x")).select("layer", "row", "x.col", "x.z")


def missing_report(cells: DataFrame) -> DataFrame:
    """layer, n_cells, n_missing, missing_share."""
    n = F.count_if(F.col("z").isNull())
    return cells.groupBy("layer").agg(F.count("*").alias("n_cells"), n.alias("n_missing"), (n / F.count("*")).alias("missing_share"))


def registered(cells: DataFrame, layers: DataFrame, grid: Grid, method: str = "linear") -> DataFrame:
    """Fills and resamples every layer; a layer without any value is left out with a warning, as it would void all samples."""
    empty = [r.layer for r in missing_report(cells).where("n_missing = n_cells").collect()]
    for name in empty:
        warnings.warn(f"layer {name} has no values and is left out", stacklevel=2)
    if empty:
        cells, layers = cells.where(~F.col("layer").isin(empty)), layers.where(~F.col("layer").isin(empty))
    return resample(fill_nearest(cells), layers, grid, method)
