"""Grid, scatter and well files as cells and layer rows, points and wells."""

from __future__ import annotations

import json
import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sources import gridfiles

LAYERS = "layer string, format string, crs string, filepath string, nx int, ny int, xmin double, xmax double, ymin double, ymax double, n_points long"
CELLS = gridfiles.CELLS
#: Words of a Surfer ASCII file before its cells.
HEAD_WORDS = 9
#: Fixed values of the formats.
EXTENSIONS = {".grd": "sniff", ".tif": "geotiff", ".tiff": "geotiff", ".ers": "ermapper", ".xyz": "xyz", ".txt": "xyz", ".dat": "xyz", ".csv": "csv"}


def detect_format(path: str, head: bytes = b"") -> str:
    """Format by extension; .grd files by their first four bytes (Geosoft if unknown)."""
    dot = re.search(r"\.[^./]+$", path.lower())
    kind = EXTENSIONS.get(dot[0] if dot else "", "unknown")
    return gridfiles.MAGIC.get(head[:4], "geosoft") if kind == "sniff" else kind


def surfer_ascii(raw: bytes) -> dict:
    return gridfiles.whole(raw, "surfer_ascii")


def geotiff(raw: bytes) -> dict:
    """Band 1 of a TIFF in strips or tiles (plain, deflate, LZW or PackBits, with or without horizontal differences) at pixel
    centres, rows turned to ascend; without geo tags, in pixels. ValueError for another compression."""
    return gridfiles.whole(raw, "geotiff")


def _files(spark: SparkSession, paths: list[str], names: list[str] | None) -> list[tuple[str, str]]:
    """(layer, path) of every file below the paths. Contents aren't read."""
    found = spark.read.format("binaryFile").load(paths).select("path")
    stem = F.coalesce(F.nullif(F.regexp_extract("path", r"/layer=([^/]+)/", 1), F.lit("")), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    if names:
        pairs = [x for p, n in zip(paths, names) for x in (F.lit(re.sub(r"^file:/*", "/", p)), F.lit(n))]
        stem = F.coalesce(F.element_at(F.create_map(*pairs), F.regexp_replace("path", r"^file:/*", "/")), stem)
    return [tuple(r) for r in found.select(stem, "path").collect()]


def _text_cells(spark: SparkSession, heads: list) -> DataFrame:
    """Cells of Surfer ASCII files by Spark's text reader: a task for each split of a file. A value's cell follows from how many
    values the splits and lines before it hold. Fails if a file hasn't as many values as its header says."""
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    known = spark.createDataFrame([(re.sub(r"^file:/*", "/", h.filepath), h.layer, h.nx, h.ny) for h in heads], "file string, layer string, nx int, ny int")
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    lines = spark.read.text([h.filepath for h in heads]).select(plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), words.alias("words"))
    splits = lines.groupBy("file", "split").agg(F.sum(F.size("words")).alias("n"))
    by_file = Window.partitionBy("file")
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(by_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("n").over(by_file).alias("total"))
    before = F.coalesce(F.sum(F.size("words")).over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("before", before).join(F.broadcast(splits.join(known, "file")), ["file", "split"])
    each = placed.select("layer", "nx", "ny", "total", F.posexplode("words").alias("k", "w"), (F.col("below") + F.col("before") - HEAD_WORDS).alias("first"))
    cell, count = F.col("first") + F.col("k"), F.col("nx").cast("long") * F.col("ny")
    value = F.when(F.col("total") == count + HEAD_WORDS, F.col("w").cast("double")).otherwise(F.raise_error(F.format_string("%d values for a grid of %d cells in layer %s", F.col("total") - HEAD_WORDS, count, "layer")).cast("double"))
    rows = each.where(cell >= 0).select("layer", F.floor(cell / F.col("nx")).cast("int").alias("row"), (cell % F.col("nx")).cast("int").alias("col"), value.alias("z"))
    return rows.withColumn("z", F.when(F.abs("z") <= 0.9 * gridfiles.SURFER_BLANK, F.col("z")))


def read_grids(spark: SparkSession, paths: list[str], names: list[str] | None = None, kind: str | None = None, block_cells: int = gridfiles.BLOCK_CELLS) -> tuple[DataFrame, DataFrame]:
    """(cells, layers) of grid files, of one kind or of those that their names and heads tell.

    Headers are read at once (a job that reads no cells; the driver gets a row a file), cells when they are asked for: a
    binary file by blocks of rows of about block_cells cells, a text file by Spark's splits, so a file of any size is
    read by many tasks. Conditions on `row` and `layer` leave blocks of binary files unread. Files below a folder
    layer=NAME, as the writers leave them, are of that layer. ValueError for a format without a reader, OSError or
    ValueError for a header that can't be read. Files must lie where Arrow's file systems can open them.
    """
    gridfiles.register(spark)
    files = []
    for layer, path in _files(spark, paths, names):
        sure = kind or detect_format(path)
        if sure not in gridfiles.HEADERS:
            raise ValueError(f"{path}: no reader for {sure}")
        files.append((layer, path, None if kind is None and path.lower().endswith(".grd") else sure))
    heads = spark.read.format("grid_heads").option("files", json.dumps(files)).load().collect()
    for h in heads:
        if h.error:
            raise (OSError if h.error.startswith("OSError") else ValueError)(f"{h.filepath}: {h.error}")
    layers = spark.createDataFrame([(h.layer, h.format, h.crs, h.filepath, h.nx, h.ny, h.xmin, h.xmax, h.ymin, h.ymax, None) for h in heads], LAYERS)
    plan = [(h.layer, h.filepath, h.format, h.nx, h.ny, h.align) for h in heads if h.format != "surfer_ascii"]
    cells = spark.read.format("grid_cells").option("plan", json.dumps(plan)).option("blockCells", block_cells).load()
    texts = [h for h in heads if h.format == "surfer_ascii"]
    if texts:
        cells = cells.unionByName(_text_cells(spark, texts)) if plan else _text_cells(spark, texts)
    return cells, layers


def find_column(names: list[str], explicit: str | None, candidates: list[str], numeric: list[str] | None = None, at: int = 0) -> str:
    """The explicit name, else the first candidate that equals or is part of a name, else the numeric column at a place."""
    clean = [n.strip().lower() for n in names]
    if explicit:
        if explicit.strip().lower() not in clean:
            raise KeyError(explicit)
        return clean[clean.index(explicit.strip().lower())]
    for c in candidates:
        if c in clean:
            return c
        for n in clean:
            if c in n:
                return n
    if numeric:
        warnings.warn(f"column taken by its place: {numeric[min(at, len(numeric) - 1)]}", stacklevel=2)
        return numeric[min(at, len(numeric) - 1)]
    raise KeyError(candidates[0] if candidates else "column")


#: Names to look for, in order; points first, then wells.
X_NAMES = ["x", "easting", "lon", "longitude", "east", "e"]
Y_NAMES = ["y", "northing", "lat", "latitude", "north", "n"]
Z_NAMES = ["z", "value", "val", "data", "field", "mag", "grav", "res", "ip", "depth", "signal"]
WELL_X_NAMES = ["x", "easting", "lon", "east", "longitude"]
WELL_Y_NAMES = ["y", "northing", "lat", "north", "latitude"]
LABEL_NAMES = ["label", "result", "target", "positive", "hit", "found", "mineralized", "success", "class"]


def _table(spark: SparkSession, path: str, delimiter: str | None, sniff: int) -> DataFrame:
    """A delimited text with a header as strings: tab, else comma, else white space; '#' starts a comment."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(32).collect())[:sniff] if delimiter is None else ""
    sep = delimiter or ("\t" if "\t" in head else "," if "," in head else None)
    if sep:
        df = spark.read.csv(path, sep=sep, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    else:
        lines = spark.read.text(path).where("trim(value) <> '' and not value like '#%'").withColumn("p", F.split(F.trim("value"), r"\s+"))
        names = lines.first()["p"]
        df = lines.where(F.col("p") != F.array(*[F.lit(n) for n in names])).select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return df.toDF(*[c.strip().lower() for c in df.columns]).na.drop("all")


def _numeric(df: DataFrame) -> list[str]:
    row = df.select([F.count(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] > 0]


def read_points(spark: SparkSession, path: str, x: str | None = None, y: str | None = None, z: str | None = None, delimiter: str | None = None, name: str | None = None, least: int = 10) -> DataFrame:
    """layer, x, y, z of a scatter file; rows without three numbers are dropped; ValueError with fewer than ten left."""
    df = _table(spark, path, delimiter, 1024)
    numeric = _numeric(df)
    cols = [find_column(df.columns, e, c, numeric, k) for k, (e, c) in enumerate(((x, X_NAMES), (y, Y_NAMES), (z, Z_NAMES)))]
    out = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(k) for c, k in zip(cols, "xyz")]).na.drop()
    if out.limit(least).count() < least:
        raise ValueError(f"{path}: fewer than {least} points")
    return out.select(F.lit(name or re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])).alias("layer"), "x", "y", "z")


def read_wells(spark: SparkSession, path: str, x: str | None = None, y: str | None = None, label: str | None = None, target_type: str | None = None, delimiter: str | None = None) -> DataFrame:
    """x, y, label and those of target_type, depth and notes that the file has; ValueError for labels other than 0 and 1."""
    df = _table(spark, path, delimiter, 512)
    numeric = _numeric(df)
    xc, yc, lc = find_column(df.columns, x, WELL_X_NAMES, numeric, 0), find_column(df.columns, y, WELL_Y_NAMES, numeric, 1), find_column(df.columns, label, LABEL_NAMES)
    cast = lambda c, k: F.expr(f"try_cast(`{c}` as double)").alias(k)
    more = [cast("depth", "depth")] if "depth" in df.columns else []
    more += [F.col(c) for c in ((target_type or "target_type").lower(), "notes") if c in df.columns]
    out = df.select(cast(xc, "x"), cast(yc, "y"), cast(lc, "label"), *more).na.drop(subset=["x", "y", "label"])
    wrong = [r.label for r in out.where(~F.col("label").isin(0.0, 1.0)).select("label").limit(5).collect()]
    if wrong:
        raise ValueError(f"labels must be 0 or 1; found {wrong}")
    return out.withColumn("label", F.col("label").cast("int"))


def load_layer(spark: SparkSession, path: str, name: str | None = None, nx: int = 200, ny: int = 200, method: str = "linear", sigma: float = 0.5, **how) -> tuple[DataFrame, DataFrame]:
    """(cells, layers) of any file that has a reader; scatter files are gridded. Warns if over half is missing."""
    from strata.operators.grid import gridded, missing_report

    kind = detect_format(path, b"")
    if kind in ("xyz", "csv"):
        points = read_points(spark, path, name=name, **how)
        cells = gridded(points, nx, ny, method, sigma)
        layers = points.groupBy("layer").agg(F.lit(kind).alias("format"), F.lit(None).cast("string").alias("crs"), F.lit(path).alias("filepath"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count("*").alias("n_points"))
    else:
        cells, layers = read_grids(spark, [path], [name] if name else None)
    for r in missing_report(cells).where("missing_share > 0.5").collect():
        warnings.warn(f"layer {r.layer}: {r.missing_share:.0%} missing", stacklevel=2)
    return cells, layers


def array_layer(spark: SparkSession, grid, x, y, name: str) -> tuple[DataFrame, DataFrame]:
    """(cells, layers) of a 2-D array with its axes; NaN is missing."""
    z = np.asarray(grid, float)
    ny, nx = z.shape
    frame = pd.DataFrame({"layer": name, "row": np.repeat(np.arange(ny), nx), "col": np.tile(np.arange(nx), ny), "z": z.ravel()})
    cells = spark.createDataFrame(frame, CELLS).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    row = (name, "array", None, None, nx, ny, float(np.min(x)), float(np.max(x)), float(np.min(y)), float(np.max(y)), None)
    return cells, spark.createDataFrame([row], LAYERS)
