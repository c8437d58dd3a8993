"""Writers of grids, points and reports: Spark's writers for texts and tables, a task a file for binary grids."""

from __future__ import annotations

import struct
import warnings
from datetime import datetime

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sources import gridfiles

REPORT = ("rank", "x", "y", "max_probability", "mean_probability", "max_score", "mean_uncertainty", "area_km2", "n_pixels", "target_type")
BLANK = "1.70141e+38"


def target_table(targets: DataFrame) -> DataFrame:
    """The report's ten columns."""
    return targets.select(*REPORT)


def combined_targets(tables: list[DataFrame]) -> DataFrame:
    """All types' targets as one table, ranked anew in the order of the tables and of their ranks."""
    both = None
    for k, t in enumerate(tables):
        part = target_table(t).withColumn("_k", F.lit(k))
        both = part if both is None else both.unionByName(part)
    return both.withColumn("rank", F.row_number().over(Window.orderBy("_k", "rank"))).drop("_k")


def write_targets(tables: list[DataFrame], path: str) -> bool:
    """CSV with four decimals; nothing is written without a target."""
    if not tables:
        return False
    out = combined_targets(tables)
    if out.isEmpty():
        return False
    texts = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
    out.orderBy("rank").select(*texts).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def report_lines(targets: DataFrame, metrics: list[dict], target_type: str) -> list[str]:
    """The text report of one type; target tables hold a few rows."""
    lines = [f"== {target_type} =="]
    found = target_table(targets).orderBy("rank").collect()
    lines += [f"{r['rank']:>3}  {r.x:12.1f} {r.y:12.1f}  p={r.max_probability:.4f} score={r.max_score:.4f} area={r.area_km2:.4f} km2" for r in found] or ["no targets"]
    return lines + [f"{m['model']}: " + ", ".join(f"{k}={v:.4f}" for k, v in m.items() if isinstance(v, float)) for m in metrics]


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def surfer_lines(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """layer, line_no, value: the lines of a Surfer ASCII file of each layer, missing cells blanked."""
    z = F.coalesce(F.format_string("%.4f", "z"), F.lit(BLANK))
    z = F.when(F.col("z").isNull(), BLANK).otherwise(z)
    body = cells.groupBy("layer", "row").agg(F.array_sort(F.collect_list(F.struct("col", z.alias("t")))).alias("l")).select("layer", (F.col("row") + 5).alias("line_no"), F.concat_ws(" ", F.transform("l", lambda p: p["t"])).alias("value"))
    ranges = cells.groupBy("layer").agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("zmin"), F.coalesce(F.max("z"), F.lit(0.0)).alias("zmax")).join(layers, "layer")
    pair = lambda a, b: F.format_string("%.6f %.6f", a, b)
    head = F.array(F.lit("DSAA"), F.format_string("%d %d", "nx", "ny"), pair("xmin", "xmax"), pair("ymin", "ymax"), pair("zmin", "zmax"))
    return ranges.select("layer", F.posexplode(head).alias("line_no", "value")).unionByName(body)


def write_surfer(cells: DataFrame, layers: DataFrame, path: str) -> None:
    """A folder per layer below path, each with one text file."""
    surfer_lines(cells, layers).repartition("layer").sortWithinPartitions("layer", "line_no").select("layer", "value").write.mode("overwrite").partitionBy("layer").text(path)


def _binary_head(kind: str, r) -> tuple[bytes, bytes]:
    """What stands before and after the cells of a file. r: the layer's row with zmin and zmax."""
    box = (r.xmin, r.xmax, r.ymin, r.ymax)
    if kind == "surfer_binary":
        if max(r.nx, r.ny) > 65535:
            raise ValueError(f"a Surfer 6 grid has at most 65535 lines; {r.layer} is {r.nx} x {r.ny}")
        return b"DSBB" + struct.pack("<HH6d", r.nx, r.ny, *box, r.zmin, r.zmax), b""
    if kind == "surfer7":
        return b"DSRB" + struct.pack("<5I8d", 1, 72, 1, r.nx, r.ny, r.xmin, r.ymin, r.xmax, r.ymax, r.zmin, r.zmax, 0, gridfiles.SURFER_BLANK) + struct.pack("<2I", 2, min(8 * r.nx * r.ny, 2**32 - 1)), b""
    dx, dy = (r.xmax - r.xmin) / max(r.nx - 1, 1) or 1.0, (r.ymax - r.ymin) / max(r.ny - 1, 1) or 1.0
    if kind == "geosoft":
        head = bytearray(512)
        struct.pack_into("<ii", head, 4, r.nx, r.ny)
        struct.pack_into("<4d", head, 16, r.xmin, r.ymin, dx, dy)
        return bytes(head), b""
    size, blank = 8 * r.nx * r.ny, b"-1e+300\0"
    if size > 2**32 - 4096:
        raise ValueError(f"a TIFF has at most 4 GB; {r.layer} is {r.nx} x {r.ny}")
    tags = [(256, "I", (r.nx,)), (257, "I", (r.ny,)), (258, "H", (64,)), (259, "H", (1,)), (273, "I", (8,)), (277, "H", (1,)), (278, "I", (r.ny,)), (279, "I", (size,)), (339, "H", (3,))]
    tags += [(33550, "d", (dx, dy, 0.0)), (33922, "d", (0.0, 0.0, 0.0, r.xmin - dx / 2, r.ymax + dy / 2, 0.0)), (42113, "s", (blank,))]
    start, entries, extra = 8 + size + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in tags:
        raw = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", start + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack("<HHI", tag, {"s": 2, "H": 3, "I": 4, "d": 12}[code], len(raw) if code == "s" else len(values)) + where
    return b"II" + struct.pack("<HI", 42, 8 + size), struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


#: Cell types, and what a missing cell is written as, by format.
BINARY = {"surfer_binary": ("<f4", gridfiles.SURFER_BLANK), "surfer7": ("<f8", gridfiles.SURFER_BLANK), "geosoft": ("<f4", gridfiles.GEOSOFT_DUMMY), "geotiff": ("<f8", -1e300)}


def _written(kind: str, path: str, heads: dict, suffix: str):
    """mapInPandas: cells by layer and place -> the files written, cell by cell as they come."""
    dtype, blank = BINARY[kind]

    def run(frames):
        system, folder = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        out = layer = None
        at = 0

        def close():
            out.write(np.full(heads[layer][2] - at, blank, dtype).tobytes() + heads[layer][1])
            out.close()

        for frame in frames:
            for name, part in frame.groupby("layer", sort=False):
                if name != layer:
                    if out:
                        close()
                    system.create_dir(f"{folder}/layer={name}", recursive=True)
                    out, layer, at = system.open_output_stream(f"{folder}/layer={name}/{name}{suffix}"), name, 0
                    out.write(heads[name][0])
                place = part["place"].to_numpy()
                cells = np.full(place[-1] + 1 - at, blank, dtype)
                cells[place - at] = part["z"].fillna(blank).to_numpy(float)
                out.write(cells.tobytes())
                at = int(place[-1]) + 1
                yield pd.DataFrame({"layer": [name]})
        if out:
            close()

    return run


def write_binary(cells: DataFrame, layers: DataFrame, path: str, kind: str) -> None:
    """A Surfer 6, Surfer 7, Geosoft or GeoTIFF file of each layer, in a folder layer=NAME below path.

    A task writes a layer's file as its sorted cells stream by, so a layer is never held whole. Cells that are null or
    absent are blank; layers without a cell aren't written. The driver gets a row a layer.
    """
    suffix = ".tif" if kind == "geotiff" else ".grd"
    ranges = cells.groupBy("layer").agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("zmin"), F.coalesce(F.max("z"), F.lit(0.0)).alias("zmax")).join(layers, "layer")
    heads = {r.layer: (*_binary_head(kind, r), r.nx * r.ny) for r in ranges.select("layer", "nx", "ny", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax").collect()}
    line = F.col("ny") - 1 - F.col("row") if kind == "geotiff" else F.col("row")
    rows = cells.join(F.broadcast(layers.select("layer", "nx", "ny")), "layer").select("layer", (line.cast("long") * F.col("nx") + F.col("col")).alias("place"), "z")
    rows.repartition("layer").sortWithinPartitions("layer", "place").mapInPandas(_written(kind, path, heads, suffix), "layer string").write.format("noop").mode("overwrite").save()


def write_points(cells: DataFrame, layers: DataFrame, path: str, sep: str = "\t", names=("X", "Y", "Z")) -> None:
    """Present cells as x, y, z with four decimals (sep "," and names X, Y, value for CSV), a folder per layer."""
    step = lambda lo, hi, n: F.when(F.col(n) > 1, (F.col(hi) - F.col(lo)) / (F.col(n) - 1)).otherwise(0.0)
    rows = cells.where("z is not null").join(F.broadcast(layers), "layer")
    x, y = F.col("xmin") + F.col("col") * step("xmin", "xmax", "nx"), F.col("ymin") + F.col("row") * step("ymin", "ymax", "ny")
    texts = [F.format_string("%.4f", v).alias(n) for v, n in zip((x, y, F.col("z")), names)]
    rows.select("layer", *texts).write.mode("overwrite").partitionBy("layer").option("sep", sep).option("header", True).csv(path)


def write_wells(wells: DataFrame, path: str) -> None:
    texts = [F.format_string("%.1f", c).alias(c.upper()) if t == "double" else F.col(c).alias(c.upper()) for c, t in wells.dtypes]
    wells.select(*texts).coalesce(1).write.mode("overwrite").csv(path, header=True)


def stamped(name: str, when: datetime | None = None) -> str:
    """name with date and minute, as reports are called."""
    return f"{name}_{when or datetime.now():%Y%m%d_%H%M}"


#: Formats that a survey is saved in.
FORMATS = ("surfer_grd", "xyz", "csv")


def save_survey(cells: DataFrame, layers: DataFrame, wells: DataFrame, folder: str, formats: list[str] | None = None, target_type: str = "generic", scenario: str = "survey") -> list[str]:
    """Writes the layers in each different format asked for (Surfer and xyz if none is), and the wells, with target_type and
    scenario added where they lack them. Unknown formats are skipped with a warning. Returns the folders written."""
    asked = list(dict.fromkeys(formats or FORMATS[:2]))
    if unknown := [f for f in asked if f not in FORMATS]:
        warnings.warn(f"formats {unknown} are skipped; there are {list(FORMATS)}", stacklevel=2)
    saved = []
    for f in asked:
        if f == "surfer_grd":
            write_surfer(cells, layers, f"{folder}/{f}")
        elif f == "xyz":
            write_points(cells, layers, f"{folder}/{f}")
        elif f == "csv":
            write_points(cells, layers, f"{folder}/{f}", ",", ("X", "Y", "value"))
        else:
            continue
        saved.append(f"{folder}/{f}")
    for c, v in (("target_type", target_type), ("scenario", scenario)):
        wells = wells if c in wells.columns else wells.withColumn(c, F.lit(v))
    write_wells(wells, f"{folder}/wells")
    return [*saved, f"{folder}/wells"]
