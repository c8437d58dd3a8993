"""Grid files by header and by blocks of rows, as a data source of Spark: a task reads the bytes of its block alone."""

from __future__ import annotations

import json
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

CELLS = "layer string, row int, col int, z double"
HEADS = "layer string, format string, crs string, filepath string, nx int, ny int, xmin double, xmax double, ymin double, ymax double, align int, error string"
#: Fixed values of the formats.
SURFER_BLANK, GEOSOFT_BLANK, GEOSOFT_DUMMY, MOST_LINES = 1.70141e38, -5e31, -1e32, 100_000
#: Cells of a block, about; blocks end where a strip or a row of tiles does.
BLOCK_CELLS = 1 << 21
#: Bytes that hold the header of a text grid.
HEAD_BYTES = 4096


class Head(NamedTuple):
    """What a file's header tells. align: rows that are read together at least. at, kind: place and type of plain cells."""

    format: str
    nx: int
    ny: int
    x: tuple[float, float]
    y: tuple[float, float]
    crs: str | None = None
    align: int = 1
    at: int = 0
    kind: str = ""
    blank: float | None = None
    flip: bool = False
    tags: dict | None = None
    end: str = "<"


def opened(path: str) -> pa.NativeFile:
    """A file for reading at places, by URI or local path."""
    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path if not path.startswith("file:") else "file:///" + path[5:].lstrip("/").replace(" ", "%20"))
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


def _surfer_ascii(f: pa.NativeFile) -> Head:
    words = f.read_at(min(HEAD_BYTES, f.size()), 0).decode("ascii", "replace").split()
    if words[:1] != ["DSAA"]:
        raise ValueError("not a Surfer ASCII grid")
    a, b, c, d = map(float, words[3:7])
    return Head("surfer_ascii", int(words[1]), int(words[2]), (a, b), (c, d))


def _surfer_binary(f: pa.NativeFile) -> Head:
    tag, nx, ny, xlo, xhi, ylo, yhi, _, _ = struct.unpack("<4sHH6d", f.read_at(56, 0))
    if tag != b"DSBB":
        raise ValueError("not a Surfer 6 grid")
    return Head("surfer_binary", nx, ny, (xlo, xhi), (ylo, yhi), at=56, kind="<f4")


def _surfer7(f: pa.NativeFile) -> Head:
    tag, _, _, _, nx, ny, xlo, ylo, xhi, yhi, _, _, _, blank = struct.unpack("<4s5I8d", f.read_at(88, 0))
    if tag != b"DSRB":
        raise ValueError("not a Surfer 7 grid")
    return Head("surfer7", nx, ny, (xlo, xhi), (ylo, yhi), at=96, kind="<f8", blank=blank)


def _geosoft(f: pa.NativeFile) -> Head:
    raw = f.read_at(min(512, f.size()), 0)
    try:
        nx, ny = struct.unpack_from("<ii", raw, 4)
        x0, y0, dx, dy = struct.unpack_from("<4d", raw, 16)
        if not (0 < nx <= MOST_LINES and 0 < ny <= MOST_LINES):
            raise ValueError(f"a size of {nx} x {ny}")
        if f.size() < 512 + 4 * nx * ny:
            raise ValueError(f"{f.size()} bytes for {nx} x {ny} cells")
    except (struct.error, ValueError) as e:
        raise OSError(f"not a readable Geosoft grid: {e}") from e
    return Head("geosoft", nx, ny, (x0, x0 + dx * (nx - 1)), (y0, y0 + dy * (ny - 1)), at=512, kind="<f4")


def _unpacked_bits(raw: bytes) -> bytes:
    """PackBits: runs of a byte, or bytes as they are."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 if raw[at] > 127 else raw[at]
        if n >= 0:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > -128:
                out += raw[at + 1 : at + 2] * (1 - n)
            at += 2 if n > -128 else 1
    return bytes(out)


def _unpacked_lzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, widths one code early; 256 clears, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


#: Compression codes of TIFF.
_UNPACK = {1: bytes, 5: _unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}
_TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _geotiff(f: pa.NativeFile) -> Head:
    """Band 1 of a TIFF at pixel centres, rows turned to ascend; without geo tags, in pixels. Reads the tags alone."""
    raw = f.read_at(8, 0)
    end = "<" if raw[:2] == b"II" else ">"
    if raw[:2] not in (b"II", b"MM") or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(end + "I", raw, 4)[0]
    count = struct.unpack(end + "H", f.read_at(2, at))[0]
    entries, tags = f.read_at(12 * count, at + 2), {}
    for k in range(count):
        tag, kind, n, where = struct.unpack_from(end + "HHII", entries, 12 * k)
        if code := _TIFF_TYPES.get(kind):
            size = struct.calcsize(code) * n
            value = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else f.read_at(size, where)
            tags[tag] = value if code == "s" else struct.unpack(f"{end}{n}{code}", value)
    one = lambda t, d: tags.get(t, (d,))[0]
    if one(259, 1) not in _UNPACK:
        raise ValueError(f"TIFFs of compression {one(259, 1)} are not read")
    if one(317, 1) not in (1, 2):
        raise ValueError(f"TIFFs of predictor {one(317, 1)} are not read")
    nx, ny = one(256, 0), one(257, 0)
    align = one(323, ny) if 324 in tags else min(ny, one(278, ny))
    if 324 not in tags and one(259, 1) == 1 and one(317, 1) == 1:
        align = 1  # rows of a plain strip can be read by themselves
    kind = f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 1) // 8}"
    head = Head("geotiff", nx, ny, (0.0, nx - 1.0), (0.0, ny - 1.0), "pixel", max(1, align), 0, kind, float(tags[42113].rstrip(b"\0")) if 42113 in tags else None, False, tags, end)
    if 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y, _) = tags[33550][:2], tags[33922][:6]
        left, top = x + (0.5 - i) * sx, y - (0.5 - j) * sy
        crs = f"geokeys:{','.join(map(str, tags[34735]))}" if 34735 in tags else None
        return head._replace(x=(left, left + (nx - 1) * sx), y=(top - (ny - 1) * sy, top), crs=crs, flip=True)
    return head


#: What .grd files begin with; others are Geosoft's.
MAGIC = {b"DSAA": "surfer_ascii", b"DSBB": "surfer_binary", b"DSRB": "surfer7"}
HEADERS = {"surfer_ascii": _surfer_ascii, "surfer_binary": _surfer_binary, "surfer7": _surfer7, "geosoft": _geosoft, "geotiff": _geotiff}


def _tiff_rows(f: pa.NativeFile, head: Head, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi, from the top, of band 1: only the strips or tiles that hold them are read."""
    tags = head.tags
    one = lambda t, d: tags.get(t, (d,))[0]
    bands, tiled = one(277, 1) if one(284, 1) == 1 else 1, 324 in tags  # in separate planes the first band's parts come first
    w, h = (one(322, head.nx), one(323, head.ny)) if tiled else (head.nx, min(head.ny, one(278, head.ny)))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    z, across, size = np.full((hi - lo, head.nx), np.nan), -(-head.nx // w), np.dtype(head.kind).itemsize * w * bands
    for k in range(lo // h * across, min(len(starts), -(-hi // h) * across)):
        top, left = k // across * h, k % across * w
        rows = h if tiled else min(h, head.ny - top)
        first, last = max(lo, top), min(hi, top + rows, head.ny)
        if head.align == 1 and not tiled:
            part, skip, rows = f.read_at((last - first) * size, starts[k] + (first - top) * size), 0, last - first
        else:
            part, skip = _UNPACK[one(259, 1)](f.read_at(sizes[k], starts[k])), first - top
        cells = np.frombuffer(part, head.kind, rows * w * bands).reshape(rows, w, bands)
        if one(317, 1) == 2:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype.newbyteorder("="))
        z[first - lo : last - lo, left : left + w] = cells[skip : skip + last - first, : head.nx - left, 0]
    return z


def rows_of(f: pa.NativeFile, head: Head, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi (counted from ymin) as doubles, missing cells as NaN. For any format but text."""
    if head.format == "geotiff":
        z = _tiff_rows(f, head, head.ny - hi, head.ny - lo)[::-1] if head.flip else _tiff_rows(f, head, lo, hi)
        return z if head.blank is None else np.where(z == head.blank, np.nan, z)
    size = np.dtype(head.kind).itemsize * head.nx
    z = np.frombuffer(f.read_at((hi - lo) * size, head.at + lo * size), head.kind, (hi - lo) * head.nx).astype(float).reshape(hi - lo, head.nx)
    missing = {"surfer_binary": np.abs(z) > 0.9 * SURFER_BLANK, "geosoft": z < GEOSOFT_BLANK}.get(head.format)
    return np.where(z >= 0.99 * head.blank if missing is None else missing, np.nan, z)


def whole(raw: bytes, kind: str) -> dict:
    """A grid in memory: z and what its header tells. ValueError or OSError if it can't be read."""
    f = pa.BufferReader(raw)
    head = HEADERS[kind](f)
    if kind == "surfer_ascii":
        z = np.array(raw.decode("ascii", "replace").split()[9:], float)
        if z.size != head.nx * head.ny:
            raise ValueError(f"{z.size} values for a grid of {head.nx} x {head.ny}")
        z[np.abs(z) > 0.9 * SURFER_BLANK] = np.nan
        z = z.reshape(head.ny, head.nx)
    else:
        z = rows_of(f, head, 0, head.ny)
    return {"z": z, "xmin": float(head.x[0]), "xmax": float(head.x[1]), "ymin": float(head.y[0]), "ymax": float(head.y[1]), "format": kind, "crs": head.crs}


class Block(ds.InputPartition):
    def __init__(self, layer: str, path: str, kind: str, lo: int, hi: int):
        self.layer, self.path, self.kind, self.lo, self.hi = layer, path, kind, lo, hi


class _Heads(ds.DataSourceReader):
    """A row for each file of the option `files` (JSON of layer, path, kind; null to tell it by the head), read from its first bytes."""

    def __init__(self, options):
        self.files, self.each = json.loads(options["files"]), max(1, int(options.get("filesPerTask", "64")))

    def partitions(self):
        return [ds.InputPartition(self.files[i : i + self.each]) for i in range(0, len(self.files), self.each)]

    def read(self, partition):
        for layer, path, kind in partition.value:
            try:
                with opened(path) as f:
                    kind = kind or MAGIC.get(f.read_at(min(4, f.size()), 0), "geosoft")
                    h = HEADERS[kind](f)
                yield layer, kind, h.crs, path, h.nx, h.ny, *map(float, (*h.x, *h.y)), h.align, None
            except (OSError, ValueError, struct.error) as e:
                yield layer, kind, None, path, 0, 0, 0.0, 0.0, 0.0, 0.0, 1, f"{type(e).__name__}: {e}"


class _Cells(ds.DataSourceReader):
    """Cells of the grids of the option `plan` (JSON of layer, path, kind, nx, ny, align), in blocks of rows."""

    def __init__(self, options):
        self.plan, self.cells = json.loads(options["plan"]), int(options.get("blockCells", BLOCK_CELLS))
        self.least, self.most, self.layers = 0, None, None

    def pushFilters(self, filters):
        """Bounds on `row` and choices of `layer` leave blocks out; Spark applies all filters to what is read."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "row" and isinstance(value, int):
                if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, ds.GreaterThan))
                if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                    most = value - isinstance(f, ds.LessThan)
                    self.most = most if self.most is None else min(self.most, most)
            elif name == "layer" and isinstance(f, (ds.EqualTo, ds.In)):
                named = {value} if isinstance(f, ds.EqualTo) else set(value)
                self.layers = named if self.layers is None else self.layers & named
            yield f

    def partitions(self):
        out = []
        for layer, path, kind, nx, ny, align in self.plan:
            if self.layers is not None and layer not in self.layers:
                continue
            step = max(align, self.cells // max(nx, 1) // align * align)
            # Blocks follow the file's strips from the top; ends are counted from ymin by the reader.
            for lo in range(0, ny, step):
                hi = min(ny, lo + step)
                a, b = (ny - hi, ny - lo) if kind == "geotiff" and align > 1 else (lo, hi)
                if b > self.least and (self.most is None or a <= self.most):
                    out.append(Block(layer, path, kind, a, b))
        return out or [Block("", "", "", 0, 0)]

    def read(self, partition):
        p = partition
        if p.hi <= p.lo:
            return
        with opened(p.path) as f:
            z = rows_of(f, HEADERS[p.kind](f), p.lo, p.hi)
        n = z.shape[1]
        for at in range(0, len(z), max(1, (1 << 16) // n)):
            part = z[at : at + max(1, (1 << 16) // n)]
            rows = np.repeat(np.arange(p.lo + at, p.lo + at + len(part), dtype=np.int32), n)
            columns = [pa.array([p.layer] * len(rows), pa.string()), pa.array(rows), pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))), pa.array(part.ravel(), pa.float64(), mask=np.isnan(part.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["layer", "row", "col", "z"])


class GridHeads(ds.DataSource):
    """spark.read.format("grid_heads"): see _Heads."""

    @classmethod
    def name(cls):
        return "grid_heads"

    def schema(self):
        return HEADS

    def reader(self, schema):
        return _Heads(self.options)


class GridCells(ds.DataSource):
    """spark.read.format("grid_cells"): see _Cells."""

    @classmethod
    def name(cls):
        return "grid_cells"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return _Cells(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GridHeads, GridCells):
        spark.dataSource.register(source)
