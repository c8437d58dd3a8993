"""Scattered points on a grid, by tiles: triangles, slopes and nearest points that hold for a whole layer.

A tile triangulates the points that it sees. A triangle is one of the whole layer's if no point lies in its circle, a node's
nearest point is the layer's if none lies in the disc up to it, and a node is outside the hull if none lies beyond an edge
that it looks over. Circles, discs and edges that reach other tiles are joined with the points there; the deepest point of
each tile is what the asking tile sees in the next round, until nothing is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.stencil import _name, smoothed
from strata.operators.storage import stored

#: Points of a tile, about; tiles of all layers at most (then tiles hold more); sampled points a tile, which only place its cuts.
TILE_POINTS, MOST_TILES, SAMPLED = 2000, 16_384, 32
#: Nodes that a task fills at a time, about.
NODES = 1 << 16
#: How many mean spacings of its own tile away from a neighbour's rectangle a point is seen there from the start.
HALO = 4.0
#: What rounding may take from a circle or an edge.
SLACK = 1e-9


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles (indices) of distinct points, inserted from left to right; empty where all lie on one line.

    A triangle whose circle ends left of the next point can't change any more, so few are looked at for each point."""
    n = len(x)
    if not n:
        return np.zeros((0, 3), int)
    span = max(np.ptp(x), np.ptp(y), 1e-12)
    x, y, far = x - x.mean(), y - y.mean(), 1e4 * span
    px, py = np.r_[x, -far, far, 0.0], np.r_[y, -far, -far, far]

    def circles_of(t):
        """Centre and squared radius of each; infinite for flat ones."""
        (ax, bx, cx), (ay, by, cy) = px[t].T, py[t].T
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        flat = np.abs(d) < 1e-12 * span * span
        d = np.where(flat, 1.0, d)
        s, t_, u = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (s * (by - cy) + t_ * (cy - ay) + u * (ay - by)) / d, (s * (cx - bx) + t_ * (ax - cx) + u * (bx - ax)) / d
        r2 = (ax - ux) ** 2 + (ay - uy) ** 2
        return np.stack([np.where(flat, 0.0, ux), np.where(flat, 0.0, uy), np.where(flat, np.inf, r2)], axis=1)

    tri, done = np.array([[n, n + 1, n + 2]]), []
    circles = circles_of(tri)
    for p in np.lexsort((y, x)):
        left = circles[:, 0] + np.sqrt(circles[:, 2]) * (1 + 1e-9) < px[p]
        if left.any():
            done.append(tri[left])
            tri, circles = tri[~left], circles[~left]
        bad = (px[p] - circles[:, 0]) ** 2 + (py[p] - circles[:, 1]) ** 2 < circles[:, 2] * (1 + 1e-12)
        # An edge of one such triangle alone is on the rim of the hole.
        ends = tri[bad]
        u, v = ends.ravel(), ends[:, [1, 2, 0]].ravel()
        rim, count = np.unique(np.minimum(u, v) * (n + 3) + np.maximum(u, v), return_counts=True)
        rim = rim[count == 1]
        new = np.stack([rim // (n + 3), rim % (n + 3), np.full(len(rim), p)], axis=1)
        tri = np.concatenate([tri[~bad], new])
        circles = np.concatenate([circles[~bad], circles_of(new)])
    tri = np.concatenate([*done, tri])
    tri = tri[(tri < n).all(1)]
    area = (x[tri[:, 1]] - x[tri[:, 0]]) * (y[tri[:, 2]] - y[tri[:, 0]]) - (x[tri[:, 2]] - x[tri[:, 0]]) * (y[tri[:, 1]] - y[tri[:, 0]])
    return tri[np.abs(area) > 1e-12 * span * span]


def slopes(x: np.ndarray, y: np.ndarray, z: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """(points x 2) gradients: planes through each point that fit its neighbours best, near ones counting more."""
    a, b = (np.concatenate([tri[:, i] for i in k]) for k in ((0, 1, 2, 1, 2, 0), (1, 2, 0, 0, 1, 2)))
    dx, dy, dz = x[b] - x[a], y[b] - y[a], z[b] - z[a]
    w = 1 / np.maximum(dx * dx + dy * dy, 1e-300)
    total = lambda v: np.bincount(a, w * v, len(x))
    xx, xy, yy, xz, yz = (total(v) for v in (dx * dx, dx * dy, dy * dy, dx * dz, dy * dz))
    det = xx * yy - xy * xy
    ok = det > 1e-12 * np.maximum(xx * yy, 1e-300)
    det = np.where(ok, det, 1.0)
    return np.where(ok[:, None], np.stack([(yy * xz - xy * yz) / det, (xx * yz - xy * xz) / det], axis=1), 0.0)


def patch(px: np.ndarray, py: np.ndarray, z: np.ndarray, g: np.ndarray, bary: np.ndarray) -> np.ndarray:
    """Values at barycentric places of one triangle of a surface with continuous slopes: the triangle is cut into three at
    its centre, each a cubic in Bernstein form, slopes across the outer edges changing evenly along them."""
    p = np.stack([px, py], axis=1)
    centre = p.mean(0)
    toward = lambda i, q: z[i] + g[i] @ (q - p[i]) / 3
    inward = [toward(i, centre) for i in range(3)]
    face = {}
    for i, j in ((0, 1), (1, 2), (2, 0)):
        edge, ij, ji = p[j] - p[i], toward(i, p[j]), toward(j, p[i])
        t = (centre - p[i]) @ edge / (edge @ edge)
        ends = -(1 - t) * z[i] - t * ij + inward[i] - (1 - t) * ji - t * z[j] + inward[j]
        face[i, j] = face[j, i] = (1 - t) * ij + t * ji + ends / 2
    near = [(inward[i] + face[i, (i + 1) % 3] + face[i, (i + 2) % 3]) / 3 for i in range(3)]
    middle, out, low = sum(near) / 3, np.empty(len(bary)), bary.argmin(1)
    for k in range(3):
        m, i, j = low == k, (k + 1) % 3, (k + 2) % 3
        c = 3 * bary[m, k]
        u, v = bary[m, i] - bary[m, k], bary[m, j] - bary[m, k]
        out[m] = z[i] * u**3 + z[j] * v**3 + middle * c**3 + 3 * (toward(i, p[j]) * u * u * v + toward(j, p[i]) * u * v * v + inward[i] * u * u * c + inward[j] * v * v * c + near[i] * u * c * c + near[j] * v * c * c) + 6 * face[i, j] * u * v * c
    return out


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners, counterclockwise, of distinct points sorted by x, then y; two where all lie on one line."""

    def half(order):
        out: list[int] = []
        for p in order:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[p] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[p] - x[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(range(len(x))) + half(range(len(x) - 1, -1, -1)), int)


def _circles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius, a little less, of each triangle's circle; no point stands for the places that settle ties."""
    a = tri[:, 0]
    bx, by, cx, cy = x[tri[:, 1]] - x[a], y[tri[:, 1]] - y[a], x[tri[:, 2]] - x[a], y[tri[:, 2]] - y[a]
    b2, c2, d = bx * bx + by * by, cx * cx + cy * cy, 2 * (bx * cy - by * cx)
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    none = np.full(len(tri), -np.inf)
    return np.stack([x[a] + ux, y[a] + uy, (ux * ux + uy * uy) * (1 - SLACK), none, none], axis=1)


def _values(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, method: str):
    """Values at the nodes of gy x gx from distinct points sorted by x, then y, and what they rest on: circles (centre, squared
    radius, and the point found, for ties) that must hold no other point, edges (outer normal, offset) that none lies beyond."""
    nx, (qx, qy) = len(gx), (a.ravel() for a in np.meshgrid(gx, gy))
    out, edges = np.full(len(qx), np.nan), np.zeros((0, 3))
    tri = triangulate(x, y) if method != "nearest" and len(x) >= 3 else np.zeros((0, 3), int)
    g, used = slopes(x, y, z, tri) if method == "cubic" else None, np.zeros(len(tri), bool)
    (c0, c1), (r0, r1) = ((np.searchsorted(axis, v[tri].min(1) - SLACK), np.searchsorted(axis, v[tri].max(1) + SLACK)) for axis, v in ((gx, x), (gy, y)))
    for k in np.flatnonzero((c0 < c1) & (r0 < r1)):
        a, b, c = t = tri[k]
        at = (np.arange(r0[k], r1[k])[:, None] * nx + np.arange(c0[k], c1[k])).ravel()
        det = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
        u = ((y[b] - y[c]) * (qx[at] - x[c]) + (x[c] - x[b]) * (qy[at] - y[c])) / det
        v = ((y[c] - y[a]) * (qx[at] - x[c]) + (x[a] - x[c]) * (qy[at] - y[c])) / det
        ok = (u >= -SLACK) & (v >= -SLACK) & (u + v <= 1 + SLACK)
        if ok.any():
            used[k] = True
            bary = np.stack([u[ok], v[ok], 1 - u[ok] - v[ok]], axis=1)
            out[at[ok]] = bary @ z[t] if g is None else patch(x[t], y[t], z[t], g[t], bary)
    if g is not None:
        # A slope rests on all triangles around its point.
        corner = np.zeros(len(x), bool)
        corner[tri[used]] = True
        used = corner[tri].any(1)
    circles, hole, step = [_circles(x, y, tri[used])], np.flatnonzero(np.isnan(out)), max(1, (1 << 22) // len(x))
    for lo in range(0, len(hole), step):
        part = hole[lo : lo + step]
        d2 = (qx[part, None] - x) ** 2 + (qy[part, None] - y) ** 2
        near = d2.argmin(1)
        out[part] = z[near]
        circles.append(np.stack([qx[part], qy[part], d2[np.arange(len(part)), near], x[near], y[near]], axis=1))
    if len(hole) and method != "nearest" and len(x) > 1:
        a = _hull(x, y)
        b = np.roll(a, -1)
        normal = np.stack([y[b] - y[a], x[a] - x[b]], axis=1) / np.hypot(x[b] - x[a], y[b] - y[a])[:, None]
        off = normal[:, 0] * x[a] + normal[:, 1] * y[a] + SLACK * max(np.ptp(x), np.ptp(y))
        over = np.zeros(len(a), bool)
        step = max(1, (1 << 22) // len(a))
        for lo in range(0, len(hole), step):
            part = hole[lo : lo + step]
            beyond = qx[part, None] * normal[:, 0] + qy[part, None] * normal[:, 1] - off
            most = beyond.argmax(1)
            over[most[beyond[np.arange(len(part)), most] > 0]] = True
        over |= not len(tri)
        edges = np.c_[normal, off][over]
    return out, np.concatenate(circles), edges


def _interpolated(frame: pd.DataFrame, nx: int, ny: int, method: str) -> pd.DataFrame:
    """A layer as one tile."""
    points = frame.groupby(["x", "y"], as_index=False)["z"].mean()
    x, y, z = (points[c].to_numpy(float) for c in "xyz")
    out, _, _ = _values(x, y, z, np.linspace(x.min(), x.max(), nx), np.linspace(y.min(), y.max(), ny), method)
    return pd.DataFrame({"layer": frame["layer"].iloc[0], "row": np.repeat(np.arange(ny), nx).astype(np.int32), "col": np.tile(np.arange(nx), ny).astype(np.int32), "z": out})


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, every number from low[i] to before high[i])."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]


def _tiles(x: np.ndarray, y: np.ndarray, n: int, size: int, extent, extremes: np.ndarray, nx: int, ny: int) -> dict:
    """The tiles of a layer of n points that x and y are a sample of: strips by quantiles of x, each cut by quantiles of y."""
    wanted = math.ceil(n / size) if len(x) else 1
    strips = math.ceil(math.sqrt(wanted))
    xs = np.unique(np.quantile(x, np.arange(1, strips) / strips)) if strips > 1 else np.zeros(0)
    strip, ys = np.searchsorted(xs, x, "right"), []
    for s in range(len(xs) + 1):
        own = y[strip == s]
        k = max(1, round(wanted * len(own) / max(1, len(x))))
        ys.append(np.unique(np.quantile(own, np.arange(1, k) / k)) if k > 1 else np.zeros(0))
    counts = np.array([len(c) + 1 for c in ys])
    t = {"xs": xs, "ys": ys, "first": np.cumsum(counts) - counts, "extremes": extremes, "extent": extent}
    edge = np.r_[-np.inf, xs, np.inf]
    low = np.concatenate([np.c_[np.full(k, edge[s]), np.r_[-np.inf, ys[s]]] for s, k in enumerate(counts)])
    high = np.concatenate([np.c_[np.full(k, edge[s + 1]), np.r_[ys[s], np.inf]] for s, k in enumerate(counts)])
    x0, x1, y0, y1 = extent
    sides = np.minimum(high, [x1, y1]) - np.maximum(low, [x0, y0])
    held = np.bincount(_meeting(t, x, x, y, y)[1], minlength=len(low)) * (n / max(1, len(x))) if len(x) else np.full(len(low), n)
    t["low"], t["high"], t["reach"] = low, high, HALO * np.sqrt(np.maximum(sides.prod(1), 0.0) / np.maximum(held, 1))
    t["gx"], t["gy"] = np.linspace(x0, x1, nx), np.linspace(y0, y1, ny)
    (c0, r0), (c1, r1) = ([np.searchsorted(t[a], side[:, i]) for i, a in enumerate(("gx", "gy"))] for side in (low, high))
    t["nodes"], t["step"] = np.stack([r0, r1, c0, c1], axis=1), np.maximum(1, NODES // np.maximum(1, c1 - c0))
    t["parts"] = np.where(c1 > c0, -(-(r1 - r0) // t["step"]), 0)
    return t


def _meeting(t: dict, x0, x1, y0, y1) -> tuple[np.ndarray, np.ndarray]:
    """(i, tile) of every tile that rectangle i meets."""
    i, strip = _runs(np.searchsorted(t["xs"], x0, "right"), np.searchsorted(t["xs"], x1, "right") + 1)
    low, high = np.zeros(len(i), int), np.zeros(len(i), int)
    for s in np.unique(strip):
        m = np.flatnonzero(strip == s)
        low[m], high[m] = (np.searchsorted(t["ys"][s], v[i[m]], "right") for v in (y0, y1))
    j, at = _runs(low, high + 1)
    return i[j], t["first"][strip[j]] + at


def _sent(held):
    """mapInPandas: layer, x, y, z -> a row for the point's own tile (part -1), and one for each part of the tiles that see it."""

    def run(frames):
        for f in frames:
            for name in f["layer"].unique():
                t, g = held.value[name], f[f["layer"] == name]
                x, y, z = (g[c].to_numpy(float) for c in "xyz")
                _, own = _meeting(t, x, x, y, y)
                r = t["reach"][own]
                i, tile = _meeting(t, x - r, x + r, y - r, y + r)
                j, part = _runs(np.zeros(len(i), int), t["parts"][tile])
                at = np.r_[np.arange(len(x)), i[j]]
                yield pd.DataFrame({"layer": name, "tile": np.r_[own, tile[j]], "part": np.r_[np.full(len(x), -1), part], "x": x[at], "y": y[at], "z": z[at]})

    return run


def _all_parts(held, names):
    """mapInPandas: number of a layer -> a row without a point for each part of its tiles, as some may see none."""

    def run(frames):
        for f in frames:
            for i in f["id"]:
                tile, part = _runs(np.zeros(len(held.value[names[i]]["parts"]), int), held.value[names[i]]["parts"])
                yield pd.DataFrame({"layer": names[i], "tile": tile, "part": part, "x": np.nan, "y": np.nan, "z": np.nan})

    return run


_SOLVED = "layer string, tile long, part long, kind int, row int, col int, z double, id int, at long, a double, b double, c double, px double, py double"


def _solved(held, method: str):
    """applyInPandas: the points that a part of a tile sees -> its nodes' values (kind 0), and for each tile that they reach the
    circles (1) and edges (2) to look at there."""

    def run(key, f):
        name, tile, part = key
        t = held.value[name]
        points = np.concatenate([f.loc[f["x"].notna(), ["x", "y", "z"]].to_numpy(float), t["extremes"]])
        points = points[np.lexsort((points[:, 1], points[:, 0]))]
        x, y, z = points[np.r_[True, (points[1:, :2] != points[:-1, :2]).any(1)]].T
        r0, r1, c0, c1 = t["nodes"][tile]
        r0 = r0 + part * t["step"][tile]
        r1 = min(r1, r0 + t["step"][tile])
        values, circles, edges = _values(x, y, z, t["gx"][c0:c1], t["gy"][r0:r1], method)
        rows, cols = np.repeat(np.arange(r0, r1), c1 - c0), np.tile(np.arange(c0, c1), r1 - r0)
        nodes = pd.DataFrame({"kind": 0, "row": rows, "col": cols, "z": values})
        r = np.sqrt(circles[:, 2]) * (1 + SLACK)
        # All points of the own tile are seen.
        far = np.flatnonzero((np.stack([circles[:, k] - r for k in (0, 1)], axis=1) < t["low"][tile]).any(1) | (np.stack([circles[:, k] + r for k in (0, 1)], axis=1) >= t["high"][tile]).any(1))
        circles, r = circles[far], r[far]
        i, at = _meeting(t, circles[:, 0] - r, circles[:, 0] + r, circles[:, 1] - r, circles[:, 1] + r)
        gap = np.maximum(np.maximum(t["low"][at] - circles[i, :2], circles[i, :2] - t["high"][at]), 0.0)
        keep = (at != tile) & ((gap * gap).sum(1) <= r[i] ** 2)
        i, at = i[keep], at[keep]
        asked = pd.DataFrame({"kind": 1, "id": i, "at": at, **{k: circles[i, n] for n, k in enumerate(("a", "b", "c", "px", "py"))}})
        x0, x1, y0, y1 = t["extent"]
        low, high = np.maximum(t["low"], [x0, y0]), np.minimum(t["high"], [x1, y1])
        reach = [np.flatnonzero(((np.where(e[:2] > 0, high, low) * e[:2]).sum(1) > e[2]) & (np.arange(len(low)) != tile)) for e in edges]
        i, at = np.repeat(np.arange(len(edges)), [len(m) for m in reach]), np.concatenate([*reach, np.zeros(0, int)])
        over = pd.DataFrame({"kind": 2, "id": i, "at": at, "a": -edges[i, 0], "b": -edges[i, 1], "c": -edges[i, 2], "px": -np.inf, "py": -np.inf})
        out = pd.concat([nodes, asked, over], ignore_index=True)
        out.insert(0, "layer", name), out.insert(1, "tile", tile), out.insert(2, "part", part)
        for c in ("row", "col", "id", "at"):
            out[c] = out[c].astype("Int64")
        return out

    return run


def _inside(own: DataFrame, asked: DataFrame) -> DataFrame:
    """layer, tile, part, x, y, z: for every circle or edge, and every tile that it reaches, the point deepest inside or beyond."""
    own = own.select(F.col("layer").alias("l"), F.col("tile").alias("o"), "x", "y", F.col("z").alias("v"))
    d = F.when(F.col("kind") == 1, (F.col("a") - F.col("x")) * (F.col("a") - F.col("x")) + (F.col("b") - F.col("y")) * (F.col("b") - F.col("y"))).otherwise(F.col("a") * F.col("x") + F.col("b") * F.col("y"))
    # Of points at one distance the one of smaller x, then y, is the nearest.
    first = (F.col("x") < F.col("px")) | ((F.col("x") == F.col("px")) & (F.col("y") < F.col("py")))
    met = asked.join(own, (F.col("layer") == F.col("l")) & (F.col("at") == F.col("o"))).withColumn("d", d).where((F.col("d") < F.col("c")) | ((F.col("d") == F.col("c")) & first))
    deepest = met.groupBy("layer", "tile", "part", "kind", "id", "at").agg(F.min(F.struct("d", "x", "y", "v")).alias("p"))
    return deepest.select("layer", "tile", "part", "p.x", "p.y", F.col("p.v").alias("z")).distinct()


def gridded(points: DataFrame, nx: int = 200, ny: int = 200, method: str = "linear", sigma: float = 0.5, tile_points: int = TILE_POINTS) -> DataFrame:
    """layer, row, col, z from scattered layer, x, y, z: linear or cubic (with continuous slopes) on a Delaunay triangulation,
    or nearest (ties to the smaller x, then y); nearest outside the hull; then a Gaussian smooth (sigma 0: none). ValueError
    for another method.

    Equal places are averaged; rows with a missing layer, place or value are left out; no rows give none. A layer is cut into
    tiles of about `tile_points` points, which no task sees more than a few of; rounds of joins settle what crosses their borders.
    """
    if method not in ("linear", "cubic", "nearest"):
        raise ValueError(f"unknown method {method}")
    there = F.col("layer").isNotNull()
    for c in "xyz":
        there &= F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    points = stored(points.where(there).groupBy("layer", "x", "y").agg(F.avg("z").alias("z")), "points")
    ways = {f"w{i}": (f, e) for i, (f, e) in enumerate((f, e) for e in ("x", "y", "x + y", "x - y") for f in (F.min, F.max))}
    sizes = points.groupBy("layer").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)], *[f(F.struct(F.expr(e).alias("e"), "x", "y", "z")).alias(k) for k, (f, e) in ways.items()]).collect()
    size = max(tile_points, math.ceil(sum(r.n for r in sizes) / MOST_TILES))
    share = min(1.0, SAMPLED / size)
    drawn = points.where(F.pmod(F.xxhash64("layer", "x", "y"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).join(F.broadcast(points.sparkSession.createDataFrame([(r.layer,) for r in sizes if r.n > size], "layer string")), "layer").select("layer", "x", "y").toPandas()
    tiles = {}
    for r in sizes:
        at = drawn[drawn["layer"] == r.layer]
        tiles[r.layer] = _tiles(at["x"].to_numpy(float), at["y"].to_numpy(float), r.n, size, (r.min_x, r.max_x, r.min_y, r.max_y), np.array([r[k][1:] for k in ways], float), nx, ny)
    spark, key = points.sparkSession, ["layer", "tile", "part"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as stated: tiles are work, though few bytes
    held = spark.sparkContext.broadcast(tiles)
    schema = "layer string, tile long, part long, x double, y double, z double"
    sent = stored(points.mapInPandas(_sent(held), schema), "sent")
    own, done = sent.where("part = -1"), None
    todo = sent.where("part >= 0").unionByName(spark.range(len(sizes)).mapInPandas(_all_parts(held, [r.layer for r in sizes]), schema))
    while True:
        solved = stored(todo.repartition(tasks, *key).groupBy(key).applyInPandas(_solved(held, method), _SOLVED), "solved")
        more = stored(_inside(own, solved.where("kind > 0")).join(todo.select(*key, "x", "y"), [*key, "x", "y"], "left_anti"), "more")
        nodes, again = solved.where("kind = 0").select(*key, "row", "col", "z"), more.select(key).distinct()
        settled = nodes.join(again, key, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if more.isEmpty():
            break
        todo = stored(todo.join(again, key, "left_semi").unionByName(more.select(todo.columns)), "todo")
    cells = done.select("layer", "row", "col", "z")
    return smoothed(cells, [sigma]).select("layer", "row", "col", F.col(_name(sigma)).alias("z")) if sigma else cells
