"""Operators against NumPy and against small cases with known results."""

import itertools
import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions import columns
from strata.operators import features, graph, grid, metrics, nearest, network, ranks, sampling, stencil, targets, transformers, trees
from strata.operators.grid import Grid
from strata.plans import charts
from strata.plans.pipeline import SurveyPipeline
from strata.sources import gridfiles, grids, sinks, synthetic


def frame(spark, z, layer="a"):
    return grids.array_layer(spark, z, np.arange(z.shape[1]), np.arange(z.shape[0]), layer)[0]


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def smooth(z, sigma):
    k, r = np.array(stencil.kernel(sigma)), len(stencil.kernel(sigma)) // 2
    for axis in (0, 1):
        p = np.pad(z, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        z = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, p)
    return z


def test_filters(spark):
    z = np.random.default_rng(1).normal(size=(13, 17)) * 10
    got = stencil.all_filters(frame(spark, z), 5, 2.0, 3.0).cache()
    gy, gx = np.gradient(z, 3.0, 2.0)
    dog = smooth(z, 0.8) - smooth(z, 2.5)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(z, 2, mode="symmetric"), (5, 5))
    want = {"smooth": smooth(z, 1.5), "residual": z - smooth(z, 8.0), "hgrad": np.hypot(gx, gy), "analytic_signal": np.sqrt(gx**2 + gy**2 + dog**2), "tilt": np.arctan2(dog, np.hypot(gx, gy) + 1e-10), "upward": smooth(z, 3.0), "fvd": smooth(z, 0.5) - smooth(z, 2.0), "log": np.sign(z) * np.log1p(abs(z)), "win_mean": views.mean((2, 3)), "win_std": views.std((2, 3)), "win_range": views.max((2, 3)) - views.min((2, 3))}
    for name, w in want.items():
        np.testing.assert_allclose(array(got, name, z.shape), w, atol=1e-7, err_msg=name)


def test_one_line_grids(spark):
    got = stencil.all_filters(frame(spark, np.array([[1.0, 2.0, 4.0]])), 3)
    assert got.count() == 3 and got.where("hgrad is null").count() == 0


def test_registration_shapes(spark):
    (a, la), (b, lb) = (grids.array_layer(spark, np.random.default_rng(i).normal(size=(n, n)), np.linspace(lo, hi, n), np.linspace(lo, hi, n), name) for i, (n, lo, hi, name) in enumerate(((50, 0, 1000, "mag"), (80, 100, 900, "grav"))))
    g = grid.common_grid(la.unionByName(lb), 40, 40)
    assert (g.xmin, g.xmax) == (100, 900)
    got = grid.registered(a.unionByName(b), la.unionByName(lb), g)
    assert {r["layer"]: r["count"] for r in got.where("z is not null").groupBy("layer").count().collect()} == {"mag": 1600, "grav": 1600}


def test_no_common_extent(spark):
    layers = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0, 2, 2), ("b", 2.0, 3.0, 0.0, 1.0, 2, 2)], "layer string, xmin double, xmax double, ymin double, ymax double, nx int, ny int")
    with pytest.raises(ValueError):
        grid.common_grid(layers)


def test_size_is_cut(spark):
    layers = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 1.0, 5000, 2)], "layer string, xmin double, xmax double, ymin double, ymax double, nx int, ny int")
    with pytest.warns(UserWarning):
        assert grid.common_grid(layers).nx == 2000


def test_points_and_mask(spark):
    got = grid.locate(spark.createDataFrame([(-1.0, 5.0), (5.0, 5.0), (12.0, 5.0)], "x double, y double"), Grid(0.0, 10.0, 0.0, 10.0, 11, 11)).orderBy("x").collect()
    assert [(r["row"], r["col"], r["inside"]) for r in got] == [(5, 0, False), (5, 5, True), (5, 10, False)]


def test_fill_and_empty_layer(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(9, 12))
    z[rng.random(z.shape) < 0.6] = np.nan
    got = array(grid.fill_nearest(frame(spark, z)), "z", z.shape)
    r, c = np.nonzero(~np.isnan(z))
    for i in range(9):
        for j in range(12):
            k = min(range(len(r)), key=lambda k: ((r[k] - i) ** 2 + (c[k] - j) ** 2, r[k], c[k]))
            assert got[i, j] == z[r[k], c[k]]
    none = np.full((3, 3), np.nan)
    assert np.isnan(array(grid.fill_nearest(frame(spark, none)), "z", (3, 3))).all()


def test_triangulated_plane(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(80) * 10, rng.random(80) * 10
    x[:4], y[:4] = [0, 0, 10, 10], [0, 10, 0, 10]
    points = spark.createDataFrame(pd.DataFrame({"layer": "p", "x": x, "y": y, "z": 2 * x + 3 * y}))
    got = array(grid.gridded(points, 11, 9, sigma=0), "z", (9, 11))
    gx, gy = np.meshgrid(np.linspace(0, 10, 11), np.linspace(0, 10, 9))
    np.testing.assert_allclose(got, 2 * gx + 3 * gy, atol=1e-6)


def test_triangles_have_empty_circles():
    rng = np.random.default_rng(2)
    x, y = rng.random(60), rng.random(60)
    tri = grid.triangulate(x, y)
    want = set()
    for a, b, c in itertools.combinations(range(60), 3):
        m = np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]])
        o = np.linalg.solve(2 * m, (m**2).sum(1))
        d = (x - x[a] - o[0]) ** 2 + (y - y[a] - o[1]) ** 2
        if (np.delete(d, [a, b, c]) > o @ o).all():
            want.add((a, b, c))
    assert {tuple(sorted(t.tolist())) for t in tri} == want


def test_cubic_surface():
    rng = np.random.default_rng(7)
    x, y = np.r_[rng.random(200), 0, 0, 1, 1], np.r_[rng.random(200), 0, 1, 0, 1]
    f = lambda x, y: np.sin(3 * x) * np.cos(2 * y)
    frame_ = pd.DataFrame({"layer": "a", "x": x, "y": y, "z": f(x, y)})
    gx, gy = np.meshgrid(np.linspace(0, 1, 41), np.linspace(0, 1, 41))
    off = {m: np.abs(grid._interpolated(frame_, 41, 41, m)["z"].to_numpy() - f(gx, gy).ravel()).mean() for m in ("linear", "cubic", "nearest")}
    assert off["cubic"] < 0.6 * off["linear"] < off["nearest"]
    plane = grid._interpolated(frame_.assign(z=2 * x - 3 * y), 41, 41, "cubic")["z"]
    np.testing.assert_allclose(plane, (2 * gx - 3 * gy).ravel(), atol=1e-9)
    # Slopes go on across an inner edge.
    tri, z = grid.triangulate(x, y), f(x, y)
    g, edges = grid.slopes(x, y, z, tri), {}
    for t in tri.tolist():
        for k in range(3):
            edges.setdefault(tuple(sorted((t[k], t[k - 1]))), []).append(t)
    (a, b), (s, t) = next((e, ts) for e, ts in edges.items() if len(ts) == 2)

    def at(t, q):
        m = np.array([x[t], y[t], [1, 1, 1]])
        return grid.patch(x[t], y[t], z[t], g[t], np.linalg.solve(m, np.r_[q, 1])[None])[0]

    p, across = 0.3 * np.array([x[a], y[a]]) + 0.7 * np.array([x[b], y[b]]), np.array([y[a] - y[b], x[b] - x[a]])
    h = 1e-5
    one, two = ((at(k, p + h * across) - at(k, p - h * across)) / (2 * h) for k in (s, t))
    assert one == pytest.approx(two, rel=1e-4)


def test_features_by_profile(spark):
    layers = ["magnetic_tmi", "gravity_bouguer", "resistivity", "ip_chargeability", "geochemistry_cu", "geochemistry_au"]
    assert len(features.feature_names(layers)) == 47
    z = np.random.default_rng(2).normal(size=(8, 8))
    got = features.extract(frame(spark, z, "magnetic_tmi").unionByName(frame(spark, z, "some_geology")), ["magnetic_tmi", "some_geology"])
    assert {r[0] for r in got.select("feature").distinct().collect()} == set(features.feature_names(["magnetic_tmi", "some_geology"]))


def test_few_values_are_left_as_they_are(spark):
    long = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("a", None)], "feature string, val double")
    assert tuple(features.norm_params(long).first()) == ("a", 0.0, 1.0, 0.0, 1.0)


def test_balance():
    b = sampling.Balance(5, 95)
    assert (b.severity, b.ratio, b.folds) == ("severe", 19.0, 2)
    assert sampling.synthetic_count(5, 95, b.smote_ratio) == 26


def test_smote_and_balance_errors(spark):
    x = np.random.default_rng(0).normal(size=(5, 4)) + 3
    made = sampling.smote(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), 26, 4).collect()
    assert len(made) == 26
    for r in made:
        v = np.array(r["vec"])
        assert any(np.linalg.norm(np.cross(*np.pad([v - a, b - a], ((0, 0), (0, 0)))[:, :3])) < 1e-9 for a in x for b in x if (a != b).any())
    assert sampling.smote(spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>"), 3).count() == 3
    with pytest.raises(ValueError):
        sampling.balance(spark.createDataFrame([(1,), (1,), (0,)], "label int"))


def test_components_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and len(got) == 101
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tile", [3, 512])
def test_labels_over_tiles(spark, tile):
    m = np.random.default_rng(4).random((15, 20)) < 0.55
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(m))], "row int, col int")
    got = {(r["row"], r["col"]): r["component"] for r in targets.label_components(cells, 20, tile).collect()}
    left = {(int(r), int(c)) for r, c in zip(*np.nonzero(m))}
    while left:
        first = min(left)
        todo, seen = [first], {first}
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left and n not in seen:
                    seen.add(n)
                    todo.append(n)
        assert {got[p] for p in seen} == {first[0] * 20 + first[1]}
        left -= seen


def test_metrics_without_a_class(spark):
    m = metrics.model_metrics(spark.createDataFrame([(0, 0.2), (0, 0.4)], "label int, prob double")).first()
    assert (m.auc_roc, m.auc_pr) == (0.0, 0.0)


def test_ensemble_guard(spark):
    row = spark.range(1).select(columns.ensemble([F.lit(0.2), F.lit(0.4)], [0.0, 0.0]).alias("p")).first()
    assert row.p == pytest.approx(0.3)


def test_column_detection():
    assert [grids.find_column(["a", "b", "c"], None, [w], ["a", "b", "c"], i) for i, w in enumerate("xyz")] == ["a", "b", "c"]
    assert grids.find_column(["max_val", "q"], None, ["x"]) == "max_val"
    with pytest.raises(KeyError):
        grids.find_column(["a"], "b", [])


def test_wells_file(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("X,Y,LABEL\n1,1,2\n2,2,1\n")
    with pytest.raises(ValueError):
        grids.read_wells(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "good.csv").write_text("X;no\n")
    (tmp_path / "w.txt").write_text("Easting\tNorthing\tResult\tDepth\tNotes\n1\t2\t1\t10\ta\nx\t2\t0\t1\tb\n3\t4\t0\t5\tc\n")
    got = grids.read_wells(spark, str(tmp_path / "w.txt")).collect()
    assert [(r.x, r.y, r.label, r.depth) for r in got] == [(1, 2, 1, 10), (3, 4, 0, 5)]


def test_grid_files(spark, tmp_path):
    z = np.array([[1.0, 2.0, np.nan], [4.0, 5.0, 6.0]])
    z_b = np.where(np.isnan(z), 1.70141e38, z)
    (tmp_path / "a.grd").write_text("DSAA\n3 2\n0 20\n5 6\n1 6\n" + "\n".join(" ".join(f"{v:g}" for v in r) for r in z_b))
    (tmp_path / "b.grd").write_bytes(b"DSBB" + struct.pack("<HH6d", 3, 2, 0, 20, 5, 6, 1, 6) + z_b.astype("<f4").tobytes())
    (tmp_path / "c.grd").write_bytes(b"DSRB" + struct.pack("<5I8d", 1, 72, 1, 3, 2, 0, 5, 20, 6, 1, 6, 0, 1.70141e38) + b"\0" * 8 + z_b.astype("<f8").tobytes())
    head = bytearray(512)
    struct.pack_into("<ii", head, 4, 3, 2)
    struct.pack_into("<4d", head, 16, 0, 5, 10, 1)
    (tmp_path / "d.grd").write_bytes(bytes(head) + np.where(np.isnan(z), -1e32, z).astype("<f4").tobytes())
    cells, layers = grids.read_grids(spark, [str(tmp_path / f"{n}.grd") for n in "abcd"])
    for n in "abcd":
        np.testing.assert_array_equal(array(cells.where(F.col("layer") == n), "z", z.shape), z)
    assert {(r.xmin, r.xmax, r.ymin, r.ymax) for r in layers.collect()} == {(0, 20, 5, 6)}
    assert {r.layer: r.format for r in layers.collect()} == {"a": "surfer_ascii", "b": "surfer_binary", "c": "surfer7", "d": "geosoft"}
    lines = [r.value for r in sinks.surfer_lines(cells.where("layer = 'a'"), layers.where("layer = 'a'")).orderBy("line_no").collect()]
    assert grids.surfer_ascii("\n".join(lines).encode())["z"].shape == (2, 3)


@pytest.mark.parametrize("kind", ["surfer_binary", "surfer7", "geosoft", "geotiff", "surfer_ascii"])
def test_large_grids_are_read_by_blocks(spark, tmp_path, kind):
    z = np.random.default_rng(1).integers(0, 1000, (37, 53)).astype(float)
    z[::5, ::3] = np.nan
    cells, layers = grids.array_layer(spark, z, np.arange(53) * 2.0, np.arange(37) + 5.0, "a")
    if kind == "surfer_ascii":
        sinks.write_surfer(cells, layers, str(tmp_path))
    else:
        sinks.write_binary(cells, layers, str(tmp_path), kind)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        back, heads = grids.read_grids(spark, [str(tmp_path)], kind=kind, block_cells=200)
        np.testing.assert_array_equal(array(back, "z", z.shape), z)
        scan = spark.read.text(str(tmp_path)) if kind == "surfer_ascii" else back
        tasks = scan.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    h = heads.first()
    assert (h.layer, h.format, h.nx, h.ny, h.xmin, h.xmax, h.ymin, h.ymax) == ("a", kind, 53, 37, 0, 104, 5, 41)
    assert tasks >= (4 if kind == "surfer_ascii" else 10)


def test_conditions_leave_blocks_unread():
    reader = gridfiles._Cells({"plan": json.dumps([["a", "p", "surfer7", 10, 100, 1], ["b", "q", "geotiff", 10, 100, 8]]), "blockCells": "100"})
    assert len(reader.partitions()) == 10 + 13
    some = gridfiles._Cells(reader_options := {"plan": json.dumps([["a", "p", "surfer7", 10, 100, 1], ["b", "q", "geotiff", 10, 100, 8]]), "blockCells": "100"})
    filters = [gridfiles.ds.GreaterThan(("row",), 39), gridfiles.ds.LessThanOrEqual(("row",), 55), gridfiles.ds.GreaterThan(("z",), 0.5)]
    assert list(some.pushFilters(filters)) == filters
    assert [(p.layer, p.lo, p.hi) for p in some.partitions()] == [("a", 40, 50), ("a", 50, 60), ("b", 52, 60), ("b", 44, 52), ("b", 36, 44)]
    one = gridfiles._Cells(reader_options)
    list(one.pushFilters([gridfiles.ds.In(("layer",), ("b", "c")), gridfiles.ds.EqualTo(("row",), 99)]))
    assert [(p.layer, p.lo, p.hi) for p in one.partitions()] == [("b", 92, 100)]
    none = gridfiles._Cells(reader_options)
    list(none.pushFilters([gridfiles.ds.EqualTo(("layer",), "z")]))
    assert [p.hi for p in none.partitions()] == [0] and not list(none.read(none.partitions()[0]))


def test_broken_grid_files(spark, tmp_path):
    (tmp_path / "a.grd").write_text("DSAA\n3 2\n0 20\n5 6\n1 6\n1 2 3 4 5")
    with pytest.raises(Exception, match="5 values for a grid of 6 cells"):
        grids.read_grids(spark, [str(tmp_path / "a.grd")])[0].collect()
    (tmp_path / "b.grd").write_bytes(b"\0" * 600)
    with pytest.raises(OSError, match="not a readable Geosoft grid"):
        grids.read_grids(spark, [str(tmp_path / "b.grd")])
    (tmp_path / "c.tif").write_bytes(b"not a tiff at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        grids.read_grids(spark, [str(tmp_path / "c.tif")])


def test_plain_tiff_by_rows():
    z = np.arange(23 * 30, dtype=float).reshape(23, 30)
    for raw in (tiff(z), tiff(z, False)):
        f = gridfiles.pa.BufferReader(raw)
        head = gridfiles.HEADERS["geotiff"](f)
        want = gridfiles.whole(raw, "geotiff")["z"]
        for lo, hi in ((0, 23), (0, 1), (5, 17), (22, 23)):
            np.testing.assert_array_equal(gridfiles.rows_of(f, head, lo, hi), want[lo:hi])


def tiff(z, geo=True):
    body = z.astype("<f4").tobytes()
    tags = [(256, 4, (z.shape[1],)), (257, 4, (z.shape[0],)), (258, 3, (32,)), (259, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (z.shape[0],)), (279, 4, (len(body),)), (339, 3, (3,))]
    tags += [(33550, 12, (1.0, 1.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 100.0, 200.0, 0.0))] if geo else []
    at, extra, entries = 8 + len(body), b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        if len(raw) > 4:
            field, extra = struct.pack("<I", start + len(extra)), extra + raw
        else:
            field = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + field
    return b"II" + struct.pack("<HI", 42, at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def test_geotiff():
    g = grids.geotiff(tiff(np.array([[1.0, 2.0], [3.0, 4.0]])))
    assert (g["xmin"], g["ymin"], g["ymax"]) == (100.5, 198.5, 199.5)
    np.testing.assert_array_equal(g["z"], [[3, 4], [1, 2]])
    assert grids.geotiff(tiff(np.ones((2, 2)), False))["crs"] == "pixel"


def test_scatter_file_and_ermapper(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("# made\nX\tY\tZ\n" + "\n".join(f"{i % 5}\t{i // 5}\t{i}" for i in range(25)))
    cells, layers = grids.load_layer(spark, str(tmp_path / "p.xyz"), nx=5, ny=5, sigma=0)
    assert array(cells, "z", (5, 5))[2, 3] == pytest.approx(13) and layers.first().n_points == 25
    (tmp_path / "q.xyz").write_text("X Y Z\n1 2 3\n")
    with pytest.raises(ValueError):
        grids.read_points(spark, str(tmp_path / "q.xyz"))
    (tmp_path / "r.ers").write_text("x")
    with pytest.raises(ValueError):
        grids.load_layer(spark, str(tmp_path / "r.ers"))


def test_sinks(spark, tmp_path):
    cells, layers = grids.array_layer(spark, np.array([[1.0, np.nan], [3.0, 4.0]]), [0, 10], [0, 5], "a")
    sinks.write_points(cells, layers, str(tmp_path / "xyz"))
    assert spark.read.csv(str(tmp_path / "xyz"), sep="\t", header=True).count() == 3
    assert not sinks.write_targets([], str(tmp_path / "t"))


def test_unsupervised_run(spark, tmp_path):
    z = np.random.default_rng(42).normal(size=(30, 30))
    pipe = SurveyPipeline(spark).add_layer_array(z, np.linspace(0, 100, 30), np.linspace(0, 100, 30), "magnetic_tmi")
    got = pipe.run(["mineral"], 30, 30, output_dir=str(tmp_path))["mineral"]
    assert got.mode == "unsupervised" and got.maps.count() == 900 and got.targets.columns == list(targets.COLUMNS)
    with pytest.raises(ValueError):
        SurveyPipeline(spark).run()
    with pytest.warns(UserWarning):
        assert not SurveyPipeline(spark).add_layer(str(tmp_path / "none.grd")).layers


def test_supervised_run_and_reload(spark, tmp_path):
    grid_, made, points = synthetic.demo(40, 40)
    pipe = SurveyPipeline(spark)
    for name in ("magnetic_tmi", "geochemistry_cu"):
        pipe.add_layer_cells(synthetic.cells_of(spark, {name: made[name]}, grid_), synthetic.layer_rows(spark, [name], grid_), name)
    pipe.add_wells_frame(pd.DataFrame(points["mineral"], columns=["x", "y", "label"]), "mineral")
    got = pipe.run(["mineral"], 40, 40, min_prob=0.3, cv_folds=2, iterations=20, trees=10, rounds=5)["mineral"]
    assert got.mode == "supervised" and {m["model"] for m in got.model.metrics} == {"ann", "rf", "gb", "ensemble"}
    first = got.targets.orderBy("rank").first()
    assert np.hypot(first.x - 312_000, first.y - 4_012_000) < 3000
    got.model.save(spark, str(tmp_path / "m"))
    again = type(got.model).load(spark, str(tmp_path / "m"))
    assert again.threshold == got.model.threshold and again.importances() == got.model.importances()


def test_streamed_wells(spark, tmp_path):
    from strata.streaming.wells import well_counts

    spark.sql("SELECT timestamp'2024-01-01 00:10' ts, 'mineral' target_type, 1 label UNION ALL SELECT timestamp'2024-01-01 00:20', 'mineral', 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = well_counts(spark.readStream.schema("ts timestamp, target_type string, label int").parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("complete").format("memory").queryName("wells").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    assert [(r.n_pos, r.n_neg) for r in spark.table("wells").collect()] == [(1, 1)]


def packed_lzw(raw):
    """Codes of 9 to 12 bits, highest bit first, widths one code early."""
    table, out, n, width, word = {bytes([i]): i for i in range(256)}, 256, 9, 9, b""
    following = 258
    for byte in raw:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        out, n = out << width | table[word], n + width
        table[word + bytes([byte])] = following
        following, word = following + 1, bytes([byte])
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            out, n = out << width | 256, n + width
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
    for code in [table[word]] * bool(word):
        out, n = out << width | code, n + width
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    out, n = out << width | 257, n + width
    return (out << (-n % 8)).to_bytes((n + 7) // 8, "big")


def packed_bits(raw):
    return b"".join(bytes([min(128, len(raw) - i) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))


@pytest.mark.parametrize("code,pack", [(8, zlib.compress), (5, packed_lzw), (32773, packed_bits)])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("differences", [False, True])
def test_packed_geotiff(code, pack, tiled, differences):
    z = np.random.default_rng(1).integers(0, 60, (37, 50)).astype("<u2")
    w, h = (16, 16) if tiled else (50, 10)
    parts = []
    for top in range(0, 37, h):
        for left in range(0, 50, w):
            part = np.zeros((h, w), "<u2") if tiled else np.zeros((min(h, 37 - top), w), "<u2")
            cut = z[top : top + h, left : left + w]
            part[: cut.shape[0], : cut.shape[1]] = cut
            if differences:
                part[:, 1:] = part[:, 1:] - part[:, :-1]
            parts.append(pack(part.tobytes()))
    starts = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    tags = [(256, 3, [50]), (257, 3, [37]), (258, 3, [16]), (259, 3, [code]), (277, 3, [1]), (317, 3, [2 if differences else 1]), (339, 3, [1])]
    tags += [(322, 3, [16]), (323, 3, [16]), (324, 4, starts), (325, 4, list(map(len, parts)))] if tiled else [(273, 4, starts), (278, 3, [h]), (279, 4, list(map(len, parts)))]
    tags += [(33550, 12, (2.0, 2.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 10.0, 90.0, 0.0))]
    body = b"".join(parts)
    at = 8 + len(body)
    extra, entries, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", after + len(extra)), extra + raw
        entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    raw = b"II" + struct.pack("<HI", 42, at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
    g = grids.geotiff(raw)
    np.testing.assert_array_equal(g["z"], z[::-1])
    f = gridfiles.pa.BufferReader(raw)
    for lo, hi in ((0, 5), (7, 8), (11, 30), (36, 37)):
        np.testing.assert_array_equal(gridfiles.rows_of(f, gridfiles.HEADERS["geotiff"](f), lo, hi), z[::-1][lo:hi])
    assert (g["xmin"], g["ymax"]) == (11.0, 89.0)


def test_percentiles_of_any_size(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 3000).astype(str), "v": np.round(rng.normal(size=3000), 1)})
    frame.loc[rng.random(3000) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).unionByName(spark.sql("SELECT 'none' AS k, cast(null as double) AS v")).repartition(7)
    at = [0.0, 0.02, 0.25, 0.5, 0.777, 1.0]
    got = {r.k: r for r in ranks.percentiles(df, "v", at, "k").collect()}
    for k, part in frame.dropna().groupby("k"):
        np.testing.assert_allclose(got[k].p, np.percentile(part["v"], np.array(at) * 100))
        assert got[k].n == len(part)
    assert got["none"].n == 0 and set(got["none"].p) == {None}
    np.testing.assert_allclose(ranks.percentiles(df, "v", [0.3]).first().p[0], np.percentile(frame["v"].dropna(), 30))


def test_row_numbers(spark):
    got = ranks.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9), "n", F.desc("v")).collect()
    assert {r.v: r.n for r in got} == {v: 999 - v for v in range(1000)}


def test_neighbours_by_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (70, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 4), (99, None)], "id long, vec array<double>").repartition(5)
    for cell_rows, block_rows in ((256, 1024), (9, 1024), (9, 4), (1, 3)):
        got = {(r.id, r["rank"]): (r.other, r.d2) for r in sampling.neighbours(df, 6, cell_rows=cell_rows, block_rows=block_rows).collect()}
        for i in range(70):
            want = sorted((float(((v[i] - v[j]) ** 2).sum()), j) for j in range(70) if j != i)[:6]
            assert [got[i, k + 1] for k in range(6)] == [(j, d) for d, j in want]


def test_suppression_keeps_what_greedy_keeps(spark):
    rng = np.random.default_rng(6)
    rows = [("a", int(r), int(c), float(s), k) for k, (r, c, s) in enumerate(zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), np.round(rng.random(400), 2)))]
    df = spark.createDataFrame(rows, "target_type string, row int, col int, max_score double, component long")
    kept = []
    for _, r, c, s, k in sorted(rows, key=lambda x: (-x[3], x[4])):
        if len(kept) < 6 and all(abs(r - a) >= 4 or abs(c - b) >= 4 for a, b, _ in kept):
            kept.append((r, c, k))
    assert [(r.row, r.col, r.component) for r in targets.suppressed(df, 6, 4).orderBy("rank").collect()] == kept


@pytest.mark.parametrize("cols", [list(range(30)), [c for c in range(30) if c % 7 != 3]])
def test_filling_long_lines(spark, cols):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(8, 30))
    z[rng.random(z.shape) < 0.9] = np.nan
    cells = frame(spark, z).where(F.col("col").isin(cols))
    full = [(r["row"], r["col"], r.z) for r in cells.where("z is not null").collect()]
    for r in grid.fill_nearest(cells).collect():
        assert r.z == min(full, key=lambda p: ((p[0] - r["row"]) ** 2 + (p[1] - r["col"]) ** 2, p[0], p[1]))[2]


def test_resampling_with_missing_cells(spark):
    z = np.arange(12.0).reshape(3, 4)
    z[1, 2] = np.nan
    cells, layers = grids.array_layer(spark, z, range(4), range(3), "a")
    full = array(grid.resample(cells, layers, Grid(0.0, 3.0, 0.0, 2.0, 7, 5)), "z", (5, 7))
    thin = array(grid.resample(cells.where("z is not null"), layers, Grid(0.0, 3.0, 0.0, 2.0, 7, 5)), "z", (5, 7))
    np.testing.assert_array_equal(full, thin)
    assert np.isnan(full[2, 4]) and np.isnan(full[1, 3]) and full[0, 3] == 1.5 and full[2, 2] == 5.0 and np.isnan(full).sum() == 9


def test_layers_on_their_own_grids(spark):
    g = Grid(0.0, 39.0, 0.0, 29.0, 40, 30)
    z = np.add.outer(np.arange(30.0), 2 * np.arange(40.0))
    z[10:14, 20:25] = np.nan
    cells = frame(spark, z, "gravity_x")
    own = synthetic.own_grids(["gravity_x", "geochemistry_cu"], g)
    assert own == synthetic.own_grids(["gravity_x", "geochemistry_cu"], g) and own["geochemistry_cu"].nx == 20 and 30 <= own["gravity_x"].nx <= 44
    h = own["gravity_x"]
    got = array(synthetic.on_own_grids(cells, g, {"gravity_x": h}), "z", (h.ny, h.nx))
    for r in range(h.ny):
        for c in range(h.nx):
            x, y = h.xmin + c * h.dx, h.ymin + r * h.dy
            if not (0 <= x <= 39 and 0 <= y <= 29):
                assert np.isnan(got[r, c])
            elif not (8 <= y <= 15 and 18 <= x <= 26):
                assert got[r, c] == pytest.approx(y + 2 * x)
    assert np.isnan(got).any()


def test_survey_is_saved(spark, tmp_path):
    cells, layers = grids.array_layer(spark, np.array([[1.0, np.nan], [3.0, 4.0]]), [0, 10], [0, 5], "a")
    wells = spark.sql("SELECT 1.0D AS x, 2.0D AS y, 1 AS label")
    with pytest.warns(UserWarning):
        saved = sinks.save_survey(cells, layers, wells, str(tmp_path / "s"), ["csv", "netcdf", "surfer_grd", "csv"], "mineral", "demo")
    assert [x.rsplit("/", 1)[-1] for x in saved] == ["csv", "surfer_grd", "wells"]
    assert spark.read.csv(saved[0], header=True).columns == ["X", "Y", "value", "layer"]
    assert spark.read.csv(saved[2], header=True).first().asDict() == {"X": "1.0", "Y": "2.0", "LABEL": "1", "TARGET_TYPE": "mineral", "SCENARIO": "demo"}
    assert sinks.stamped("report", datetime(2024, 3, 1, 9, 5)) == "report_20240301_0905"


def test_chart_tables(spark):
    t = spark.createDataFrame([(i, 10.0 * i, 5.0, 0.9, 0.8, 0.1) for i in range(1, 13)], "rank int, x double, y double, max_probability double, max_score double, mean_uncertainty double")
    assert [(r.name, r.colour) for r in charts.marks(t).orderBy("x").collect()] == [(f"T{i}", i - 1) for i in range(1, 11)]
    assert charts.bars(t).count() == 12 and charts.comparison({"a": t, "b": t}, 3).count() == 6
    assert {(r.x, r.marker) for r in charts.overlay(spark.sql("SELECT * FROM VALUES (1, 0, 1), (2, 0, 0), (3, 0, 7) AS w(x, y, label)")).collect()} == {(1, "up"), (2, "down")}
    assert charts.importance_bars(spark, [("mag__win_std", 0.5)]).first().asDict() == {"label": "mag\nwin std", "importance": 0.5}


@pytest.mark.parametrize("few,reach,most", [(10_000, 0.01, 1 << 22), (50, 0.01, 1 << 22), (50, -0.02, 1 << 22), (50, 0.01, 3)])
def test_percentiles_by_brackets(spark, monkeypatch, few, reach, most):
    """Whole groups, brackets, ranks that miss their brackets, brackets with too many values: always the same percentiles."""
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(size=20_000), "ties": rng.integers(0, 7, 15_000).astype(float), "one": np.full(12_000, 3.5), "few": rng.normal(size=9), "two": np.array([1.0, 2.0]), None: rng.exponential(size=11_000)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("few", None)] * 5 + [("none", None)]
    df = spark.createDataFrame(rows, "_n string, v double").repartition(6)
    at = [0.0, 0.02, 0.5, 0.8, 0.98, 1.0]
    asked = []
    monkeypatch.setattr(ranks, "_by_ranges", lambda *a, f=ranks._by_ranges: asked.append(1) or f(*a))
    for name, value in (("FEW", few), ("REACH", reach), ("MOST", most)):
        monkeypatch.setattr(ranks, name, value)
    got = {r["k"]: r for r in ranks.percentiles(df.withColumnRenamed("_n", "k"), "v", at, "k").collect()}
    for k, x in groups.items():
        assert got[k].n == len(x)
        np.testing.assert_allclose(got[k].p, np.percentile(x, [100 * q for q in at]))
    assert got["none"].n == 0 and got["none"].p == [None] * len(at) and len(got) == len(groups) + 1
    assert bool(asked) == (reach < 0 or most == 3)
    every = np.concatenate(list(groups.values()))
    r = ranks.percentiles(df, "v", [0.3, 0.999]).first()
    assert r.n == len(every)
    np.testing.assert_allclose(r.p, np.percentile(every, [30, 99.9]))


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 500, p=[0.8, 0.15, 0.05]), "v": rng.permutation(500)})
    frame.loc[:20, "k"] = None
    df = spark.createDataFrame([(None if pd.isna(k) else k, int(v)) for k, v in frame.itertuples(index=False)], "k string, v int").repartition(9)
    got = ranks.numbered(df, "place", "v", within=("k",), total="n").toPandas()
    for k, part in got.groupby(got["k"].fillna("null")):
        assert (part.sort_values("v")["place"].to_numpy() == np.arange(len(part))).all() and (part["n"] == len(part)).all()
    every = ranks.numbered(df, "place", "v").toPandas().sort_values("v")
    assert list(every["place"]) == list(range(500))


def test_neighbours_of_clusters_skip_far_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 50
    size = np.r_[1500, rng.integers(1, 60, 39)]  # one cluster holds more than half of the rows
    v = np.concatenate([c + rng.normal(size=(n, 6)) for c, n in zip(centres, size)])
    v[10:20] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(6)
    work = nearest.compared(df, 5, cell_rows=40, block_rows=200).first()
    assert work.n == len(v) and work.distances < len(v) ** 2 / 1.5
    d2 = nearest.squared(v, v)
    d2[np.arange(len(v)), np.arange(len(v))] = np.inf
    want = {(i, k + 1): (int(j), float(d2[i, j])) for i in range(len(v)) for k, j in enumerate(np.lexsort((np.arange(len(v)), d2[i]))[:5])}
    assert {(r.id, r["rank"]): (r.other, r.d2) for r in nearest.neighbours(df, 5, cell_rows=40, block_rows=200).collect()} == want
    even = np.concatenate([c + rng.normal(size=(50, 6)) for c in centres])
    even_df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(even)], "id long, vec array<double>")
    work = nearest.compared(even_df, 5, cell_rows=20).first()
    assert work.distances < work.n**2 / 8
    assert nearest.neighbours(df.where("id < 0")).count() == 0 and nearest.compared(df.where("id < 0")).first().distances == 0


def test_neighbours_shuffle_no_vector_for_a_pair(spark):
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    v = np.random.default_rng(11).normal(size=(2000, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables beyond it
    try:
        before = sent()
        assert nearest.neighbours(df, 5, cell_rows=20, block_rows=100).count() == 10000
        assert sent() - before < 6 * v.nbytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("kind", ["copies", "near copies", "far", "mixed"])
def test_neighbours_whatever_products_round(spark, kind):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(600, 8))
    if kind in ("copies", "near copies"):
        v[:300] = v[0] + rng.normal(size=(300, 8)) * (1e-9 if kind == "near copies" else 0)
    v = {"far": v * 1e-3 + 1e6, "mixed": v * 10.0 ** rng.integers(-8, 8, (600, 1))}.get(kind, v)
    ids = rng.permutation(600) - 100
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)] + [(9999, [float("nan")] * 8)], "id long, vec array<double>").repartition(3)
    d2 = nearest.squared(v, v)
    d2[np.arange(600), np.arange(600)] = np.inf
    want = {(int(ids[i]), n + 1): (int(ids[j]), float(d2[i, j])) for i in range(600) for n, j in enumerate(np.lexsort((ids, d2[i]))[:5])}
    assert {(r.id, r["rank"]): (r.other, r.d2) for r in nearest.neighbours(df, 5, cell_rows=30, block_rows=120).collect()} == want


@pytest.mark.parametrize("by", [(), ("k",)])
def test_curves_of_any_size(spark, by):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"k": rng.choice(["a", "b"], 4000, p=[0.9, 0.1]), "prob": np.round(rng.random(4000), 3), "label": (rng.random(4000) < 0.2).astype(int)})
    df = spark.createDataFrame(frame).repartition(9)
    got = metrics.curve(df, *by).toPandas()
    for k, part in frame.groupby("k") if by else [(None, frame)]:
        mine = got[got.k == k] if by else got
        mine = mine.sort_values("prob", ascending=False)
        at = np.sort(part.prob.unique())[::-1]
        tp = np.array([((part.prob >= p) & (part.label == 1)).sum() for p in at])
        fp = np.array([((part.prob >= p) & (part.label == 0)).sum() for p in at])
        assert (mine.prob.to_numpy() == at).all() and (mine.tp.to_numpy() == tp).all() and (mine.fp.to_numpy() == fp).all()
        np.testing.assert_allclose(mine.recall, tp / tp[-1])


def test_no_task_gets_all_rows(spark):
    """Curves, folds and suppression bring rows of one key together by ranges or shares, not through one partition."""
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 0.37 % 1).alias("prob"), "id").repartition(4)
    seen = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in seen(sampling.folds(df, 3, "id"))
    got = sampling.folds(df, 3, "id").toPandas()
    for _, part in got.groupby("label"):
        assert (part.sort_values("id")["fold"].to_numpy() == np.arange(len(part)) % 3).all()


def test_labels_of_winding_components():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.55, 0.6, 0.9):
        mask = rng.random((60, 45)) < share
        rows, cols = np.nonzero(mask)
        got = targets._tile_labels(pd.DataFrame({"row": rows, "col": cols}).sample(frac=1, random_state=1), 45)
        label = {(r, c): n for r, c, n in zip(got.row, got.col, got.component)}
        want = {}
        for r, c in zip(rows.tolist(), cols.tolist()):
            if (r, c) in want:
                continue
            todo, want[r, c] = [(r, c)], r * 45 + c
            while todo:
                y, x = todo.pop()
                for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if at not in want and 0 <= at[0] < 60 and 0 <= at[1] < 45 and mask[at]:
                        want[at] = r * 45 + c
                        todo.append(at)
        assert label == want


def labelled(spark, n=1200, parts=5):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(n, 5)), 2)
    y = ((x[:, 0] * x[:, 1] > 0.3) | (x[:, 2] > 1.4)).astype(float)
    rows = [(i * 7, float(b), 1.0 + (i % 3), i % 5 == 0, a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, rows, spark.createDataFrame(rows, "id long, y double, w double, held boolean, x array<double>").repartition(parts)


def area(p, y):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def plain_boost(bins, y, w, held, rounds, rate, depth, least, l2, patience):
    """Boosting row by row: trees as nested tuples, splits by trying every one."""
    use = ~held
    start = np.log((w * y)[use].sum() / (w * (1 - y))[use].sum())
    raw, losses = np.full(len(y), start), []

    def split(rows, left):
        p = 1 / (1 + np.exp(-raw[rows]))
        g, h = w[rows] * (p - y[rows]), w[rows] * p * (1 - p)
        value = -rate * g.sum() / (h.sum() + l2)
        best = (0.0, None)
        for f in range(bins.shape[1]) if left else []:
            for b in range(bins[:, f].max() + 1):
                lo = bins[rows, f] <= b
                if lo.sum() >= least and (~lo).sum() >= least:
                    gain = g[lo].sum() ** 2 / (h[lo].sum() + l2) + g[~lo].sum() ** 2 / (h[~lo].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
                    if round(gain, 9) > best[0]:
                        best = (round(gain, 9), (f, b))
        if best[1] is None:
            return value
        f, b = best[1]
        lo = bins[rows, f] <= b
        return f, b, split(rows[lo], left - 1), split(rows[~lo], left - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for r in range(rounds + 1):
        if held.any():
            losses.append(((w * (np.logaddexp(0, raw) - y * raw))[held]).sum() / w[held].sum())
        if r == rounds or (len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience])):
            return raw, losses
        tree = split(np.flatnonzero(use), depth)
        raw = raw + np.array([value(tree, b) for b in bins])


def test_boosting_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 3)
    x, y, rows, df = labelled(spark, 400)
    w, held = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    model = trees.boost(df, 5, 7, 0.3, 3, 8, 0.5, 25, 12)
    raw, losses = plain_boost(trees.cells(x, model.cuts), y, w, held, 7, 0.3, 3, 8, 0.5, 25)
    np.testing.assert_allclose(model.predict(x), 1 / (1 + np.exp(-raw)), rtol=1e-8)
    np.testing.assert_allclose(model.losses, losses, rtol=1e-8)
    monkeypatch.setattr(trees, "FEW_TASKS", 0)  # histograms added up by an exchange
    np.testing.assert_allclose(trees.boost(df, 5, 2, 0.3, 3, 8, 0.5, 25, 12).predict(x), 1 / (1 + np.exp(-plain_boost(trees.cells(x, model.cuts), y, w, held, 2, 0.3, 3, 8, 0.5, 25)[0])), rtol=1e-8)


def test_equal_rows_add_up_few_distances(monkeypatch):
    """Of a block's many equal rows a run of columns settles each, and their distances to the rest aren't added up; ids that repeat aren't neighbours."""
    rng = np.random.default_rng(4)
    v, ids = rng.normal(size=(1700, 6)), np.r_[rng.permutation(1690), np.arange(10)]
    v[50:1650] = v[7]
    cell, looked = np.zeros(850, np.int32), []
    bounds = (v[7:8], np.array([0]), np.zeros(1), np.sqrt(((v - v[7]) ** 2).sum(1).max(keepdims=True)) * (1 + 1e-9))
    halves = [np.sort(x) for x in np.split(rng.permutation(1700), 2)]
    halves = [x[np.argsort(ids[x], kind="stable")] for x in halves]
    monkeypatch.setattr(nearest, "_of_pairs", lambda a, i, b, j, f=nearest._of_pairs: looked.append(len(i)) or f(a, i, b, j))
    for order in (1, -1):  # its own half first or last
        for k, own in enumerate(halves):
            lists = nearest._Lists(cell, ids[own], v[own], 5, bounds)
            looked.clear()
            for other in (own, halves[1 - k])[::order]:
                lists.meet(cell, ids[other], v[other])
            assert sum(looked) < 0.8 * 850 * 850
            d2 = nearest.squared(v[own], v)
            d2[ids[own][:, None] == ids] = np.inf
            best = np.lexsort((np.broadcast_to(ids, d2.shape), d2), axis=1)[:, :5]
            assert (lists.other == ids[best]).all() and (lists.d2 == np.take_along_axis(d2, best, 1)).all()


def test_blocks_are_dealt_evenly(spark, monkeypatch):
    """A file has no more blocks than its share, and blocks are put together where they were dealt to."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 4))
    v[:300] = v[0]
    df = spark.createDataFrame([(i % 880, x.tolist()) for i, x in enumerate(v)] + [(None, v[1].tolist()), (901, None)], "id long, vec array<double>").repartition(3)
    plans = []
    monkeypatch.setattr(nearest, "stored", lambda d, name, f=nearest.stored: plans.append(d._jdf.queryExecution().executedPlan().toString()) or f(d, name))
    for files in (1024, 4):
        monkeypatch.setattr(nearest, "MOST_FILES", files)
        blocks = nearest.cells(df, "id", "vec", 30, 60).blocks
        n, per_file = blocks.count(), [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
        assert n >= 15 and len(per_file) == min(n, files) and max(per_file) == -(-n // files)
        assert blocks.agg(F.sum(F.length("ids")), F.count_distinct("block")).first()[:] == (8 * 900, n)
        assert "hashpartitioning(block" not in plans[-1]


def test_boosting_reads_equal_rows_once(spark, monkeypatch):
    """Levels read a row for each y, held and bins; the model is that of all rows, with missing features, labels of one kind held, ids that repeat and weights of 0."""
    rng = np.random.default_rng(8)
    rows = [(int(i % 300), float(v[0] + v[1] > rng.integers(2, 8)), float(i % 4) / 2, bool(i % 5 == 0), [float(v[0]), None if i % 17 == 0 else float(v[1])]) for i, v in enumerate(rng.integers(0, 6, (600, 2)))]
    df = spark.createDataFrame(rows, "id long, y double, w double, held boolean, x array<double>").repartition(3)
    read = []
    monkeypatch.setattr(trees, "prepared", lambda *a, f=trees.prepared: read.append(f(*a)) or read[-1])
    model = trees.boost(df, 2, 4, 0.3, 2, 9, 0.5, 25, 8)
    assert read[0].count() <= 2 * 2 * 6 * 7 < 300 and read[0].agg(F.sum("n"), F.sum("w")).first()[:] == (600, sum(r[2] for r in rows))
    x = np.array([[np.nan if v is None else v for v in r[4]] for r in rows])
    y, w, held = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    raw, losses = plain_boost(trees.cells(x, model.cuts), y, w, held, 4, 0.3, 2, 9, 0.5, 25)
    np.testing.assert_allclose(model.predict(x), 1 / (1 + np.exp(-raw)), rtol=1e-8)
    np.testing.assert_allclose(model.losses, losses, rtol=1e-8)
    # A missing label or weight isn't 0: it shows in all sums of its bins, merged or not.
    for odd in (df.withColumn("y", F.expr("if(id = 7, null, y)")), df.withColumn("w", F.expr("if(id = 7, null, w)"))):
        made = []
        for few in (trees.FEW_BINNED, 0):
            monkeypatch.setattr(trees, "FEW_BINNED", few)
            made.append(trees.boost(odd, 2, 2, 0.3, 2, 9, 0.5, 25, 8))
        monkeypatch.undo()
        np.testing.assert_allclose(*[m.predict(x) for m in made], rtol=1e-8)
        np.testing.assert_allclose(*[m.losses for m in made], rtol=1e-8)


def test_edges_leave_values_where_they_are(spark, monkeypatch):
    """The brackets of the few places go to the values; values don't meet by place, which would be a task a feature."""
    rows = spark.createDataFrame([(i, [float(i), None if i % 9 == 0 else float(i % 7), None]) for i in range(200)] + [(1, None), (2, [])], "id long, x array<double>").repartition(3)
    plans, key = [], "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(ranks, "stored", lambda df, *a, f=ranks.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *a))
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        cuts = trees.edges(rows, 4, 8)
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        each = rows.select(F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"), F.get("x", F.lit(1)).alias("v"))  # with a null key
        few, many = (sorted(ranks.percentiles(each, "v", [0.1, 0.5], "k", few=x).collect(), key=repr) for x in (True, False))
    finally:
        spark.conf.set(key, kept)
    assert few == many and len(few) == 3
    np.testing.assert_allclose(cuts[0], np.quantile(np.arange(200), np.arange(1, 8) / 8))
    assert cuts[1].tolist() == np.unique(np.quantile([i % 7 for i in range(200) if i % 9], np.arange(1, 8) / 8)).tolist() and not len(cuts[2]) and not len(cuts[3])


def test_boosting_stops_without_gain(spark):
    x, y, rows, df = labelled(spark, 300)
    noise = df.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("double"))
    model = trees.boost(noise, 5, 60, 0.5, 2, 5, 0.1, 4, 8)
    assert len(model.trees) < 60 and min(model.losses[-4:]) >= min(model.losses[:-4])
    assert trees.unpacked(trees.packed(model)).predict(x).tolist() == model.predict(x).tolist()


def test_boosting_ranks_well(spark):
    x, y, rows, df = labelled(spark)
    model = trees.boost(df, 5, 25, 0.2, 4, 5, 0.1)
    held = np.array([r[3] for r in rows])
    assert area(model.predict(x)[held], y[held]) > 0.93


def test_forest_out_of_bag_equals_a_plain_loop(spark):
    x, y, rows, df = labelled(spark, 500)
    forest = trees.grow(df, 5, trees=25, depth=6, least=2, split_least=4, bins=16)
    bins, ids = trees.cells(x, forest.cuts), np.array([r[0] for r in rows])
    votes = [[] for _ in ids]
    for t, tree in enumerate(forest.trees):
        k = trees.drawn(ids, t, 42)
        ends = {}
        for i in range(len(ids)):
            node = 0
            while tree.feature[node] >= 0:
                assert tree.feature[node] in trees.subset(5, 2, t, node, 42)
                node = 2 * node + 1 + int(bins[i, tree.feature[node]] > tree.cut[node])
            if k[i]:
                ends.setdefault(node, []).append(i)
            else:
                votes[i].append(tree.value[node])
        own = [k[y == c].sum() for c in (0, 1)]
        for node, held in ends.items():
            p, q = (sum(k[i] for i in held if y[i] == c) / own[c] for c in (1, 0))
            assert abs(tree.value[node] - p / (p + q)) < 1e-9 and len(held) >= 2
    seen = [i for i, v in enumerate(votes) if v]
    assert forest.oob == np.mean([(np.mean(votes[i]) > 0.5) == y[i] for i in seen])
    got = {r.id: r.vote for r in trees.out_of_bag(df, forest).collect()}
    assert all(abs(got[ids[i]] - np.mean(votes[i])) < 1e-12 for i in seen)
    assert forest.oob > 0.85 and area(forest.predict(x), y) > 0.97
    again = trees.grow(df.repartition(3), 5, trees=25, depth=6, least=2, split_least=4, bins=16)
    assert all((a.feature == b.feature).all() and (a.cut == b.cut).all() for a, b in zip(again.trees, forest.trees))
    assert 0.36 < np.mean(trees.drawn(np.arange(20_000), 3, 1) == 0) < 0.375


def test_levels_of_many_trees_go_by_portions(spark, monkeypatch):
    x, y, rows, df = labelled(spark, 300)
    whole = trees.grow(df, 5, trees=6, depth=4, bins=8)
    monkeypatch.setattr(trees, "MOST_CELLS", 60)
    parts = trees.grow(df, 5, trees=6, depth=4, bins=8)
    assert all((a.feature == b.feature).all() and np.allclose(a.value, b.value) for a, b in zip(whole.trees, parts.trees))


@pytest.mark.parametrize("window", [3, 5, 7, 9, 31])
def test_windows_of_any_width(spark, window):
    z = np.round(np.random.default_rng(window).normal(size=(23, 17)), 3) * 100
    cells = grids.array_layer(spark, z, np.arange(17), np.arange(23), "a")[0]
    got = stencil.window_stats(cells, window)
    r = window // 2
    mirrored = lambda i, n: (i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - (i % (2 * n))
    wide = z[[mirrored(i, 23) for i in range(-r, 23 + r)]][:, [mirrored(i, 17) for i in range(-r, 17 + r)]]
    view = np.lib.stride_tricks.sliding_window_view(wide, (window, window))
    np.testing.assert_allclose(array(got, "win_mean", z.shape), view.mean((2, 3)), atol=1e-9)
    np.testing.assert_allclose(array(got, "win_range", z.shape), view.max((2, 3)) - view.min((2, 3)), atol=1e-9)
    np.testing.assert_allclose(array(got, "win_std", z.shape), view.std((2, 3)), atol=1e-5)


def test_saved_transformers_keep_what_they_were_fitted_on(spark, tmp_path):
    rng = np.random.default_rng(11)
    long = lambda v: spark.createDataFrame([(i, f, float(x)) for f, c in v.items() for i, x in enumerate(c)], "i int, feature string, val double")
    first, second = {"a": rng.normal(size=300), "b": rng.exponential(size=300), "few": [1.0, 2.0]}, {"a": rng.normal(size=50) * 3, "b": rng.exponential(size=50), "few": [0.5], "new": [1.0]}
    transformers.RobustNormalizer(clip=5.0).fit(long(first)).save(str(tmp_path / "n"))
    model = transformers.RobustNormalizerModel.load(str(tmp_path / "n"))
    got = {(r.feature, r.i): r.val for r in model.transform(long(second)).collect()}
    assert {f for f, _ in got} == {"a", "b", "few"} and got["few", 0] == 0.5
    for f in "ab":
        lo, q1, mid, q3, hi = np.percentile(first[f], [5, 25, 50, 75, 95])
        np.testing.assert_allclose([got[f, i] for i in range(50)], np.clip((np.clip(second[f], lo, hi) - mid) / (q3 - q1), -5, 5))
    assert model.getOrDefault(model.clip) == 5.0
    with pytest.raises(RuntimeError, match="knows nothing yet"):
        transformers.RobustNormalizerModel().transform(long(second))
    with pytest.raises(RuntimeError, match="knows nothing yet"):
        transformers.CoRegistrationModel().grid  # noqa: B018
    z = rng.normal(size=(9, 11))
    cells, layers = grids.array_layer(spark, z, np.linspace(0, 100, 11), np.linspace(0, 80, 9), "m")
    transformers.CoRegistration(nx=6, ny=5).fit(transformers.described(cells, layers)).save(str(tmp_path / "c"))
    kept = transformers.CoRegistrationModel.load(str(tmp_path / "c"))
    assert kept.grid == Grid(0.0, 100.0, 0.0, 80.0, 6, 5)
    other, rows = grids.array_layer(spark, z * 2, np.linspace(0, 100, 11), np.linspace(0, 80, 9), "other")
    np.testing.assert_allclose(array(kept.transform(transformers.described(other, rows)), "z", (5, 6)), 2 * z[::2, ::2])
    assert kept.locate(spark.createDataFrame([(100.0, 0.0)], "x double, y double")).first().col == 5
    whole = transformers.CoRegistration().fit(transformers.described(cells, layers)).grid
    assert (whole.nx, whole.ny) == (11, 9)


def test_gradients_of_a_network():
    rng = np.random.default_rng(1)
    x, y, net = rng.normal(size=(40, 3)), (rng.random(40) < 0.4).astype(float), network.started([3, 7, 5, 1], 2)
    grads, loss = network.gradients(net, x, y)
    for a, g in zip(net, grads):
        for at in list(np.ndindex(a.shape))[:6]:
            held, d = a[at], 1e-6
            a[at] = held + d
            up = network.gradients(net, x, y)[1]
            a[at] = held - d
            down = network.gradients(net, x, y)[1]
            a[at] = held
            assert abs((up - down) / (2 * d) - g[at]) < 1e-4 * max(1, abs(g[at]))


@pytest.mark.parametrize("fan", [32, 2])
def test_steps_of_a_network_equal_plain_ones(spark, monkeypatch, fan):
    monkeypatch.setattr(network, "FAN", fan)  # with 2, partial gradients meet in a tree
    x, y, rows, df = labelled(spark, 300, 6)
    df = df.withColumn("fold", (F.col("id") % 2).cast("int"))
    steps, sizes = 3, [5, 8, 4, 1]
    got = network.train(df, sizes, 2, steps, 0.01, 0.1, share=0.0, tol=-1e9, seed=7)
    fold = np.array([r[0] % 2 for r in rows])
    for k in (0, 1):
        net, mine = network.started(sizes, 7 + k), fold != k
        first, second = ([np.zeros_like(a) for a in net] for _ in range(2))
        for t in range(1, steps + 1):
            grads = [(g + 0.1 * a * (a.ndim == 2)) / mine.sum() for g, a in zip(network.gradients(net, x[mine], y[mine])[0], net)]
            first = [0.9 * m + 0.1 * g for m, g in zip(first, grads)]
            second = [0.999 * v + 0.001 * g * g for v, g in zip(second, grads)]
            net = [a - 0.01 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8) for a, m, v in zip(net, first, second)]
        for a, b in zip(got[k], net):
            np.testing.assert_allclose(a, b, atol=1e-9)


def test_a_network_learns_and_stops(spark):
    x, y, rows, df = labelled(spark, 600)
    (net,) = network.train(df.withColumn("fold", F.lit(-1)), [5, 32, 16, 1], 1, 120, 0.02)
    assert area(network.margins(net, x), y) > 0.9
    noise = df.withColumns({"fold": F.lit(-1), "y": F.pmod(F.xxhash64("id"), F.lit(2)).cast("double")})
    assert len(network.train(noise, [5, 8, 1], 1, 400, 0.5, patience=3)) == 1


@pytest.mark.parametrize("method", ["linear", "cubic", "nearest"])
def test_tiles_equal_one_task(spark, method):
    """Points with a dense cluster and a bent outline, in tiles of 40, against a layer in one task."""
    from strata.operators import scatter

    rng = np.random.default_rng(11)
    x, y = np.r_[rng.random(500), rng.normal(0.3, 0.01, 250)], np.r_[rng.random(500), rng.normal(0.6, 0.01, 250)]
    keep = (x - 1) ** 2 + y**2 > 0.2
    frame_ = pd.DataFrame({"layer": "a", "x": x[keep], "y": y[keep], "z": rng.random(keep.sum())})
    frame_ = pd.concat([frame_, frame_.iloc[:5].assign(z=7.0), frame_.iloc[:1].assign(z=np.nan)])
    other = pd.DataFrame({"layer": "b", "x": [0.0, 1.0, 2.0], "y": [0.0, 1.0, 2.0], "z": [1.0, 2.0, 3.0]})
    got = scatter.gridded(spark.createDataFrame(pd.concat([frame_, other])), 37, 29, method, 0, tile_points=40).toPandas()
    assert len(got) == 2 * 37 * 29 and not got.duplicated(["layer", "row", "col"]).any()
    for want in (grid._interpolated(frame_.dropna(), 37, 29, method), grid._interpolated(other, 37, 29, method)):
        both = got.merge(want, on=["layer", "row", "col"])
        assert len(both) == len(want)
        np.testing.assert_allclose(both["z_x"], both["z_y"], atol=1e-7)


def test_tiles_of_few_points(spark):
    from strata.operators import scatter

    schema = "layer string, x double, y double, z double"
    assert scatter.gridded(spark.createDataFrame([], schema), 4, 3, "linear", 0).count() == 0
    one = spark.createDataFrame([("a", 1.0, 2.0, 5.0), (None, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0)], schema)
    assert {(r.row, r.col, r.z) for r in scatter.gridded(one, 2, 2, "cubic", 0).collect()} == {(i, j, 5.0) for i in (0, 1) for j in (0, 1)}
    # A lattice: four points on every circle, many on each line.
    lattice = spark.createDataFrame([("a", float(i), float(j), 2.0 * i - j) for i in range(20) for j in range(20)], schema)
    got = array(scatter.gridded(lattice, 39, 39, "linear", 0, tile_points=30), "z", (39, 39))
    np.testing.assert_allclose(got, np.arange(39)[None] * 1.0 - np.arange(39)[:, None] / 2, atol=1e-9)


def test_wide_gaps_are_filled(spark):
    """Few values, an absent column, and many ties, against a search of all values."""
    rng = np.random.default_rng(4)
    z = np.where(rng.random((40, 70)) < 0.02, rng.integers(0, 1000, (40, 70)).astype(float), np.nan)
    z[:, 30:55] = np.nan
    cells = frame(spark, z).where("col <> 12")
    got = {(r.row, r.col): r.z for r in grid.fill_nearest(cells).collect()}
    r, c = np.nonzero(~np.isnan(z))
    r, c = r[c != 12], c[c != 12]
    assert len(got) == 40 * 69
    for i, j in got:
        k = np.lexsort((c, r, (r - i) ** 2 + (c - j) ** 2))[0]
        assert got[i, j] == z[r[k], c[k]]


def test_tiles_need_their_rounds(spark, monkeypatch):
    """Without what the joins across borders find, tiles give other values than a layer in one task."""
    from strata.operators import scatter

    rng = np.random.default_rng(3)
    frame_ = pd.DataFrame({"layer": "a", "x": rng.random(300) ** 3, "y": rng.random(300), "z": rng.random(300)})
    found = scatter._inside
    monkeypatch.setattr(scatter, "HALO", 0.0)
    points, want = spark.createDataFrame(frame_), grid._interpolated(frame_, 25, 25, "linear")

    def off():
        got = scatter.gridded(points, 25, 25, "linear", 0, tile_points=40).toPandas().merge(want, on=["layer", "row", "col"])
        return len(got), np.abs(got["z_x"] - got["z_y"]).max()

    n, least = off()
    assert n == 625 and least < 1e-7
    monkeypatch.setattr(scatter, "_inside", lambda own, asked: found(own, asked).limit(0))
    assert off()[1] > 0.01
