"""Neighbourhood operators on grids, as passes over whole rows and then whole columns.

cells: layer, row, col and one or more value columns, every cell of a layer present. A pass gathers each line into an
array and works on it inside the JVM; all kernels wanted of a line are computed in the same pass, so any number of
filters costs two shuffles of the grid. Lines are at most as long as a grid is wide. Outside the grid, values are mirrored
at the edge (d c b a | a b c d | d c b a).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("layer", "row", "col")


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights of radius int(truncate * sigma + 0.5)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _mirrored(i: Column, n: Column) -> Column:
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _extended(values: Column, radius: int) -> Column:
    n = F.size(values)
    return F.transform(F.sequence(F.lit(-radius), n - 1 + radius), lambda i: F.get(values, _mirrored(i, n)))


def _convolved(values: Column, weights: list[float]) -> Column:
    n, taps = F.size(values), F.array(*[F.lit(w) for w in weights])
    one = lambda line, c: F.aggregate(F.sequence(F.lit(0), F.lit(len(weights) - 1)), F.lit(0.0), lambda acc, k: acc + F.get(taps, k) * F.get(line, c + k))
    return _let(_extended(values, len(weights) // 2), lambda line: F.transform(F.sequence(F.lit(0), n - 1), lambda c: one(line, c)))


def _paired(level: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """From the joins of `step` values that begin at each place those of twice as many."""
    return F.transform(F.sequence(F.lit(0), F.size(level) - 1 - step), lambda i: join(F.get(level, i), F.get(level, i + step)))


def _extreme(values: Column, radius: int, largest: bool) -> Column:
    """Largest or smallest of each window of 2 radius + 1: two overlapping stretches of a power of two, which double from
    level to level, so the work grows with the logarithm of the window."""
    join, w, each = F.greatest if largest else F.least, 2 * radius + 1, F.sequence(F.lit(0), F.size(values) - 1)

    def build(level: Column, step: int) -> Column:
        if 2 * step > w:
            return F.transform(each, lambda i: join(F.get(level, i), F.get(level, i + (w - step))))
        return _let(_paired(level, step, join), lambda more: build(more, 2 * step))

    return _let(_extended(values, radius), lambda line: build(line, 1))


def _mean(values: Column, radius: int) -> Column:
    """Mean of each window of 2 radius + 1: sums of stretches of powers of two, one for each binary digit of the window. Nothing
    is subtracted, so nothing is lost by cancelling."""
    w, each = 2 * radius + 1, F.sequence(F.lit(0), F.size(values) - 1)

    def build(level: Column, step: int, total: Column | None, done: int) -> Column:
        if step > w:
            return F.transform(total, lambda x: x / w)

        def onward(so_far: Column | None, covered: int) -> Column:
            if 2 * step > w:
                return build(level, 2 * step, so_far, covered)
            return _let(_paired(level, step, lambda a, b: a + b), lambda more: build(more, 2 * step, so_far, covered))

        if not w & step:
            return onward(total, done)
        if total is None:
            return _let(F.transform(each, lambda i: F.get(level, i)), lambda t: onward(t, step))
        return _let(F.transform(each, lambda i: F.get(total, i) + F.get(level, i + done)), lambda t: onward(t, done + step))

    return _let(_extended(values, radius), lambda line: build(line, 1, None, 0))


def _difference(values: Column, step: float) -> Column:
    """Central inside, one-sided at both ends; 0 on a line of one cell."""
    n = F.size(values)
    at = lambda i: F.get(values, F.least(F.greatest(i, F.lit(0)), n - 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.when(n == 1, 0.0).otherwise((at(c + 1) - at(c - 1)) / (F.when((c == 0) | (c == n - 1), 1.0).otherwise(2.0) * step)))


def _pass(cells: DataFrame, along: str, made: dict) -> DataFrame:
    """Adds columns computed from whole lines along `along` ("col" or "row"); made: name -> function of {column: array}."""
    across = "row" if along == "col" else "col"
    values = [c for c in cells.columns if c not in KEYS]
    lines = cells.groupBy("layer", across).agg(F.array_sort(F.collect_list(F.struct(along, *values))).alias("l"))
    arrays = {c: F.col(f"l.{c}") for c in values}
    lines = lines.select("layer", across, F.col(f"l.{along}").alias("at"), *[arrays[c].alias(c) for c in values])
    lines = lines.select("*", *[f({c: F.col(c) for c in values}).alias(name) for name, f in made.items()])
    names = ["at", *values, *made]
    out = lines.select("layer", across, F.explode(F.arrays_zip(*names)).alias("x"))
    return out.select("layer", across, F.col("x.at").alias(along), *[F.col(f"x.{c}").alias(c) for c in names[1:]]).select(*KEYS, *names[1:])


def _name(sigma: float) -> str:
    return f"g{sigma:g}".replace(".", "_")


def smoothed(cells: DataFrame, sigmas: list[float], value: str = "z") -> DataFrame:
    """cells with a column of the Gaussian smooth for each sigma (g1_5 for 1.5)."""
    keep = [c for c in cells.columns if c not in KEYS]
    rows = _pass(cells, "col", {"_h" + _name(s): (lambda a, s=s: _convolved(a[value], kernel(s))) for s in sigmas})
    done = _pass(rows, "row", {_name(s): (lambda a, s=s: _convolved(a["_h" + _name(s)], kernel(s))) for s in sigmas})
    return done.select(*KEYS, *keep, *[_name(s) for s in sigmas])


def gradient(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, value: str = "z") -> DataFrame:
    """cells with gx and gy; windows over lines, so a null neighbour makes a null."""
    out = cells
    for name, across, along, step in (("gx", "row", "col", dx), ("gy", "col", "row", dy)):
        line = Window.partitionBy("layer", across).orderBy(along)
        after, before, here = F.lead(value).over(line), F.lag(value).over(line), F.col(value)
        first, last = F.lag(along).over(line).isNull(), F.lead(along).over(line).isNull()
        out = out.withColumn(name, F.when(first & last, F.lit(0.0)).when(first, (after - here) / step).when(last, (here - before) / step).otherwise((after - before) / (2.0 * step)))
    return out


def horizontal_gradient(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    return gradient(cells, dx, dy).select(*KEYS, F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("hgrad"))


def upward_continuation(cells: DataFrame, height_ratio: float = 2.0) -> DataFrame:
    """Approximation by a smooth of sigma 1.5 x height ratio."""
    return smoothed(cells, [1.5 * height_ratio]).select(*KEYS, F.col(_name(1.5 * height_ratio)).alias("upward"))


def regional_residual(cells: DataFrame, sigma: float = 8.0) -> DataFrame:
    return smoothed(cells, [sigma]).select(*KEYS, F.col(_name(sigma)).alias("regional"), (F.col("z") - F.col(_name(sigma))).alias("residual"))


def first_vertical_derivative(cells: DataFrame) -> DataFrame:
    return smoothed(cells, [0.5, 2.0]).select(*KEYS, (F.col("g0_5") - F.col("g2")).alias("fvd"))


def analytic_signal(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    g = gradient(smoothed(cells, [0.8, 2.5]), dx, dy)
    return g.select(*KEYS, F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + (F.col("g0_8") - F.col("g2_5")) ** 2).alias("analytic_signal"))


def tilt_angle(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    g = gradient(smoothed(cells, [0.8, 2.5]), dx, dy)
    return g.select(*KEYS, F.atan2(F.col("g0_8") - F.col("g2_5"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) + 1e-10).alias("tilt"))


def local_wavenumber(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    g = gradient(tilt_angle(cells, dx, dy).withColumnRenamed("tilt", "z"), dx, dy)
    return g.select(*KEYS, F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("wavenumber"))


def sobel(cells: DataFrame) -> DataFrame:
    """Magnitude of the two Sobel responses."""
    rows = _pass(cells, "col", {"_d": lambda a: _convolved(a["z"], [-1.0, 0.0, 1.0]), "_s": lambda a: _convolved(a["z"], [1.0, 2.0, 1.0])})
    done = _pass(rows, "row", {"sx": lambda a: _convolved(a["_d"], [1.0, 2.0, 1.0]), "sy": lambda a: _convolved(a["_s"], [-1.0, 0.0, 1.0])})
    return done.select(*KEYS, F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2).alias("edge"))


def window_stats(cells: DataFrame, window: int = 5) -> DataFrame:
    """Mean, standard deviation and range in a square window of odd width, 3 at least."""
    w = max(3, window | 1)
    r = w // 2
    rows = _pass(cells, "col", {"_m": lambda a: _mean(a["z"], r), "_q": lambda a: _mean(F.transform(a["z"], lambda v: v * v), r), "_hi": lambda a: _extreme(a["z"], r, True), "_lo": lambda a: _extreme(a["z"], r, False)})
    done = _pass(rows, "row", {"m": lambda a: _mean(a["_m"], r), "q": lambda a: _mean(a["_q"], r), "hi": lambda a: _extreme(a["_hi"], r, True), "lo": lambda a: _extreme(a["_lo"], r, False)})
    return done.select(*KEYS, F.col("m").alias("win_mean"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("win_std"), (F.col("hi") - F.col("lo")).alias("win_range"))


def all_filters(cells: DataFrame, window: int = 5, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Every filter of the feature profiles in two passes over lines; each smooth and gradient is computed once."""
    w, sigmas = max(3, window | 1), [0.5, 0.8, 1.5, 2.0, 2.5, 3.0, 8.0]
    r = w // 2
    rows = _pass(
        cells.select(*KEYS, "z"), "col",
        {"_h" + _name(s): (lambda a, s=s: _convolved(a["z"], kernel(s))) for s in sigmas}
        | {"gx": lambda a: _difference(a["z"], dx), "_m": lambda a: _mean(a["z"], r), "_q": lambda a: _mean(F.transform(a["z"], lambda v: v * v), r), "_hi": lambda a: _extreme(a["z"], r, True), "_lo": lambda a: _extreme(a["z"], r, False)},
    )
    g = _pass(
        rows, "row",
        {_name(s): (lambda a, s=s: _convolved(a["_h" + _name(s)], kernel(s))) for s in sigmas}
        | {"gy": lambda a: _difference(a["z"], dy), "m": lambda a: _mean(a["_m"], r), "q": lambda a: _mean(a["_q"], r), "hi": lambda a: _extreme(a["_hi"], r, True), "lo": lambda a: _extreme(a["_lo"], r, False)},
    )
    z, hgrad, dog = F.col("z"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), F.col("g0_8") - F.col("g2_5")
    return g.select(
        *KEYS, z.alias("raw"), F.col("g1_5").alias("smooth"), (z - F.col("g8")).alias("residual"), hgrad.alias("hgrad"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + dog**2).alias("analytic_signal"),
        F.atan2(dog, hgrad + 1e-10).alias("tilt"), F.col("g3").alias("upward"), (F.col("g0_5") - F.col("g2")).alias("fvd"), (F.signum(z) * F.log1p(F.abs(z))).alias("log"),
        F.col("m").alias("win_mean"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("win_std"), (F.col("hi") - F.col("lo")).alias("win_range"),
    )
