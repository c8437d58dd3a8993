"""Scalar functions on grid values. A missing value is null, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(z: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(z), None).otherwise(z)


def signed_log(z: Column) -> Column:
    return F.signum(z) * F.log1p(F.abs(z))


def clip(v: Column, lo, hi) -> Column:
    """v kept in lo to hi; null stays null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def robust(v: Column, low: Column, high: Column, median: Column, iqr: Column, bound: float = 5.0) -> Column:
    return clip((clip(v, low, high) - median) / iqr, -bound, bound)


def score(prob: Column, uncertainty: Column, penalty: float = 0.3) -> Column:
    return clip(prob - penalty * uncertainty, 0.0, 1.0)


def unit(v: Column, lo: Column, hi: Column) -> Column:
    """Share of the way from lo to hi, kept in 0 to 1; one half where they don't differ; null is 0."""
    return F.when(v.isNull(), 0.0).when(hi <= lo, 0.5).otherwise(clip((v - lo) / (hi - lo), 0.0, 1.0))


def known(v: Column) -> Column:
    """Null and NaN as 0, infinities as the largest doubles."""
    big = 1.7976931348623157e308
    return F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), big).when(v == float("-inf"), -big).otherwise(v)


def keyword(name: Column, table: dict, otherwise) -> Column:
    """The value of the first key that the lower-cased name contains."""
    pairs = list(table.items())
    return reduce(lambda rest, kv: F.when(F.lower(name).contains(kv[0]), F.lit(kv[1])).otherwise(rest), reversed(pairs), F.lit(otherwise))


def ensemble(probs: list[Column], weights: list[float]) -> Column:
    """Weighted mean; with no positive weight the plain mean."""
    total = float(sum(weights))
    if total <= 0:
        weights, total = [1.0] * len(probs), float(len(probs))
    return reduce(lambda a, b: a + b, [p * (w / total) for p, w in zip(probs, weights)])


def spread(probs: list[Column]) -> Column:
    """Population standard deviation across columns."""
    n = float(len(probs))
    mean = reduce(lambda a, b: a + b, probs) / n
    return F.sqrt(reduce(lambda a, b: a + b, [(p - mean) * (p - mean) for p in probs]) / n)


def area_km2(n: Column, dx: float, dy: float) -> Column:
    return n * (abs(dx * dy) / 1e6)


def kilometres(v: Column) -> Column:
    """Axis label: kilometres with one decimal."""
    return F.format_string("%.1f", v / 1000)


def feature_label(name: Column) -> Column:
    """Name for a chart: layer and filter on two lines, spaces for underscores, 30 characters."""
    return F.substring(F.replace(F.replace(name, F.lit("__"), F.lit("\n")), F.lit("_"), F.lit(" ")), 1, 30)
