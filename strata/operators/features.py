"""From registered layers to a normalised feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import keyword, robust
from strata.operators.ranks import percentiles
from strata.operators.stencil import KEYS, all_filters

#: Which filters a layer gets by the first kind that its name contains.
PROFILES = {
    "magnetic": ["raw", "smooth", "residual", "hgrad", "analytic_signal", "tilt", "fvd", "stats"],
    "gravity": ["raw", "smooth", "residual", "hgrad", "upward", "fvd", "stats"],
    "resistivity": ["raw", "smooth", "residual", "hgrad", "log", "stats"],
    "ip": ["raw", "smooth", "hgrad", "stats"],
    "chargeability": ["raw", "smooth", "hgrad", "stats"],
    "geochemistry": ["raw", "smooth", "log", "hgrad", "stats"],
    "seismic": ["raw", "smooth", "hgrad", "stats"],
    "geology": ["raw", "stats"],
    "default": ["raw", "smooth", "hgrad", "stats"],
}
#: Factors by target type and by the first keyword that a feature's name contains.
WEIGHTS = {
    "mineral": {"ip": 2.0, "chargeability": 2.0, "magnetic": 1.5, "gravity": 1.2, "geochemistry": 1.8, "resistivity": 1.3},
    "groundwater": {"resistivity": 2.5, "ip": 1.5, "gravity": 1.0, "geochemistry": 0.8, "magnetic": 0.7},
    "geothermal": {"resistivity": 2.0, "gravity": 1.8, "magnetic": 1.5, "geochemistry": 1.2, "ip": 1.0},
    "generic": {},
}


def layer_kind(name: str) -> str:
    return next((k for k in PROFILES if k in name.lower()), "default")


def feature_names(layers: list[str]) -> list[str]:
    """Names of the features in order: layer__filter, and three for the window statistics."""
    steps = lambda kind: [y for x in PROFILES[kind] for y in (["win_mean", "win_std", "win_range"] if x == "stats" else [x])]
    return [f"{name}__{step}" for name in layers for step in steps(layer_kind(name))]


def extract(cells: DataFrame, layers: list[str], window: int = 5, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Long features (row, col, feature, val) of registered layers. All filters come from one pair of passes; the profile
    then picks those of each layer, and missing cells should have been filled."""
    if not layers:
        raise ValueError("no layer gives a feature")
    made = all_filters(cells, window, dx, dy)
    steps = [c for c in made.columns if c not in KEYS]
    kinds = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("val")) for s in steps])
    wanted = {k: ["win_mean", "win_std", "win_range"] + [x for x in v if x != "stats"] for k, v in PROFILES.items()}
    allowed = keyword(F.col("layer"), {k: ",".join(v) for k, v in wanted.items() if k != "default"}, ",".join(wanted["default"]))
    long = made.withColumn("_allowed", F.split(allowed, ",")).select("layer", "row", "col", "_allowed", F.explode(kinds).alias("k"))
    return long.where(F.array_contains("_allowed", F.col("k.step"))).select("row", "col", F.concat_ws("__", "layer", "k.step").alias("feature"), "k.val")


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """row, col and a column per feature."""
    return long.groupBy("row", "col").pivot("feature", names).agg(F.first("val"))


def norm_params(long: DataFrame, clip: float = 2.0, *keys: str) -> DataFrame:
    """feature, p_low, p_high, median, iqr: exact percentiles of what is present; fewer than ten values give 0, 1, 0, 1."""
    keys = keys or ("feature",)
    at = [clip / 100, 0.25, 0.5, 0.75, 1 - clip / 100]
    p = percentiles(long, "val", at, *keys)
    few = F.col("n") < 10
    pick = lambda i, otherwise: F.when(few, float(otherwise)).otherwise(F.col("p")[i])
    return p.select(*keys, pick(0, 0).alias("p_low"), pick(4, 1).alias("p_high"), pick(2, 0).alias("median"), F.when(few, 1.0).otherwise(F.greatest(F.col("p")[3] - F.col("p")[1], F.lit(1e-10))).alias("iqr"))


def normalised(long: DataFrame, params: DataFrame) -> DataFrame:
    """Long features clipped to their percentiles, centred on the median, scaled by the interquartile range, kept in -5 to 5."""
    return long.join(F.broadcast(params), "feature").withColumn("val", robust(F.col("val"), F.col("p_low"), F.col("p_high"), F.col("median"), F.col("iqr"))).select(*long.columns)


def weighted(long: DataFrame, target_type: str) -> DataFrame:
    table = WEIGHTS.get(target_type, {})
    return long.withColumn("val", F.col("val") * keyword(F.col("feature"), table, 1.0)) if table else long
