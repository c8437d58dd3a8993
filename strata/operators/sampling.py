"""Training samples from wells, class balance, synthetic minority samples and folds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.grid import Grid
from strata.operators.nearest import neighbours
from strata.operators.ranks import numbered


class Balance(NamedTuple):
    """Class counts and what follows from them."""

    n_pos: int
    n_neg: int

    @property
    def ratio(self) -> float:
        return self.n_neg / self.n_pos

    @property
    def severity(self) -> str:
        return "mild" if self.ratio < 3 else "moderate" if self.ratio < 10 else "severe" if self.ratio < 20 else "extreme"

    @property
    def use_smote(self) -> bool:
        return self.severity != "mild"

    @property
    def smote_ratio(self) -> float:
        return {"extreme": 1 / 5, "severe": 1 / 3}.get(self.severity, 1 / 2)

    @property
    def folds(self) -> int:
        return max(2, min(5, self.n_pos // 2))


def balance(samples: DataFrame, label: str = "label") -> Balance:
    """ValueError with fewer than three positives."""
    r = samples.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if r.p < 3:
        raise ValueError(f"{r.p} positive samples; at least 3 are needed")
    return Balance(r.p, r.n)


def balance_report(samples: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_pos, n_neg, ratio, severity, smote_ratio, folds."""
    r = samples.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    ratio = F.col("n_neg") / F.col("n_pos")
    r = r.withColumn("ratio", ratio).withColumn("severity", F.when(F.col("ratio") < 3, "mild").when(F.col("ratio") < 10, "moderate").when(F.col("ratio") < 20, "severe").otherwise("extreme"))
    share = F.when(F.col("severity") == "extreme", F.lit(1 / 5)).when(F.col("severity") == "severe", F.lit(1 / 3)).otherwise(F.lit(1 / 2))
    return r.withColumn("smote_ratio", share).withColumn("folds", F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("n_pos") / 2))).cast("int"))


def balanced_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """samples with weight n / (2 * rows of the class); classes are counted before the join."""
    counts = samples.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))
    return samples.join(F.broadcast(counts), label).withColumn("weight", F.col("_all") / (2.0 * F.col("_n"))).drop("_n", "_all")


def buffered(wells: DataFrame, grid: Grid, positive: int = 3, negative: int = 1) -> DataFrame:
    """label, row, col: the cells within `positive` (or `negative`) cells of each well on the grid; cells may repeat."""
    b = F.when(F.col("label") == 1, positive).otherwise(negative)
    steps = F.sequence(-b, b)
    cells = wells.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    cells = cells.select("label", (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"))
    return cells.where(F.col("row").between(0, grid.ny - 1) & F.col("col").between(0, grid.nx - 1))


def far_cells(cells: DataFrame, positives: DataFrame, distance: int = 12) -> DataFrame:
    """cells (row, col) for which no positive is nearer than `distance` in both row and column: each positive names the
    cells it rules out, so the exclusion is an equi-join."""
    near = F.sequence(F.lit(-(distance - 1)), F.lit(distance - 1))
    ruled = positives.select("row", "col").distinct().withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near))
    ruled = ruled.select((F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col")).distinct()
    return cells.join(ruled, ["row", "col"], "left_anti")


def far_negatives(cells: DataFrame, positives: DataFrame, n: int = 60, positive: int = 3, seed: int = 42) -> DataFrame:
    """label 0 and row, col of n such cells in the order of a hash."""
    chosen = far_cells(cells, positives, max(4 * positive, 8)).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "row", "col").cast("binary")), "row", "col").limit(n)
    return chosen.select(F.lit(0).alias("label"), "row", "col")


def assemble(features: DataFrame, wells: DataFrame, grid: Grid, positive: int = 3, negative: int = 1, extra: int = 60, seed: int = 42) -> DataFrame:
    """Samples: label, row, col and the feature columns of located wells inside the grid, with far negatives; rows with a
    missing feature are dropped."""
    on = wells.where("inside").select("label", "row", "col")
    cells = buffered(on, grid, positive, negative).unionByName(far_negatives(features.select("row", "col"), on.where("label = 1"), extra, positive, seed))
    return features.join(cells, ["row", "col"]).na.drop()


def synthetic_count(n_pos: int, n_neg: int, ratio: float) -> int:
    return max(0, int(ratio * n_neg) - n_pos)


def smote(positives: DataFrame, n: int, k: int = 5, seed: int = 42, key: str = "id", vec: str = "vec") -> DataFrame:
    """n rows (id, vec) on lines from a positive to one of its k nearest, all picks by hash; a single positive gives copies
    with a little noise."""
    spark, total = positives.sparkSession, positives.count()
    k = min(k, total - 1)
    if n <= 0 or total == 0:
        return positives.select(F.col(key).cast("long").alias(key), F.col(vec).alias(vec)).limit(0)
    ordered = numbered(positives.select(F.col(key).alias("_k"), F.col(vec).alias("_v")), "_i", "_k")
    digits = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("_s")).cast("binary")), 1, 12), 16, 10).cast("long")
    draw = lambda salt, m: (digits(salt) % m).cast("int")
    made = spark.range(n).select(F.col("id").alias("_s")).withColumn("_i", draw(1, total)).join(ordered, "_i")
    if k < 1:
        noise = lambda x, i: x * (1 + 0.05 * (F.pmod(F.xxhash64(F.col("_s"), i), F.lit(1000)) / 500.0 - 1))
        return made.select((-F.col("_s") - 1).alias(key), F.transform("_v", noise).alias(vec))
    near = neighbours(positives, k, key, vec).select(F.col(key).alias("_k"), F.col("rank").alias("_r"), F.col("other").alias("_o"))
    other = ordered.select(F.col("_k").alias("_o"), F.col("_v").alias("_w"))
    made = made.withColumn("_r", draw(2, k) + 1).withColumn("_a", digits(3) / float(16**12)).join(near, ["_k", "_r"]).join(other, "_o")
    return made.select((-F.col("_s") - 1).alias(key), F.zip_with("_v", "_w", lambda x, y: x + F.col("_a") * (y - x)).alias(vec))


def folds(samples: DataFrame, k: int, order, label: str = "label") -> DataFrame:
    """samples with fold 0 .. k-1, even within each label in the given order. A label's rows are numbered by sorted ranges."""
    placed = numbered(samples, "_fold", order, within=(label,))
    return placed.withColumn("fold", (F.col("_fold") % k).cast("int")).drop("_fold")
