"""Learners of one target type: neural network with Platt scaling, random forest, boosted trees, and their weighted ensemble."""

from __future__ import annotations

import json
import warnings
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import ensemble, known, spread
from strata.operators import network
from strata.operators import trees as forests
from strata.operators.features import WEIGHTS
from strata.operators.metrics import above_threshold, best_threshold, ensemble_weights, model_metrics
from strata.operators.sampling import Balance, balance, balanced_weights, folds, smote, synthetic_count

MODELS = ("ann", "rf", "gb")


class Network:
    """Perceptrons on parts of the rows, each with Platt scaling on the rest; probabilities are averaged. pairs: a net's arrays and
    the slope and bias of its scaling."""

    def __init__(self, pairs):
        self.pairs = pairs

    @classmethod
    def fit(cls, samples: DataFrame, width: int, iterations: int = 800, parts: int = 3, seed: int = 42) -> Network:
        """ReLU layers, l2 of 0.01, and an end after 30 steps without gain on 15 % of the rows; parts are trained together."""
        sizes = [width, max(64, 2 * width), max(32, width), max(16, width // 2), 1]
        dealt = folds(samples, parts, F.xxhash64(F.lit(seed), "label", "id")).withColumns({"x": vector_to_array("features"), "y": F.col("label")})
        pairs = []
        for k, net in enumerate(network.train(dealt, sizes, parts, iterations, seed=seed)):
            scored = dealt.where(F.col("fold") == k).select("label", array_to_vector(F.array(network.margin_column(net, F.col("x")))).alias("margin"))
            platt = LogisticRegression(featuresCol="margin", labelCol="label").fit(scored)
            pairs.append((net, float(platt.coefficients[0]), float(platt.intercept)))
        return cls(pairs)

    def add(self, rows: DataFrame, name: str) -> DataFrame:
        x = vector_to_array("features")
        parts = [1 / (1 + F.exp(-(slope * network.margin_column(net, x) + bias))) for net, slope, bias in self.pairs]
        return rows.withColumn(name, reduce(lambda a, b: a + b, parts) / len(parts))

    def packed(self) -> str:
        return json.dumps([([a.tolist() for a in net], slope, bias) for net, slope, bias in self.pairs])

    @classmethod
    def unpacked(cls, text: str) -> Network:
        return cls([([np.array(a) for a in net], slope, bias) for net, slope, bias in json.loads(text)])


class Trees:
    """A forest or boosted trees over the features column."""

    def __init__(self, model):
        self.model = model

    def add(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, forests.scores(self.model, vector_to_array("features")))


def _listed(samples: DataFrame, width: int | None) -> tuple[DataFrame, int]:
    rows = samples.withColumns({"x": vector_to_array("features"), "y": F.col("label")})
    return rows, width or rows.select(F.size("x").alias("n")).first().n


def fit_forest(samples: DataFrame, b: Balance, trees: int | None = None, seed: int = 42, width: int | None = None) -> Trees:
    """300 to 600 trees of depth 10, by the number of positives; both classes weigh the same in each bootstrap. The model has
    the out-of-bag accuracy as `oob`."""
    rows, width = _listed(samples, width)
    return Trees(forests.grow(rows, width, trees or min(600, max(300, 20 * b.n_pos)), 10, max(1, b.n_pos // 5), max(2, b.n_pos // 3), seed=seed))


def fit_boosted(samples: DataFrame, b: Balance, rounds: int = 500, seed: int = 42, width: int | None = None) -> Trees:
    """At most `rounds` rounds at a rate of 0.02 and depth 5, balanced weights; a fifth of the rows, by hash, ends training
    after 25 rounds without gain. The l2 penalty is 0.1, or 0.3 where positives are few."""
    held = (F.pmod(F.xxhash64(F.lit(seed), "label", "id"), F.lit(5)) == 0).alias("held")
    rows, width = _listed(balanced_weights(samples), width)
    l2 = 0.1 if b.severity in ("mild", "moderate") else 0.3
    return Trees(forests.boost(rows.select("id", "y", F.col("weight").alias("w"), held, "x"), width, rounds, 0.02, 5, max(3, b.n_pos // 3), l2))


def vectors(samples: DataFrame, names: list[str]) -> DataFrame:
    """samples with features (vector of the named columns, missing as 0) and a row id from their values."""
    filled = samples.withColumns({c: known(F.col(c).cast("double")) for c in names})
    out = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    return out if "id" in out.columns else out.withColumn("id", F.xxhash64("features"))


class Prospect:
    """Trains and applies the ensemble of one target type. An unknown type becomes generic with a warning."""

    def __init__(self, target_type: str = "generic", iterations: int = 800, trees: int | None = None, rounds: int = 500):
        if target_type not in WEIGHTS:
            warnings.warn(f"unknown target type {target_type}: generic is used", stacklevel=2)
            target_type = "generic"
        self.target_type, self.iterations, self.trees, self.rounds = target_type, iterations, trees, rounds
        self.models, self.weights, self.threshold, self.metrics, self.names = {}, {}, 0.5, [], []
        #: Negatives for each positive of the training samples.
        self.imbalance: float | None = None
        #: After training: how many out-of-fold rows reach the threshold (n_above, n, share).
        self.above: dict = {}

    def _fit(self, rows: DataFrame, b: Balance, seed: int) -> dict:
        made, width = {}, len(self.names)
        for name, f in (("ann", lambda: Network.fit(rows, width, self.iterations, seed=seed)), ("rf", lambda: fit_forest(rows, b, self.trees, seed, width)), ("gb", lambda: fit_boosted(rows, b, self.rounds, seed, width))):
            try:
                made[name] = f()
            except Exception as e:  # a learner that can't fit these rows is left out, as long as one can
                warnings.warn(f"{name} could not be fitted: {type(e).__name__}", stacklevel=2)
        return made

    def _enriched(self, rows: DataFrame, b: Balance, k: int, seed: int) -> DataFrame:
        if not b.use_smote:
            return rows
        positives = rows.where("label = 1").select("id", vector_to_array("features").alias("vec"))
        made = smote(positives, synthetic_count(b.n_pos, b.n_neg, b.smote_ratio), k, seed)
        return rows.select("id", "label", "features").unionByName(made.select("id", F.lit(1).alias("label"), array_to_vector("vec").alias("features")))

    def train(self, samples: DataFrame, names: list[str], cv_folds: int = 5, metric: str = "f1", seed: int = 42) -> Prospect:
        """samples: label and the named columns. Models are judged out of fold; a fold that fails counts as 0.5."""
        self.names = list(names)
        rows = vectors(samples, self.names).select("id", "label", "features").cache()
        cached = [rows]
        try:
            b = balance(rows)
            self.imbalance = b.ratio
            k = min(cv_folds, b.folds)
            dealt, parts = folds(rows, k, F.xxhash64(F.lit(seed), "id")).cache(), []
            cached.append(dealt)
            for f in range(k):
                inner = dealt.where(F.col("fold") != f).drop("fold")
                own = balance(inner)
                models, held = self._fit(self._enriched(inner, own, min(3, own.n_pos - 1), seed + f), own, seed), dealt.where(F.col("fold") == f)
                for m in MODELS:
                    held = models[m].add(held, m) if m in models else held.withColumn(m, F.lit(0.5))
                parts.append(held.select("id", "label", *MODELS))
            oof = reduce(DataFrame.unionByName, parts).cache()
            cached.append(oof)
            long = oof.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prob")) for m in MODELS])).alias("x")).select("label", "x.*")
            metrics = model_metrics(long, "model")
            self.weights = {r.model: r.weight for r in ensemble_weights(metrics).collect()}
            joint = oof.select("label", ensemble([F.col(m) for m in MODELS], [self.weights[m] for m in MODELS]).alias("prob"))
            self.metrics = [r.asDict() for r in metrics.collect()] + [{"model": "ensemble", **model_metrics(joint).drop("brier").first().asDict(), "brier": None}]
            self.threshold = float(min(0.95, max(0.05, best_threshold(joint, metric).first().threshold)))
            self.above = above_threshold(joint, self.threshold).first().asDict()
            self.models = self._fit(self._enriched(rows, b, min(5, b.n_pos - 1), seed), b, seed)
        finally:
            for held in cached:
                held.unpersist()
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        """row, col, prob, uncertainty and p_<model> for each cell."""
        rows = vectors(features, self.names).select("row", "col", "features")
        for m in MODELS:
            rows = self.models[m].add(rows, f"p_{m}") if m in self.models else rows.withColumn(f"p_{m}", F.lit(0.5))
        probs = [F.col(f"p_{m}") for m in MODELS]
        return rows.select("row", "col", ensemble(probs, [self.weights.get(m, 1.0) for m in MODELS]).alias("prob"), spread(probs).alias("uncertainty"), *[f"p_{m}" for m in MODELS])

    def importances(self) -> list[tuple[str, float]]:
        """(feature, importance) of the tree models' mean, largest first."""
        found = [forests.importances(self.models[m].model.trees, len(self.names)) for m in ("rf", "gb") if m in self.models]
        return sorted(zip(self.names, (sum(found) / len(found)).tolist()), key=lambda x: (-x[1], x[0])) if found else []

    def save(self, spark: SparkSession, path: str) -> None:
        kept = {"target_type": self.target_type, "names": self.names, "weights": self.weights, "threshold": self.threshold, "metrics": self.metrics, "imbalance_ratio": self.imbalance, "models": sorted(self.models)}
        spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        for name in ("rf", "gb"):
            if name in self.models:
                spark.createDataFrame([(forests.packed(self.models[name].model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
        if "ann" in self.models:
            spark.createDataFrame([(self.models["ann"].packed(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/ann")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Prospect:
        kept = json.loads(spark.read.text(f"{path}/meta").first().value)
        out = cls(kept["target_type"])
        out.names, out.weights, out.threshold, out.metrics, out.imbalance = kept["names"], kept["weights"], kept["threshold"], kept["metrics"], kept.get("imbalance_ratio")
        for name in ("rf", "gb"):
            if name in kept["models"]:
                out.models[name] = Trees(forests.unpacked(spark.read.text(f"{path}/{name}").first().value))
        if "ann" in kept["models"]:
            out.models["ann"] = Network.unpacked(spark.read.text(f"{path}/ann").first().value)
        return out
