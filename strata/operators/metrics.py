"""Threshold choice and model metrics over (label, prob); group columns keep models or types apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.ranks import running

STEPS = 181


def by_threshold(scored: DataFrame) -> DataFrame:
    """step, threshold (0.05 to 0.95), tp, fp, fn, tn: rows are counted by the last threshold they reach, then summed from
    the top, so the data is read once and 181 counts are what moves."""
    # Thresholds are compared as they are, not by division: the largest step whose threshold is not above prob.
    at = lambda s: F.lit(0.05) + s * (0.9 / (STEPS - 1))
    near = F.floor((F.col("prob") - 0.05) / (0.9 / (STEPS - 1))).cast("int")
    step = F.when(at(near + 1) <= F.col("prob"), near + 1).when(at(near) > F.col("prob"), near - 1).otherwise(near)
    counted = scored.select(F.least(F.greatest(step, F.lit(-1)), F.lit(STEPS - 1)).alias("step"), "label").groupBy("step").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    every = scored.sparkSession.range(-1, STEPS).select(F.col("id").cast("int").alias("step")).join(F.broadcast(counted), "step", "left").na.fill(0)
    down, whole = Window.orderBy(F.desc("step")), Window.partitionBy()
    tp, fp = F.sum("p").over(down), F.sum("n").over(down)
    out = every.select("step", tp.alias("tp"), fp.alias("fp"), (F.sum("p").over(whole) - tp).alias("fn"), (F.sum("n").over(whole) - fp).alias("tn"))
    return out.where("step >= 0").withColumn("threshold", at(F.col("step")))


def best_threshold(scored: DataFrame, metric: str = "f1") -> DataFrame:
    """One row: threshold, score. f1, gmean, or pr (the corner of the precision-recall curve); the lowest of equals wins."""
    if metric == "pr":
        every = curve(scored).select("prob", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)).alias("score"))
        best = every.orderBy(F.desc("score"), "prob").limit(1)
        return best.select(F.least(F.greatest("prob", F.lit(0.05)), F.lit(0.95)).alias("threshold"), "score")
    t = by_threshold(scored)
    if metric == "f1":
        value = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    else:
        value = F.sqrt(F.col("tp") / (F.col("tp") + F.col("fn") + 1e-10) * (F.col("tn") / (F.col("tn") + F.col("fp") + 1e-10)))
    return t.withColumn("score", value).orderBy(F.desc("score"), "step").limit(1).select("threshold", "score")


def curve(scored: DataFrame, *by: str) -> DataFrame:
    """Group columns, prob, tp, fp, precision, recall at each distinct prob, from counts per prob, added up over sorted ranges."""
    counts = scored.groupBy(*by, "prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    tp, fp = F.col("p_upto"), F.col("n_upto")
    return running(counts, ("p", "n"), F.desc("prob"), within=by).select(*by, "prob", "p", "n", tp.alias("tp"), fp.alias("fp"), (tp / (tp + fp)).alias("precision"), (tp / F.col("p_all")).alias("recall"))


def model_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Group columns, auc_roc, auc_pr, brier. Ties count half for the ROC area; the PR area is the sum of recall steps times
    precision. 0 where a class is missing."""
    c = curve(scored, *by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.sum("p") * F.sum("n"))
    average = F.sum(F.col("p") * F.col("precision")) / F.sum("p")
    areas = c.groupBy(*by).agg(F.coalesce(F.when(F.sum("p") * F.sum("n") > 0, area), F.lit(0.0)).alias("auc_roc"), F.coalesce(F.when(F.sum("p") > 0, average), F.lit(0.0)).alias("auc_pr"))
    brier = scored.groupBy(*by).agg(F.avg((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))).alias("brier"))
    return areas.join(brier, list(by)) if by else areas.crossJoin(brier)


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """model, weight: shares of the rounded PR areas, times the number of models; even where all are 0."""
    whole = Window.partitionBy()
    v = F.round("auc_pr", 4)
    total, n = F.sum(v).over(whole), F.count("*").over(whole)
    return metrics.select("model", F.when(total > 0, v / total * n).otherwise(1.0).alias("weight"))


def recall_at_k(targets: DataFrame, zones: DataFrame, k: int = 10, factor: float = 2.5) -> DataFrame:
    """One row: hits, recall, precision. Zones take in turn the nearest unused one of the first k targets that lies within
    factor x radius; what is compared is k targets with a scenario's zones, gathered in one row."""
    t = targets.where(F.col("rank") <= k).agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("ts"))
    z = zones.agg(F.array_sort(F.collect_list(F.struct("zone_id", "x", "y", "r"))).alias("zs"))

    def take(used, zone):
        near = F.transform(F.filter("ts", lambda p: ~F.array_contains(used, p["rank"])), lambda p: F.struct(F.sqrt((p["x"] - zone["x"]) ** 2 + (p["y"] - zone["y"]) ** 2).alias("d"), p["rank"].alias("rank")))
        best = F.array_min(F.filter(near, lambda q: q["d"] < factor * zone["r"]))
        return F.when(best.isNull(), used).otherwise(F.array_append(used, best["rank"]))

    hits = F.size(F.aggregate("zs", F.array().cast("array<int>"), take))
    return t.crossJoin(z).select(hits.alias("hits"), (hits / F.greatest(F.size("zs"), F.lit(1))).alias("recall"), (hits / F.greatest(F.size("ts"), F.lit(1))).alias("precision"))


def within(points: DataFrame, zones: DataFrame, factor: float = 2.5) -> DataFrame:
    """zone_id, rank, d: each zone with the points (rank, x, y) nearer than factor x its radius.

    A join on squares as wide as the widest reach: a zone meets the points of its square and of the eight around it.
    """
    side = factor * float(zones.agg(F.max("r")).first()[0] or 1.0)
    square = lambda c: F.floor(F.col(c) / side)
    p = points.select("rank", F.col("x").alias("u"), F.col("y").alias("v")).withColumns({"sx": square("u"), "sy": square("v")})
    around = F.sequence(F.lit(-1), F.lit(1))
    z = zones.select("zone_id", "x", "y", "r").withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    z = z.withColumns({"sx": square("x") + F.col("dx"), "sy": square("y") + F.col("dy")})
    d = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
    return z.join(p, ["sx", "sy"]).withColumn("d", d).where(F.col("d") < factor * F.col("r")).select("zone_id", "rank", "d")


def above_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: n_above (rows whose prob reaches the threshold), n, share."""
    n = F.count_if(F.col("prob") >= threshold)
    return scored.agg(n.alias("n_above"), F.count("*").alias("n"), (n / F.count("*")).alias("share"))
