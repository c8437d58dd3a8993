"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.storage import stored


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge to another.

    Alternates large-star and small-star steps, so that the number of rounds follows the logarithm of the nodes; each
    round is a table in the shared folder. Minima are taken before the shuffle, and a hub is only a skewed join. Edges
    with a null end and loops count for nothing; no edges give no rows.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, said = stored(now, "edges"), None
    for _ in range(rounds):
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == said or print_of[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        said = print_of
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
