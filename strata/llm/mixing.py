"""Mixing sources to target weights: token totals, repetition rates, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import WORD, read, spare, stored
from strata.operators.ranks import numbered

#: Weights repeat over the sources in code point order, null last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
def words(text):
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate: one row per source.

    Targets share `share` times all words by weight; a target stops at `most` times its source's size and the excess is
    shared again by weight, until none is above: min(most * size, level * weight) with one level for all. The level rises
    from that of no full source, round by round, until no source fills up anew; a round is one sum over the sources.
    Sources may be many: they are numbered by the counts of the sorted partitions, and no task holds them all. A source
    without words has target 0 and rate 0.
    """
    total = numbered(sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size")), "number", F.col(source).asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(total.select(F.col(source), "source_size", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "sources")
    every, level = ranked.agg(F.sum("source_size")).first()[0], 0.0
    while every:
        full = F.col("cap") < F.lit(level) * F.col("w")
        r = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        now = (every * float(share) - r["full"]) / r["open"] if r["open"] else float("inf")
        if now <= level:
            break
        level = now
    target = F.least(F.col("cap"), F.lit(float(level)) * F.col("w"))
    return ranked.select(source, "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))


def copies(rate, key, seed: str = SEED):
    """floor(rate) copies plus one with probability equal to the fraction; the draw hangs on the key and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def planned(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", columns=("_size", "_source_size", "_target", "_copies"), **how) -> DataFrame:
    """docs with four columns of these names: the row's words, those of its source, the source's target, and the copies taken.

    Sizes are summed per source before the shuffle, so a hot source is one row a task. The join with the sources compares
    null-safe; their table is broadcast only if Spark finds it small. Null texts have size 0, repeated rows with one key
    share their draw, an empty table gives an empty plan. Columns of docs that have these names are replaced.
    """
    size, source_size, target, taken = columns
    docs = docs.drop(*columns)
    own, rate = spare(docs.withColumns({c: F.lit(0) for c in columns}), "source_of_rate", "rate_of_source")
    table = rates(docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size")), **how)
    table = table.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate))
    joined = docs.withColumn(size, words(F.col(text))).join(table, F.col(source).eqNullSafe(F.col(own)), "left")
    return joined.withColumn(taken, copies(F.coalesce(F.col(rate), F.lit(0.0)), F.col(key))).drop(own, rate)


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay, whatever their names."""
    columns = spare(docs, "size", "source_size", "target", "copies")
    plan = planned(docs, columns=columns, **how)
    return plan.where(F.col(columns[3]) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(columns[3]).cast("int"))).alias(columns[0])).drop(columns[0])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def plan_sql(documents: str) -> str:
    """DuckDB SQL of planned() over a relation, with columns of op10 and n_copies."""
    return f"""
SELECT *, size * n_copies AS taken FROM (
SELECT d.*, t.source_size, t.target,
  CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 12) AS BIGINT) / {float(16**12)!r} < rate - floor(rate) THEN 1 ELSE 0 END AS n_copies
FROM (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {documents}) d
JOIN (
  WITH s AS (SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS source_size FROM {documents} GROUP BY source),
  w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
  f AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
  l AS (SELECT arg_min(level, cap / w) AS lowest FROM f WHERE level * w <= cap)
  SELECT source, source_size, CASE WHEN lowest IS NULL THEN cap ELSE least(cap, lowest * w) END AS target,
    CASE WHEN source_size > 0 THEN least(CASE WHEN lowest IS NULL THEN cap ELSE least(cap, lowest * w) END / source_size, 2.0::DOUBLE) ELSE 0.0 END AS rate
  FROM f LEFT JOIN l ON true
) t ON d.source IS NOT DISTINCT FROM t.source)
"""


OP10_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({plan_sql('documents')})"
