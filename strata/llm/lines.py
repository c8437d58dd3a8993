"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, spare, stored

#: A line on this many distinct sites is boilerplate.
SITES = 10
#: 2^12 registers: a relative error of 1.6 %; counts within NEAR of the threshold are taken again exactly.
REGISTERS = 12
NEAR = 0.1


def _line_hash(line):
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """id, k (of the row), site, place, h for each line that isn't blank."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("k"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    return rows.where(F.trim("line") != "").select("id", "k", "site", "place", _line_hash(F.col("line")).alias("h"))


def boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", sites: int = SITES) -> DataFrame:
    """h, keeper: the hash of each line found on at least `sites` distinct sites, and the smallest id that has it.

    One sketch per line and task is merged by the aggregation, so a line on every page costs a row a task. Estimates that
    could lie on either side of the threshold are replaced by exact distinct counts, which read those lines alone.
    """
    lines = _lines(docs, key, site, text)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= int(sites * (1 - NEAR)))
    spread = stored(spread, "spread")
    sure, near = spread.where(F.col("n") > sites * (1 + NEAR)), spread.where(F.col("n") <= sites * (1 + NEAR))
    exact = lines.join(near, "h").groupBy("h", "keeper", "site").agg(F.lit(1).alias("one")).groupBy("h", "keeper").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return sure.select("h", "keeper").unionByName(exact.select("h", "keeper"))


def without_boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", sites: int = SITES) -> DataFrame:
    """docs with such lines taken out of text, and n_lines and n_removed; columns of these names are replaced.

    Lines part at \\n and are compared without surrounding spaces; blank lines always stay. The row with the smallest id
    that has a line keeps it, so that one copy is left in the corpus (rows with a null id keep it only if no other row
    has it). A null site counts as one site. Null texts stay null with no lines; a text all of whose lines go is empty.
    Rows that repeat are treated alike.
    """
    found = stored(boilerplate(docs, key, site, text, sites), "boilerplate")
    lines = _lines(docs, key, site, text)
    hits = lines.join(found, "h").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("k").agg(F.array_sort(F.collect_set("place")).alias("places"))
    k, gone, parts = spare(docs, "k", "gone", "parts")
    rows = docs.withColumn(k, F.xxhash64(key, text)).join(hits.select(F.col("k").alias(k), F.col("places").alias(gone)), k, "left").withColumn(parts, F.split(F.col(text), "\n", -1))
    # What stands between two removed lines, from the first on.
    start = lambda i: F.when(i == 0, 1).otherwise(F.element_at(gone, i) + 2)
    end = lambda i: F.when(i == F.size(gone), F.size(parts)).otherwise(F.element_at(gone, i + 1))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(parts, start(i), end(i) - start(i) + 1)))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return rows.select(*[kept.alias(c) if c == text else c for c in docs.columns if c not in ("n_lines", "n_removed")], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def cleaned_sql(documents: str) -> str:
    """DuckDB SQL: all columns of documents with kept (the text left), n_lines and n_removed."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS _r, * FROM {documents}),
l AS (SELECT _r, doc_id, coalesce(CAST(source AS VARCHAR), '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL),
b AS (SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {SITES}),
k AS (SELECT l._r, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL), '') AS kept
      FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line AND l.doc_id IS DISTINCT FROM b.keeper GROUP BY l._r)
SELECT d.* EXCLUDE (_r), kept, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN k USING (_r)"""


OP6_SQL = f"SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars, sha256(kept) AS kept_sha256 FROM ({cleaned_sql('documents')})"
