"""Secret scans over an incremental blob ledger: every content is scanned once for each version of a rule."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import read, stored


class Rule(NamedTuple):
    """group of pattern must have at least `least` characters, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: Fixed patterns. [0-9a-f]+ and AKIA[A-Z0-9]+ take whole runs, so a least length inside the pattern drops the same matches.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}+", 0, 32),
)


def contents(history: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, text (null: empty) and blob_id, the text's SHA-256."""
    body = F.coalesce(F.col(text), F.lit(""))
    return history.select(F.col(path).alias("path"), body.alias("text")).withColumn("blob_id", F.sha2(F.col("text").cast("binary"), 256))


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """blob_id, text, rules: each content once, with the kinds that the ledger (blob_id, kind, version) lacks for it.

    Only ids are grouped; the text then moves once, to the row chosen for its id. The key of that join holds the path,
    so many copies don't meet in one task.
    """
    own = F.coalesce(F.col("path").cast("string"), F.lit(""))
    chosen = blobs.groupBy("blob_id").agg(F.min(own).alias("own"))
    if ledger is None:
        chosen = chosen.withColumn("rules", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = chosen.select("blob_id", "own", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("blob_id", "own", "r.*")
        chosen = pairs.join(ledger.select("blob_id", "kind", "version"), ["blob_id", "kind", "version"], "left_anti").groupBy("blob_id", "own").agg(F.collect_set("kind").alias("rules"))
    return blobs.withColumn("own", own).join(chosen.hint("shuffle_hash"), ["blob_id", "own"]).select("blob_id", "text", "rules")


def scan(pending: DataFrame, rules=RULES) -> DataFrame:
    """blob_id, kind, kind_no, start, end: spans in code points, leftmost and non-overlapping per kind.

    A text splits at its matches; the lengths of the parts and of the matches give each place. Lengths alone leave the
    scan. Rows whose text was repeated under one path give their spans once.
    """
    found = []
    for r in rules:
        lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
        pattern = F.lit(r.pattern)
        every = F.arrays_zip(
            lengths(F.split(F.col("text"), r.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all("text", pattern, F.lit(0))).alias("whole"),
            lengths(F.regexp_extract_all("text", pattern, F.lit(r.group))).alias("part"),
        )
        found.append(F.when(F.array_contains("rules", r.kind) & F.col("text").rlike(r.pattern), every))
    rows = pending.select("blob_id", F.array(*found).alias("found")).where(F.exists("found", lambda x: x.isNotNull()))
    rows = rows.select("blob_id", F.posexplode("found").alias("kind_no", "f")).where("f is not null").select("blob_id", "kind_no", F.posexplode("f").alias("i", "m")).where("m.whole is not null")
    # Repeated rows of one path are equal here.
    rows = rows.select("blob_id", "kind_no", "i", "m.gap", "m.whole", "m.part").distinct()
    upto = Window.partitionBy("blob_id", "kind_no").orderBy("i")
    end = F.sum(F.col("gap") + F.col("whole")).over(upto).cast("long")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind_no") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_no") + 1)
    return rows.withColumn("end", end).where(F.col("part") >= least).select("blob_id", kind.alias("kind"), "kind_no", (F.col("end") - F.col("whole")).alias("start"), "end")


def update(history: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(spans found now, rows to add to the ledger) for a history of path and text, a row per version of a file.

    Contents that the ledger names for a rule's version aren't scanned again. A null path is a path like any other, a null
    text is empty, other columns are ignored. Equal contents are scanned once; rows that repeat both path and text may be
    scanned each, but give their spans once. Empty histories give empty tables.
    """
    blobs = contents(history, path, text)
    spans = scan(unseen(blobs, ledger, rules), rules)
    pairs = blobs.select("blob_id").distinct().select("blob_id", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("blob_id", "r.*")
    return spans, pairs if ledger is None else pairs.join(ledger, ["blob_id", "kind", "version"], "left_anti")


def scanned(history: DataFrame, path: str = "path", text: str = "text", increments: int = 2, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(spans, ledger) of a whole history that comes in by increments: each is checked against the ledger that the ones
    before it left, so a content that returns is not scanned again. Rows fall to increments by a hash of their path."""
    when, ledger, found = F.pmod(F.xxhash64(path), F.lit(increments)), None, []
    for n in range(increments):
        spans, added = update(history.where(when == n), ledger, path, text, rules)
        found.append(stored(spans, "spans"))
        if n + 1 < increments:
            ledger = stored(added if ledger is None else ledger.unionByName(added), "ledger")
        else:
            ledger = added if ledger is None else ledger.unionByName(added)
    return reduce(DataFrame.unionByName, found), ledger


def by_path(history: DataFrame, spans: DataFrame, path: str = "path", text: str = "text", rules=RULES) -> DataFrame:
    """path, spans: every row of the history with the spans of its content, by start, then by rule; none: an empty array.

    Rows that repeat and null paths come back as often as they stand; a null text has the spans of the empty one: none.
    """
    found = spans.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("spans"))
    none = F.array().cast(found.schema["spans"].dataType)
    return contents(history, path, text).select("path", "blob_id").join(found, "blob_id", "left").select("path", F.coalesce("spans", none).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans, _ = scanned(docs, "doc_id")
    rows = by_path(docs, spans, "doc_id")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(F.col("path").alias("doc_id"), *[n(r.kind).alias(f"n_{r.kind}") for r in RULES], F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"))


def _kind_sql(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT k, {no} AS kind_no, '{kind}' AS kind, i, ms[i] AS m, vs[i] AS v, {least} AS least,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
FROM (SELECT k, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, string_split_regex(t, '{pattern}') AS gaps,
  regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs FROM d WHERE regexp_matches(t, '{pattern}')))"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(no, r.kind, r.pattern.replace("}+", "}"), r.group, r.least) for no, r in enumerate(RULES))}),
g AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s, kind_no) AS spans FROM m WHERE length(v) >= least GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (k)
"""
