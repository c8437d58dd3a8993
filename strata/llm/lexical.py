"""Ranked lexical search: document shards of CSR postings with integer impacts, dense accumulators a term at a time, shards' lists merged."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, stored, text_bytes

#: A term is a run of ASCII letters and digits and of characters beyond ASCII; in UTF-8 these are the bytes that aren't ASCII.
TERM = rb"[0-9a-z\x80-\xff]+"
#: Text bytes of a shard, but for a longer text, which is a shard of its own; terms of a text counted at once.
SHARD_BYTES = 1 << 23
TERMS = 1 << 20
#: Bytes of items that go along on one pass over the index (a broadcast).
BLOCK_BYTES = 1 << 24
#: Lists merged into one on each level of the tree.
FAN = 64
#: The formula's constants: length normalisation of 100 is 25 + 75 n / mean length, tf saturates at 0.8 of them.
FIXED, BY_LENGTH, UNIT, SATURATION = 25, 75, 10**9, 8


def _found(text: bytes):
    """Lists of a text's terms, in order; a long text gives them by pieces."""
    low = text.lower()
    if len(low) <= SHARD_BYTES:
        yield re.findall(TERM, low)
        return
    matches = re.finditer(TERM, low)
    while some := [m.group() for m in islice(matches, TERMS)]:
        yield some


def terms_of(text: bytes) -> tuple[Counter, int]:
    """Terms of a text with their numbers, and how many they are."""
    counts, n = Counter(), 0
    for some in _found(text):
        counts.update(some)
        n += len(some)
    return counts, n


def _rows(column: pa.Array, limit: int):
    """(i, list of texts as bytes) of about `limit` bytes together, from row i on."""
    raw, offsets = text_bytes(column)
    for i, j in pieces(offsets, limit):
        yield i, [raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]


def _sizes(batches):
    """mapInArrow: documents that have a term, and terms, of this task."""
    docs = terms = 0
    for batch in batches:
        for _, texts in _rows(batch.column(0), SHARD_BYTES):
            for text in texts:
                n = sum(map(len, _found(text)))
                docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Integer impact of each posting, from its tf and the terms of its document; Python's integers where 64 bits can't hold a product."""
    wide = BY_LENGTH * int(n.max(initial=0)) * docs >= 2**63
    m = FIXED + np.array([BY_LENGTH * x * docs // terms for x in n.tolist()], np.int64) if wide else FIXED + BY_LENGTH * n.astype(np.int64) * docs // max(terms, 1)
    return (UNIT * tf.astype(np.int64) // (1000 * tf + SATURATION * m)).astype(np.int32)


SHARD = "docs int, ids binary, terms binary, starts binary, places binary, impacts binary"


def _build(docs: int, terms: int):
    """mapInArrow function: a row for each shard. Documents stand by id, those without one last; places and impacts are the postings, term by term."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for i, texts in _rows(batch.column(1), SHARD_BYTES):
                known = keys.slice(i, len(texts))
                ids = known.fill_null(0).to_numpy(zero_copy_only=False)
                there = known.is_valid().to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, ~there)).tolist()
                words, tf, distinct, lengths = [], [], [], []
                for k in order:
                    counts, n = terms_of(texts[k])
                    words.extend(counts)
                    tf.extend(counts.values())
                    distinct.append(len(counts))
                    lengths.append(n)
                if not words:
                    continue
                vocabulary = sorted(set(words))
                number = dict(zip(vocabulary, range(len(vocabulary))))
                term = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                place = np.repeat(np.arange(len(order), dtype=np.int32), distinct)
                impact = impacts(np.array(tf, np.int64), np.repeat(np.array(lengths, np.int64), distinct), docs, terms)
                by = np.argsort(term, kind="stable")
                starts = np.searchsorted(term[by], np.arange(len(vocabulary) + 1))
                cells = [ids[order][: there.sum()].astype(np.int64).tobytes(), b"\n".join(vocabulary), starts.astype(np.int64).tobytes(), place[by].tobytes(), impact[by].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["docs", "ids", "terms", "starts", "places", "impacts"])

    return run


class Index(NamedTuple):
    """shards: stored rows of SHARD; docs: documents that have a term; terms: all their terms with repeats."""

    shards: DataFrame
    docs: int
    terms: int


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index of every term of every text, in shards of documents that one task reads together; no posting is shuffled.

    The first scan counts documents and terms, the second writes postings with their impacts, as a table in the shared
    folder. A null or empty text has no term. A row without an id counts in all statistics, but no search
    names it. Repeated rows are documents of their own. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    total = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, size = total[0] or 0, total[1] or 0
    return Index(stored(rows.mapInArrow(_build(n, size), SHARD), "postings"), n, size)


def _lists(shard: dict) -> tuple[list[bytes], np.ndarray]:
    return shard["terms"].split(b"\n"), np.frombuffer(shard["starts"], np.int64)


def _frequencies(wanted):
    """mapInArrow function: number (of a wanted term) and how many documents of this task's shards have it."""

    def run(batches):
        number, total = wanted.value, np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for shard in batch.to_pylist():
                terms, starts = _lists(shard)
                for k, t in enumerate(terms):
                    if t in number:
                        total[number[t]] += starts[k + 1] - starts[k]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["term", "df"])

    return run


def _select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by place: all above the k-th, then the first of those equal to it."""
    if len(scores) > k:
        least = scores[np.argpartition(-scores, k - 1)[k - 1]]
        above = np.flatnonzero(scores > least)
        best = np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))
    else:
        best = np.arange(len(scores))
    return best[scores[best] > 0]


def _keep(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """(item, id, score) arrays cut to each item's k best."""
    order = np.lexsort((held[1], -held[2], held[0]))
    held = [x[order] for x in held]
    first = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if len(held[0]) else np.zeros(0, int)
    rank = np.arange(len(held[0])) - np.repeat(first, np.diff(np.r_[first, len(held[0])]))
    return [x[rank < k] for x in held]


def _search(block, k: int):
    """mapInArrow function: the k best documents of this task's shards for each item of the block."""

    def run(batches):
        from pyspark import TaskContext

        items, number, weights = block.value
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for shard in batch.to_pylist():
                terms, starts = _lists(shard)
                here = {number[t]: j for j, t in enumerate(terms) if t in number}
                ids = np.frombuffer(shard["ids"], np.int64)
                places, impact = np.frombuffer(shard["places"], np.int32), np.frombuffer(shard["impacts"], np.int32)
                found = []
                for q, own in enumerate(items):
                    total = np.zeros(shard["docs"], np.int64)
                    for term, times in own:
                        if (j := here.get(term)) is not None:
                            run = slice(starts[j], starts[j + 1])
                            total[places[run]] += weights[term] * times * impact[run].astype(np.int64)
                    best = _select(total[: len(ids)], k)
                    found.append((np.full(len(best), q), ids[best], total[best]))
                held = _keep([np.concatenate((h, *x)) for h, x in zip(held, zip(*found))] if found else held, k)
        part = np.full(len(held[0]), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int64()), pa.array(part, pa.int32())], names=["item", "doc_id", "score", "part"])

    return run


def _merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(built: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each item, equal scores by doc_id.

    A pass over the index takes along as many items as block_bytes hold; their terms' document frequencies come first, from
    the shards' dictionaries alone. In a shard an item adds up its terms' weighted impacts one term after the other in an
    array over the shard's documents. A task keeps k rows an item, tasks' lists merge in a tree. Items without a term or
    a hit give no rows; rows that share an item_id (null too) are one item with all their terms; repeated documents are
    listed each for itself, one after the other.
    """
    spark = items.sparkSession
    asked = items.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")), "items", "block")
    out, width = None, built.shards.rdd.getNumPartitions()
    for b in range(blocks):
        counts: dict[int | None, Counter] = {}
        for row in (asked.where(F.col("block") == b) if blocks > 1 else asked).select("key", "text").toLocalIterator():
            counts.setdefault(row["key"], Counter()).update(terms_of(row["text"].encode())[0])
        names = list(counts)
        number = {t: i for i, t in enumerate(sorted({t for c in counts.values() for t in c}))}
        rows = built.shards.select("terms", "starts").mapInArrow(_frequencies(spark.sparkContext.broadcast(number)), "term int, df long")
        weights = [0] * len(number)
        for term, df in rows.groupBy("term").agg(F.sum("df")).collect():  # as many rows as the block has terms
            weights[term] = math.floor(1000 * math.log((2 * built.docs + 2) / (2 * df + 1)))
        block = spark.sparkContext.broadcast(([[(number[t], n) for t, n in counts[x].items()] for x in names], number, weights))
        lists = built.shards.mapInArrow(_search(block, k), "item int, doc_id long, score long, part int")
        left = width
        while left > FAN:
            lists = _merged(lists.withColumn("part", F.expr(f"part div {FAN}").cast("int")), k, "item", "part").drop("rank")
            left = -(-left // FAN)
        # As many names as the block has items.
        table = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "item int, item_id long")
        best = _merged(lists.drop("part"), k, "item").join(F.broadcast(table), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP12_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
tf AS (SELECT k, doc_id, t, count(*) AS tf FROM (SELECT k, doc_id, {_TERMS} AS t FROM numbered) GROUP BY ALL),
n AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY k),
every AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, every GROUP BY t),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, tf.k, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN n USING (k), every GROUP BY item_id, tf.k),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
