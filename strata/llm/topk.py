"""Exact top-k inner-product search: query blocks against shards, partial selection per tile, tree merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import read, stored

#: Bytes of queries that one pass over the vectors takes along (a broadcast), as float64; rows of a tile.
BLOCK_BYTES = 1 << 27
TILE_ROWS = 8192
#: Queries that meet a tile at once.
QUERY_ROWS = 1024
#: Lists merged into one on each level of the tree.
FAN = 64
LONG = (-(2**63), 2**63 - 1)


def _matrix(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(256 x) as float64 of the rows that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return {}
    flat = vectors.flatten()
    lengths = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    valid = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    valid &= bad[starts[1:]] == bad[starts[:-1]]
    keys, out = ids.fill_null(0).to_numpy(zero_copy_only=False), {}
    with np.errstate(over="ignore"):
        for d in np.unique(lengths[valid]):
            rows = np.flatnonzero(valid & (lengths == d))
            out[int(d)] = keys[rows], np.floor(256.0 * values[starts[rows][:, None] + np.arange(d)])
    return out


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: float32 or float64 BLAS where no sum can round, else Python integers.

    Sums beyond a long stand at its ends.
    """
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2**24:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.float64)
    if top < 2**53:
        return q @ v.T
    whole = lambda m: np.array([[int(x) if np.isfinite(x) else (LONG[1] if x > 0 else LONG[0]) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(v).T), *LONG)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores the k best (query index, id, score), ties to the smaller id. ids ascend; equal ids count once."""
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(start) < len(ids):
        scores, ids = np.maximum.reduceat(scores, start, axis=1), ids[start]
    at = np.searchsorted(ids, own)
    hit = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own))
    if scores.dtype != object and (np.abs(scores).max(initial=0) + 1) * (len(ids) + 1) < 2**52:
        rank = scores * (len(ids) + 1) - np.arange(len(ids))  # one number that orders by score, then by id
        rank[hit, at[hit]] = -np.inf
        cols = np.argpartition(-rank, k - 1, axis=1)[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), scores.shape)
    else:
        # A stable order by falling score; one more than k, as the query itself may be among them. ~x falls as x rises.
        cols = np.argsort(~scores.astype(np.int64), axis=1, kind="stable")[:, : k + 1]
    rows = np.repeat(np.arange(len(scores)), cols.shape[1])
    cols = cols.ravel()
    keep = ids[cols] != own[rows]
    rows, cols = rows[keep], cols[keep]
    return rows, ids[cols], scores[rows, cols].astype(np.int64)


def _first(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each q, an id counting once with its best score."""
    order = np.lexsort((ids, -scores, q)) if scores.min(initial=0) > LONG[0] else np.lexsort((ids, ~scores, q))
    q, ids = q[order], ids[order]
    again = np.lexsort((np.arange(len(q)), ids, q))
    repeated = np.zeros(len(q), bool)
    repeated[again[1:]] = (q[again[1:]] == q[again[:-1]]) & (ids[again[1:]] == ids[again[:-1]])
    order, q = order[~repeated], q[~repeated]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


SCHEMA = "query_id long, vec_id long, score long, part int"


def _search(block, k: int, id_col: str, vec_col: str):
    """mapInArrow function: the k best of this task's shard for each query of the block."""

    def run(batches):
        from pyspark import TaskContext

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(at, TILE_ROWS)
                for d, (ids, v) in _matrix(tile.column(tile.schema.get_field_index(id_col)), tile.column(tile.schema.get_field_index(vec_col))).items():
                    if d not in block.value:
                        continue
                    order = np.argsort(ids, kind="stable")
                    ids, v, (qid, q) = ids[order], v[order], block.value[d]
                    for lo in range(0, len(qid), QUERY_ROWS):
                        rows, got, score = _best(_scores(q[lo : lo + QUERY_ROWS], v), ids, qid[lo : lo + QUERY_ROWS], k)
                        held = [np.r_[a, b] for a, b in zip(held, (qid[lo : lo + QUERY_ROWS][rows], got, score))]
            keep = _first(*held, k)
            held = [x[keep] for x in held]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held] + [pa.array(np.full(len(held[0]), part), pa.int32())], names=["query_id", "vec_id", "score", "part"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of floor(256 x) for each query.

    A pass over the vectors takes along as many queries as block_bytes hold, as a broadcast; a tile of vectors meets them
    by QUERY_ROWS. More queries make more passes, each paid for by as many products. Vectors are never shuffled. A task
    keeps k rows a query, and the tasks' lists merge in a tree. Ties go to the smaller id. A query never finds its own id.
    Null vectors, null ids and vectors with a null or non-finite component take no part. Only vectors of the same length
    are compared. Rows that share an id count as versions of one vector: the best score of a pair stands. Scores beyond a
    long stand at its ends. Fewer candidates than k give fewer rows; empty tables give none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col)
    asked = queries.select(F.col(id_col).cast("long").alias(id_col), vec_col).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    size = asked.agg(F.sum(F.size(vec_col) * 8 + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        # Blocks of about block_bytes each; every block is read alone.
        asked = stored(asked.select(id_col, vec_col, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias(f"block_of_{id_col}")), "queries", f"block_of_{id_col}")
    lists = None
    for b in range(blocks):
        table = (asked.where(F.col(f"block_of_{id_col}") == b).select(id_col, vec_col) if blocks > 1 else asked).toArrow()
        matrix = _matrix(table.column(0).combine_chunks(), table.column(1).combine_chunks()) if table.num_rows else {}
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(matrix), k, id_col, vec_col), SCHEMA)
        lists = found if lists is None else lists.unionByName(found)
    width = rows.rdd.getNumPartitions()
    while width > FAN:
        lists = _merged(lists.withColumn("part", F.expr(f"part div {FAN}").cast("int")), k, "query_id", "part").drop("rank")
        width = -(-width // FAN)
    return _merged(lists.drop("part"), k, "query_id").select("query_id", "rank", "vec_id", "score")


def _merged(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    once = lists.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
