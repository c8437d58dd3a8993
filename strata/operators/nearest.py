"""Exact nearest neighbours: Voronoi cells around sampled pivots, triangle-inequality bounds on which cells can meet, products as a first look."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.storage import stored

#: Rows of a cell, about; pivots at most (they go to every task); rows of a block, about: larger cells are several blocks.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 256, 2048, 4096
#: Rows of the blocks that a task keeps at hand while others pass, about; each such side gives k rows for every row.
SIDE_ROWS = 1 << 18
#: Rows that meet a block at once; files of the blocks at most; near pairs a row from which on columns are taken a run at a time.
RUN_ROWS, MOST_FILES, MANY_NEAR = 512, 1024, 64
#: What rounding may take from a bound.
SLACK = 1e-9
LAST = 2**63 - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, added up component by component, so they are the same whatever the tiles."""
    out = np.zeros((len(a), len(b)))
    for x in range(a.shape[1]):
        out += (a[:, x, None] - b[None, :, x]) ** 2
    return out


def _of_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """squared() of the pairs (i, j) of columns of a and b."""
    out = np.zeros(len(i))
    for x in range(len(a)):
        out += (a[x, i] - b[x, j]) ** 2
    return out


def _placed(pivots):
    """mapInArrow: a, v -> cell (of the nearest pivot, as far as products tell), r (the distance to it), a, v."""

    def run(batches):
        with np.errstate(all="ignore"):
            centre = pivots.value.mean(0)
            p = pivots.value - centre
            half, across = (p**2).sum(1) / 2, np.ascontiguousarray(pivots.value.T)
            for batch in batches:
                for lo in range(0, batch.num_rows, RUN_ROWS):
                    part = batch.slice(lo, RUN_ROWS)
                    v = _matrix(part.column(1)).astype(np.float64)
                    cell = ((v - centre) @ p.T - half).argmax(1)
                    r = np.sqrt(_of_pairs(np.ascontiguousarray(v.T), np.arange(len(v)), across, cell))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(r), *part.columns], names=["cell", "r", "a", "v"])

    return run


PACKED = "block long, cells binary, ids binary, vecs binary"


def _packed(kind):
    """applyInArrow: the rows of a block -> one row, by cell and id."""

    def run(table):
        table = table.combine_chunks()
        cell, ids = table["cell"].to_numpy(), table["a"].to_numpy()
        order = np.lexsort((ids, cell))
        v = _matrix(table["v"].combine_chunks())[order].astype(kind)
        columns = [pa.array([table["block"][0].as_py()], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in (cell[order].astype(np.int32), ids[order].astype(np.int64), v)]
        return pa.Table.from_arrays(columns, names=["block", "cells", "ids", "vecs"])

    return run


def _block(columns: list[pa.Array], i: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cells, ids and vectors of row i."""
    cell, ids, v = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, (np.int32, np.int64, kind)))
    return cell, ids, v.reshape(len(ids), -1).astype(np.float64)


def _error(t, d: int, own: float, other: float) -> float:
    """What rounding may do to q.v - v.v / 2 in numbers of type t, if q.q and v.v are at most own and other."""
    return (d + 8) * float(np.finfo(t).eps) * (np.sqrt(own) * np.sqrt(other) + other) + 1e-300


class _Lists:
    """The k nearest rows found so far for each row of a block.

    Products on vectors less the block's mean say which pairs can matter, with a margin for their rounding: in float32
    where that margin is small beside the distances, else in float64. The distances of those pairs are then added up as
    squared() does.
    """

    def __init__(self, cell, ids, v, k: int, bounds):
        self.ids, self.k, self.bounds, self.done = ids, k, bounds, 0
        self.across, self.centre = np.ascontiguousarray(v.T), v.mean(0)
        near = v - self.centre
        self.norm = (near**2).sum(1)
        self.most = self.norm.max()
        self.rows = {t: np.c_[near, np.ones(len(v))].astype(t) for t in (np.float32, np.float64)}
        edges = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        self.runs = [slice(lo, min(lo + RUN_ROWS, hi)) for start, hi in zip(edges[:-1], edges[1:]) for lo in range(start, hi, RUN_ROWS)]
        self.d2, self.other = np.full((len(v), k), np.inf), np.full((len(v), k), LAST)
        self.within = self._first()

    def _first(self) -> np.ndarray:
        """For each row a squared distance within which k others of its block lie; infinite if there aren't so many."""
        n, out = len(self.ids), np.full(len(self.ids), np.inf)
        if n <= self.k:
            return out
        for t in (np.float32, np.float64):
            if t is np.float32 and not 1e-20 < self.most < 1e30:
                continue
            error = _error(t, len(self.across), self.most, self.most)
            there = np.c_[self.rows[np.float64][:, :-1], -self.norm / 2].astype(t).T
            for run in self.runs:
                dots = self.rows[t][run] @ there
                dots[self.ids[run, None] == self.ids] = -np.inf
                kth = np.partition(dots, n - self.k, axis=1)[:, n - self.k].astype(np.float64)
                out[run] = np.maximum(self.norm[run] - 2 * kth + 2 * error + self.norm[run] * SLACK, 0.0) * (1 + SLACK)
            if error <= 0.01 * np.median(out):
                break
        return np.where(np.isnan(out), np.inf, out)

    def _low(self, cells: np.ndarray) -> np.ndarray:
        """How near each row can be, at least, to rows of the cells, whose distances to their pivots lie between least and most."""
        pivots, known, least, most = self.bounds
        p, at = pivots[cells] - self.centre, np.searchsorted(known, cells)
        norm = (p**2).sum(1)
        d2 = self.norm[:, None] + norm - 2 * (self.rows[np.float64][:, :-1] @ p.T)
        margin = 4 * (_error(np.float64, len(self.across), self.most, norm.max()) + _error(np.float64, len(self.across), 0.0, self.most))
        return np.maximum(np.maximum(np.sqrt(np.maximum(d2 - margin, 0)) - most[at], least[at] - np.sqrt(np.maximum(d2 + margin, 0))), 0.0)

    def meet(self, cell: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        start = np.r_[True, cell[1:] != cell[:-1]]
        keep = ~(self._low(cell[start]) > np.sqrt(self.within)[:, None] * (1 + SLACK))
        if not keep.any():
            return
        of, near, across = np.cumsum(start) - 1, v - self.centre, np.ascontiguousarray(v.T)
        norm = (near**2).sum(1)
        error = _error(np.float32, len(across), self.most, norm.max())
        t = np.float32 if error <= 0.01 * np.median(self.within) < 1e30 and 1e-20 < max(self.most, norm.max()) < 1e30 else np.float64
        error, there = _error(t, len(across), self.most, norm.max()), np.c_[near, -norm / 2].astype(t)
        for run in self.runs:
            some = keep[run].any(0)
            if not some.any():
                continue
            rows = run.start + np.flatnonzero(keep[run].any(1))
            cols = np.flatnonzero(some[of])
            self.done += len(rows) * len(cols)
            if np.isfinite(error):
                least = (self.norm[rows] * (1 - 1e-12) - self.within[rows] * (1 + SLACK)) / 2 - error
                least = np.maximum(least - np.abs(least) * 2 * np.finfo(t).eps, np.finfo(t).min).astype(t)
                # What isn't a number counts as near.
                pairs = ~(self.rows[t][rows] @ (there if len(cols) == len(ids) else there[cols]).T < least[:, None])
            else:
                pairs = np.ones((len(rows), len(cols)), bool)
            # Of many equal rows the first ones found leave out the rest before their distances are added up.
            step = RUN_ROWS if np.count_nonzero(pairs) > MANY_NEAR * len(rows) else len(cols)
            for lo in range(0, len(cols), step):
                part = cols[lo : lo + step]
                # Of rows at no distance only smaller ids than those at hand matter.
                wanting = (self.within[rows] > 0) | (ids[part].min() < self.other[rows, -1])
                hit = np.flatnonzero(pairs[:, lo : lo + step] & wanting[:, None])
                row, col = rows[hit // len(part)], part[hit % len(part)]
                use = (ids[col] != self.ids[row]) & ((self.within[row] > 0) | (ids[col] < self.other[row, -1]))
                self._take(row[use], ids[col[use]], _of_pairs(self.across, row[use], across, col[use]))

    def _take(self, row: np.ndarray, ids: np.ndarray, d2: np.ndarray) -> None:
        use = np.isfinite(d2) & (d2 <= self.within[row])
        some = np.unique(row[use])
        if not len(some):
            return
        row = np.r_[row[use], np.repeat(some, self.k)]
        ids, d2 = np.r_[ids[use], self.other[some].ravel()], np.r_[d2[use], self.d2[some].ravel()]
        order = np.lexsort((ids, d2, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        order = order[(first[:, None] + np.arange(self.k)).ravel()]  # each has the k it had, or more
        self.d2[some], self.other[some] = d2[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)
        self.within[some] = np.minimum(self.within[some], self.d2[some, -1])

    def found(self) -> pa.RecordBatch:
        there = np.isfinite(self.d2)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(1))), pa.array(self.other[there]), pa.array(self.d2[there])], names=["a", "b", "d2"])


def _compared(held, k: int, kind, report: bool):
    """mapInArrow: pairs of blocks, those of one first block behind each other -> the k nearest rows of the second ones for
    each row of the first, or how many distances were looked at."""

    def run(batches):
        block, lists = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([lists.done], pa.int64())], names=["n"]) if report else lists.found()
        with np.errstate(all="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    if lists is None or batch.column(0)[i].as_py() != block:
                        if lists:
                            yield out()
                        block, lists = batch.column(0)[i].as_py(), _Lists(*_block(batch.columns[1:4], i, kind), k, held.value)
                    lists.meet(*_block(batch.columns[4:], i, kind))
            if lists:
                yield out()

    return run


class Cells(NamedTuple):
    """blocks: block and the cells, ids and vectors of its rows; rows: how many there are; bounds: broadcast pivots and
    cells' rings; kind: the type that holds the vectors' components."""

    blocks: DataFrame
    rows: int
    bounds: object
    kind: type


def _numbers(counts: list[int], block_rows: int) -> list[tuple[int, int]]:
    """For cells of so many rows the first of their blocks and how many: a block is several small cells or part of a large one."""
    out, block, room = [], -1, 0
    for n in counts:
        if n > block_rows:
            out.append((block + 1, -(-n // block_rows)))
            block, room = block + out[-1][1], 0
        else:
            if n > room:
                block, room = block + 1, block_rows
            out.append((block, 1))
            room -= n
    return out


def cells(vectors: DataFrame, key: str, vec: str, cell_rows: int, block_rows: int) -> Cells | None:
    """Rows in cells, and these in blocks. None without rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("a"), F.col(vec).cast("array<double>").alias("v")).dropna()
    rows = stored(rows.where(F.forall("v", lambda x: F.abs(x) < float("inf"))), "vectors")
    # Components that were floats are kept as such.
    n, short = rows.agg(F.count("*"), F.bool_and(F.forall("v", lambda x: x.cast("float").cast("double") == x))).first()
    if not n:
        return None
    chosen = rows.orderBy(F.xxhash64("a"), "a").limit(max(1, min(MOST_PIVOTS, -(-n // cell_rows)))).select("v").toArrow()
    pivots = np.unique(_matrix(chosen.column(0).combine_chunks()), axis=0)
    kind = "float" if short else "double"
    placed = rows.select("a", F.col("v").cast(f"array<{kind}>").alias("v")).mapInArrow(_placed(spark.sparkContext.broadcast(pivots)), f"cell int, r double, a long, v array<{kind}>")
    # A row a cell.
    ring = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).orderBy("cell").toPandas()
    bounds = spark.sparkContext.broadcast((pivots, ring["cell"].to_numpy(), ring["least"].to_numpy() * (1 - SLACK), ring["most"].to_numpy() * (1 + SLACK)))
    numbers = _numbers(ring["n"].tolist(), block_rows)
    of = spark.createDataFrame([(int(c), *x) for c, x in zip(ring["cell"], numbers)], "cell int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("a"), F.col("parts"))
    dealt = placed.join(F.broadcast(of), "cell").select(block.cast("int").alias("block"), "cell", "a", "v").repartitionById(min(MOST_FILES, sum(numbers[-1])), "block")
    dtype = np.float32 if short else np.float64
    return Cells(stored(dealt.groupBy("block").applyInArrow(_packed(dtype), PACKED), "blocks"), n, bounds, dtype)


def _met(made: Cells, k: int, report: bool, schema: str) -> DataFrame:
    """All blocks beside all others: nothing is shuffled, tasks read the blocks again."""
    other = made.blocks.select(*[F.col(c).alias(f"other_{c}") for c in ("cells", "ids", "vecs")]).coalesce(-(-made.rows // SIDE_ROWS))
    return made.blocks.crossJoin(other.hint("shuffle_replicate_nl")).mapInArrow(_compared(made.bounds, k, made.kind, report), schema)


def neighbours(vectors: DataFrame, k: int = 5, key: str = "id", vec: str = "vec", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, rank, other, d2: the k nearest other rows by squared distance, ties by id. Vectors have one length; rows with a
    null key or vector, or a component that isn't finite, take no part; rows that share an id aren't neighbours of each other.

    Pivots are a sample by hash, and a row belongs to the cell of its nearest one. Some cells, or a part of a large one, are
    a block, stored as one row, so no task holds a cell. Each block meets all others in a product of the stored table with
    itself: tasks read it again, and no vector is shuffled. A row has k neighbours within its own block, and nearer ones
    as blocks pass, which bounds how far others can matter; by the triangle inequality that leaves out the cells whose
    rings around their pivots are farther. Products leave few of the other pairs, whose distances are then worked out.
    The lists of a row, one for each SIDE_ROWS rows of the table, are merged by its key. Where distances tell little
    apart (many dimensions without clusters) all rows meet in products.
    """
    made = cells(vectors, key, vec, cell_rows, block_rows)
    if made is None:
        lists = vectors.sparkSession.createDataFrame([], "a long, b long, d2 double")
    else:
        lists = _met(made, k, False, "a long, b long, d2 double")
    order = Window.partitionBy("a").orderBy("d2", "b")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("a").alias(key), "rank", F.col("b").alias("other"), "d2")


def compared(vectors: DataFrame, k: int = 5, key: str = "id", vec: str = "vec", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: n, distances: how many rows there are, and how many pairs of them neighbours() looks at."""
    made = cells(vectors, key, vec, cell_rows, block_rows)
    if made is None:
        return vectors.sparkSession.createDataFrame([(0, 0)], "n long, distances long")
    return _met(made, k, True, "n long").agg(F.lit(made.rows).cast("long").alias("n"), F.sum("n").alias("distances"))
