"""Tree learners by histograms: binned features, and one aggregation by (tree, node, feature, bin) for each level.

What leaves the executors is sums, as many as the trees' open nodes have bins, however many rows there are; splits are
chosen from them on the driver. Rows, their bins and their scores stay in a stored table.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strata.operators.ranks import percentiles
from strata.operators.storage import stored

#: Bins of a feature at most.
BINS = 32
#: Boosting rounds whose trees a pass applies anew before scores are stored; cells of histograms that the driver takes at once.
KEPT_ROUNDS, MOST_CELLS = 16, 4_000_000
#: Where no more different rows of bins than this are possible, boosting keeps equal ones as one row.
FEW_BINNED = 1 << 16
#: Gains are compared to so many decimals, so that the order in which tasks' sums meet doesn't choose between equal splits.
DECIMALS = 9


class Tree(NamedTuple):
    """Node i has children 2 i + 1 (bin <= cut) and 2 i + 2; feature -1 is a leaf. gain: what each split brought."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def _empty(depth: int) -> Tree:
    n = 2 ** (depth + 1) - 1
    return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))


def leaves(tree, bins: np.ndarray) -> np.ndarray:
    """The node each row of bins ends in."""
    at, feature, cut = np.zeros(len(bins), np.int64), tree[0], tree[1]
    while True:
        f = feature[at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return at
        i = at[inner]
        at[inner] = 2 * i + 1 + (bins[inner, f[inner]] > cut[i])


def edges(rows: DataFrame, width: int, bins: int = BINS, features: str = "x") -> list[np.ndarray]:
    """For each place of an array column, the distinct percentiles that cut its values into at most `bins` bins."""
    each = rows.select(F.posexplode(features).alias("place", "val"))
    cuts = percentiles(each, "val", [i / bins for i in range(1, bins)], "place", few=True).collect()
    found = {r.place: np.unique(np.array([v for v in r.p if v is not None], float)) for r in cuts}
    return [found.get(i, np.zeros(0)) for i in range(width)]


def cells(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows: how many cuts lie below each value."""
    out = np.zeros(x.shape, np.int32)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], "left")
    return out


def _rows(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _binned(cuts):
    """mapInArrow: id, y, w, held, x -> id, y, w, held, bins."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = cells(_rows(batch.column(4), float), cuts.value)
                at = pa.array(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(at, pa.array(b.ravel()))], names=["id", "y", "w", "held", "bins"])

    return run


def prepared(samples: DataFrame, cuts: list[np.ndarray], merged: bool = False) -> DataFrame:
    """A stored table of id, y (0 or 1), w, held and bins. samples: id, y, w, held, x (array of doubles).

    merged: rows that agree in y, held and bins are one, with the sum of their weights (rows without one stay apart) and
    their number n in place of id.
    """
    held = samples.sparkSession.sparkContext.broadcast(cuts)
    rows = samples.select(F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), "held", "x")
    rows = rows.mapInArrow(_binned(held), "id long, y double, w double, held boolean, bins array<int>")
    if merged:
        rows = rows.groupBy("y", "held", "bins", F.isnull("w").alias("bare")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).select("n", "y", "w", "held", "bins")
    return stored(rows, "binned")


#: From so many tasks on, their histograms are added up by an exchange before the driver gets them.
FEW_TASKS = 16


def _summed(parts: DataFrame, tasks: int) -> dict[str, np.ndarray]:
    """Columns of the tasks' histograms by tree, node, feature and bin; cells that are still there more than once are added up later."""
    if tasks > FEW_TASKS:
        parts = parts.groupBy("tree", "node", "feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    table = parts.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


CELLS = "tree int, node int, feature int, bin int, a double, b double, n long"


def _emit(tree: int, node: np.ndarray, features: dict[int, np.ndarray] | None, bins: np.ndarray, a: np.ndarray, b: np.ndarray, count: int, rows: np.ndarray | None = None):
    """Rows of CELLS: sums of a and b, and rows, by node, feature and bin. features: those of each node, all if None; rows: how many each stands for, one if None."""
    width = bins.shape[1]
    out = []
    for f in range(width):
        some = slice(None) if features is None else np.isin(node, [k for k, own in features.items() if f in own])
        key = node[some].astype(np.int64) * count + bins[some, f]
        if not len(key):
            continue
        used, at, n = np.unique(key, return_inverse=True, return_counts=True)
        n = n if rows is None else np.bincount(at, rows[some])
        out.append((used // count, np.full(len(used), f), used % count, np.bincount(at, a[some]), np.bincount(at, b[some]), n))
    if out:
        node_, feature, bin_, a_, b_, n = (np.concatenate(x) for x in zip(*out))
        whole = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([whole(np.full(len(node_), tree)), whole(node_), whole(feature), whole(bin_), pa.array(a_), pa.array(b_), pa.array(n.astype(np.int64))], names=["tree", "node", "feature", "bin", "a", "b", "n"])


def grids(found: dict[str, np.ndarray], width: int, count: int):
    """(tree, node) -> arrays (features x bins) of the sums."""
    order = np.lexsort((found["node"], found["tree"]))
    tree, node = found["tree"][order], found["node"][order]
    first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]) if len(tree) else []
    for lo, hi in zip(first, [*first[1:], len(tree)]):
        own, out = order[lo:hi], []
        for c in ("a", "b", "n"):
            z = np.zeros((width, count))
            np.add.at(z, (found["feature"][own], found["bin"][own]), found[c][own])
            out.append(z)
        yield (int(tree[lo]), int(node[lo])), out


def _best(gain: np.ndarray) -> tuple[int, int, float]:
    """Feature, bin and gain of the best split, equal ones by feature and bin; feature -1 if none gains."""
    gain = np.round(gain, DECIMALS)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 0 else (-1, 0, 0.0)


# Boosting


def raw_scores(trees, bins: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for t in trees:
        out += t[2][leaves(t, bins)]
    return out


def _loss(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, raw) - y * raw


def _gradients(state, count: int):
    """mapInArrow: n, y, w, held, bins, raw -> sums of gradients and hessians of the open nodes; node -1: loss and weight of held rows."""

    def run(batches):
        trees, now, level, report = state.value
        open_from, open_to = 2**level - 1, 2 ** (level + 1) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            n, y, w, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bins, raw = _rows(batch.column(4), np.int32), batch.column(5).to_numpy()
            raw = raw_scores(trees, bins, raw)
            if report and held.any():
                yield from _emit(0, np.full(held.sum(), -1), None, np.zeros((held.sum(), 1), np.int32), (w * _loss(raw, y))[held], w[held], 1)
            node = leaves(now, bins)
            some = ~held & (node >= open_from) & (node < open_to)
            p = 1 / (1 + np.exp(-raw[some]))
            yield from _emit(0, node[some], None, bins[some], w[some] * (p - y[some]), w[some] * p * (1 - p), count, n[some])

    return run


def _advanced(trees):
    """mapInArrow: adds the trees to the raw scores."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = raw_scores(trees.value, _rows(batch.column(4), np.int32), batch.column(5).to_numpy())
                yield batch.set_column(5, "raw", pa.array(raw))

    return run


class Boosted(NamedTuple):
    """cuts of the features, the score everything begins with, the trees, and the held rows' loss after each round."""

    cuts: list[np.ndarray]
    start: float
    trees: list[Tree]
    losses: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = raw_scores(self.trees, cells(x, self.cuts), np.full(len(x), self.start))
        return 1 / (1 + np.exp(-raw))


def boost(samples: DataFrame, width: int, rounds: int = 500, rate: float = 0.02, depth: int = 5, least: int = 3, l2: float = 0.1, patience: int | None = 25, bins: int = BINS) -> Boosted:
    """Gradient boosting of log loss. samples: id, y, w, held, x; held rows only judge.

    A level of a tree is one aggregation of gradients G and hessians H by node, feature and bin. A node is split where
    G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2) is largest and above 0, with at least `least` rows on
    either side; a leaf is worth -rate * G / (H + l2). Training ends after `rounds`, or when the held rows' loss has not
    fallen below its best for `patience` rounds, and keeps all its trees. Rows with weight 0 count for nothing but as rows.
    Rows with equal bins go down the same way: where few different ones are possible, levels read each once, not each row.
    """
    spark = samples.sparkSession
    samples = stored(samples, "samples")
    cuts = edges(samples.where("not held"), width, bins)
    merged = math.prod(len(c) + 1 for c in cuts) <= FEW_BINNED
    table, count = prepared(samples, cuts, merged), max(1, max((len(c) for c in cuts), default=0) + 1)
    table = table if merged else table.select(F.lit(1).cast("long").alias("n"), "y", "w", "held", "bins")
    totals = table.where("not held").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("w")).first()
    share = min(max((totals.p or 0.0) / (totals.w or 1.0), 1e-9), 1 - 1e-9)
    start = math.log(share / (1 - share))
    table, trees, losses, done, tasks = table.withColumn("raw", F.lit(start)), [], [], 0, table.rdd.getNumPartitions()
    for r in range(rounds + 1):
        if r - done == KEPT_ROUNDS:
            schema = table.schema
            table, done = stored(table.mapInArrow(_advanced(spark.sparkContext.broadcast([tuple(t) for t in trees[done:]])), schema), "raw"), r
        now = _empty(depth)
        for level in range(depth):
            state = spark.sparkContext.broadcast(([tuple(t) for t in trees[done:]], tuple(now), level, level == 0))
            found = _summed(table.mapInArrow(_gradients(state, count), CELLS), tasks)
            state.unpersist()
            split = False
            for (_, node), (g, h, n) in grids(found, width, count):
                if node < 0:
                    losses.append(float(g[0, 0] / max(h[0, 0], 1e-300)))
                    continue
                total_g, total_h = g[0].sum(), h[0].sum()
                worth = lambda a, b: -rate * a / (b + l2)
                now.value[node] = worth(total_g, total_h)
                gl, hl, nl = np.cumsum(g, 1), np.cumsum(h, 1), np.cumsum(n, 1)
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                f, b, won = _best(np.where((nl >= least) & (n[0].sum() - nl >= least), gain, -np.inf))
                if f >= 0:
                    now.feature[node], now.cut[node], now.gain[node], split = f, b, won, True
                    now.value[2 * node + 1], now.value[2 * node + 2] = worth(gl[f, b], hl[f, b]), worth(total_g - gl[f, b], total_h - hl[f, b])
            stop = level == 0 and (r == rounds or (patience is not None and len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience])))
            if stop or not split:
                break
        if stop:
            break
        trees.append(now)
    return Boosted(cuts, start, trees, losses)


# Forest


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Chances that a row is drawn at most 0, 1, 2 ... times: Poisson of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap: by hash, so it hangs on the row, the tree and the seed alone."""
    with np.errstate(over="ignore"):
        u = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 1_000_003 + seed))
    return np.searchsorted(_POISSON, (u >> np.uint64(11)) / 2.0**53, "right").astype(float)


def subset(width: int, take: int, tree: int, node: int, seed: int) -> np.ndarray:
    """The features that a node of a tree may split on."""
    return np.sort(np.random.default_rng([seed, tree, node]).permutation(width)[:take])


def _counts(state, count: int):
    """mapInArrow: drawn rows of both classes in the open nodes of the trees, by the features each node looks at."""

    def run(batches):
        trees, level, take, seed = state.value
        open_from, open_to = 2**level - 1, 2 ** (level + 1) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows(batch.column(4), np.int32)
            for t, tree in trees:
                k, node = drawn(ids, t, seed), leaves(tree, bins)
                some = (k > 0) & (node >= open_from) & (node < open_to)
                own = {int(m): set(subset(bins.shape[1], take, t, int(m), seed).tolist()) for m in np.unique(node[some])}
                yield from _emit(t, node[some], own, bins[some], (k * y)[some], (k * (1 - y))[some], count)

    return run


def _votes(state):
    """mapInArrow: id, y, mean vote of the trees that did not draw the row (null if all did)."""

    def run(batches):
        trees, seed = state.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bins = batch.column(0).to_numpy(), _rows(batch.column(4), np.int32)
            total, n = np.zeros(len(ids)), np.zeros(len(ids))
            for t, tree in enumerate(trees):
                out = drawn(ids, t, seed) == 0
                total += np.where(out, tree[2][leaves(tree, bins)], 0.0)
                n += out
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total / np.maximum(n, 1), mask=n == 0)], names=["id", "y", "vote"])

    return run


class Forest(NamedTuple):
    """cuts of the features, the trees, and the share of rows that the trees which didn't see them get right."""

    cuts: list[np.ndarray]
    trees: list[Tree]
    oob: float | None

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = cells(x, self.cuts)
        return sum((t.value[leaves(t, bins)] for t in self.trees), np.zeros(len(x))) / max(1, len(self.trees))


def grow(samples: DataFrame, width: int, trees: int = 300, depth: int = 10, least: int = 1, split_least: int = 2, take: int | None = None, seed: int = 42, bins: int = BINS) -> Forest:
    """Random forest. samples: id (unlike for different rows), y, x.

    A tree's bootstrap gives each row a Poisson weight by hash; in it both classes weigh the same. A node looks at `take`
    features (the root of their number if None) and is split where the weighted Gini impurity falls most, if it has
    split_least drawn rows and leaves `least` on either side. A level of as many trees as MOST_CELLS sums allow is one
    aggregation. oob is the accuracy of the mean vote of those trees that didn't draw a row.
    """
    spark = samples.sparkSession
    take = take or max(1, int(math.sqrt(width)))
    samples = stored(samples.select("id", "y", F.lit(1.0).alias("w"), F.lit(False).alias("held"), "x"), "samples")
    cuts = edges(samples, width, bins)
    table, count = prepared(samples, cuts), max(1, max((len(c) for c in cuts), default=0) + 1)
    made, tasks = {t: _empty(depth) for t in range(trees)}, table.rdd.getNumPartitions()
    scale, active = {}, dict.fromkeys(range(trees), 1)
    for level in range(depth):
        todo = [t for t in range(trees) if active[t]]
        while todo:
            some, size = [], 0
            while todo and (not some or size + active[todo[0]] * take * count <= MOST_CELLS):
                size += active[todo[0]] * take * count
                some.append(todo.pop(0))
            state = spark.sparkContext.broadcast(([(t, tuple(made[t])) for t in some], level, take, seed))
            found = _summed(table.mapInArrow(_counts(state, count), CELLS), tasks)
            state.unpersist()
            active.update(dict.fromkeys(some, 0))
            for (t, node), (p, q, n) in grids(found, width, count):
                own = subset(width, take, t, node, seed)
                p, q, n = p[own], q[own], n[own]
                if level == 0:
                    scale[t] = tuple((p[0].sum() + q[0].sum()) / (2 * max(x[0].sum(), 1e-300)) for x in (p, q))
                p, q = p * scale[t][0], q * scale[t][1]
                total_p, total_q = p[0].sum(), q[0].sum()
                made[t].value[node] = total_p / (total_p + total_q)
                if n[0].sum() < split_least or not total_p or not total_q:
                    continue
                pl, ql, nl = np.cumsum(p, 1), np.cumsum(q, 1), np.cumsum(n, 1)
                impure = lambda a, b: 2 * a * b / np.maximum(a + b, 1e-300)  # noqa: E731  Gini impurity times weight
                gain = impure(total_p, total_q) - impure(pl, ql) - impure(total_p - pl, total_q - ql)
                f, b, won = _best(np.where((nl >= least) & (n[0].sum() - nl >= least), gain, -np.inf))
                if f >= 0:
                    made[t].feature[node], made[t].cut[node], made[t].gain[node] = own[f], b, won
                    for child, (a, c) in ((2 * node + 1, (pl[f, b], ql[f, b])), (2 * node + 2, (total_p - pl[f, b], total_q - ql[f, b]))):
                        made[t].value[child] = a / max(a + c, 1e-300)
                    active[t] += 2
    every = [made[t] for t in range(trees)]
    votes = table.mapInArrow(_votes(spark.sparkContext.broadcast(([tuple(t) for t in every], seed))), "id long, y double, vote double")
    right = votes.where("vote is not null").agg(F.avg(((F.col("vote") > 0.5).cast("double") == F.col("y")).cast("double")).alias("r")).first().r
    return Forest(cuts, every, right)


def out_of_bag(samples: DataFrame, forest: Forest, seed: int = 42) -> DataFrame:
    """id, y, vote: the mean vote of the trees that did not draw a row."""
    table = prepared(samples.select("id", "y", F.lit(1.0).alias("w"), F.lit(False).alias("held"), "x"), forest.cuts)
    return table.mapInArrow(_votes(samples.sparkSession.sparkContext.broadcast(([tuple(t) for t in forest.trees], seed))), "id long, y double, vote double")


def importances(trees: list[Tree], width: int) -> np.ndarray:
    """Each feature's share of what all splits gained."""
    total = np.zeros(width)
    for t in trees:
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], t.gain[inner])
    return total / total.sum() if total.sum() > 0 else total


def scores(model, x):
    """A column of probabilities from an array column. The model goes along as plain arrays."""
    cuts, trees, start = model.cuts, [tuple(t) for t in model.trees], getattr(model, "start", None)

    def run(column):
        import pandas as pd

        if not len(column):
            return pd.Series([], dtype=float)
        bins = cells(np.stack(column.to_numpy()).astype(float), cuts)
        if start is None:
            out = sum((t[2][leaves(t, bins)] for t in trees), np.zeros(len(bins))) / max(1, len(trees))
        else:
            out = 1 / (1 + np.exp(-raw_scores(trees, bins, np.full(len(bins), start))))
        return pd.Series(out)

    return F.pandas_udf(run, DoubleType())(x)


def packed(model) -> str:
    """The model as JSON."""
    return json.dumps({"kind": type(model).__name__, **{k: [[x.tolist() for x in t] for t in v] if k == "trees" else [c.tolist() for c in v] if k == "cuts" else v for k, v in model._asdict().items()}})


def unpacked(text: str):
    kept = json.loads(text)
    kind = {"Boosted": Boosted, "Forest": Forest}[kept.pop("kind")]
    kept["cuts"] = [np.array(c, float) for c in kept["cuts"]]
    kept["trees"] = [Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v, float), np.array(g, float)) for f, c, v, g in kept["trees"]]
    return kind(**kept)
