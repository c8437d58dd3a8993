"""Perceptrons by data-parallel gradients: tasks add up the gradients of their rows, the driver takes the step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strata.operators.storage import stored

#: Partial gradients that are added up at once, on each level of the tree and at last on the driver.
FAN = 32
#: Adam's fixed values.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def started(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Weights and biases, layer by layer, uniform within sqrt(6 / (in + out))."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def margins(net, x: np.ndarray) -> np.ndarray:
    """Log odds of rows: ReLU layers, then one unit."""
    for i in range(0, len(net) - 2, 2):
        x = np.maximum(x @ net[i] + net[i + 1], 0.0)
    return (x @ net[-2] + net[-1])[:, 0]


def _losses(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0.0, z) - y * z).sum())


def gradients(net, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Sums over the rows: the gradient of the log loss for each array of the net, and the loss."""
    seen = [x]
    for i in range(0, len(net) - 2, 2):
        seen.append(np.maximum(seen[-1] @ net[i] + net[i + 1], 0.0))
    z = (seen[-1] @ net[-2] + net[-1])[:, 0]
    back, out = (1 / (1 + np.exp(-z)) - y)[:, None], []
    for i in reversed(range(0, len(net), 2)):
        out += [back.sum(0), seen[i // 2].T @ back]
        back = (back @ net[i].T) * (seen[i // 2] > 0)
    return out[::-1], _losses(z, y)


SUMS = "net int, part int, sums binary, loss double, n long, held_loss double, held long"


def _partial(state):
    """mapInArrow: fold, draw, y, x -> this task's sums for each net that still learns. A net k learns from the rows of other
    folds; those whose draw is below its share only judge."""

    def run(batches):
        from pyspark import TaskContext

        nets, share, done = state.value, state.value[1], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, draw, y = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(len(y), -1)
            for k, net in nets[0]:
                mine, judge = fold != k, draw < share
                grads, loss = gradients(net, x[mine & ~judge], y[mine & ~judge])
                flat = np.concatenate([g.ravel() for g in grads])
                z = margins(net, x[mine & judge])
                new = [flat, loss, int((mine & ~judge).sum()), _losses(z, y[mine & judge]), int((mine & judge).sum())]
                done[k] = [a + b for a, b in zip(done[k], new)] if k in done else new
        part = TaskContext.get().partitionId()
        for k, (flat, *rest) in done.items():
            yield pa.RecordBatch.from_pylist([{"net": k, "part": part, "sums": flat.tobytes(), "loss": rest[0], "n": rest[1], "held_loss": rest[2], "held": rest[3]}], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("net", pa.int32()), ("part", pa.int32()), ("sums", pa.binary()), ("loss", pa.float64()), ("n", pa.int64()), ("held_loss", pa.float64()), ("held", pa.int64())])


def _added(frame):
    """applyInPandas: sums of at most FAN tasks as one."""
    out = frame.head(1).copy()
    out["sums"] = [np.sum([np.frombuffer(bytes(s), float) for s in frame["sums"]], axis=0).tobytes()]
    for c in ("loss", "n", "held_loss", "held"):
        out[c] = frame[c].sum()
    return out


def _gathered(parts: DataFrame, tasks: int) -> dict[int, list]:
    """By net: the sums of all tasks, [gradient, loss, n, held loss, held]."""
    while tasks > FAN:
        parts = parts.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("net", "part").applyInPandas(_added, SUMS)
        tasks = -(-tasks // FAN)
    out: dict[int, list] = {}
    for r in sorted(parts.toArrow().to_pylist(), key=lambda r: (r["net"], r["part"])):
        new = [np.frombuffer(r["sums"], float), r["loss"], r["n"], r["held_loss"], r["held"]]
        out[r["net"]] = [a + b for a, b in zip(out[r["net"]], new)] if r["net"] in out else new
    return out


class Adam:
    """Adam's moments of one net."""

    def __init__(self, size: int, rate: float):
        self.first, self.second, self.step, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def move(self, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = BETA1 * self.first + (1 - BETA1) * grad
        self.second = BETA2 * self.second + (1 - BETA2) * grad**2
        return -self.rate * np.sqrt(1 - BETA2**self.step) / (1 - BETA1**self.step) * self.first / (np.sqrt(self.second) + EPSILON)


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [flat[e - a.size : e].reshape(a.shape) for e, a in zip(ends, like)]


def train(rows: DataFrame, sizes: list[int], parts: int = 1, iterations: int = 800, rate: float = 5e-3, l2: float = 0.01, patience: int = 30, share: float = 0.15, tol: float = 1e-5, seed: int = 42) -> list[list[np.ndarray]]:
    """Nets 0 to parts - 1, all trained in the same passes. rows: id, fold, y, x; net k learns from the folds other than k.

    A pass is one step: each task adds up the gradients of its rows for all nets, the sums meet in a tree, and the driver,
    which holds the weights and Adam's moments alone, moves each net. The penalty is l2 / 2 times the squared weights (not
    biases) over the rows. `share` of a net's rows, by hash, only judge: a net stops when their loss has not fallen by
    `tol` below its best for `patience` steps, and keeps its best weights.
    """
    spark = rows.sparkSession
    draw = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6).alias("draw")
    table = stored(rows.select(F.col("fold").cast("int").alias("fold"), draw, F.col("y").cast("double").alias("y"), "x"), "rows")
    tasks = table.rdd.getNumPartitions()
    nets = {k: started(sizes, seed + k) for k in range(parts)}
    flat = {k: np.concatenate([a.ravel() for a in net]) for k, net in nets.items()}
    decays = {k: np.concatenate([np.full(a.size, float(a.ndim == 2)) for a in net]) for k, net in nets.items()}
    adam, best = {k: Adam(len(flat[k]), rate) for k in nets}, {k: (np.inf, flat[k], 0) for k in nets}
    learning = set(nets)
    for step in range(iterations + 1):
        state = spark.sparkContext.broadcast(([(k, _shaped(flat[k], nets[k])) for k in sorted(learning)], share))
        found = _gathered(table.mapInArrow(_partial(state), SUMS), tasks)
        state.unpersist()
        for k in sorted(learning):
            if k not in found or not found[k][2]:
                learning.discard(k)  # no rows to learn from
                continue
            grad, loss, n, held_loss, held = found[k]
            judged = held_loss / held if held else loss / n
            if judged < best[k][0] - tol:
                best[k] = (judged, flat[k], step)
            if step == iterations or step - best[k][2] >= patience:
                learning.discard(k)
            else:
                flat[k] = flat[k] + adam[k].move((grad + l2 * decays[k] * flat[k]) / n)
        if not learning:
            break
    return [_shaped(best[k][1], nets[k]) for k in nets]


def margin_column(net, x):
    """A column of log odds from an array column."""

    def run(column):
        import pandas as pd

        return pd.Series(margins(net, np.stack(column.to_numpy()).astype(float)) if len(column) else [], dtype=float)

    return F.pandas_udf(run, DoubleType())(x)
