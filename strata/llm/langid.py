"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

The model is learned from every labelled row. A start fitted on some rows of each label goes to all tasks; each goes on from
there over its own rows, and the mean of what the tasks learned is where the next pass, or the model, stands. Temperature and rejection score come from
all rows that are held back.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, stored, text_bytes
from strata.operators.ranks import percentiles

#: Rows a label gives to the sample of the start at most, and words of the pieces cut from texts besides the whole.
SAMPLE_PER_LABEL = 500
SNIPPETS = (2, 5, 12, 40)
#: Bags of a step, passes over all rows and their first rate (the start's is 1), rows of a task at least (a few steps teach little),
#: and models that are added up at a time.
STEP, PASSES, RATE, TASK_ROWS, FAN = 64, 2, 0.5, 4096, 16
BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Bytes looked at together.
CHUNK = 1 << 19

# Letters and bytes of longer characters stay; anything else parts words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    """labels, table (bucket x column), columns x labels weights or None, bias, temperature, and the score below which a text is rejected."""

    labels: list
    table: np.ndarray
    weights: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, and whether each has a letter."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    letter = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
    raw, offsets = text_bytes(pc.utf8_lower(column))
    return raw, offsets, letter


def subwords(raw: np.ndarray, offsets: np.ndarray):
    """For each size, the bucket of the subword that starts at each byte and whether one does: none crosses words or rows."""
    b = _FOLD[raw].astype(np.uint32)
    space = b == 32
    last = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(b))] - 1
    goes_on = np.ones(len(b), bool)  # whether the next byte is of the same row
    goes_on[last] = False
    # A size goes on from the one before it: another byte, which must be of the row, behind one that must not part words.
    code, whole = b, np.ones(len(b), bool)
    for n in range(2, SIZES[-1] + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        code = code[:m] * np.uint32(0x01000193) + b[n - 1 :]
        whole = whole[:m] & goes_on[n - 2 : -1]
        if n > 2:
            whole &= ~space[n - 2 : -1]
        if n in SIZES:
            yield ((code + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64), whole & ~(space[:m] & space[n - 1 :])


assert BUCKETS == 1 << (32 - 18)


def _by_row(raw: np.ndarray, offsets: np.ndarray):
    """For each size, the buckets of all subwords, row by row, and n + 1 offsets of the rows among them."""
    for code, ok in subwords(raw, offsets):
        at = np.flatnonzero(ok)
        yield code[at], np.searchsorted(at, offsets)


def sums(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x columns) sums of the table over the subwords of each row, and their number."""
    n = len(offsets) - 1
    total, count = np.zeros((n, table.shape[1])), np.zeros(n)
    columns = [table[:, c].astype(np.float64) for c in range(table.shape[1])]
    for code, of in _by_row(raw, offsets):
        some = np.flatnonzero(of[:-1] < of[1:])
        if len(some):
            count += np.diff(of)
            for c, column in enumerate(columns):
                total[some, c] += np.add.reduceat(column[code], of[some])
    return total, count


def _logits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x labels) outputs before the temperature."""
    total, count = sums(raw, offsets, model.table)
    mean = total / np.maximum(count, 1)[:, None]
    return (mean if model.weights is None else mean @ model.weights) + model.bias


def predict(model: Model, column: pa.Array) -> tuple[list, np.ndarray]:
    """Labels ('und' for texts without a letter) and calibrated scores."""
    raw, offsets, letter = lowered(column)
    labels, scores = np.empty(len(column), object), np.zeros(len(column))
    for i, j in pieces(offsets, CHUNK):
        part = offsets[i : j + 1]
        p = _softmax(_logits(model, raw[part[0] : part[-1]], part - part[0]) / model.temperature)
        best = p.argmax(1)
        labels[i:j] = np.array(model.labels, object)[best]
        scores[i:j] = p[np.arange(j - i), best]
    labels[~letter] = UNKNOWN
    scores[~letter] = 0.0
    return list(labels), scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(batches):
    """mapInArrow: bags of subword buckets of each sampled text and of pieces of it."""
    for batch in batches:
        out = {"label": [], "draw": [], "whole": [], "ids": [], "counts": []}
        for label, draw, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words, rng = (text or "").split(), np.random.default_rng(draw & (2**63 - 1))
            parts = [text or ""] + [" ".join(words[at : at + k]) for k in SNIPPETS if len(words) > k for at in [int(rng.integers(0, len(words) - k + 1))]]
            raw, offsets, letter = lowered(pa.array(parts, pa.large_string()))
            for p in range(len(parts)):
                bag = np.zeros(BUCKETS, np.int64)
                for lo, hi in _cuts(int(offsets[p]), int(offsets[p + 1])):
                    for code, ok in subwords(raw[lo:hi], np.array([0, hi - lo])):
                        bag += np.bincount(code[ok], minlength=BUCKETS)
                ids = np.flatnonzero(bag)
                if len(ids) and letter[p]:
                    for k, v in (("label", label), ("draw", draw), ("whole", p == 0), ("ids", ids.astype(np.int32)), ("counts", bag[ids].astype(np.float32))):
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["label"], pa.string()), pa.array(out["draw"], pa.int64()), pa.array(out["whole"], pa.bool_()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.float32()))], names=list(out))


def _cuts(lo: int, hi: int):
    return [(a, min(hi, a + CHUNK)) for a in range(lo, hi, CHUNK)]


def labelled(docs: DataFrame, label: str, text: str, key: str, seed: int = 1) -> DataFrame:
    """label, draw (a hash of key), text: the rows with a label and a letter."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    return rows.select(F.col(label).cast("string").alias("label"), F.xxhash64(F.lit(seed), F.col(key)).alias("draw"), F.col(text).alias("text"))


def bags(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x BUCKETS) how often each row has a subword of each bucket."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    for i, j in pieces(offsets, CHUNK):
        cuts = _cuts(int(offsets[i]), int(offsets[j]))  # more than one for a row alone
        for lo, hi in cuts:
            # A cut is counted on its own: ones added to a float32 count for nothing from 2^24 on.
            counts = out[i:j] if len(cuts) == 1 else np.zeros((1, BUCKETS), np.float32)
            for code, of in _by_row(raw[lo:hi], np.clip(offsets[i : j + 1], lo, hi) - lo):
                np.add.at(counts.reshape(-1), np.repeat(np.arange(j - i) * BUCKETS, np.diff(of)) + code, np.float32(1))
            if len(cuts) > 1:
                out[i:j] += counts
    return out


def _parts(batch: pa.RecordBatch):
    """(labels, whole, bytes, offsets) of the rows of label, draw, text, some at a time: each whole text, and one piece of it. The
    order is that of the draws."""
    order = np.argsort(batch.column(1).to_numpy(), kind="stable")
    for lo in range(0, len(order), STEP // 2):
        label, draw, text = batch.take(pa.array(order[lo : lo + STEP // 2])).to_pydict().values()
        parts = [(y, True, t) for y, t in zip(label, text)]
        for y, d, t in zip(label, draw, text):
            words, d = t.split(), d & (2**63 - 1)
            k = SNIPPETS[d // 5 % len(SNIPPETS)]
            if len(words) > k:
                at = d // 20 % (len(words) - k + 1)
                parts.append((y, False, " ".join(words[at : at + k])))
        label, whole, text = zip(*parts)
        raw, offsets, letter = lowered(pa.array(text, pa.large_string()))
        yield np.array(label, object)[letter], np.array(whole)[letter], *_only(raw, offsets, letter)


def _only(raw: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    return (raw if which.all() else raw[np.repeat(which, sizes)]), np.concatenate(([0], np.cumsum(sizes[which])))


def _step(x: np.ndarray, y: np.ndarray, rate: float, E: np.ndarray, W: np.ndarray, bias: np.ndarray, weights: np.ndarray | None = None) -> None:
    """A step of SGD, in place. x: bags of sum 1; y: labels; weights: of the rows, if not all the same."""
    h = x @ E
    g = _softmax(h @ W + bias)
    g[np.arange(len(x)), y] -= 1
    g /= len(x)
    if weights is not None:
        g *= weights[:, None]
    back = g @ W.T
    W -= 0.5 * rate * (h.T @ g)
    bias -= 0.5 * rate * g.sum(0)
    E -= 200.0 * rate * (x.T @ back)


def _learn(held, weights: dict, done: float, steps: float):
    """mapInArrow: label, draw, text -> what a task's rows teach that goes on from the model held, as its share of a weighted mean.
    done: steps of a task before this pass; steps: of all passes."""

    def run(batches):
        from pyspark import TaskContext

        labels, *start = held.value
        place, own = {x: i for i, x in enumerate(labels)}, [x.copy() for x in start]
        weight, mass, n, step = np.array([weights[x] for x in labels], np.float32), np.zeros(BUCKETS), 0, 0
        for batch in batches:
            for label, _, raw, offsets in _parts(batch):
                x, y = bags(raw, offsets), np.array([place.get(t, -1) for t in label], int)
                size = x.sum(1)
                if not (good := (size > 0) & (y >= 0)).all():
                    x, y, size = x[good], y[good], size[good]
                if len(x):
                    x /= size[:, None]
                    _step(x, y, RATE * max(0.1, 1 - (done + step) / steps), *own, weight[y])
                    mass += x.sum(0)
                    n, step = n + len(x), step + 1
        if n:
            E, W, bias = (a - b for a, b in zip(own, start))
            values = np.concatenate([(E * mass[:, None]).ravel(), mass, n * W.ravel(), n * bias, [n]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([values.tobytes()])], names=["part", "sums"])

    return run


def _sum(table: pa.Table) -> np.ndarray:
    """Of the tasks' sums, in the order of the tasks."""
    rows = table.sort_by("part").column("sums").to_pylist()
    return sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows)


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("up")[:1], "sums": pa.array([_sum(table).astype(np.float32).tobytes()])})


def _mean(held):
    """applyInArrow: the model held, moved by the mean of what the tasks learned. A bucket's mean is weighted by what a task has of it, so
    a bucket that few rows have moves as far as they move it."""

    def run(table: pa.Table) -> pa.Table:
        labels, E, W, bias = held.value
        k, total = len(labels), _sum(table)
        moved, mass, w, b, n = np.split(total, np.cumsum([E.size, BUCKETS, DIMENSIONS * k, k]))
        E = (E + moved.reshape(E.shape) / np.maximum(mass, 1e-30)[:, None]).astype(np.float32)
        W, bias = (W + (w / n).reshape(W.shape)).astype(np.float32), (bias + b / n).astype(np.float32)
        return _as_row(labels, E, W, bias)

    return run


_ROW = "labels array<string>, features binary, weights binary, bias binary"


def _as_row(labels: list, E: np.ndarray, W: np.ndarray, bias: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array([labels], pa.list_(pa.string())), *(pa.array([x.tobytes()]) for x in (E, W, bias))], names=["labels", "features", "weights", "bias"])


def _of_row(row) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    E, W, bias = (np.frombuffer(x, np.float32) for x in (row.features, row.weights, row.bias))
    return list(row.labels), E.reshape(BUCKETS, DIMENSIONS), W.reshape(DIMENSIONS, -1), bias


def _product(batches):
    """mapInArrow: for few labels, the product of embeddings and weights is all that's needed."""
    for batch in batches:
        for row in batch.to_pylist():
            E, W = np.frombuffer(row["features"], np.float32).reshape(BUCKETS, DIMENSIONS), np.frombuffer(row["weights"], np.float32).reshape(DIMENSIONS, -1)
            features, weights = ((E @ W).tobytes(), None) if W.shape[1] <= DIMENSIONS else (row["features"], row["weights"])
            yield pa.RecordBatch.from_arrays([pa.array([row["labels"]], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in (features, weights, row["bias"]))], names=["labels", "features", "weights", "bias"])


def _as_model(row) -> Model:
    features = np.frombuffer(row.features, np.float32).reshape(BUCKETS, -1)
    weights = None if row.weights is None else np.frombuffer(row.weights, np.float32).reshape(DIMENSIONS, -1).astype(np.float64)
    return Model(list(row.labels), features, weights, np.frombuffer(row.bias, np.float32).astype(np.float64), row.temperature, row.threshold)


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL, epochs: int = 8, seed: int = 7) -> Model:
    """Learns from all rows that have a label and a letter, but for a fifth of them, by a hash of key, which is held back and
    sets the temperature and the rejection score.

    About per_label rows of each label make the start, some epochs of SGD in one task. In each of PASSES
    passes every task then goes over all its rows, in steps of STEP bags (each whole text and one piece of it) that weigh labels
    alike, and the tasks' models are averaged. Which rows share a task matters a little to the result; the same partitions give
    the same model. The driver gets models alone, sums of tasks meet in a tree. Rows with null text or label give nothing. With no labelled row the model knows 'und' alone.
    """
    spark, rows = docs.sparkSession, labelled(docs, label, text, key)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().toLocalIterator()}
    if not counts:
        return _none()
    every = sum(counts.values())
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, per_label / n)))])
    some = rows.where(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("label")) * (1 << 20))
    some = some.mapInArrow(_features, "label string, draw long, whole boolean, ids array<int>, counts array<float>")

    model = stored(some.groupBy().applyInArrow(lambda table: _as_row(*fit(table, epochs, seed)), _ROW), "languages")
    if not (made := model.collect()):
        return _none()
    weights = {k: min(float(STEP), every / (len(counts) * n)) for k, n in counts.items()}
    learn = rows.where(F.pmod("draw", F.lit(5)) > 0).coalesce(max(1, every // TASK_ROWS))
    tasks = learn.rdd.getNumPartitions()
    steps = max(1.0, 1.6 * every / STEP / tasks)
    for k in range(PASSES):
        held, left = spark.sparkContext.broadcast(_of_row(made[0])), tasks
        parts = learn.mapInArrow(_learn(held, weights, k * steps, PASSES * steps), "part int, sums binary")
        while left > FAN:
            parts, left = parts.withColumn("up", F.expr(f"part div {FAN}").cast("int")).groupBy("up").applyInArrow(_added, "part int, sums binary"), -(-left // FAN)
        moved = stored(parts.groupBy().applyInArrow(_mean(held), _ROW), "languages")
        if now := moved.collect():  # none if all rows are held back
            model, made = moved, now
    model = model.mapInArrow(_product, _ROW)
    found = lambda t, s: _as_model(model.withColumns({"temperature": F.lit(float(t)), "threshold": F.lit(float(s))}).collect()[0])
    return found(*calibrated(rows.where(F.pmod("draw", F.lit(5)) == 0), found(1, 0)))


def _none() -> Model:
    return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(1), 1.0, 0.0)


TEMPERATURES = np.geomspace(0.1, 10, 41)


def calibrated(rows: DataFrame, model: Model) -> tuple[float, float]:
    """The temperature of least loss on rows of label, draw, text (and a piece of each), and the rejection score: one that under one
    in 200 of their rightly labelled whole texts falls short of, and one half at most. All rows count; no rows give 1 and 0."""
    held, k = rows.sparkSession.sparkContext.broadcast(tuple(model)), len(model.labels)

    def outputs(batches):
        fitted = Model(*held.value)
        place = {x: i for i, x in enumerate(fitted.labels)}
        for batch in batches:
            for label, whole, raw, offsets in _parts(batch):
                y = np.array([place.get(t, -1) for t in label], np.int32)
                z = np.concatenate([_logits(fitted, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets, CHUNK)] or [np.zeros((0, k))])
                good = y >= 0
                yield pa.RecordBatch.from_arrays([pa.array(y[good]), pa.array(whole[good]), pa.array([r.tobytes() for r in z[good]], pa.binary())], names=["y", "whole", "z"])

    def losses(batches):
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            y, z = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, k)
            total -= [np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).sum() for t in TEMPERATURES]
        yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES), pa.array(total)], names=["temperature", "loss"])

    def right(temperature):
        def run(batches):
            for batch in batches:
                y, p = batch.column(0).to_numpy(), _softmax(np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, k) / temperature)
                yield pa.RecordBatch.from_arrays([pa.array(p.max(1)[batch.column(1).to_numpy(zero_copy_only=False) & (p.argmax(1) == y)])], names=["score"])

        return run

    told = stored(rows.mapInArrow(outputs, "y int, whole boolean, z binary"), "outputs")
    if told.isEmpty():
        return 1.0, 0.0
    temperature = told.mapInArrow(losses, "temperature double, loss double").groupBy("temperature").agg(F.sum("loss").alias("loss")).orderBy("loss", "temperature").first()[0]
    scores = told.mapInArrow(right(temperature), "score double")
    if scores.isEmpty():
        return temperature, 0.0
    return temperature, min(0.5, percentiles(scores, "score", [0.005]).first()["p"][0])


def fit(rows: pa.Table, epochs: int, seed: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """labels, embeddings, weights and bias from a sample's bags: label, draw, whole, ids, counts. The fifth held back is left out."""
    order = np.lexsort((np.array([len(x) for x in rows.column("ids")]), rows.column("draw").to_numpy()))
    rows = rows.take(pa.array(order))
    labels = sorted(set(rows.column("label").to_pylist()))
    y = np.array([labels.index(x) for x in rows.column("label").to_pylist()])
    fold = rows.column("draw").to_numpy() % 5
    ids, counts = [rows.column(c).combine_chunks() for c in ("ids", "counts")]
    at = ids.offsets.to_numpy()
    ids, counts = ids.flatten().to_numpy(), counts.flatten().to_numpy()

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for i, r in enumerate(which):
            bag = counts[at[r] : at[r + 1]]
            x[i, ids[at[r] : at[r + 1]]] = bag / bag.sum()
        return x

    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    W, bias = rng.normal(0, 0.3, (DIMENSIONS, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    learn = np.flatnonzero(fold > 0)
    steps, step = epochs * -(-len(learn) // STEP), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), STEP):
            pick = learn[lo : lo + STEP]
            _step(dense(pick), y[pick], 1.0 - step / max(1, steps), E, W, bias)
            step += 1
    return labels, E, W, bias


def label_languages(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced, all others stay, but for the text if it isn't wanted.

    A text that is null or has no letter is 'und' with score 0 and rejected; any other has a learned label, or 'und' and is
    kept if the model learned none. Every byte of every text counts. The model travels as a broadcast of fixed size (BUCKETS x DIMENSIONS at most, and the labels).
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    held = spark.sparkContext.broadcast(tuple(model))
    position = kept.index(text)
    out = [i for i, c in enumerate(kept) if with_text or c != text]

    def run(batches):
        fitted = Model(*held.value)
        for batch in batches:
            labels, scores = predict(fitted, batch.column(position))
            # A text without a letter is the only one to score 0; 'und' is also what a model without labels says.
            rejected = (scores < fitted.threshold) | (scores == 0)
            if fitted.labels != [UNKNOWN]:
                rejected |= np.array([x == UNKNOWN for x in labels], bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in out], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*[kept[i] for i in out], "lang_pred", "score", "rejected"])

    schema = docs.select(*[kept[i] for i in out]).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(key, parts: int, part: int):
    """Whether crc32 of the key as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def learning_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col(key).isNotNull() & ~held_out(F.col(key), 4, 2))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(learning_rows(docs))
    return label_languages(docs.select("doc_id", "text"), model, with_text=False).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
