"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk, minimised by SGD in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, spare, text_bytes
from strata.llm.langid import held_out
from strata.llm.texthash import CHUNK, word_hashes, word_spans

#: Rows of the two training samples at most, about: trusted positives, and unlabelled text.
SAMPLE = 4000
ACCEPT = 0.3

# Classes of bytes by what they do in writing.
_GROUPS = ("\n\r", " \t\v\f", "0123456789", ".,;:", "'\"()-", "?", "!", "|", "$*#%&", "=+/_~^@\\", "<>[]{}")
LOWER, UPPER, HIGH, OTHER = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2, len(_GROUPS) + 3
CLASSES = len(_GROUPS) + 4
_CLASS = np.full(256, OTHER, np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
_CLASS[97:123], _CLASS[65:91], _CLASS[128:] = LOWER, UPPER, HIGH
LAGS = (1, 2, 3, 4)
WIDTH = CLASSES * CLASSES + CLASSES + len(LAGS) + 2


class Model(NamedTuple):
    """Centre and scale of the features, weights, bias, and the class prior used."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: square roots of the shares of byte classes and of their pairs, shares of words that return after 1 to 4
    words, mean word length and log length. Texts without words give zeros there."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[raw]
    length = np.maximum(np.diff(offsets), 1)[:, None]
    single = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    inside = row[1:] == row[:-1]
    code = (row[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    pair = np.bincount(code[inside], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    out[:, : CLASSES * CLASSES] = np.sqrt(pair / length)
    at = CLASSES * CLASSES + CLASSES
    out[:, at - CLASSES : at] = np.sqrt(single / length)
    rows, starts, ends = word_spans(raw, offsets)
    count = np.bincount(rows, minlength=n)
    if len(rows):
        words = word_hashes(raw, starts, ends)
        for k, lag in enumerate(LAGS):
            same = (words[lag:] == words[:-lag]) & (rows[lag:] == rows[:-lag])
            out[:, at + k] = np.sqrt(np.bincount(rows[lag:][same], minlength=n) / np.maximum(count, 1))
        out[:, at + len(LAGS)] = np.bincount(rows, ends - starts, minlength=n) / np.maximum(count, 1) / 10
    out[:, at + len(LAGS) + 1] = np.log1p(count) / 10
    return out


def _each(column: pa.Array):
    raw, offsets = text_bytes(column)
    for i, j in pieces(offsets, CHUNK):
        part = offsets[i : j + 1]
        yield i, j, features(raw[part[0] : part[-1]], part - part[0])


def _vectors(batches):
    for batch in batches:
        x = np.zeros((batch.num_rows, WIDTH), np.float32)
        for i, j, part in _each(batch.column(1)):
            x[i:j] = part
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, WIDTH, dtype=np.int32), pa.array(x.ravel()))], names=["draw", "x"])


def _sample(rows: DataFrame, n: int, total: int, key: str, text: str, seed: int) -> np.ndarray:
    """Feature matrix of about n of the total rows, chosen and ordered by a hash of key."""
    draw = F.xxhash64(F.lit(seed), F.col(key))
    chosen = rows.select(draw.alias("draw"), F.col(text).alias("text")).where(F.pmod("draw", F.lit(1 << 20)) < int(min(1.0, n / max(total, 1)) * (1 << 20)))
    got = chosen.mapInArrow(_vectors, "draw long, x array<float>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if got.num_rows else np.zeros((0, WIDTH), np.float32)
    return x[np.argsort(got.column("draw").to_numpy(), kind="stable")] if got.num_rows else x


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 250, rate: float = 0.05, seed: int = 5) -> Model:
    """Minimises prior * R+(f) + max(0, Ru-(f) - prior * Rp-(f)) with logistic losses.

    Where the second part of a batch is negative, the step goes up on it instead, which keeps it from being overfitted.
    """
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH), np.float32)
    centre, scale = both.mean(0), both.std(0) + 0.02
    if not len(positive) or not len(unlabelled):
        return Model(centre, scale, np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    p, u = (positive - centre) / scale, (unlabelled - centre) / scale
    rng, w, b = np.random.default_rng(seed), np.zeros(WIDTH), float(np.log(prior / (1 - prior)))
    size, sigmoid = 2048, lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    m_w, v_w, m_b, v_b, t = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0
    for epoch in range(epochs):
        for _ in range(-(-max(len(p), len(u)) // size)):
            xp, xu = p[rng.integers(0, len(p), min(size, len(p)))], u[rng.integers(0, len(u), min(size, len(u)))]
            fp, fu = xp @ w + b, xu @ w + b
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            up, uu = prior * -sigmoid(-fp) / len(xp), np.zeros(len(xu))
            grad_p, grad_u = -prior * sigmoid(fp) / len(xp), sigmoid(fu) / len(xu)
            up, uu = (up + grad_p, uu + grad_u) if negative >= 0 else (-grad_p, -grad_u)
            gw, gb, t = xp.T @ up + xu.T @ uu + 1e-4 * w, up.sum() + uu.sum(), t + 1
            m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.999 * v_w + 0.001 * gw * gw
            m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= step * m_w / (np.sqrt(v_w) + 1e-8)
            b -= step * m_b / (np.sqrt(v_b) + 1e-8)
    return Model(centre, scale, w, float(b), prior)


def outputs(model: Model, x: np.ndarray) -> np.ndarray:
    return ((x - model.centre) / model.scale) @ model.weights + model.bias


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled outputs, from outputs of a classifier that saw neither sample.

    Above any threshold stand at most as many unlabelled rows as positives in them would give, and more if others stand
    there too: the share is the least ratio of the two tails over all thresholds, taken with a bound on chance (Hoeffding,
    both samples, probability `doubt`), which keeps it from tails of a few rows.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    tail_p, tail_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((tail_u + slack) / np.maximum(tail_p, 1e-12)))
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 0.98))


def calibrated(model: Model, positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> Model:
    """The model with its outputs f turned by the a * f + b, a > 0, of least non-negative risk on rows it wasn't fitted on."""
    fp, fu, pi = outputs(model, positive), outputs(model, unlabelled), model.prior
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    t, m, v = np.array([0.0, 0.0]), np.zeros(2), np.zeros(2)
    for k in range(1, rounds + 1):
        a = np.exp(t[0])
        zp, zu = a * fp + t[1], a * fu + t[1]
        negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
        up, gp, gu = -pi * sigmoid(-zp), -pi * sigmoid(zp), sigmoid(zu)
        up, gu = (up + gp, gu) if negative >= 0 else (up, 0 * gu)
        gradient = np.array([(up * fp * a).mean() + (gu * fu * a).mean(), up.mean() + gu.mean()]) + 1e-3 * t
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
        t = t - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model._replace(weights=model.weights * np.exp(t[0]), bias=float(model.bias * np.exp(t[0]) + t[1]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Trusted positives are the rows labelled 1, unlabelled text is all of docs; both are sampled by hash, about `sample`
    rows each. Rows labelled otherwise are never looked at. A fifth of both samples is kept from the fit: a first classifier,
    fitted as if the prior were one half, gives it the outputs from which the class prior is estimated; the classifier
    proper is fitted with that prior, and the same fifth sets slope and bias of its outputs.

    Null labels and keys count for nothing; a row labelled more than once counts once. With fewer than ten positives the
    prior is one half, and with none every text scores that.
    """
    name, = spare(docs, "trusted")
    known = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct()
    ones, total = known.count(), docs.select(key).count()
    # The chosen labels are `sample` rows at most, about: a side of bounded size for the join with the texts.
    share = int(min(1.0, sample / max(ones, 1)) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), F.col(name)), F.lit(1 << 20)) < share)
    trusted = _sample(docs.join(F.broadcast(chosen), F.col(key) == F.col(name), "left_semi"), 1, 1, key, text, 3)
    every = _sample(docs, sample, total, key, text, 4)
    cut = lambda x: (x[: len(x) // 5], x[len(x) // 5 :])
    if min(len(trusted), len(every)) < 10:
        return fit(trusted, every, 0.5)
    (p_check, p_fit), (u_check, u_fit) = cut(trusted), cut(every)
    first = fit(p_fit, u_fit, 0.5)
    model = fit(p_fit, u_fit, class_prior(outputs(first, p_check), outputs(first, u_check)))
    return calibrated(model, p_check, u_check)


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 from 0.3 on); columns of these names are replaced.

    Whole texts count. Null and empty texts are scored like any other, from features that are zero.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    held, position = docs.sparkSession.sparkContext.broadcast(tuple(model)), kept.index(text)

    def run(batches):
        m = Model(*held.value)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, j, x in _each(batch.column(position)):
                z[i:j] = outputs(m, x)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.select(*kept).mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    model = train(learn(docs), learn(read(spark, sf_dir, "labels")))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
