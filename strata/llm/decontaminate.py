"""Benchmark decontamination by latent semantic retrieval: randomised SVD of TF-IDF passages, candidate windows by their
cosine with an item in the truncated space, then longest common subsequence and answer checks.

All documents are read twice, however many items there are: once for the frequencies of the items' words and for the
passages, which are kept as places of those words, once to be searched. The space is fitted on the passages of all
documents. It has half as many directions as a block has items, 64 at most, and more only for items that it would hardly
show. The threshold of the cosine is set by measured recall against every window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, stored
from strata.llm.langid import lowered
from strata.llm.texthash import CHUNK, mix, prefix, spans_hash

#: Items that share a latent space, at most. More items make more blocks, each with a space of its own.
BLOCK_ITEMS, BLOCK_WORDS = 256, 100_000
#: Words of items that one pass over the documents looks for, at most: a broadcast of some 350 bytes a word.
PASS_WORDS = 400_000
#: Directions that a block's latent space is fitted with, at most; never more than half of its items. An item of whose squared
#: length the space shows less than SHARE gets a direction added.
SHARE = 0.2
RANK, POWER_STEPS, OVERSAMPLE = 64, 2, 16
#: Passages kept in a row of their table, and terms of a block, its most frequent ones, that take part as a dense matrix.
ROW_PASSAGES, OFTEN = 1024, 512
#: Terms of a piece of the products A'A X; pieces are summed on the executors, FAN at a time in a tree, before the driver gets them.
PIECE, FAN = 256, 64
#: Words of the shortest windows; lengths double from there. An item is looked for in the windows of the smallest length that holds it.
SHORTEST = 16
#: Words of a passage the space is fitted on.
PASSAGE = 64
#: Words of texts that are looked at together; a longer text stands alone.
PIECE_WORDS = 1 << 13
OVERLAP, ANSWER = 0.7, 0.5
#: Least cosine of a candidate. Of 1,015 pasted items with up to 30 % of their words replaced, the lowest best cosine was 0.785.
COSINE = 0.7

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[48:58] = np.arange(48, 58)
_BYTES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(column: pa.Array):
    """(i, j, row, hash) of the words of rows i to j, piece by piece: runs of letters and digits, in lower case."""
    raw, offsets, _ = lowered(column)
    for i, j in pieces(offsets, CHUNK):
        part = offsets[i : j + 1]
        b, at = _FOLD[raw[part[0] : part[-1]]], part - part[0]
        if not len(b):
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        word, before, after = b != 32, np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        # Words never cross rows.
        first = at[:-1][at[1:] > at[:-1]]
        before[first] = False
        after[first[1:] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        h = mix(spans_hash(prefix(_BYTES[b]), starts, ends) + (ends - starts).astype(np.uint64))
        yield i, j, np.repeat(np.arange(j - i), np.diff(np.searchsorted(starts, at))), h


class Items(NamedTuple):
    """A block of benchmark items: ids, the sorted vocabulary of their words, and each item's words as places in it."""

    ids: list
    vocabulary: np.ndarray
    words: list


class Item(NamedTuple):
    """An item to look for: its words in order, its sorted terms with the score of each (the item's unit TF-IDF vector times
    idf), the terms that answer it, and the least exact score that the checks leave."""

    id: int
    words: np.ndarray
    terms: np.ndarray
    scores: np.ndarray
    answer: np.ndarray
    least: float

    @property
    def window(self) -> int:
        """Words of a window: the item's length, brought up to the next of the doubling lengths."""
        return SHORTEST << int(np.ceil(np.log2(max(len(self.words) / SHORTEST, 1))))


class Passages(NamedTuple):
    """The passages of all documents for a pass: a table of sizes, terms and times (see _scanned), the vocabulary in which the
    terms are places, and the number of passages."""

    rows: DataFrame
    vocabulary: np.ndarray
    count: int


class Space(NamedTuple):
    """The latent space of a block: its terms (places in the pass's vocabulary), a term's vector times idf (terms x rank), the
    items (places in the pass's list) and their vectors of unit length (items x rank)."""

    terms: np.ndarray
    load: np.ndarray
    items: np.ndarray
    vectors: np.ndarray


class Wanted(NamedTuple):
    """What one pass looks for: the sorted vocabulary of all its items, idf of its terms, the items, and the blocks' spaces."""

    vocabulary: np.ndarray
    idf: np.ndarray
    items: list
    spaces: list

    def plain(self) -> tuple:
        """As tuples and arrays alone, for a broadcast: workers needn't know these classes to read it."""
        return self.vocabulary, self.idf, [tuple(x) for x in self.items], [tuple(x) for x in self.spaces]


_SLOTS = 1 << 16


def lookup(vocabulary: np.ndarray):
    """A function from hashes to places; most strangers fall to one look at a table of their leading bits."""
    slot = np.zeros(_SLOTS, bool)
    slot[(vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def places(h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(slot[(h >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
            hit = vocabulary[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    return places


def blocks(benchmark: DataFrame, item: str, text: str) -> list[Items]:
    """The items with words, in blocks. The driver holds their words' hashes, not their texts."""
    out, ids, words, total = [], [], [], 0

    def close():
        if ids:
            vocabulary = np.unique(np.concatenate(words))
            out.append(Items(list(ids), vocabulary, [np.searchsorted(vocabulary, w) for w in words]))
            ids.clear()
            words.clear()

    for row in benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text).distinct().orderBy(item, text).toLocalIterator():
        h = np.concatenate([h for *_, h in tokens(pa.array([row[1]], pa.large_string()))])
        if len(h) == 0:
            continue
        if len(ids) == BLOCK_ITEMS or total + len(h) > BLOCK_WORDS:
            close()
            total = 0
        ids.append(row[0])
        words.append(h)
        total += len(h)
    close()
    return out


_SCANNED = "place int, n long, sizes binary, terms binary, times binary"


def _scanned(vocabulary):
    """mapInArrow: texts -> rows of ROW_PASSAGES passages at most (terms of each as bytes, the terms' places as 32-bit integers,
    and how often each occurs in its passage as bytes); then in how many texts of the task each term of the vocabulary
    occurs, and how many texts there are (place -1)."""

    def made(place, n, sizes, terms, times):
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sizes, terms, times))], names=["place", "n", "sizes", "terms", "times"])

    def run(batches):
        places, total, n = lookup(vocabulary.value), np.zeros(len(vocabulary.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i, j, row, h in tokens(batch.column(0)):
                at = places(h)
                hit = np.flatnonzero(at >= 0)
                if not len(hit):
                    continue
                of, term = row[hit], at[hit]
                key = of * len(total) + term
                if (j - i) * len(total) <= 1 << 23:
                    seen = np.zeros((j - i) * len(total), bool)
                    seen[key] = True
                    total += seen.reshape(j - i, -1).sum(0)
                else:
                    key.sort()
                    total += np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % len(total), minlength=len(total))
                first = np.searchsorted(row, np.arange(j - i + 1))
                base = np.concatenate(([0], np.cumsum(-(-np.diff(first) // PASSAGE))))
                key, times = np.unique((base[of] + (hit - first[of]) // PASSAGE) * len(total) + term, return_counts=True)
                passage, term = np.divmod(key, len(total))
                start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1], True])
                sizes, term, times = np.diff(start).astype(np.uint8), term.astype(np.int32), times.astype(np.uint8)
                cuts = [*range(0, len(sizes), ROW_PASSAGES), len(sizes)]
                for a, b in zip(cuts, cuts[1:]):
                    part = slice(start[a], start[b])
                    yield made([None], [None], [sizes[a:b].tobytes()], [term[part].tobytes()], [times[part].tobytes()])
        used = np.flatnonzero(total)
        none = [None] * (len(used) + 1)
        yield made(np.r_[-1, used], np.r_[n, total[used]], none, none, none)

    return run


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the place at; places ascend, and may repeat."""
    if len(at):
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        turn = np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)]))
        for k in range(turn.max() + 1):  # no place twice in a turn
            some = np.flatnonzero(turn == k)
            total[at[some]] += rows[some]


def _gram(held):
    """mapInArrow: the task's share of A'A X for its passages A, as pieces of PIECE terms. held: the block's term of each place (-1:
    none), the most frequent ones first, their idf, and X."""

    def run(batches):
        from pyspark import TaskContext

        slot, idf, x = held.value
        out, n = None, min(OFTEN, len(x))
        for batch in batches:
            for sizes, term, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sizes, term, times = np.frombuffer(sizes, np.uint8), slot[np.frombuffer(term, np.int32)], np.frombuffer(times, np.uint8)
                mine = np.flatnonzero(term >= 0)
                row, term = np.repeat(np.arange(len(sizes)), sizes)[mine], term[mine]
                w = times[mine] * idf[term]
                w = (w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]).astype(np.float32)
                out = np.zeros(x.shape) if out is None else out
                often = term < n
                dense = np.zeros((len(sizes), n), np.float32)
                dense[row[often], term[often]] = w[often]
                row, term, w = row[~often], term[~often], w[~often, None]
                y = dense @ x[:n]
                _add(y, row, w * x[term])
                out[:n] += dense.T @ y
                order = np.argsort(term, kind="stable")
                _add(out, term[order], w[order] * y[row[order]])
        if out is not None:
            at = range(0, len(out), PIECE)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([i // PIECE for i in at], pa.int32()), pa.array([out[i : i + PIECE].tobytes() for i in at], pa.binary())], names=["part", "piece", "rows"])

    return run


_PIECES = "part int, piece int, rows binary"


def _added(frame):
    """applyInPandas: the sum of a piece over some tasks."""
    return frame.head(1).assign(rows=[sum(np.frombuffer(bytes(r), np.float64) for r in frame["rows"]).tobytes()])


def units(items: Items, idf: np.ndarray) -> np.ndarray:
    """(items x terms) TF-IDF vectors of unit length."""
    own = np.zeros((len(items.ids), len(idf)), np.float32)
    for i, w in enumerate(items.words):
        np.add.at(own[i], w, idf[w])
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)


def fit(passages: Passages, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """(terms x rank) right singular vectors of the weighted TF-IDF passages, by randomised subspace iteration.

    The products A'A X run on the executors, over the passages of all documents; the driver holds terms x rank numbers of a
    block. The items are passages too, weighted to four times the documents' share, so that the space spans them.
    """
    spark, n = passages.rows.sparkSession, len(items.vocabulary)
    width = min(n, rank + OVERSAMPLE)
    own = units(items, idf)
    own *= np.sqrt(max(1.0, 4.0 * passages.count / max(1, len(items.ids))))
    order = np.argsort(idf, kind="stable")
    slot = np.full(len(passages.vocabulary), -1, np.int32)
    slot[np.searchsorted(passages.vocabulary, items.vocabulary)[order]] = np.arange(n)
    tasks = passages.rows.rdd.getNumPartitions() if passages.count else 0
    x = np.random.default_rng(seed).normal(size=(n, width))
    for _ in range(POWER_STEPS + 1):
        y = own.T @ (own @ x)
        if passages.count:
            held, left = spark.sparkContext.broadcast((slot, idf[order], x[order].astype(np.float32))), tasks
            parts = passages.rows.mapInArrow(_gram(held), _PIECES)
            while left > FAN:
                parts, left = parts.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("part", "piece").applyInPandas(_added, _PIECES), -(-left // FAN)
            parts = parts.groupBy("piece").applyInPandas(_added, _PIECES).select("piece", "rows").toArrow()
            for piece, rows in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
                part = np.frombuffer(rows, np.float64).reshape(-1, width)
                y[order[piece * PIECE : piece * PIECE + len(part)]] += part
    x, _ = np.linalg.qr(y)
    inner = x.T @ (own.T @ (own @ x))
    values, turn = np.linalg.eigh(inner)
    return (x @ turn[:, np.argsort(-values)])[:, : min(rank, width)]


def _passes(every: list[Items]):
    """Blocks in groups of PASS_WORDS words at most, or of one block."""
    held, total = [], 0
    for items in every:
        n = sum(len(w) for w in items.words)
        if held and total + n > PASS_WORDS:
            yield held
            held, total = [], 0
        held.append(items)
        total += n
    if held:
        yield held


def wanted(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> list[Wanted]:
    """One Wanted a pass. Document frequencies count all documents; each block's space is fitted on its items and on the
    passages of all documents, which are kept in a table for the pass. key doesn't matter to either."""
    spark, out = docs.sparkSession, []
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    for held in _passes(blocks(benchmark, item, item_text)):
        vocabulary = np.unique(np.concatenate([items.vocabulary for items in held]))
        scanned = stored(texts.mapInArrow(_scanned(spark.sparkContext.broadcast(vocabulary)), _SCANNED), "passages")
        got = scanned.where("place is not null").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        df, total = np.zeros(len(vocabulary)), 1
        places, counts = got.column(0).to_numpy(), got.column(1).to_numpy()
        df[places[places >= 0]] = counts[places >= 0]
        total = max(1, int(counts[places < 0].sum()))
        idf = np.log((1 + total) / (1 + df)) + 0.05
        rows = scanned.where("sizes is not null").select("sizes", "terms", "times")
        passages = Passages(rows, vocabulary, rows.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0)
        looked, spaces = [], []
        for items in held:
            at = np.searchsorted(vocabulary, items.vocabulary)
            own, v = units(items, idf[at]), latent(passages, items, idf[at])
            scores, first = own.T * idf[at][:, None], len(looked)
            for k, words in enumerate(items.words):
                terms = np.unique(words)
                answer = np.sort(terms[np.argsort(-idf[at[terms]], kind="stable")][: max(1, -(-len(terms) // 3))])
                looked.append(Item(items.ids[k], at[words], at[terms], scores[terms, k], at[answer], _least(words, scores[:, k], set(answer.tolist()))))
            vectors = own @ v
            spaces.append(Space(at, (v * idf[at][:, None]).astype(np.float32), first + np.arange(len(own)), (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)))
        out.append(Wanted(vocabulary, idf, looked, spaces))
    return out


def latent(passages: Passages, items: Items, idf: np.ndarray) -> np.ndarray:
    """(terms x rank): the block's truncated basis, with directions for the items that it would hardly show."""
    v, own = fit(passages, items, idf, max(1, min(RANK, len(items.ids) // 2))), units(items, idf)
    hidden = own[((own @ v) ** 2).sum(1) < SHARE]
    _, size, more = np.linalg.svd(hidden - hidden @ v @ v.T, full_matrices=False)
    return np.hstack([v, more[size > 1e-6].T])


def _least(words: np.ndarray, scores: np.ndarray, answer: set) -> float:
    """What the words of an item that any text passing both checks holds score at least: the cheapest half of the answer,
    and the cheapest other words up to the overlap."""
    terms, first = np.unique(words, return_index=True)
    told = first[np.isin(terms, list(answer))]
    told = told[np.argsort(scores[words[told]])][: int(np.ceil(len(answer) * ANSWER))]
    others = np.sort(scores[np.delete(words, told)])[: max(0, int(np.ceil(len(words) * OVERLAP - 1e-9)) - len(told))]
    # Less what rounding may take.
    return float(scores[words[told]].sum() + others.sum()) * 0.999


def common_subsequence(masks: dict, m: int, words) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: the places of each word in the m words of an item."""
    full = v = (1 << m) - 1
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _quarters(words: np.ndarray, row: np.ndarray, place: np.ndarray, terms: np.ndarray, load: np.ndarray, step: int):
    """step, words of each row, the first cell of each row, and the sum of the vectors in each cell, a quarter of a window: the
    steps of a row, and as many empty cells as its last window reaches over, so that a row has three windows fewer than cells. An
    empty cell comes last. terms: of the words, places in load, whose last vector is zero."""
    base = _bases(words, step)
    slots = np.full((base[-1] + 1) * step, len(load) - 1, np.int32)
    slots[base[row] * step + place] = terms
    total = load.take(slots[::step], 0)
    for k in range(1, step):
        total += load.take(slots[k::step], 0)
    return step, words, base, total


def _bases(words: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.where(words > 0, np.maximum(-(-words // step) + 1, 4), 0))))


def _doubled(pairs: np.ndarray, step: int, words: np.ndarray, base: np.ndarray, total: np.ndarray):
    """The same for steps of twice the length. pairs: the sum of each cell and the next."""
    new, steps = _bases(words, 2 * step), -(-words // step)
    row = np.repeat(np.arange(len(words)), np.diff(new))
    first = 2 * (np.arange(new[-1]) - new[row])
    out = np.zeros((new[-1] + 1, total.shape[1]), np.float32)
    held = np.flatnonzero(first < steps[row])
    out[held] = pairs[base[row[held]] + first[held]]
    return 2 * step, words, new, out


class Finder:
    """Looks for the items of a pass in the words of many texts at once."""

    def __init__(self, plain: tuple):
        vocabulary, self.idf, items, spaces = plain
        self.items, self.spaces, self.places = [Item(*x) for x in items], [Space(*x) for x in spaces], lookup(vocabulary)
        self.slots = []
        for s in self.spaces:
            slot = np.full(len(vocabulary) + 1, -1, np.int32)
            slot[s.terms] = np.arange(len(s.terms))
            self.slots.append(slot)
        self.masks: dict[int, dict[int, int]] = {}
        #: Of the item that best() looks at, by place in the vocabulary; 0 for other words, and for strangers at the end.
        self._scores = np.zeros(len(vocabulary) + 1)
        self.windows = [x.window for x in self.items]
        self.loads = [np.vstack([s.load, np.zeros((1, s.load.shape[1]), np.float32)]) for s in self.spaces]
        #: By space: the lengths of windows, ascending, and the items (places in the space) of each with their vectors.
        self.lengths = {}
        for s in self.spaces:
            owns = [(n, np.array([j for j, i in enumerate(s.items) if self.windows[i] == n])) for n in sorted({self.windows[i] for i in s.items})]
            self.lengths[id(s)] = [(int(n), own, s.vectors[own]) for n, own in owns]

    def retrieved(self, row: np.ndarray, at: np.ndarray):
        """(row, item, window): the windows whose cosine with an item in the latent space is COSINE or more."""
        found, words = [], np.bincount(row)
        upto = np.concatenate(([0], np.cumsum(words)))
        for i, j in pieces(upto, PIECE_WORDS):  # few words at a time, whose vectors stay near the processor
            lo, hi = upto[i], upto[j]
            some = row[lo:hi] - i
            for r, k, w in self._retrieved(words[i:j], some, np.arange(hi - lo) - (upto[i:j] - lo)[some], at[lo:hi]):
                found.append((r + i, k, w))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def _retrieved(self, words: np.ndarray, row: np.ndarray, place: np.ndarray, at: np.ndarray):
        for s, slot, load in zip(self.spaces, self.slots, self.loads):
            term = slot[at]  # -1 is the last of slot, and no term
            hits = np.flatnonzero(term >= 0)
            if not len(hits):
                continue
            cells = pairs = None
            for length, own, vectors in self.lengths[id(s)]:
                while cells is None or cells[0] < length // 4:
                    cells = _quarters(words, row[hits], place[hits], term[hits], load, length // 4) if cells is None else _doubled(pairs, *cells)
                    pairs = cells[3][:-1] + cells[3][1:]
                base = cells[2]
                span = pairs[:-2] + pairs[2:]
                size = np.sqrt(np.einsum("ij,ij->i", span, span))
                least = np.full(base[-1], np.inf, np.float32)
                least[: len(span)] = np.where(size > 0, np.float32(COSINE) * size, np.float32(np.inf))
                ends = base[1:][np.diff(base) > 0]
                for k in (1, 2, 3):  # no windows start there
                    least[ends - k] = np.inf
                hit = np.flatnonzero(vectors @ span.T >= least[: len(span)])
                if len(hit):
                    i, cell = np.divmod(hit, len(span))
                    of = np.searchsorted(base, cell, "right") - 1
                    yield of, s.items[own[i]], cell - base[of]

    def best(self, k: int, words: np.ndarray, windows: np.ndarray, any_: bool):
        """(overlap, answer, cosine) of the best of a text's windows (ascending) for item k, or None."""
        item, length = self.items[k], self.windows[k]
        m = len(item.words)
        start = windows * (length // 4)
        # Only the words around the windows.
        skip = max(0, int(start[0]) - m)
        words, start = words[skip : int(start[-1]) + length + m], start - skip
        n = len(words)
        self._scores[item.terms] = item.scores
        scores = self._scores[words]
        self._scores[item.terms] = 0
        if scores.sum() < item.least:
            return None
        mine, end = scores > 0, np.minimum(start + length, n)
        upto = np.zeros(n + 1)
        np.cumsum(scores, out=upto[1:])
        left, right = np.maximum(start - m, 0), np.minimum(end + m, n)
        if k not in self.masks:
            masks: dict[int, int] = {}
            for i, x in enumerate(item.words.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            self.masks[k] = masks
        best = None
        for w in np.flatnonzero(upto[right] - upto[left] >= item.least):
            seen = words[left[w] : right[w]][mine[left[w] : right[w]]]
            if len(seen) / m < OVERLAP:
                continue
            answer = len(set(item.answer.tolist()).intersection(seen.tolist())) / len(item.answer)
            if answer < ANSWER:
                continue
            overlap = common_subsequence(self.masks[k], m, seen.tolist()) / m
            if overlap >= OVERLAP and (best is None or (overlap, answer) > best[:2]):
                best = (overlap, answer, self._cosine(k, words[start[w] : end[w]]))
                if any_ or best[:2] == (1.0, 1.0):
                    break
        return best

    def _cosine(self, k: int, words: np.ndarray) -> float:
        """Of an item and a window's words in the latent space."""
        s, slot = next((s, slot) for s, slot in zip(self.spaces, self.slots) if s.items[0] <= k <= s.items[-1])
        term = slot[words]
        total = s.load[term[term >= 0]].sum(0)
        return float(total @ s.vectors[k - s.items[0]] / max(np.linalg.norm(total), 1e-12))

    def leaks(self, row: np.ndarray, h: np.ndarray, any_: bool = False):
        """(row, item, overlap, answer, cosine) of what the texts hold; with any_, values of any window that does."""
        at = self.places(h)
        rows, items, windows = self.retrieved(row, at)
        order = np.lexsort((windows, rows, items))
        rows, items, windows = rows[order], items[order], windows[order]
        cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])]) if len(rows) else []
        upto = np.concatenate(([0], np.cumsum(np.bincount(row))))
        for a, b in zip(cut, [*cut[1:], len(rows)]):
            found = self.best(int(items[a]), at[upto[rows[a]] : upto[rows[a] + 1]], windows[a:b], any_)
            if found:
                yield int(rows[a]), int(items[a]), *found


def _search(held, position: int, pairs: bool):
    """mapInArrow: pairs of the first column and the items found, or the rows in which none is found."""

    def run(batches):
        finder = Finder(held.value)
        for batch in batches:
            found, clean = [], np.ones(batch.num_rows, bool)
            for i, _, row, h in tokens(batch.column(position)):
                for r, k, *values in finder.leaks(row, h, not pairs):
                    clean[i + r] = False
                    found.append((i + r, finder.items[k].id, *values))
            if not pairs:
                yield batch.filter(pa.array(clean))
            elif found:
                rows, ids, overlap, answer, cosine = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in (overlap, answer, cosine))], names=["key", "item_id", "overlap", "answer", "cosine"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, overlap, answer, cosine: every benchmark item found in a row's text.

    Words are runs of letters and digits in lower case. Windows of about an item's length whose cosine with it in the latent
    space of the item's block is COSINE or more are candidates, and are checked with as many words again as the item has on
    either side: the longest common subsequence must cover 0.7 of the item's words and the window must hold half of its
    answer, the third of its terms that are rarest in the corpus. Words outside the benchmark don't matter to the cosine.
    Recall against both checks on every window is measured by the tests; the README gives it. cosine is that of the window.
    Whole texts are searched.
    Null and empty texts hold nothing, items without words are left out, repeated rows give repeated results, and
    repeated items count once. Other columns are ignored. Without items or rows the result is empty.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "key long, item_id long, overlap double, answer double, cosine double"
    for search in wanted(docs, benchmark, key, text, item, item_text):
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(search.plain()), 1, True), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows in which leaks() finds an item; the columns stay."""
    spark, schema, position = docs.sparkSession, docs.schema, docs.columns.index(text)
    for search in wanted(docs, benchmark, key, text, item, item_text):
        docs = docs.mapInArrow(_search(spark.sparkContext.broadcast(search.plain()), position, False), schema)
    return docs


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "item_id", F.round("overlap", 4).alias("overlap"), F.round("answer", 4).alias("answer"))
