"""N-gram Jaccard join: MinHash bands propose, Bayesian pruning on the MinHash values drops, exact sets decide.

A pair of different texts is looked at where it first shares a band, nowhere else. The buckets of a band first see the
MinHash values alone; only texts with a pair that outlives the pruning there send their shingle sets after them.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, spare, stored, text_bytes
from strata.llm.texthash import CHUNK, mix, shingles, word_hashes, word_spans
from strata.operators.graph import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
#: 32 bands of 4 values: a pair at the threshold shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: A pair is dropped when the posterior probability that it reaches the threshold is below this.
TOLERANCE = 1e-6
STEP = 16
#: Texts of a tile while only MinHash values are compared, and texts and shingles of a tile of sets: a task holds two.
VALUE_TEXTS, TILE_TEXTS, TILE_SHINGLES = 4096, 1024, 2_000_000
#: Pairs compared at once; texts of a tile pair whose pairs are listed together with those of others; rows worked on together.
PAIRS, SMALL, SOLVE = 1 << 18, 64, 8192

_RNG = np.random.default_rng(2024)
_XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n x HASHES) MinHash values of the shingle sets, 16 bits of each; rows without a shingle have the largest value."""
    out = np.full((n, HASHES), 2**16 - 1, np.uint16)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        present, held = rows[starts], np.empty(len(hashes), np.uint64)
        for i in range(HASHES):
            np.bitwise_xor(hashes, _XOR[i], out=held)
            np.multiply(held, _MUL[i], out=held)
            out[present, i] = mix(np.minimum.reduceat(held, starts)) >> np.uint64(48)
    return out


def least_matches(threshold: float = float(THRESHOLD), tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair goes on.

    With a uniform prior and m of n matches, similarity is Beta(m + 1, n - m + 1), and the chance that it reaches t is
    that of at most m successes among n + 1 draws with probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        chance = 0.0
        for m in range(n + 1):
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                out[n] = m
                break
    return out


def _sets(column: pa.Array):
    """(i, j, rows, hashes): the shingle sets of rows i to j of the column, piece by piece."""
    raw, offsets = text_bytes(column)
    for i, j in pieces(offsets, CHUNK):
        part = offsets[i : j + 1]
        bytes_, at = raw[part[0] : part[-1]], part - part[0]
        rows, starts, ends = word_spans(bytes_, at)
        yield (i, j, *shingles(rows, word_hashes(bytes_, starts, ends), j - i, WORDS))


def _keys(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit numbers that stand for each whole set, and the sets' sizes."""
    size = np.bincount(rows, minlength=n)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        one[rows[starts]] = np.add.reduceat(mix(hashes), starts)
        two[rows[starts]] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return one.view(np.int64), two.view(np.int64), size


def _bands(sig: np.ndarray) -> np.ndarray:
    """(n x BANDS): the ROWS values of 16 bits of each band as one number."""
    return np.ascontiguousarray(sig).view(np.int64)


def _profiles(batches):
    """mapInArrow: id, t, text -> id, t, k1, k2, n, bands."""
    for batch in batches:
        n = batch.num_rows
        one, two, size, bands = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, BANDS), np.int64)
        for i, j, rows, hashes in _sets(batch.column(2)):
            one[i:j], two[i:j], size[i:j] = _keys(rows, hashes, j - i)
            bands[i:j] = _bands(signatures(rows, hashes, j - i))
        lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(one), pa.array(two), pa.array(size), lists], names=["id", "t", "k1", "k2", "n", "bands"])


def _with_sets(batches):
    """mapInArrow: rows with text last -> the same with its set as binary; other texts of the id are left out."""
    for batch in batches:
        names = batch.schema.names
        k1, k2 = (batch.column(names.index(k)).to_numpy() for k in ("k1", "k2"))
        keep, sets = np.zeros(batch.num_rows, bool), []
        for i, j, rows, hashes in _sets(batch.column(names.index("text"))):
            one, two, _ = _keys(rows, hashes, j - i)
            same = (one == k1[i:j]) & (two == k2[i:j])
            keep[i:j] = same
            at = np.searchsorted(rows, np.arange(j - i + 1))
            sets += [hashes[at[r] : at[r + 1]].tobytes() for r in np.flatnonzero(same)]
        out = batch.drop_columns(["text"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary())], names=[*out.schema.names, "set"])


def likely(bands: np.ndarray, size: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int], threshold: Fraction = THRESHOLD):
    """The pairs (i, j) that share the band `first` of i as their first, have sizes that allow the threshold, and whose
    MinHash values, compared step by step, leave it likely enough."""
    near = np.minimum(size[i], size[j]) * threshold.denominator >= np.maximum(size[i], size[j]) * threshold.numerator
    i, j = i[near], j[near]
    for earlier in range(int(first[i].max(initial=0))):
        new = (bands[i, earlier] != bands[j, earlier]) | (first[i] <= earlier)
        i, j = i[new], j[new]
    sig, match = bands.view(np.uint16), np.zeros(len(i), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(i):
            break
        match += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1)
        on = match >= least[n]
        i, j, match = i[on], j[on], match[on]
    return i, j


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, one_by_one: bool = False, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which of the pairs reach the threshold."""
    size = np.array([len(s) for s in sets])
    return _common(sets, i, j, one_by_one) * (threshold.numerator + threshold.denominator) >= threshold.numerator * (size[i] + size[j])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, one_by_one: bool) -> np.ndarray:
    """Exact sizes of the intersections of pairs: one by one, or by products of incidence blocks where pairs are many."""
    used = np.unique(np.concatenate([i, j]))
    if one_by_one or len(i) < 3 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    a, b = np.unique(i), np.unique(j)
    owner = np.repeat(used, [len(sets[x]) for x in used])
    order = np.concatenate([sets[x] for x in used])
    _, column, count = np.unique(order, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    narrow = np.cumsum(count > 1) - 1
    column, width = narrow[column], int((count > 1).sum())
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, width, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        own, col = owner[s:e], column[s:e] - lo
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        ina, inb = place_a[own] >= 0, place_b[own] >= 0
        x[place_a[own[ina]], col[ina]] = 1
        y[place_b[own[inb]], col[inb]] = 1
        total += x @ y.T
    return np.rint(total[place_a[i], place_b[j]]).astype(np.int64)


class Tiles:
    """Whole tile pairs (b, key, ta, tb) of a table sorted by them, each text once in each."""

    def __init__(self, table: pa.Table):
        number = lambda t, *names: [t.column(c).to_numpy() for c in names]
        at = number(table, "b", "key", "ta", "tb")
        group = np.cumsum(np.r_[0, np.any([x[1:] != x[:-1] for x in at], axis=0)])
        k1, k2 = number(table, "k1", "k2")
        order = np.lexsort((k2, k1, group))
        new = np.r_[True, (group[order][1:] != group[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
        self.table = table.take(pa.array(order[new]))
        self.group = group[order[new]]
        self.b, self.ta, self.tb, self.tile, self.n = number(self.table, "b", "ta", "tb", "tile", "n")
        self.bands = self.table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.start = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        self.size = np.diff(np.r_[self.start, len(self.group)])

    def pairs(self):
        """(i, j, small) of all pairs that a tile pair has to look at, PAIRS or so at a time; small: of small groups."""
        small = (self.size <= SMALL) & (self.ta[self.start] == self.tb[self.start])
        left = np.repeat(self.start + self.size, self.size) - np.arange(len(self.group))
        rows = np.flatnonzero(np.repeat(small, self.size))
        held, total = [], 0
        for d in range(1, SMALL):
            rows = rows[left[rows] > d]
            if not len(rows):
                break
            held.append((rows, rows + d))
            total += len(rows)
            if total >= PAIRS:
                yield *(np.concatenate(x) for x in zip(*held)), True
                held, total = [], 0
        if held:
            yield *(np.concatenate(x) for x in zip(*held)), True
        for g in np.flatnonzero(~small):
            own = np.arange(self.start[g], self.start[g] + self.size[g])
            ta, tb = self.ta[own[0]], self.tb[own[0]]
            one, two = own[self.tile[own] == ta], own[self.tile[own] == tb]
            step = max(1, PAIRS // max(1, len(two)))
            for lo in range(0, len(one), step):
                i, j = (x.ravel() for x in np.meshgrid(one[lo : lo + step], two, indexing="ij"))
                yield (i[i < j], j[i < j], False) if ta == tb else (i, j, False)

    def likely(self, least: dict[int, int]):
        for i, j, small in self.pairs():
            yield *likely(self.bands, self.n, self.b, i, j, least), small


def _whole(batches, columns: list[str]):
    """Tables of whole tile pairs from batches sorted by them, of SOLVE rows or more if there are as many."""
    held, rows = [], 0
    for batch in batches:
        batch = batch.select([*("b", "key", "ta", "tb"), *columns])
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= SOLVE:
            table = pa.Table.from_batches(held)
            at = [table.column(c).to_numpy() for c in ("b", "key", "ta", "tb")]
            # The last tile pair may go on in the next batch.
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0))
            if len(cut):
                yield Tiles(table.slice(0, int(cut[-1]) + 1))
                held = table.slice(int(cut[-1]) + 1).to_batches()
                rows = table.num_rows - int(cut[-1]) - 1
    if rows:
        yield Tiles(pa.Table.from_batches(held))


def _propose(least: dict[int, int]):
    """mapInArrow over sorted tile pairs: the texts that have a likely pair in their bucket."""

    def run(batches):
        for t in _whole(batches, ["k1", "k2", "n", "bands", "tile"]):
            seen = np.zeros(len(t.group), bool)
            for i, j, _ in t.likely(least):
                seen[i] = seen[j] = True
            yield from t.table.select(["k1", "k2", "b", "key", "n"]).filter(pa.array(seen)).to_batches()

    return run


def _verify(least: dict[int, int]):
    """mapInArrow over sorted tile pairs with sets: links of each text, and a forest of the linked ones."""

    def run(batches):
        for t in _whole(batches, ["k1", "k2", "id", "n", "copies", "bands", "tile", "set"]):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.table.column("set")]
            copies, ids, k1, k2 = (t.table.column(c).to_numpy() for c in ("copies", "id", "k1", "k2"))
            links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
            for i, j, small in t.likely(least):
                ok = exact(sets, i, j, small) if len(i) else np.zeros(0, bool)
                i, j = i[ok], j[ok]
                links += (np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))).astype(np.int64)
                # What was joined before stays joined through its labels.
                i, j, before = np.r_[i, np.arange(len(label))], np.r_[j, label], None
                while before is None or (label != before).any():
                    before = label.copy()
                    low = np.minimum(label[i], label[j])
                    np.minimum.at(label, i, low)
                    np.minimum.at(label, j, low)
            who = np.flatnonzero(links)
            ends = [x for at in (who, label[who]) for x in (ids[at], k1[at], k2[at])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends, links[who])], names=["u", "u1", "u2", "v", "v1", "v2", "links"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with b, key and the number of tiles of that bucket, dealt to the tile pairs they belong to."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("k1", "k2"), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda s: F.struct(F.least("tile", s).alias("ta"), F.greatest("tile", s).alias("tb")))
    rows = rows.withColumn("p", F.explode(pair)).select("*", "p.ta", "p.tb").drop("p", "tiles")
    return rows.repartition("b", "key", "ta", "tb").sortWithinPartitions("b", "key", "ta", "tb")


def _classified(docs: DataFrame, key: str, text: str, value_texts: int, tile_texts: int, tile_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(id, t, k1, k2 of every row; k1, k2, label, class_id, n_links of every set of shingles)."""
    t = F.xxhash64(text)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), t).alias("id"), t.alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    profiles = stored(rows.mapInArrow(_profiles, "id long, t long, k1 long, k2 long, n long, bands array<long>"), "profiles")
    classes = stored(profiles.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands")), "classes")
    narrow = classes.select("k1", "k2", F.posexplode("bands").alias("b", "key"))
    shared = narrow.groupBy("b", "key").agg(F.count("*").alias("size")).where("size > 1")
    live = narrow.join(shared, ["b", "key"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("b", "size")).alias("buckets"))
    live = stored(classes.join(live, ["k1", "k2"]), "live")
    tiles = lambda *of: F.greatest(*[F.ceil(x / F.lit(n)) for x, n in of]).cast("int")
    met = live.select("k1", "k2", "n", "bands", F.explode("buckets").alias("x")).select("k1", "k2", "n", "bands", "x.b", F.get("bands", F.col("x.b")).alias("key"), F.ceil(F.col("x.size") / value_texts).cast("int").alias("tiles"))
    proposed = stored(_dealt(met).mapInArrow(_propose(least_matches()), "k1 long, k2 long, b int, key long, n long").distinct(), "proposed")
    dense = proposed.groupBy("b", "key").agg(tiles((F.count("*"), tile_texts), (F.sum("n"), tile_shingles)).alias("tiles"))
    wanted = proposed.join(dense, ["b", "key"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("b", "key", "tiles")).alias("buckets"))
    # A text without words has no set; the id of a set's row leads back to its text.
    wanted = live.drop("buckets").join(wanted, ["k1", "k2"])
    texts = wanted.withColumnRenamed("id", "own").hint("shuffle_hash")
    texts = rows.join(texts, F.col("id") == F.col("own")).select("k1", "k2", "id", "n", "copies", "bands", "buckets", "text")
    sets = texts.mapInArrow(_with_sets, "k1 long, k2 long, id long, n long, copies long, bands array<long>, buckets array<struct<b: int, key: long, tiles: int>>, set binary")
    dealt = _dealt(sets.withColumn("x", F.explode("buckets")).select("k1", "k2", "id", "n", "copies", "bands", "set", "x.*"))
    found = stored(dealt.mapInArrow(_verify(least_matches()), "u long, u1 long, u2 long, v long, v1 long, v2 long, links long"), "links")
    # A node is a set with the smallest id of its rows, so the smallest node of a component has the class's id.
    node = lambda *c: F.struct(*[F.col(x).alias(k) for x, k in zip(c, ("id", "k1", "k2"))])
    joined = components(found.select(node("u", "u1", "u2").alias("u"), node("v", "v1", "v2").alias("v"))).select("node.k1", "node.k2", F.col("component").alias("label"))
    linked = found.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("links").alias("links")).join(joined, ["k1", "k2"])
    known = classes.select("k1", "k2", "id", "copies").join(linked, ["k1", "k2"], "left").withColumn("label", F.coalesce("label", node("id", "k1", "k2")))
    known = known.select("k1", "k2", "label", F.col("label.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return profiles.select("id", "t", "k1", "k2", "n"), known


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", value_texts: int = VALUE_TEXTS, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """id, class_id, n_links for each row: the connected component of texts linked by a Jaccard similarity of at least 0.8
    between their sets of five-word shingles (class_id is its smallest id), and the number of other rows linked directly.

    Words part at ASCII white space and are compared as written; a text of one to four words has one shingle of all its
    words. Rows with equal sets form one class at once and are never compared. Two other sets are compared if they share
    a band of MinHash values, in the bucket of the first one they share; a large bucket is compared tile by tile, so that no
    task holds more than two tiles and no pair leaves a task: only counts and a spanning forest do. The Bayesian test drops
    pairs that can't reach the threshold, the exact sets decide on the rest. A text without words links to nothing and is
    its own class. A null id is replaced by a hash of the text. Rows may share an id, with one text or several. Other
    columns are ignored. No rows give none.
    """
    rows, known = _classified(docs, key, text, value_texts, tile_texts, tile_shingles)
    return rows.join(known, ["k1", "k2"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id; of equal rows one stays, and of different texts of that id
    in one class the one of the smallest hash. Texts without words stay, once for each id. The columns stay, whatever their
    names."""
    rows, known = _classified(docs, key, text, VALUE_TEXTS, TILE_TEXTS, TILE_SHINGLES)
    rows = rows.groupBy("id", "t", "k1", "k2").agg(F.count("*").alias("rows")).join(known.select("k1", "k2", "label"), ["k1", "k2"], "left")
    # What has no words is a class of its own.
    alone = F.when(F.col("label").isNull(), F.struct("id", "t"))
    best = rows.groupBy("label", alone.alias("alone")).agg(F.min(F.struct("id", "t", "rows")).alias("x")).select("x.*")
    own, t, n = spare(docs, "own", "t", "rows")
    best = best.select(F.col("id").alias(own), F.col("t").alias(t), F.col("rows").alias(n))
    kept = docs.withColumns({own: F.coalesce(F.col(key).cast("long"), F.xxhash64(text)), t: F.xxhash64(text)}).join(best.hint("shuffle_hash"), [own, t])
    return kept.where(F.col(n) == 1).unionByName(kept.where(F.col(n) > 1).dropDuplicates([own, t])).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


#: For small tables only: it joins all shingles. Ids are taken to be there and to differ.
OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE c * 5 >= 4 * (u.n + v.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x AS doc_id, x AS far FROM (SELECT DISTINCT x FROM e) UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.far)
SELECT d.doc_id, least(d.doc_id, coalesce(c.far, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM d LEFT JOIN (SELECT doc_id, min(far) AS far FROM reach GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM e GROUP BY 1) k USING (doc_id)
"""
