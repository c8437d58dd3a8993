"""Suffix-array dedup: every byte that lies in a 400-byte string which starts anywhere else is removed.

All suffixes of a large corpus can't be shuffled within a few times its size, so suffixes that can't repeat are screened
out first, without loss. In each 400-byte window the 64-byte string of the smallest hash (the rightmost of equals) is the
window's anchor; equal windows have equal anchors at the same place, so a window whose anchor's hash occurs once in the
corpus is unique. Neighbouring windows share an anchor: a segment is such a run. Segments that occur again as a whole
(known by 128 bits of hash) repeat in all their windows, and one of them stands for all. The suffixes of what is then
left are range-partitioned by their leading bytes from the anchor on, with sampled splitters, sorted in their bucket by
their own bytes, eight at a time, ties alone going on to the next eight, and compared with their neighbours. Keys too
large for a task are split into pieces, and what the pieces' own comparison leaves open is compared across them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import pieces, read, spare, stored, text_bytes
from strata.llm.texthash import CHUNK, byte_table, mix, prefix, spans_hash

LENGTH = 400
ANCHOR = 64
#: Two tables, for two hashes of 64 bits each.
_BYTES, _MORE = byte_table(404), byte_table(405)
_PLACE = np.uint64((1 << 24) - 1)
#: Segments of one key that meet in a task at most; larger keys are split by hash and settled across the pieces.
KEY_ROWS = 8192
#: Bytes of a text looked at together at most; longer texts go on in pieces that share LENGTH - 1 bytes.
PIECE = 1 << 20
#: Suffixes compared at once.
SLICE = 1 << 16


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(row, first window, last window, anchor place, anchor hash, two segment hashes) of all segments; places count from 0 of raw."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    sums = prefix(_BYTES[raw])
    place = np.arange(len(raw) - anchor + 1)
    h = mix(spans_hash(sums, place, place + anchor))
    least = (h & ~_PLACE) | (_PLACE - place.astype(np.uint64))
    width, span = length - anchor + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    counts = sizes[long] - length + 1
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    window = np.arange(counts.sum()) + np.repeat(offsets[long] - before, counts)
    value = least[window]
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    end = np.r_[start[1:], len(window)] - 1
    first, last = window[start], window[end]
    at = (_PLACE - (value[start] & _PLACE)).astype(np.int64)
    seg, seg2 = (mix(spans_hash(x, first, last + length) + (last - first).astype(np.uint64)) for x in (sums, prefix(_MORE[raw])))
    return np.searchsorted(offsets, first, "right") - 1, first, last, at, h[at], seg, seg2


_SEGMENTS = "t1 long, t2 long, ah long, seg long, seg2 long, firsts array<int>, reach int, anchor int"


def _screen(length: int, anchor: int):
    """mapInArrow: t1, t2, text -> a row for each different segment of a text: the first windows of all its places, how far
    its last window is from the first, and where its anchor is from there."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in pieces(offsets, CHUNK):
                part = offsets[i : j + 1]
                for lo in range(0, max(1, int(part[-1] - part[0]) - length + 1), PIECE):
                    hi = min(int(part[-1]), int(part[0]) + lo + PIECE + length - 1)
                    at = part - part[0] if j - i > 1 else np.array([0, hi - int(part[0]) - lo])
                    row, first, last, place, ah, seg, seg2 = segments(raw[part[0] + lo : hi], at, length, anchor)
                    if len(row):
                        order = np.lexsort((seg2, seg, row))
                        row, first, last, place, ah, seg, seg2 = (x[order] for x in (row, first, last, place, ah, seg, seg2))
                        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]) | (seg2[1:] != seg2[:-1]) | (ah[1:] != ah[:-1])])
                        firsts = pa.array((first - at[row] + (lo if j - i == 1 else 0)).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t1[i + row[new]]), pa.array(t2[i + row[new]]), *(pa.array(x[new].view(np.int64)) for x in (ah, seg, seg2)), pa.ListArray.from_arrays(np.r_[new, len(row)].astype(np.int32), firsts), *(pa.array((x - first)[new].astype(np.int32)) for x in (last, place))],
                            names=["t1", "t2", "ah", "seg", "seg2", "firsts", "reach", "anchor"],
                        )
                    if j - i > 1:
                        break

    return run


_OPEN = ("ah", "pieces", "copies", "first", "anchor")


def _cut(length: int):
    """mapInArrow: a text and its open segments -> a row for each with its bytes and, as `lead`, the anchor's first eight."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("lead", "ah", "piece", "pieces", "copies", "t1", "t2", "first", "anchor", "bytes")}
            for t1, t2, text, segs in zip(*(batch.column(i) for i in range(4))):
                raw = text.as_buffer().to_pybytes()
                for s in segs.as_py():
                    for k in _OPEN:
                        out[k].append(s[k])
                    at = s["first"] + s["anchor"]
                    # Signed numbers in the order of the bytes.
                    out["lead"].append(int.from_bytes(raw[at : at + 8].ljust(8, b"\0"), "big") - (1 << 63))
                    out["piece"].append(s["seg"] % s["pieces"])
                    out["t1"].append(t1.as_py())
                    out["t2"].append(t2.as_py())
                    out["bytes"].append(raw[s["first"] : s["first"] + s["reach"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int32() if k in ("first", "anchor") else pa.int64()) for k, v in out.items()], names=list(out))

    return run


def repeated(group: np.ndarray, raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix equals another of its group in its first `length` (8 at least) bytes: a multikey sort by eight
    bytes at a time, from 64 on by 64. What stands alone in its run is done; ties alone are sorted by their next bytes."""
    raw = np.ascontiguousarray(raw)
    left = np.argsort(group, kind="stable")
    run = np.cumsum(np.r_[False, group[left][1:] != group[left][:-1]]) if len(left) else left
    if len(left) and run[-1] < 1 << 24:
        # The first five bytes fit into one number with the run.
        first = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))[start[left]].byteswap() >> np.uint64(24)
        first |= run.astype(np.uint64) << np.uint64(40)
        order = np.argsort(first)
        left, first = left[order], first[order]
        run = np.cumsum(np.r_[False, first[1:] != first[:-1]])
    head = min(length, 64)
    steps = [(at, 8) for at in (*range(0, head - 8, 8), head - 8)] + [(at, 64) for at in (*range(64, length - 64, 64), length - 64) if length > 64]
    for at, width in steps:
        tied = np.r_[False, run[1:] == run[:-1], False]
        tied = tied[1:] | tied[:-1]
        if not tied.all():
            left, run = left[tied], run[tied]
        if not len(left):
            break
        here = np.ndarray((len(raw) - width + 1,), f"V{width}", raw.data, strides=(1,))
        new, other = run[1:] != run[:-1], np.zeros(len(left) - 1, bool)
        for lo in range(0, len(other), SLICE):
            part = here[start[left[lo : lo + SLICE + 1]] + at].view(np.uint64).reshape(-1, width // 8)
            other[lo : lo + SLICE] = (part[1:] != part[:-1]).any(1)
        other &= ~new
        if not other.any():
            continue
        # Runs in which all are equal stay as they are.
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][other]] = True
        mixed = np.flatnonzero(mixed[run])
        keys = here[start[left[mixed]] + at].view(np.uint64).reshape(-1, width // 8).byteswap()  # in the order of the bytes
        order = np.lexsort((*keys.T[::-1], run[mixed]))
        left[mixed], keys = left[mixed[order]], keys[order]
        new[mixed[1:] - 1] |= (keys[1:] != keys[:-1]).any(1)
        run = np.cumsum(np.r_[False, new])
    out = np.zeros(len(group), bool)
    if len(left):
        tied = np.r_[False, run[1:] == run[:-1], False]
        out[left[tied[1:] | tied[:-1]]] = True
    return out


_FOUND = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("ah", pa.int64()), ("code", pa.int64()), ("code2", pa.int64())])


def _compare(length: int):
    """mapInArrow over a sorted bucket: spans of repeated suffixes (ah null), and the suffixes of the keys that are split
    over pieces (ah and codes set; t1 null where the suffix is settled already)."""

    def solve(table: pa.Table):
        ah, pieces_, copies, t1, t2 = (table.column(c).to_numpy() for c in ("ah", "pieces", "copies", "t1", "t2"))
        first, anchor = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "anchor"))
        raw, offsets = text_bytes(table.column("bytes"))
        count, group = np.diff(offsets) - length + 1, np.cumsum(np.r_[0, ah[1:] != ah[:-1]])
        split = pieces_ > 1
        # A key of one whole row has nothing to meet.
        rows = np.flatnonzero((np.bincount(group)[group] > 1) | split)
        if not len(rows):
            return
        reps = count[rows]
        owner = np.repeat(rows, reps)
        w = np.arange(reps.sum()) - np.repeat(np.concatenate(([0], np.cumsum(reps)[:-1])), reps)
        start = offsets[owner] + w
        # Windows meet only where their anchors lie at the same place.
        meet = group[owner] * (length + 1) + anchor[owner] - w
        same = repeated(meet, raw, start, length)
        mine = np.flatnonzero(same & (copies[owner] == 1))
        if len(mine):
            a = np.flatnonzero(np.r_[True, (owner[mine][1:] != owner[mine][:-1]) | (w[mine][1:] != w[mine][:-1] + 1)])
            b = np.r_[a[1:], len(mine)] - 1
            o, lo, hi = owner[mine[a]], w[mine[a]], w[mine[b]] + length
            yield _found(t1[o], t2[o], first[o] + lo, first[o] + hi)
        far = np.flatnonzero(split[owner])
        if len(far):
            o, code = owner[far], [mix(spans_hash(prefix(x[raw]), start[far], start[far] + length) ^ (anchor[owner[far]] - w[far]).astype(np.uint64)).view(np.int64) for x in (_BYTES, _MORE)]
            single = ~same[far] & (copies[o] == 1)
            # Of equal suffixes one stands for all.
            _, one = np.unique(np.stack([ah[o], *code]), axis=1, return_index=True)
            keep = single.copy()
            keep[one] = True
            o, w_, code, single = o[keep], w[far][keep], [c[keep] for c in code], single[keep]
            yield _found(t1[o], t2[o], first[o] + w_, first[o] + w_ + length, ah[o], code, ~single)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # Keys are whole in what is solved: the last one of a batch waits for the next.
            key = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("ah", "piece")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and batch.num_rows and [held[-1].column("ah")[-1].as_py(), held[-1].column("piece")[-1].as_py()] != key[:, 0].tolist():
                yield from solve(pa.Table.from_batches(held))
                held = []
            at = 0
            for end in cut:
                if sum(b.num_rows for b in held) + end - at >= KEY_ROWS // 4:
                    held.append(batch.slice(at, end - at))
                    yield from solve(pa.Table.from_batches(held))
                    held, at = [], end
            held.append(batch.slice(at))
        if held and sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held))

    return run


def _found(t1, t2, s, e, ah=None, code=None, none=None) -> pa.RecordBatch:
    empty = pa.nulls(len(t1), pa.int64())
    more = [empty] * 3 if ah is None else [pa.array(x) for x in (ah, *code)]
    return pa.RecordBatch.from_arrays([pa.array(t1, mask=none), pa.array(t2, mask=none), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), *more], schema=_FOUND)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """t1, t2 (two hashes of a text), firsts, reach: every byte from a place of firsts on to `length + reach` bytes after it
    lies in a repeated string of that text.

    Texts that are equal share their spans. Spans overlap. A segment that returns within a text is one row of it. Keys that
    hold many suffixes are counted before they are shuffled, split over buckets by the splitters, and settled across
    borders by counts, so no key meets in one task.
    """
    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), F.col("text").cast("binary").alias("text"))
    found = stored(texts.mapInArrow(_screen(length, anchor), _SEGMENTS), "segments")
    times, whole = F.sum(F.size("firsts")), ["ah", "seg", "seg2"]
    # The keys are a table of their own, so that the join can split a key that many segments have.
    keys = found.groupBy("ah").agg(times.alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("seg", "seg2")]).where("n > 1")
    keys = stored(keys.select("ah", F.expr("min_seg <> max_seg or min_seg2 <> max_seg2").alias("differ"), F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("pieces")), "keys")
    live = stored(found.join(keys, "ah"), "live")
    spans = ["t1", "t2", "firsts", "reach"]
    settled = live.where("not differ").select(spans)
    open_ = stored(live.where("differ").groupBy(whole).agg(times.alias("copies"), F.min("t1").alias("t1")), "open")
    # Segments that occur again as they are repeat as a whole.
    again = live.where("differ").join(open_.where("copies > 1").select(whole), whole).select(spans)
    # One place stands for each segment of an open key; its bytes come from one row of its text.
    stand = live.where("differ").join(open_, [*whole, "t1"]).groupBy(*whole, "copies", "pieces").agg(F.min(F.struct("t1", "t2", F.col("firsts")[0].alias("first"), "reach", "anchor")).alias("x"))
    by_text = stand.groupBy("x.t1", "x.t2").agg(F.collect_list(F.struct("ah", "seg", "copies", "pieces", "x.first", "x.reach", "x.anchor")).alias("segs"))
    once = texts.dropDuplicates(["t1", "t2"])
    cut = once.join(by_text.hint("shuffle_hash"), ["t1", "t2"]).select("t1", "t2", "text", "segs").mapInArrow(_cut(length), "lead long, ah long, piece long, pieces long, copies long, t1 long, t2 long, first int, anchor int, bytes binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = cut.repartitionByRange(n, "lead", "ah", "piece").sortWithinPartitions("lead", "ah", "piece")
    compared = stored(buckets.mapInArrow(_compare(length), "t1 long, t2 long, s int, e int, ah long, code long, code2 long"), "compared")
    one = [F.col("t1"), F.col("t2"), F.array("s").alias("firsts"), (F.col("e") - F.col("s") - length).alias("reach")]
    inside = compared.where("ah is null").select(one)
    met = compared.where("ah is not null").groupBy("ah", "code", "code2").agg(F.count("*").alias("n")).where("n > 1")
    across = compared.where("t1 is not null and ah is not null").join(met, ["ah", "code", "code2"]).select(one)
    return settled.unionByName(again).unionByName(inside).unionByName(across)


def _remove(position: int, length: int):
    """mapInArrow: rows with text as binary at `position` and their spans last -> kept bytes and the maximal removed runs."""

    def run(batches):
        for batch in batches:
            kept, runs = [], []
            for text, spans in zip(batch.column(position), batch.column(batch.num_columns - 1)):
                raw, spans = text.as_buffer().to_pybytes() if text.is_valid else b"", spans.values
                firsts = spans.field("firsts")
                s = firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                e = s + length + np.repeat(spans.field("reach").to_numpy(zero_copy_only=False), np.diff(firsts.offsets.to_numpy()))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                s, e = s[new].tolist(), e[np.r_[new[1:], len(e)] - 1].tolist()
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)])))
                runs.append(list(zip(s, e)))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.list_(pa.int32())))], names=[*names, "kept", "runs"])

    return run


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with kept (binary: the bytes left) and runs (array of [start, end): the maximal removed runs in bytes).

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in another row or the same one,
    overlapping or not; all strings are judged on the input. Rows of equal text lose everything from `length` bytes on.
    Null and empty texts keep nothing and lose nothing; shorter texts stay whole. Columns named kept or runs are replaced,
    all others stay. No rows give none.
    """
    spans = repeated_spans(docs, text, length, anchor).groupBy("t1", "t2").agg(F.collect_set(F.struct("firsts", "reach")).alias("spans"))
    names = [c for c in docs.columns if c not in ("kept", "runs")]
    docs = docs.select(*names)
    t1, t2, own, raw = spare(docs, "t1", "t2", "spans", "raw")
    rows = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), F.col(text))})
    joined = rows.join(spans.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(own)), [t1, t2], "left")
    plain, hit = joined.where(F.col(own).isNull()), joined.where(F.col(own).isNotNull())
    whole = plain.select(*names, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"), F.array().cast("array<array<int>>").alias("runs"))
    given = hit.select(*names, F.col(text).cast("binary").alias(raw), own)
    schema = given.drop(own).withColumns({"kept": F.lit(b""), "runs": F.array().cast("array<array<int>>")}).schema
    return whole.unionByName(given.mapInArrow(_remove(len(names), length), schema).drop(raw))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.octet_length("text") - F.octet_length("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("runs") > 0).alias("changed"),
    )


#: For small tables only: it lists every window. Ids are taken to differ.
OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {LENGTH - 1})) AS p FROM d WHERE len(x) >= {2 * LENGTH})),
r AS (SELECT doc_id, p FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER k + {LENGTH} THEN 0 ELSE 1 END AS new FROM r WINDOW k AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM n),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY doc_id),
o AS (SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i: substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END,
    CASE WHEN i = len(starts) THEN len(x) ELSE 2 * starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE 2 * ends[i] END)), '') END AS kept FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256, n_removed > 0 AS changed FROM o
"""
