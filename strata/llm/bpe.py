"""Byte-level BPE: a minimal perfect hash knows whole pre-tokens of the vocabulary, the others are merged by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
import os
import struct
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from strata.llm import texthash
from strata.llm.common import pieces, read, text_bytes

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
#: Keys that share a displacement, on average.
BUCKET = 4
#: The vocabulary goes to every task; a larger file is refused.
MOST_BYTES = 1 << 26
#: Text bytes taken at once; a longer text goes by MATCHES pre-tokens.
PIECE = 1 << 20
MATCHES = 1 << 18
#: Pre-tokens whose ids a Python worker keeps, some 200 MB; then it forgets them.
KEPT = 800_000
# Code points (hex) that newer versions of Unicode made letters or numbers, which tiktoken doesn't count as such yet.
YOUNG = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: What stands for them while a text is cut: a code point that is neither letter, number nor space.
OTHER = "\ue000"


def ranks_of(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and their ranks, a line each."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"the vocabulary {path} is over {MOST_BYTES} bytes")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _hashes(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return texthash.word_hashes(np.frombuffer(b"".join(keys), np.uint8), starts, ends)


def _slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (texthash.mix(h + shift.astype(np.uint64) * STEP) % U64(n)).astype(np.int64)


def perfect(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """shifts, order: a minimal perfect hash of distinct keys by displacement, and the key (its place in keys) of each slot.

    Keys fall into buckets; from the largest down, each bucket takes the first shift that sends its keys to free slots.
    A bucket of one key names its slot itself (as -1 - slot), so the table fills up without a gap.
    """
    n = len(keys)
    h = _hashes(keys)
    if len(np.unique(h)) < n:
        raise ValueError("keys are repeated or share 64 bits of hash")
    count = max(1, n // BUCKET)
    bucket = (h % U64(count)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[by], np.arange(count + 1))
    shifts, order = np.zeros(count, np.int64), np.full(n, -1, np.int64)
    sizes = np.diff(starts)
    for b in np.argsort(-sizes, kind="stable"):
        own = by[starts[b] : starts[b + 1]]
        if len(own) < 2:
            break
        at, width = 0, 16
        while True:
            slots = _slots(h[own][None, :], np.arange(at, at + width)[:, None], n)
            spread = np.sort(slots, axis=1)
            good = (order[slots] < 0).all(1) & (spread[:, 1:] != spread[:, :-1]).all(1)
            if good.any():
                k = int(good.argmax())
                shifts[b], order[slots[k]] = at + k, own
                break
            at, width = at + width, min(4096, 4 * width)
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(order < 0)
    shifts[single], order[free] = -1 - free, by[starts[single]]
    return shifts, order


def find(wanted: list[bytes], shifts: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """The slot of each wanted string, -1 if it isn't a key. keys: by slot."""
    if not wanted or not keys:
        return np.full(len(wanted), -1, np.int64)
    h = _hashes(wanted)
    shift = shifts[(h % U64(len(shifts))).astype(np.int64)]
    slots = np.where(shift < 0, -1 - shift, _slots(h, np.maximum(shift, 0), len(keys)))
    same = np.fromiter(map(eq, map(keys.__getitem__, slots.tolist()), wanted), bool, len(wanted))
    return np.where(same, slots, -1)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours whose join is a token, the join of least rank is made, the leftmost first, until none is left.

    Parts are a linked list over the bytes; a heap holds the joins by rank and place, and an entry counts only while its
    place still has that join. Work grows as n log n.
    """
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    best: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
    best.append(None)
    heap = [(r << 40) | i for i, r in enumerate(best) if r is not None]
    heapq.heapify(heap)
    pop, push, place = heapq.heappop, heapq.heappush, (1 << 40) - 1
    while heap:
        top = pop(heap)
        i = top & place
        if best[i] != top >> 40:
            continue
        j = after[i]
        k = after[j]
        after[i], best[j] = k, None
        if k < n:
            before[k] = i
            r = best[i] = get(piece[i : after[k]])
            if r is not None:
                push(heap, (r << 40) | i)
        else:
            best[i] = None
        p = before[i]
        if p >= 0:
            r = best[p] = get(piece[p:k])
            if r is not None:
                push(heap, (r << 40) | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def _texts(column: pa.Array):
    """(bytes) lists of texts of about PIECE bytes together."""
    raw, offsets = text_bytes(column)
    data = raw.tobytes()
    for i, j in pieces(offsets, PIECE):
        yield [data[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") for k in range(i, j)]


def _cutter(pattern: str):
    """A function that gives the pattern's matches in a text one after the other, as tiktoken's tables of letters and numbers see it."""
    cut = regex.compile(pattern)
    young = regex.compile("[" + "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in YOUNG.split()) + "]")

    def matches(text: str):
        if text.isascii() or not young.search(text):
            return (m.group() for m in cut.finditer(text)) if len(text) > PIECE else cut.findall(text)
        return (text[m.start() : m.end()] for m in cut.finditer(young.sub(OTHER, text)))

    return matches


def _encoder(shifts: np.ndarray, keys: list[bytes], ids: np.ndarray, known: dict[str, bytes], pattern: str):
    """A function of a list of texts: each one's ids as little-endian unsigned 32-bit integers. known: what has been found so far."""
    ranks, matches = dict(zip(keys, ids.tolist())), _cutter(pattern)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    packed = ids.astype("<u4").view("V4").tolist()

    def learn(tokens: set[str]) -> None:
        if len(known) > KEPT:
            known.clear()
        new = list(tokens.difference(known))
        parts = [t.encode("utf-8", "surrogatepass") for t in new]
        slots = find(parts, shifts, keys)
        for token, part, slot in zip(new, parts, slots.tolist()):
            known[token] = packed[slot] if slot >= 0 else struct.pack(f"<{len(out := merged(part, ranks))}I", *out)

    def encode(texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) <= 2 * PIECE:
            tokens = [list(matches(t)) for t in texts]
            learn(set().union(*tokens))
            return [b"".join(map(known.__getitem__, t)) for t in tokens]
        out = []
        for text in texts:
            parts, rest = [], iter(matches(text))
            while some := list(islice(rest, MATCHES)):
                learn(set(some))
                parts.append(b"".join(map(known.__getitem__, some)))
            out.append(b"".join(parts))
        return out

    return encode


def _run_encode(table, pattern: str, name: str):
    """mapInArrow function: the text, the last column, gives way to its packed ids."""

    def run(batches):
        encode = None
        for batch in batches:
            encode = encode or _encoder(*table.value, pattern)
            at, key = 0, batch.columns[:-1]
            for texts in _texts(batch.column(batch.num_columns - 1)):
                packed = pa.array(encode(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(at, len(texts)) for c in key] + [packed], names=[*batch.schema.names[:-1], name])
                at += len(texts)

    return run


def _run_decode(table, name: str):
    """mapInArrow function: adds the bytes of the packed ids, the last column."""

    def run(batches):
        _, keys, ids, _ = table.value
        token = dict(zip(ids.tolist(), keys))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in pieces(offsets, 4 * PIECE):
                out = []
                for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1]):
                    cuts = range(int(a), int(b), 4 * MATCHES)
                    out.append(b"".join(b"".join(map(token.__getitem__, raw[lo : min(lo + 4 * MATCHES, int(b))].copy().view("<u4").tolist())) for lo in cuts))
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns] + [pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return run


def vocabulary(spark: SparkSession, path: str):
    """The file's tokens behind a minimal perfect hash, as a broadcast (at most MOST_BYTES of file) of plain arrays.

    With them goes an empty dictionary: a Python worker notes the ids of pre-tokens there that it has met, up to KEPT, and
    finds them again in its next task.
    """
    ranks = ranks_of(path)
    tokens = list(ranks)
    shifts, order = perfect(tokens)
    keys = [tokens[i] for i in order]
    return spark.sparkContext.broadcast((shifts, keys, np.array([ranks[k] for k in keys], np.int64), {}))


def encode(docs: DataFrame, table, pattern: str, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """key, ids: the BPE ids of every text, as little-endian unsigned 32-bit integers in one binary (unpacked() gives an array).

    Each match of pattern is encoded by itself: a pre-token that is in the vocabulary by one look into the perfect hash
    (and a comparison with the key that stands there, so nothing rests on a hash alone), any other by merges. Null and empty texts have no ids; no special tokens are known;
    bytes that aren't UTF-8 count as U+FFFD. Rows with repeated or null keys each give a row; other columns are ignored. Texts
    of any length go through by pieces; only a text's ids and one pre-token are held whole. No row is shuffled.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text_of_row"))
    schema = StructType([rows.schema.fields[0], StructField(ids, BinaryType())])
    return rows.mapInArrow(_run_encode(table, pattern, ids), schema)


def decode(rows: DataFrame, table, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes that the packed ids stand for. An id outside the vocabulary is an error; null ids give no bytes."""
    laid = rows.select(*[c for c in rows.columns if c != ids], ids)
    schema = StructType([*laid.schema.fields, StructField(decoded, BinaryType())])
    return laid.mapInArrow(_run_decode(table, decoded), schema)


def unpacked(ids):
    """array<bigint> of packed ids, as a Spark expression."""
    every = F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    one = lambda i: F.conv(F.concat(*[F.hex(F.substring(ids, i * 4 + b, F.lit(1))) for b in (4, 3, 2, 1)]), 16, 10).cast("long")
    return F.when(F.octet_length(ids) > 0, F.transform(every, one)).otherwise(F.array().cast("array<bigint>"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    table = vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = decode(encode(read(spark, sf_dir, "documents"), table, public_tokenizers.PATTERN), table)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
