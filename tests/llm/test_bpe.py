"""Byte-level BPE against the tiktoken library, text by text, and back."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, SF, awkward, tables

from strata.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(own, text):
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_table(spark, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op11(spark, SF).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(own, texts[r.doc_id]) for r in got)


def test_awkward_rows(spark, own, tmp_path):
    rng = random.Random(1)
    odd = ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "\r\n\t \x85\xa0 ", "don't DON'T 'S's", "".join(chr(rng.randrange(0x20, 0xD800)) for _ in range(3000)), "".join(chr(rng.randrange(0x10000, 0x110000)) for _ in range(3000)), "12 345٣½ ①", "\x00\x01\x7f"]
    rows = awkward(spark).union(spark.createDataFrame([(100 + i, t, None, None, 0) for i, t in enumerate(odd)], DOCS)).withColumn("ids", F.lit("clash")).withColumn("text_of_row", F.lit(1))
    sf = tables(spark, tmp_path, documents=rows)
    kept = sorted((want(own, r.text), r.doc_id or -1) for r in rows.collect())
    assert sorted(((r.n_tokens, r.ids_sha256, r.decoded_sha256), r.doc_id or -1) for r in bpe.op11(spark, sf).collect()) == kept


def test_letters_of_later_unicode_are_cut_as_the_library_does(own):
    table = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    shifts, order = bpe.perfect(list(table))
    keys = [list(table)[i] for i in order]
    encode = bpe._encoder(shifts, keys, np.array([table[k] for k in keys]), {}, P.PATTERN)
    edges = [int(x, 16) + d for r in bpe.YOUNG.split() for x in r.split("-") for d in (-1, 0, 1)]
    texts = [f" a{chr(c)}1{chr(c)} .{chr(c)}x {chr(c)}'s" for c in edges]
    assert [np.frombuffer(e, "<u4").tolist() for e in encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_long_texts_go_by_pieces(spark, own, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 200)
    monkeypatch.setattr(bpe, "MATCHES", 7)
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = "The quick brön fox, 123 jumps\n\n over it's lazy dog. " * 40
    table = bpe.vocabulary(spark, P.path("byte_bpe_50k.tiktoken"))
    rows = bpe.decode(bpe.encode(spark.createDataFrame([(1, text), (1, text), (None, None)], "k long, body string"), table, P.PATTERN, "k", "body"), table)
    got = rows.withColumn("list", bpe.unpacked(F.col("ids"))).collect()
    assert sorted(len(r.list) for r in got) == sorted([0, *[len(own.encode_ordinary(text))] * 2])
    assert all(r.list == own.encode_ordinary(text) and bytes(r.decoded) == text.encode() for r in got if r.k)


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 256, 3000):
        keys = list({rng.randbytes(rng.randrange(1, 9)) for _ in range(n)})
        shifts, order = bpe.perfect(keys)
        assert sorted(order.tolist()) == list(range(len(keys)))
        by_slot = [keys[i] for i in order]
        assert [by_slot[s] for s in bpe.find(keys, shifts, by_slot)] == keys
        other = [k + b"\xff\xff\xff" for k in keys if k + b"\xff\xff\xff" not in keys]
        assert (bpe.find(other, shifts, by_slot) == -1).all()
    with pytest.raises(ValueError):
        bpe.perfect([b"a", b"a"])


def test_merges_are_those_of_a_plain_search(own):
    ranks, rng = own._mergeable_ranks, random.Random(4)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(300):
        piece = bytes(rng.choice(b"aaatheion \xc3\xa9") for _ in range(rng.randrange(1, 60)))
        assert bpe.merged(piece, ranks) == plain(piece)


def test_a_vocabulary_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(255)))
    ranks = bpe.ranks_of(str(path))
    shifts, order = bpe.perfect(list(ranks))
    with pytest.raises(ValueError, match="255"):
        bpe._encoder(shifts, [list(ranks)[i] for i in order], np.arange(255), {}, P.PATTERN)
