"""Lexical search against SQL and against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
from oracle import connect, same
from pyspark.sql import functions as F
from test_llm import DOCS, awkward, none, prose, tables

from strata.llm import lexical


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) by the formula, a document at a time."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(cut(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item in {i for i, _ in items}:
        asked = Counter(t for i, text in items if i == item for t in cut(text))
        scored = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if i is not None and score > 0:
                scored.append((-score, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_against_a_plain_scorer(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)] + [(None, prose(rng, 30))] * 2 + [(7, prose(rng, 5)), (400, None), (401, ""), (402, " .,;- \n"), (403, "É É é 9 Straße"), (404, prose(rng, 20_000))]
    docs += [(500 + i, "same same text") for i in range(40)]
    items = [(1, "same text"), (2, docs[5][1]), (2, docs[6][1] + " " + docs[6][1]), (3, None), (4, ""), (5, "nowhere-found!"), (None, docs[9][1]), (6, "É 9 STRASSE straße"), (7, " ".join(d[1] for d in docs[:50]))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, key string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    want = plain(docs, items, 10)
    assert sum(w[0] == 1 for w in want) == 10 and not any(w[0] in (3, 4, 5) for w in want)
    for parts, shard, block in ((3, lexical.SHARD_BYTES, lexical.BLOCK_BYTES), (7, 2000, 9000), (130, lexical.SHARD_BYTES, lexical.BLOCK_BYTES)):
        monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
        monkeypatch.setattr(lexical, "TERMS", 500)
        built = lexical.index(df.repartition(parts))
        if parts == 130:  # as many lists as need a tree
            built = built._replace(shards=built.shards.repartition(130))
        got = [tuple(r) for r in lexical.search(built, asked, block_bytes=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeated_documents_are_listed_each(spark):
    df = spark.createDataFrame([(5, "alpha beta")] * 4 + [(6, "alpha"), (9, "gamma")], "doc_id long, text string")
    got = lexical.search(lexical.index(df), spark.createDataFrame([(1, "beta gamma")], "item_id long, text string"), k=3).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [9, 5, 5]


def test_awkward_rows_equal_sql(spark, tmp_path):
    bench = spark.createDataFrame([(0, "All rights reserved by nobody"), (0, "WORD"), (1, None), (None, "word é password"), (2, "kaban3 lodor7 same")], "item_id long, text string")
    sf = tables(spark, tmp_path, documents=awkward(spark).withColumn("block", F.lit(1)), benchmark=bench)
    same(lexical.op12(spark, sf), connect(sf, documents=spark.read.parquet(sf + "/documents.parquet").toArrow(), benchmark=bench.toArrow()), lexical.OP12_SQL)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(none(spark)), items).count() == 0
    assert lexical.search(lexical.index(spark.createDataFrame([(1, "a", None, None, 0)], DOCS)), items.where("false")).count() == 0


def test_selection_is_safe_with_ties():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(0, 4, rng.integers(0, 30))
        want = [i for s, i in sorted((-s, i) for i, s in enumerate(scores.tolist()))[:5] if scores[i] > 0]
        assert sorted(lexical._select(scores, 5).tolist()) == sorted(want)


def test_impacts_hold_beyond_64_bits():
    tf, n, docs, terms = np.array([1, 3, 7]), np.array([10, 10**7, 5 * 10**8]), 10**12, 10**15
    want = [(10**9 * t) // (1000 * t + 8 * (25 + 75 * x * docs // terms)) for t, x in zip(tf.tolist(), n.tolist())]
    assert lexical.impacts(tf, n, docs, terms).tolist() == want
