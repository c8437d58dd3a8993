"""The Merkle manifest against a plain tree built in Python, and what tampering does to it."""

import hashlib
import random

from test_llm import DOCS, awkward, tables

from oracle import connect, same
from strata.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, j):
    out = []
    for nodes in tree[:-1]:
        run = j - j % 16
        out.append(("".join(nodes[run:j]), "".join(nodes[j + 1 : run + 16])))
        j //= 16
    return out


def plain(rows):
    """rows of (group, order, leaf): root, and (group, order, leaf, path, subroot) of each."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for j, (known, o, leaf) in enumerate(sorted(groups[g])):
            out.append((g, o if known else None, leaf, tuple(siblings(trees[g], j) + siblings(top, i)), trees[g][-1][0]))
    return top[-1][0], sorted(out, key=repr)


def test_trees_of_every_depth(spark):
    rng = random.Random(3)
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "é": 256, "z": 257, "big": 4500}
    rows = [(g, rng.choice([None, *range(5 * n)]), h(g or "", str(i // 2))) for g, n in sizes.items() for i in range(n)]
    rows += [(f"s{i}", i, h(str(i))) for i in range(300)]
    rng.shuffle(rows)
    root, want = plain(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "grp string, o long, leaf string, path string, tree string").repartition(7)
    made = merkle.manifest(df, "grp", "o", "leaf", ("o",))
    got = sorted(((r.grp, r.o, r.leaf, tuple((p.left, p.right) for p in r.path), r.subroot) for r in made.proofs.collect()), key=repr)
    assert made.root == root and got == want
    assert {(r.grp, r.n) for r in made.subroots.collect()} == {*sizes.items(), *((f"s{i}", 1) for i in range(300))}
    assert made.proofs.where(merkle.folded(F.col("leaf"), F.col("path")) != root).count() == 0
    assert made.proofs.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == root).count() == 0


def test_awkward_rows_equal_sql(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=awkward(spark).withColumn("leaf", F.lit("clash")).withColumn("Tree", F.lit(1)))
    got = merkle.op13(spark, sf)
    same(got, connect(sf, documents=spark.read.parquet(sf + "/documents.parquet").toArrow()), merkle.OP13_SQL)


def test_one_document_is_its_own_root(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=spark.createDataFrame([(2, "Aé", None, None, 2)], DOCS))
    r = merkle.op13(spark, sf).first()
    assert r.leaf == r.subroot == r.root == h("1:2", "-", "-", "1:2", "3:Aé") and r.proof_sha256 == h("") and r.verified
