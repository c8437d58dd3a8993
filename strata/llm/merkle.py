"""Merkle manifest of a table: leaves in fixed-size ordered blocks whose levels collapse by higher-order functions, then the blocks' roots likewise."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, stored
from strata.operators.ranks import numbered

#: Children of a node.
FAN = 16
#: Levels that one row collapses: a block is an array of FAN ** LEVELS nodes, some 40 KB with what goes along.
LEVELS = 2
WIDTH = FAN**LEVELS

PATH = "array<struct<left:string,right:string>>"


def field(column: Column) -> Column:
    """'-' if null, else the count of UTF-8 bytes, ':' and the value, so that no two rows give one string."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof(path: Column) -> Column:
    """One string of all siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _div(a: Column, b: int) -> Column:
    return ((a - a % b) / b).cast("int")


def _up(nodes: Column) -> Column:
    """The next level: each run of FAN nodes, the last one shorter, becomes its hash."""
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, FAN))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _levels(n: Column) -> Column:
    """Levels that a block of a tree of n nodes has to collapse: LEVELS, fewer if fewer reach the top."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FAN**k, F.lit(k)).otherwise(out)
    return out


def _collapsed(nodes: Column, levels: Column) -> Column:
    """The node that a block of nodes becomes after so many levels."""
    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), levels)
    return F.aggregate(steps, nodes, lambda now, _: _up(now))[0]


def _step(nodes: Column, j: Column) -> Column:
    """What stands left and right of node j in its run."""
    at = j % FAN
    return F.struct(F.array_join(F.slice(nodes, j - at + 1, at), "").alias("left"), F.array_join(F.slice(nodes, j + 2, F.lit(FAN - 1) - at), "").alias("right"))


def _with_paths(members: Column, levels: Column, above: Column, subroot: Column) -> Column:
    """members (place, node, ...) with the path of each: its steps in the block, then the block's own path."""

    def paths(rows: list[Column]) -> Column:
        def one(m: Column, j: Column) -> Column:
            steps, at = [], j
            for nodes in rows:
                steps.append(_step(nodes, at))
                at = _div(at, FAN)
            return F.struct(m.alias("m"), F.concat(F.slice(F.array(*steps), F.lit(1), levels), above).alias("path"), subroot.alias("subroot"))

        return F.transform(members, one)

    def build(rows: list[Column]) -> Column:
        return paths(rows) if len(rows) == LEVELS else _let(_up(rows[-1]), lambda up: build([*rows, up]))

    return _let(F.transform(members, lambda m: m["node"]), lambda nodes: build([nodes]))


def _forest(nodes: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of every round, and each tree's top (tree, node). nodes: tree, place in it, n of it, node, carry."""
    rounds, now = [], nodes
    while True:
        block = F.floor(F.col("place") / WIDTH).cast("long").alias("block")
        held = now.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("place", "node", *(carry if not rounds else [])))).alias("members"))
        held = held.withColumn("node", _collapsed(F.transform("members", lambda m: m["node"]), _levels(F.col("n"))))
        held = stored(held, "merkle")
        rounds.append(held)
        now = held.select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), "node")
        if (held.agg(F.max("n")).first()[0] or 0) <= WIDTH:
            return rounds, now.select("tree", "node")


def _paths(rounds: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """tree, carry, node, path, subroot of the first round's nodes. tops: tree, path, subroot of each tree's top."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k, held in reversed(list(enumerate(rounds))):
        both = held.drop("node").join(above, ["tree", "block"])
        each = both.select("tree", F.explode(_with_paths(F.col("members"), _levels(F.col("n")), F.col("path"), F.col("subroot"))).alias("x"))
        if k == 0:
            return each.select("tree", *[F.col(f"x.m.{c}").alias(c) for c in carry], F.col("x.m.node").alias("node"), "x.path", "x.subroot")
        above = each.select("tree", F.col("x.m.place").alias("block"), "x.path", "x.subroot")


class Manifest(NamedTuple):
    """root: hash of the whole table, None if it is empty. subroots: group, subroot, n (leaves). proofs: group, carried columns, leaf, path, subroot."""

    root: str | None
    subroots: DataFrame
    proofs: DataFrame


def manifest(rows: DataFrame, group: str, order: str, leaf: str, carry: tuple[str, ...] = ()) -> Manifest:
    """Merkle tree over rows that hold their leaf (hex of a SHA-256): a tree for each group, and one over the groups' roots.

    In a group leaves ascend by `order` (null first), equal ones by leaf, so repeated rows are leaves of their own and
    their tree doesn't hang on how rows are dealt out. While a level has several nodes, every FAN consecutive ones become
    the hash of their digests in hex, the last run being shorter, even one. The null group is a group, the first; groups
    ascend bytewise. A table without rows has no root and no proofs. carry: further columns (of types that can be
    ordered) that come back with each proof; other columns are ignored, and no name can clash.

    Leaves are numbered by sorted ranges and gathered in blocks of WIDTH, so a group of any size is spread; a block is
    collapsed by sequence, transform, slice and aggregate. Blocks' roots are the nodes of the next round, until each
    group has one: rounds follow the logarithm of the largest group. Paths then come down the same blocks. Each round is a
    table in the shared folder.
    """
    names = [f"carry_{i}" for i in range(len(carry))]
    # A key that orders as the group does and is never null.
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("tree")
    flat = stored(rows.select(key, F.col(order).alias("by"), F.col(leaf).alias("node"), *[F.col(c).alias(a) for c, a in zip(carry, names)]), "leaves")
    rounds, tops = _forest(numbered(flat, "place", "by", "node", within=("tree",), total="n"), names)
    # The tree over the groups carries each group's key down with the path.
    over, last = _forest(numbered(tops, "place", "tree", total="n").select(F.lit("").alias("tree"), "place", "n", "node", F.col("tree").alias("of")), ["of"])
    found = last.first()
    root = found["node"] if found else None
    start = last.select("tree", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit("").alias("subroot"))
    upper = stored(_paths(over, start, ["of"]).select(F.col("of").alias("tree"), "path", F.col("node").alias("subroot")), "subroots")
    back = F.when(F.col("tree") != "0", F.substring("tree", 2, 2**31 - 1)).alias(group)
    sizes = rounds[0].groupBy("tree").agg(F.max("n").alias("n"))
    proofs = _paths(rounds, upper, names)
    fields = {group: back} | {c: F.col(a) for c, a in zip(carry, names)} | {"leaf": F.col("node"), "path": F.col("path"), "subroot": F.col("subroot")}
    return Manifest(root, upper.join(sizes, "tree").select(back, "subroot", "n"), proofs.select(*[c.alias(n) for n, c in fields.items()]))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, and whether the root stands after every fifth text was tampered with."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    changed = [F.translate(c, UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    rows = docs.select("doc_id", "source", leaf_of(*map(F.col, COLUMNS)).alias("leaf"), F.when(tampered, leaf_of(*changed)).alias("seen"))
    made = manifest(rows, "source", "doc_id", "leaf", ("doc_id", "seen"))
    root = F.lit(made.root).cast("string")
    out = made.proofs.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("seen", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
d0 AS (SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS name, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d1 AS (SELECT doc_id, source, text, low,
         coalesce(name IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 5 = 0, false) AS bad,
         coalesce(octet_length(encode(name)) || ':' || name, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
           || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
       FROM d0, crc),
d AS (SELECT row_number() OVER () AS k, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(octet_length(encode(CASE WHEN bad THEN low ELSE text END)) || ':' || CASE WHEN bad THEN low ELSE text END, '-')) AS seen FROM d1),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT s, 0 AS lvl, pos, n, leaf AS node FROM p
      UNION ALL SELECT s, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY s, lvl, pos // 16, n),
sub AS (SELECT s, node AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, s AS pos, count(*) OVER () AS n, subroot AS node FROM sub
      UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
top AS (SELECT node AS root FROM u WHERE n = 1),
every AS (SELECT s AS tree, lvl, pos, node FROM t WHERE n > 1 UNION ALL SELECT -1, lvl, pos, node FROM u WHERE n > 1),
side AS (SELECT tree, lvl, pos, coalesce(string_agg(node, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(node, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM every),
walk AS (SELECT k, s AS tree, 0 AS lvl, pos, s, seen AS node, '' AS proof FROM p
      UNION ALL SELECT w.k, CASE WHEN x.tree IS NULL THEN -1 ELSE w.tree END, CASE WHEN x.tree IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN x.tree IS NULL THEN w.s ELSE w.pos // 16 END, w.s,
           CASE WHEN x.tree IS NULL THEN w.node ELSE sha256(x.l || w.node || x.r) END, CASE WHEN x.tree IS NULL THEN w.proof ELSE w.proof || x.l || x.r END
         FROM walk w LEFT JOIN side x ON x.tree = w.tree AND x.lvl = w.lvl AND x.pos = w.pos WHERE x.tree IS NOT NULL OR w.tree <> -1),
fin AS (SELECT k, arg_max(node, length(proof) * 2 + CAST(tree = -1 AS INTEGER)) AS folded_root, arg_max(proof, length(proof)) AS proof FROM walk GROUP BY k)
SELECT p.doc_id, p.leaf, sub.subroot, top.root, sha256(fin.proof) AS proof_sha256, fin.folded_root, fin.folded_root = top.root AS verified
FROM p JOIN sub USING (s) JOIN fin USING (k), top
"""
