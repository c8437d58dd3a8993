"""Chat formatting by prefix-target expansion: one example per assistant turn, all earlier turns as its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read

# Control strings of the template. No '<' or '#' is left inside an escaped text, so neither string can occur there.
OPEN, CLOSE = "### ", "</turn>\n"
#: (plain, escaped), in the order of escaping; reading back goes the other way. A backslash is always the first of a pair.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _escaped(c, table=ESCAPES):
    for plain, safe in table:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _plain(c, table=ESCAPES):
    for plain, safe in reversed(table):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start, loss_end: a row per assistant turn, and a last one without loss
    (loss_start = loss_end) if a conversation doesn't end with one, so that every turn is in the conversation's last row.

    formatted is '### role: text</turn>\\n' of each turn up to the target, texts and roles escaped reversibly; the loss
    mask covers characters loss_start (from 0) to loss_end (exclusive), the target's text alone. Turns stand by turn,
    null first, equal turns by role and text; repeated rows stay. Null texts and roles are empty; rows without a
    conversation id form one conversation. Other columns are ignored. A conversation is put together in one task, as an
    example of it needs all of its turns.
    """
    head = F.concat(F.lit(OPEN), _escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", head.alias("head"), _escaped(F.col("text")).alias("body")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    last = F.size("ts")
    is_target = lambda i: F.element_at("ts", i)["role"] == target
    whole = whole.withColumn("at", F.filter(F.sequence(F.lit(1), last), lambda i: is_target(i) | (i == last)))
    one = whole.select("conv_id", "ts", F.posexplode("at").alias("example", "i"))
    before = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("i") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    here = F.element_at("ts", F.col("i"))
    one = one.select("conv_id", (F.col("example") + 1).alias("example"), F.concat(before, here["head"]).alias("lead"), here["body"].alias("body"), (here["role"] == target).alias("trains"))
    start = F.char_length("lead").cast("long")
    return one.select("conv_id", "example", F.concat("lead", "body", F.lit(CLOSE)).alias("formatted"), start.alias("loss_start"), (start + F.when(F.col("trains"), F.char_length("body")).otherwise(0)).alias("loss_end"))


def turns_of(formatted):
    """Reads a formatted text back: array of (role, text)."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    cut = lambda p: F.instr(p, ":")
    return F.transform(
        parts,
        lambda p: F.struct(
            _plain(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
            _plain(F.substring(p, cut(p) + 2, F.char_length(p))).alias("text"),
        ),
    )


def trained(formatted, start, end):
    """The text under the loss mask, unescaped."""
    return _plain(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation what the examples say when read back: of all turns, of the loss and the characters of all examples."""
    rows = made.withColumn("loss", trained(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    whole = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", turns_of(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "\\### Assistant: </turn> ok"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(examples(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)))


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) + 2
        + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 8 AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = count(*) OVER (PARTITION BY conv_id) AS is_last FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
