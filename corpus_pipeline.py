"""The corpus pipeline: documents in, training mix out. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, langid, lines, mixing, nearjoin
from strata.llm.common import read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones and those without a letter (null and empty texts too) go.

    Null lang values teach nothing, and with no lang at all only texts without a letter go. Repeated rows are judged alike;
    a text of any length is judged whole. Other columns stay as they are; an empty table stays empty.
    """
    return langid.label_languages(docs, langid.train(docs.select("doc_id", "text", "lang"))).where("not rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate, n_chars counted anew; a document of which nothing is left goes.

    Documents that lose nothing stay as they are, null and empty texts among them. A null source counts as one site;
    repeated rows and ties keep a line in the document of smallest id. Other columns stay.
    """
    cleaned = lines.without_boilerplate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; equal texts are one class, and repeated rows leave one.

    Texts without a word (null and empty ones) are no one's duplicates and stay, once for each id. Other columns stay with the document kept.
    """
    return nearjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows go or stay together; items without words take nothing out, nor
    does an empty benchmark. Columns stay.
    """
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts have size 0.

    The null source is a source, the last by weight; repeated rows are drawn each for itself. Columns stay, and no rows give none.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: The first stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
