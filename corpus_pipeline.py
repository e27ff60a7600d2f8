"""From documents to packed windows: language, boilerplate, near duplicates, source weights, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again before the next.
A stage begins with the executors' garbage collected: it does not start in the heap that the stages before grew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import jaccard, langid, linededup, mixing, packing
from framequarry.llm.common import collect_executors, scratch, table, written
from framequarry.llm.registry import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or far from every language, go."""
    collect_executors(spark)
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars follows the text.

    A line counts once for a group of near copies: those are left whole to the next stage.
    """
    collect_executors(spark)
    clean = linededup.drop_boilerplate(docs, one_of_each=jaccard.one_of_each)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id in each group of near duplicates."""
    collect_executors(spark)
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them: its source weights, at most three epochs."""
    collect_executors(spark)
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of at most 1024 tokens."""
    collect_executors(spark)
    return packing.pack(docs, tokenizer())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL cannot express the stages. Their operators are held against plain versions; of the stages themselves, tests hold lines and near duplicates on planted groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written; that of the stage before goes with the session
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
