"""Corpus pipeline: documents to packed training sequences, in four stages.

Each stage gets what the one before kept, as a table written and read again, and returns the columns of
``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm import jaccard_join, language_id, packing, quality_rules
from kinmesh.llm.common import discard, materialise, table

#: Least posterior probability of the predicted language.
LEAST_LANGUAGE_SCORE = 0.65
#: Least likeness to the training texts of that language (mean log probability of an n-gram, less theirs): documents in
#: other languages lie below it, whatever their length.
LEAST_LIKENESS = -2.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows are judged each by itself; other columns stay as they are."""
    return quality_rules.quality_rules(docs).filter("kept").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence, by a model of the labelled documents of this stage.

    Texts that are null or have no letter go, and all if no document names a language. Repeated rows are judged alike. Input columns named like a
    result of the model keep their own values.
    """
    results = ("lang_pred", "score", "likeness")
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]
    found = language_id.identify(docs.select(F.col("text"), *own), language_id.train(docs))
    lang, score, likeness = (F.col(c) for c in results)
    kept = found.filter((lang != language_id.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE) & (likeness >= LEAST_LIKENESS))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id. Texts without words all stay; of repeated rows one stays."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. Null texts are empty ones, of one token; repeated rows are packed each by itself."""
    return packing.pack(docs)


STAGES = [("quality_rules", keep_quality), ("language_id", keep_language), ("jaccard_join", keep_one_of_each), ("packing", pack)]

#: SQL expresses neither the models nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. What a stage wrote is deleted once the next has written; the last input stays, since the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
