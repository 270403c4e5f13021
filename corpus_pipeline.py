"""A corpus pipeline: each stage applies one operator of gridscore.llm to all that the stage before it kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Nulls, empty texts, repeated
rows and empty tables are treated as the operators' docstrings say: documents without letters are rejected by the
first stage, so later ones rarely see them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.llm import langid, mixing, pieces, quality, simhash
from gridscore.llm.queries import quality_model
from gridscore.session import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a document's source stands for its host, its lang for the declared one."""
    return langid.accepted_only(docs, langid.fit_text(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than bad."""
    column = "score" + "_" * max(map(len, docs.columns))  # longer than any name there
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")), column=column)
    return scored.where(F.col(column) >= 0.5).drop(column)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, or not at all."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with whether they decode to its text."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("quality", quality_filter), ("simhash", near_dedup), ("mixing", mix), ("pieces", encode)]
#: The stages hash, compress and train, which SQL can't express; tests/llm holds posteriors, scores, links, targets and
#: segmentations against plain versions, and the stages against these operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
