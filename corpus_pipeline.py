"""A corpus pipeline over ``documents``: quality, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of ``documents``. Stages are written as Parquet to the shared folder and read again.

Defined results: null and empty texts are judged as texts without words and have no tokens; rows without a doc_id pass the
near-duplicate stage and are copied and encoded row by row; of repeated rows of one doc_id one stays at that stage; extra columns, whatever
their names, pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import bpe, cotraining, mixing, partenum, toxicity
from bitloom.llm.shared import give_back, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return cotraining.keep(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates stays."""
    return partenum.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the whole numbers of copies that bring the languages to their target weights."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with the digests of the ids and of what they decode to."""
    return bpe.digests(docs)


def _afresh(stage: Callable) -> Callable:
    """The stage, begun on executors that have given back what the stages before took: heaps that only grow add up."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _afresh(stage)) for name, stage in (("quality", quality), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", tokens))]

#: Classifiers are no SQL: ``tests/llm/test_pipeline.py`` holds each stage against brute force or its operator's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
