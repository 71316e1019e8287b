"""The training-data pipeline: five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result and reads it back for the next stage. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe
from millrace.llm.common import table, written
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.line_dedup import drop_boilerplate
from millrace.llm.near_dups import keep_one_per_class
from millrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts stay; equal texts share their fate; an empty table
    gives no rows; without labels nothing goes.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go.

    No row goes; null and empty texts stay as they are; a null source is a
    source of its own.
    """
    return drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id.

    Null counts as an empty text, and a null id stands last; rows that repeat
    id and text are one. Texts of any length are signed whole; an empty table
    gives no rows.
    """
    return keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts stay; an empty benchmark removes nothing. Texts of any
    length are searched whole; repeated rows share their fate; an empty table
    gives no rows.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens; texts of any length are encoded whole;
    repeated rows and null ids stay; an empty table gives no rows.
    """
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY)))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the fitted model, the candidate search of near duplicates or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
