"""The corpus pipeline: documents in, packed sequences out.

Each stage reads what the stage before kept. The classifiers learn from rows of labels that may be learnt from and whose
document is still there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import jaccard, packing, quality, toxicity
from tracewright.llm.queries import BYTE_VOCABULARY, prepared
from tracewright.llm.shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.with_quality(prepared(docs), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(prepared(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, of its repeated rows one."""
    return jaccard.without_copies(prepared(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens."""
    return packing.packed_documents(prepared(docs), BYTE_VOCABULARY)


STAGES = [("quality classifier", keep_quality), ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("best-fit packing", pack_sequences)]
#: The classifiers and the packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
