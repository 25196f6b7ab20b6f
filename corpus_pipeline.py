"""The corpus pipeline: documents through the stages below, each reading what the one before it kept.

Every stage takes null ids and texts, repeated ids and rows, empty tables and further columns, whatever their names, which it hands
on; rows are judged by their texts, an empty or null text like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscope.llm.common import staged, table
from sparkscope.llm.decontaminate import clean_documents
from sparkscope.llm.packing import pack
from sparkscope.llm.quality import good_documents
from sparkscope.llm.simhash import near_duplicates_removed
from sparkscope.llm.toxicity import not_toxic


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the trained field finds bad go. A null or empty text is one empty line; repeated rows share their fate; all stay if the labels have one kind only."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained trees find toxic go. A null or empty text has features of zero; repeated rows share their fate; without labels of both kinds the labels' mean decides."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest doc_id, nulls last, then fingerprint and hash of the text. Null and empty texts are a group; rows that share an id but not a group all stay."""
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go, whatever their id. Texts without words stay; without items all do."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is concatenated and cut into sequences; a row for each piece. A null or empty text is its end mark alone; every row is packed, repeated ones too; an empty table gives no pieces."""
    return pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Scores of trained models, XXH64 and a tokenizer have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
