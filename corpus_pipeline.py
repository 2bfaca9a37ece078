"""The corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage takes what its predecessor kept; run() writes every stage out and goes on from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import linedup, nearjoin, packing, pii, quality
from tessella.llm.common import table
from tessella.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the filter's policy rejects go."""
    return quality.quality_filter(docs, quality.FILTER)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, those at the ratio too; its documents stay."""
    return linedup.drop_boilerplate(docs, margin=linedup.CHANCE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return nearjoin.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return pii.pseudonymise(docs, pii.session_key(spark)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows."""
    return packing.query(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures, surrogates and tokens can't be expressed in SQL; a brute-force run stands in for it in the tests.
ORACLE_SQL = None
