"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessella.llm import bpe, exact, linedup, nearjoin, packing, pii, quality, shard, toxicity, urlfilter
from tessella.llm.common import table


def _on(name: str, query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _on("documents", quality.query),
        "op2_ngram_jaccard_join": _on("documents", nearjoin.query),
        "op3_packing": _on("documents", packing.query),
        "op4_byte_bpe": _on("documents", bpe.query),
        "op5_url_filter": _on("pages", urlfilter.query),
        "op6_line_dedup": _on("documents", linedup.query),
        "op7_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op8_pii": _on("documents", pii.query),
        "op9_sharding": _on("documents", shard.query),
        "op10_exact_dedup": _on("documents", exact.query),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op6_line_dedup": linedup.ORACLE, "op10_exact_dedup": exact.ORACLE}
