"""Readers and writers of facts, edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}


def read_any(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A table by the suffix of its path; CSV columns are strings. Unknown suffixes raise."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    if FORMATS[suffix] != "csv":
        return spark.read.format(FORMATS[suffix]).load(path)
    df = spark.read.options(header=True, encoding=encoding, sep="\t" if suffix == "tsv" else ",", multiLine=True, escape='"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def resolve(df: DataFrame, *candidates: str) -> str:
    """The first column that one of the candidates names, whatever its case; KeyError if there is none."""
    have = {c.strip().lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in have:
            return have[name.lower()]
    raise KeyError(f"none of {candidates} in {df.columns}")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """author_id, paper_id, year, times_cited from a table of strings; unreadable numbers are 0, blank ids go."""
    df = read_any(spark, path)
    number = lambda *names: F.coalesce(F.col(resolve(df, *names)).try_cast("double").cast("int"), F.lit(0))
    out = df.select(F.col(resolve(df, "author_id")).alias("author_id"), F.col(resolve(df, "paper_id")).alias("paper_id"), number("publication_year", "year", "py").alias("year"), number("times_cited", "tc", "cites").alias("times_cited"))
    return out.where("trim(author_id) <> '' and trim(paper_id) <> ''")


def union_folder(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """One row per key: the first non-empty value of every column over the files in order; missing columns are null."""
    frames = [read_any(spark, p).withColumn("__order", F.lit(k)) for k, p in enumerate(paths)]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (key, "__order")]
    first = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), F.col("__order"))).alias(c)
    return whole.groupBy(key).agg(*[first(c) for c in rest])


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Edges as parquet, csv or json files."""
    writer = edges.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
