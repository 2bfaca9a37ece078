"""Bipartite projection: weighted co-occurrence edges (src < dst) from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(facts: DataFrame) -> DataFrame:
    """(paper_id, n, src, dst) for every pair of distinct authors of a paper; n counts its authors.

    One shuffle by paper: the pairs come from the paper's sorted author array, not from a self-join.
    """
    papers = facts.groupBy("paper_id").agg(F.array_sort(F.collect_set("author_id")).alias("a")).where(F.size("a") > 1)
    heads = papers.select("paper_id", F.size("a").alias("n"), "a", F.posexplode("a").alias("i", "src"))
    return heads.select("paper_id", "n", "src", F.explode(F.expr("slice(a, i + 2, n)")).alias("dst"))


def full(facts: DataFrame) -> DataFrame:
    """(src, dst, weight): the papers two authors share."""
    return pairs(facts).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def newman(facts: DataFrame) -> DataFrame:
    """(src, dst, weight): the sum over shared papers of 1 / (authors - 1)."""
    return pairs(facts).groupBy("src", "dst").agg(F.sum(1.0 / (F.col("n") - 1)).alias("weight"))


def newman_rows(facts: DataFrame) -> DataFrame:
    """Fractional weights where repeated rows count: an author listed m times has m places on the paper."""
    places = facts.groupBy("paper_id", "author_id").agg(F.count("*").alias("m"))
    papers = places.groupBy("paper_id").agg(F.sum("m").alias("n"), F.array_sort(F.collect_list(F.struct("author_id", "m"))).alias("a"))
    heads = papers.select("n", "a", F.posexplode("a").alias("i", "x")).select("n", "x", F.explode(F.expr("slice(a, i + 2, size(a))")).alias("y"))
    return heads.groupBy(F.col("x.author_id").alias("src"), F.col("y.author_id").alias("dst")).agg(F.sum(F.col("x.m") * F.col("y.m") / (F.col("n") - 1)).alias("weight"))


def paper_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("author_id").agg(F.countDistinct("paper_id").alias("papers"))


def jaccard(facts: DataFrame) -> DataFrame:
    """(src, dst, weight): shared papers over the papers of either."""
    count = paper_counts(facts)
    left = count.select(F.col("author_id").alias("src"), F.col("papers").alias("pu"))
    right = count.select(F.col("author_id").alias("dst"), F.col("papers").alias("pv"))
    shared = full(facts).join(left, "src").join(right, "dst")
    return shared.select("src", "dst", (F.col("weight") / (F.col("pu") + F.col("pv") - F.col("weight"))).alias("weight"))


def edge_years(facts: DataFrame) -> DataFrame:
    """(src, dst, weight, first_year, last_year, duration); a paper's year is its largest."""
    years = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    grown = pairs(facts).join(years, "paper_id").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return grown.withColumn("duration", F.col("last_year") - F.col("first_year"))
