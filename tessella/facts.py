"""The fact table (an author appears on a paper) and its views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_ids(facts: DataFrame) -> DataFrame:
    """Drop rows whose author or paper is null or blank."""
    blank = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in ("author_id", "paper_id")]
    return facts.where(~(blank[0] | blank[1]))


def dedup(facts: DataFrame, mode: str = "max") -> DataFrame:
    """One row per author and paper: `max` year and cites, the `first` by row_order, or `binary`; `none` keeps all."""
    keys = ["author_id", "paper_id"]
    if mode == "none":
        return facts
    if mode == "binary":
        return facts.select(*keys).distinct()
    if mode == "first":
        order = Window.partitionBy(*keys).orderBy("row_order")
        return facts.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return facts.groupBy(*keys).agg(F.max("year").alias("year"), F.max("times_cited").alias("times_cited"))


def authorships(spark: SparkSession, sf_dir: str, mode: str = "max") -> DataFrame:
    """Parts on orders as authors on papers: author_id, paper_id, year, times_cited."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("author_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("times_cited"))
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return dedup(facts.select("author_id", F.col("l_orderkey").cast("long").alias("paper_id"), "year", "times_cited"), mode)


def coactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the same minute as authors on a paper; the year is the day of the month."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("long").alias("author_id"), F.date_trunc("minute", "ts").alias("paper_id"), F.dayofmonth("ts").alias("year")).distinct()
