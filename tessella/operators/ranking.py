"""Global positions, ranks and one-row totals without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """`df` with the columns of `totals`, a global aggregate: one row by construction, so it is broadcast."""
    return df.join(F.broadcast(totals), how="cross")


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add `position` (0 to n - 1 in `order`) and `n`.

    Rows are dealt by ranges of `order` and sorted where they lie; only the row count of each
    partition is gathered to shift the local numbers. `order` should end in a unique column.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    # The id holds the partition in its upper bits and the place in it in the lower 33.
    local = cut(local.withColumn("__part", F.shiftright("__row", 33)).withColumn("__at", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition: their number bounds this window and the broadcast.
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("n"))
    return local.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__at")).alias("position"), "n")


def ranks(df: DataFrame, value: str, key: str, ties: str = "min") -> DataFrame:
    """Add `rank` of `value`, ascending from 1; equal values share their least ("min") or mean ("average") rank."""
    placed = positions(df, value, key)
    same = placed.groupBy(value).agg(F.min("position").alias("__lo"), F.count("*").alias("__k"))
    rank = F.col("__lo") + 1 if ties == "min" else F.col("__lo") + 1 + (F.col("__k") - 1) / 2
    return placed.join(same, value).withColumn("rank", rank).select(*df.columns, "rank")
