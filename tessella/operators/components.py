"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut


def _stars(both: DataFrame, larger_only: bool) -> DataFrame:
    """Point neighbours at the least label seen from each vertex.

    `both` holds (u, v). The minimum is a partial aggregate and the hand-out is an
    equi-join, so a hub's neighbours never meet in one task (AQE splits the hub).
    """
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k")).withColumn("m", F.least("m", "u"))
    if larger_only:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where(F.col("m") < F.col("k")).select(F.col("k").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") > F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex on an edge; a component is named by its least id.

    Null ends, self-loops, repeated and reversed edges are allowed; a null end drops the
    edge, and a vertex that has only self-loops is its own component. Rounds grow with the
    logarithm of the vertex count; each ends in a checkpoint.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    work = pairs.where("a > b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    before = _state(work)
    for _ in range(max_rounds):
        both = work.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = _tidy(_stars(both, larger_only=True))
        work = cut(_tidy(_stars(large, larger_only=False)))
        after = _state(work)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    loops = pairs.where("a = b").select(F.col("a").alias("id"))
    member = work.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = member.select(F.col("component").alias("id"), "component").distinct()
    found = member.unionByName(roots)
    alone = loops.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(alone)
