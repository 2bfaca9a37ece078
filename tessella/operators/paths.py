"""Hop distances by frontier joins, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import both_ways, degrees
from tessella.operators.ranking import beside
from tessella.session import cut


def hops(edges: DataFrame, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(source, id, d) for all nodes reached, d = 0 included; from every node unless sources(id) are given.

    Each round is one join of the frontier with the edges and one anti-join against what is known,
    checkpointed; the result has as many rows as there are pairs reached.
    """
    near = cut(both_ways(edges).select("id", "other").distinct())
    start = near.select("id").distinct() if sources is None else sources.select("id").distinct()
    found = frontier = cut(start.select(F.col("id").alias("source"), "id", F.lit(0).alias("d")))
    step = 0
    while limit is None or step < limit:
        step += 1
        new = frontier.join(near, "id").select("source", F.col("other").alias("id")).distinct()
        frontier = cut(new.join(found, ["source", "id"], "left_anti").withColumn("d", F.lit(step)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def closeness(edges: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """(id, closeness) scaled by the share of nodes reached."""
    d = hops(edges) if dist is None else dist
    n = degrees(edges).agg(F.count("*").alias("n"))
    sums = d.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("d").alias("s"))
    r = F.col("r") - 1
    return beside(sums, n).select("id", F.when(F.col("s") > 0, (r / F.col("s")) * (r / (F.col("n") - 1))).otherwise(0.0).alias("closeness"))


def path_summary(edges: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """(avg_path, diameter, efficiency): mean and largest hops over pairs reached; mean of 1/d over all ordered pairs."""
    d = (hops(edges) if dist is None else dist).where("d > 0")
    n = degrees(edges).agg(F.count("*").alias("n"))
    s = d.agg(F.avg("d").alias("avg_path"), F.max("d").cast("long").alias("diameter"), F.sum(1.0 / F.col("d")).alias("e"))
    return beside(s, n).select("avg_path", "diameter", (F.col("e") / (F.col("n") * (F.col("n") - 1))).alias("efficiency"))


def ego(edges: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """(seed, src, dst, weight): edges among the nodes within `radius` hops of each seed."""
    members = hops(edges, seeds, radius).select(F.col("source").alias("seed"), "id")
    left = edges.join(members.select("seed", F.col("id").alias("src")), "src")
    return left.join(members.select("seed", F.col("id").alias("dst")), ["seed", "dst"]).select("seed", "src", "dst", "weight")


def katz(edges: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """(id, katz) after fixed rounds of x = alpha A x + 1 from x = 1."""
    near = cut(both_ways(edges).select("id", "other"))
    x = near.select("id").distinct().withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        x = cut(near.join(x.withColumnRenamed("id", "other"), "other").groupBy("id").agg((1 + alpha * F.sum("x")).alias("x")))
    return x.withColumnRenamed("x", "katz")


def leader_rank(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, score): weighted LeaderRank with a ground node of weight 1 to every node, after fixed rounds, the ground's score shared out.

    Starts from 1 on nodes and 0 on the ground.
    """
    near = cut(both_ways(edges))
    out = cut(degrees(edges).select("id", (F.col("strength") + 1).alias("out"), F.lit(1.0).alias("x")))
    n, ground = out.count(), 0.0
    for _ in range(rounds):
        flow = near.join(out.select(F.col("id").alias("other"), (F.col("x") / F.col("out")).alias("f")), "other").groupBy("id").agg(F.sum(F.col("f") * F.col("weight")).alias("got"))
        back = out.agg(F.sum(F.col("x") / F.col("out")).alias("g")).first()["g"]
        out = cut(out.join(flow, "id", "left").select("id", "out", (F.coalesce("got", F.lit(0.0)) + ground / n).alias("x")))
        ground = float(back or 0.0)
    return out.select("id", (F.col("x") + ground / max(n, 1)).alias("score"))
