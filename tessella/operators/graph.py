"""Canonical undirected graphs as edges(src, dst, weight) and their filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.session import cut


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, weights summed; loops and weights that are null or not positive go."""
    edges = edges.where("src <> dst and weight > 0")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, weight) for either end."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.select("weight", ends.alias("e")).select("e.id", "e.other", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, strength)."""
    return both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    keep = nodes.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(both_ways(edges).select("id").distinct(), "id", "left_anti")


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; one without edges is its own component."""
    found = connected_components(edges)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the largest component; of equals the one with the least name."""
    labels = component_labels(nodes, edges)
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(top, "component", "left_semi").select("id")


def backbone(edges: DataFrame, tau: float = 0.1, rule: str = "or") -> DataFrame:
    """Disparity filter: alpha = (1 - w / s) ** (k - 1), and 0 at an end of degree 1; an edge stays if either (or both) of its ends has alpha < tau.

    So under "or" an edge to a leaf always stays; under "and" its other end decides. The edges
    are written out once, as their degrees and both ends are looked up in them.
    """
    edges = cut(edges)
    d = degrees(edges)
    met = edges
    for end in ("src", "dst"):
        alpha = F.when(F.col("degree") <= 1, 0.0).otherwise(F.pow(F.greatest(F.lit(0.0), 1 - F.col("weight") / F.col("strength")), F.col("degree") - 1))
        met = met.join(d.withColumnRenamed("id", end), end).withColumn(f"alpha_{end}", alpha).drop("degree", "strength")
    low = (F.col("alpha_src") < tau, F.col("alpha_dst") < tau)
    return met.where(low[0] | low[1] if rule == "or" else low[0] & low[1]).select(*edges.columns)


def least_papers(nodes: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Nodes with at least `least` papers by counts(id, papers)."""
    return nodes.join(counts.where(F.col("papers") >= least).select("id"), "id", "left_semi")


def whitelisted(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A slice's edges between nodes(id) of a global graph, and only those in pairs(src, dst) if given; isolates go with them."""
    kept = induced(edges, nodes)
    return kept if pairs is None else kept.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi").select(*edges.columns)


def largest_communities(partition: DataFrame, top: int | None = None, least: int = 1) -> DataFrame:
    """partition(id, label) cut to the `top` largest labels (of equals the least) of at least `least` members."""
    size = partition.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    if top is not None:
        size = size.orderBy(F.desc("size"), "label").limit(top)
    return partition.join(size, "label", "left_semi").select("id", "label")


def run_steps(nodes: DataFrame, edges: DataFrame, counts: DataFrame, steps: list[str], tau: float = 0.1, min_papers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Apply S1 (no isolates), S2 (largest component), S3 (backbone), S5 (least papers) in order; unknown names raise."""

    def step(state: tuple[DataFrame, DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
        v, e = state
        if name == "S5":
            v = least_papers(v, counts, min_papers)
            return v, induced(e, v)
        if name == "S3":
            e = backbone(e, tau)
            return v.join(both_ways(e).select("id").distinct(), "id", "left_semi"), e
        if name == "S2":
            v = largest_component(v, e)
            return v, induced(e, v)
        if name == "S1":
            return v.join(both_ways(e).select("id").distinct(), "id", "left_semi"), e
        raise ValueError(f"unknown step {name}")

    return reduce(step, steps, (nodes, edges))


def k_core(edges: DataFrame, k: int = 2) -> DataFrame:
    """The edges of the k-core, by rounds of pruning."""
    edges, before = cut(edges), -1
    while (now := edges.count()) != before:
        before = now
        edges = cut(induced(edges, degrees(edges).where(F.col("degree") >= k)))
    return edges
