"""Year slices and how a network grows over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.operators.graph import both_ways
from tessella.operators.project import pairs
from tessella.operators.twins import Graph, Twins, _ranges, _starts, collapse, contracted, dealt, load
from tessella.session import cut


def slices(start: int, end: int, mode: str = "disjoint", size: int = 5, shift: int = 1, partial: str = "clip") -> list[tuple[int | None, int]]:
    """(first, last) years: disjoint (the last one clipped or dropped), sliding (whole ones only), cumulative or full.

    A cumulative slice has no first year (None): it holds all years up to its last, unknown ones (0) too.
    """
    if mode == "disjoint":
        found = [(y, min(y + size - 1, end)) for y in range(start, end + 1, size)]
        return [s for s in found if partial == "clip" or s[1] - s[0] + 1 == size]
    if mode == "sliding":
        return [(y, y + size - 1) for y in range(start, end - size + 2, shift)]
    if mode == "cumulative":
        return [(None, y) for y in range(start + size - 1, end + 1, shift)]
    if mode == "full":
        return [(start, end)]
    raise ValueError(f"unknown mode {mode}")


def sliced(facts: DataFrame, found: list[tuple[int | None, int]]) -> DataFrame:
    """Facts once per slice (first_year, last_year) that holds their year.

    The slices are a literal array that each row filters and explodes, so nothing is joined or shuffled.
    """
    all_slices = F.array(*[F.struct(F.lit(a).cast("int").alias("first_year"), F.lit(b).cast("int").alias("last_year")) for a, b in found])
    holds = lambda s: (F.col("year") <= s["last_year"]) & (s["first_year"].isNull() | (F.col("year") >= s["first_year"]))
    return facts.withColumn("__s", F.explode(F.filter(all_slices, holds))).select(*facts.columns, "__s.first_year", "__s.last_year")


def cumulative_sizes(facts: DataFrame) -> DataFrame:
    """(year, new_nodes, new_edges, nodes, edges): first appearances of authors with a pair, and of pairs, summed up."""
    years = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    e = pairs(facts).join(years, "paper_id").groupBy("src", "dst").agg(F.min("year").alias("year"))
    v = e.select("year", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.min("year").alias("year"))
    n = e.groupBy("year").agg(F.count("*").alias("new_edges")).join(v.groupBy("year").agg(F.count("*").alias("new_nodes")), "year", "left").na.fill(0)
    run = Window.partitionBy().orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("year", "new_nodes", "new_edges", F.sum("new_nodes").over(run).alias("nodes"), F.sum("new_edges").over(run).alias("edges"))


def yearly_edges(facts: DataFrame) -> DataFrame:
    """(year, src, dst): the pairs active in a year."""
    years = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    return pairs(facts).join(years, "paper_id").select("year", "src", "dst").distinct()


def active_jaccard(facts: DataFrame) -> DataFrame:
    """(year, nodes, edges, node_jaccard, edge_jaccard): overlap of a year's active graph with the year before; null without one."""

    def overlap(items: DataFrame, keys: list[str], name: str) -> DataFrame:
        seen = items.select("year", *keys).distinct()
        again = seen.join(seen.select((F.col("year") + 1).alias("year"), *keys), ["year", *keys], "left_semi").groupBy("year").agg(F.count("*").alias("common"))
        n = seen.groupBy("year").agg(F.count("*").alias(name))
        before = n.select((F.col("year") + 1).alias("year"), F.col(name).alias("before"))
        met = n.join(before, "year", "left").join(again, "year", "left")
        c = F.coalesce("common", F.lit(0))
        return met.select("year", name, F.round(c / (F.col(name) + F.col("before") - c), 6).alias(name[:-1] + "_jaccard"))

    e = yearly_edges(facts)
    v = e.select("year", F.explode(F.array("src", "dst")).alias("id"))
    return overlap(v, ["id"], "nodes").join(overlap(e, ["src", "dst"], "edges"), "year")


def annual_average_degree(facts: DataFrame) -> DataFrame:
    """(year, avg_degree): 2E / N of the year's active graph."""
    e = yearly_edges(facts)
    n = e.select("year", F.explode(F.array("src", "dst")).alias("id")).groupBy("year").agg(F.countDistinct("id").alias("n"))
    return e.groupBy("year").agg(F.count("*").alias("m")).join(n, "year").select("year", F.round(2 * F.col("m") / F.col("n"), 6).alias("avg_degree"))


KINDS = ("repeated", "intra_component", "merge", "growth", "new_cluster")


def classify_slices(facts: DataFrame) -> DataFrame:
    """(year, kind, n): every year's pairs against all before: repeated, intra_component, merge, growth, new_cluster.

    Authors of the same papers are one class (`twins`), whose pairs with another class share
    their kind and count together; a class of several authors is paired with itself. Tasks form
    the pairs of some classes at a time from the papers and write counts only; what is connected
    before each year is found from the papers on the driver. Years are slices, so their number is small.
    """
    found = collapse(facts)
    graph = load(found, facts.groupBy("paper_id").agg(F.max("year").cast("long").alias("year")))
    if graph is None:
        return _classified_by_links(facts, found)
    years, slot = np.unique(graph.years, return_inverse=True)
    labels = _histories(graph, slot, len(years))

    def kernel(g: Graph, lo: int, hi: int) -> dict:
        counts = np.zeros(len(years) * len(KINDS), np.int64)
        (a, b), k = g.part(lo), len(years)
        for x, y in g.panels(lo, hi):
            row, to, paper = g.met(x, y)
            keep = (row + x < to) | ((row + x == to) & (g.size[to] > 1))
            key = np.unique((row[keep] * (b - a) + to[keep] - a) * k + slot[paper[keep]])
            pair, year = key // k, key % k
            u, v, new = x + pair // (b - a), a + pair % (b - a), np.diff(pair, prepend=-1) != 0
            c1, c2 = labels[year, u], labels[year, v]
            kind = np.select([~new, (c1 >= 0) & (c1 == c2), (c1 >= 0) & (c2 >= 0), (c1 >= 0) | (c2 >= 0)], [0, 1, 2, 3], 4)
            n = np.where(u == v, g.size[u] * (g.size[u] - 1) // 2, g.size[u] * g.size[v])
            counts += np.bincount(year * len(KINDS) + kind, n, minlength=len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        return {"year": years[at // len(KINDS)], "kind": np.array(KINDS, object)[at % len(KINDS)], "n": counts[at]}

    rows = dealt(facts.sparkSession, graph, kernel, "year long, kind string, n long")
    return rows.groupBy(F.col("year").cast(facts.schema["year"].dataType).alias("year"), "kind").agg(F.sum("n").alias("n"))


def _histories(g: Graph, slot: np.ndarray, years: int) -> np.ndarray:
    """Per year, each class's part in the network of the years before, -1 outside."""
    label, seen, out = np.arange(g.n, dtype=np.int32), np.zeros(g.n, bool), np.full((years, g.n), -1, np.int32)
    shared = g.per_paper(g.size) > 1
    for k in range(years):
        out[k, seen] = label[seen]
        paper = np.flatnonzero((slot == k) & shared)
        n = g.heads[paper + 1] - g.heads[paper]
        member = g.member[_ranges(g.heads[paper], n)]
        label = contracted(label, member, _starts(n))
        seen[member] = True
    return out


def _classified_by_links(facts: DataFrame, found: Twins) -> DataFrame:
    """`classify_slices` where the papers are too many for one worker.

    The histories of all years are contracted together, as components over (year, id): an author is
    tied to the first one of each paper, from the year after it on.
    """
    papers = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    size = found.classes.select(F.col("rep").alias("author_id"), "size")
    dated = cut(found.facts.join(papers, "paper_id").join(size, "author_id"))
    loops = dated.where("size > 1").select("year", F.col("author_id").alias("src"), F.col("author_id").alias("dst")).distinct()
    e = cut(yearly_edges(dated).unionByName(loops))
    first = cut(e.groupBy("src", "dst").agg(F.min("year").alias("first")))
    years = sorted(r["year"] for r in e.select("year").distinct().collect())
    if not years:
        return e.select("year", F.lit("").alias("kind"), F.lit(0).cast("long").alias("n"))
    heads = dated.groupBy("paper_id").agg(F.min("author_id").alias("src"))
    ties = dated.join(heads, "paper_id").where("author_id <> src or size > 1").groupBy("src", F.col("author_id").alias("dst")).agg(F.min("year").alias("first"))
    later = F.filter(F.array(*[F.lit(y) for y in years]), lambda y: y > F.col("first"))
    old = ties.select("src", "dst", F.explode(later).alias("year"))
    at = lambda end: F.struct("year", F.col(end).alias("id"))
    labels = connected_components(old.select(at("src").alias("src"), at("dst").alias("dst"))).select("id.year", "id.id", F.col("component.id").alias("component"))
    met = e.join(first, ["src", "dst"])
    for end, name in (("src", "c1"), ("dst", "c2")):
        met = met.join(labels.select("year", F.col("id").alias(end), F.col("component").alias(name)), ["year", end], "left")
        met = met.join(size.select(F.col("author_id").alias(end), F.col("size").alias(f"n_{end}")), end)
    kind = F.when(F.col("first") < F.col("year"), "repeated").when(F.col("c1") == F.col("c2"), "intra_component").when(F.col("c1").isNotNull() & F.col("c2").isNotNull(), "merge").when(F.coalesce("c1", "c2").isNotNull(), "growth").otherwise("new_cluster")
    pairs_ = F.when(F.col("src") == F.col("dst"), F.expr("n_src * (n_src - 1) div 2")).otherwise(F.col("n_src") * F.col("n_dst"))
    return met.groupBy("year", kind.alias("kind")).agg(F.sum(pairs_).alias("n"))


def intervals(facts: DataFrame) -> DataFrame:
    """(author_id, first_year, last_year) of authors with a pair."""
    return both_ways(yearly_edges(facts).withColumn("weight", F.lit(1)).select("src", "dst", F.col("year").alias("weight"))).groupBy(F.col("id").alias("author_id")).agg(F.min("weight").alias("first_year"), F.max("weight").alias("last_year"))


def tracker(facts: DataFrame) -> DataFrame:
    """(src, dst, first_year, last_year, years, weight): the years a pair was active in, and its fractional weights of all years summed (4 places).

    A paper belongs to its latest year, so a pair's yearly weights add up to its weight over all papers.
    """
    per = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    each = pairs(facts).join(per, "paper_id").groupBy("src", "dst", "year").agg(F.sum(1.0 / (F.col("n") - 1)).alias("w"))
    return each.groupBy("src", "dst").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("years"), F.round(F.sum("w"), 4).alias("weight"))


def membership(first_years: DataFrame, networks: dict[str, DataFrame]) -> DataFrame:
    """(id, first_year, degree_<network>.., membership): degrees (0 outside), and the last network in the given order that holds the node.

    first_years has (id, first_year); a node in none is "outside". Degrees of wider networks are at least those of narrower ones.
    """
    out = first_years
    for name, degrees_ in networks.items():
        out = out.join(degrees_.select("id", F.col("degree").alias(f"degree_{name}")), "id", "left")
    out = out.na.fill(0, [f"degree_{n}" for n in networks])
    label = F.lit("outside")
    for name in networks:
        label = F.when(F.col(f"degree_{name}") > 0, name).otherwise(label)
    names = list(networks)
    wide = {f"degree_{n}": F.greatest(*[F.col(f"degree_{m}") for m in names[k:]]) if k < len(names) - 1 else F.col(f"degree_{n}") for k, n in enumerate(names)}
    return out.withColumn("membership", label).withColumns(wide)


def cumulative_degrees(facts: DataFrame, years: list[int]) -> DataFrame:
    """(year, nodes, edges, avg_degree, density): the network of all papers up to each year, all in one pass over the pairs' first years."""
    per = facts.groupBy("paper_id").agg(F.max("year").alias("year"))
    first = pairs(facts).join(per, "paper_id").groupBy("src", "dst").agg(F.min("year").alias("first"))
    nodes = first.select("first", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.min("first").alias("first"))
    # Counts per first year are as many as there are years; each later year adds them up.
    later = F.explode(F.filter(F.array(*[F.lit(y) for y in years]), lambda y: y >= F.col("first"))).alias("year")
    n = nodes.groupBy("first").agg(F.count("*").alias("n")).select("n", later).groupBy("year").agg(F.sum("n").alias("nodes"))
    m = first.groupBy("first").agg(F.count("*").alias("n")).select("n", later).groupBy("year").agg(F.sum("n").alias("edges"))
    return n.join(m, "year").select("year", "nodes", "edges", (2 * F.col("edges") / F.col("nodes")).alias("avg_degree"), (2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"))
