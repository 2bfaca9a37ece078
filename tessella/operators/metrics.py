"""Structural statistics of a weighted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import both_ways, degrees
from tessella.operators.ranking import beside
from tessella.session import cut


def summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, average degree and strength over nodes with an edge."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.sum("strength").alias("s"))
    n = F.col("nodes")
    return d.select("nodes", "edges", (2 * F.col("edges") / (n * (n - 1))).alias("density"), (2 * F.col("edges") / n).alias("avg_degree"), (F.col("s") / n).alias("avg_strength"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, n, p)."""
    n = degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def power_law(edges: DataFrame, least: int = 1) -> DataFrame:
    """(alpha, r2) of a line through ln k and ln count."""
    n = degrees(edges).where(F.col("degree") >= least).groupBy("degree").agg(F.count("*").alias("n"))
    x, y = F.log("degree"), F.log("n")
    return n.agg((-F.regr_slope(y, x)).alias("alpha"), F.regr_r2(y, x).alias("r2"))


def hhi(edges: DataFrame) -> DataFrame:
    """Mean over nodes of the sum of squared shares of strength."""
    s = degrees(edges).select("id", "strength")
    each = both_ways(edges).join(s, "id").groupBy("id").agg(F.sum(F.pow(F.col("weight") / F.col("strength"), F.lit(2))).alias("h"))
    return each.agg(F.avg("h").alias("hhi"))


def structural_entropy(edges: DataFrame, delta: float = 0.0) -> DataFrame:
    """Entropy of importance (k + 1)(1 - p(k) + delta), and over ln N; nulls if every importance is 0."""
    d = degree_distribution(edges).withColumn("raw", (F.col("degree") + 1) * (1 - F.col("p") + delta))
    total = F.sum(F.col("raw") * F.col("n"))
    t = d.agg(F.when(total > 0, total).alias("t"), F.sum("n").alias("nodes"))
    e = beside(d, t).withColumn("i", F.col("raw") / F.col("t"))
    h = -F.sum(F.when(F.col("i") > 0, F.col("n") * F.col("i") * F.log("i")).otherwise(F.lit(0.0)))
    return e.agg(h.alias("entropy"), (h / F.log(F.first("nodes"))).alias("entropy_norm"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at the ends of edges, both ways; null if all degrees are equal."""
    d = degrees(edges).select("id", "degree")
    ends = both_ways(edges).join(d, "id").join(d.select(F.col("id").alias("other"), F.col("degree").alias("d2")), "other")
    return ends.agg(F.try_divide(F.covar_pop("degree", "d2"), F.stddev_pop("degree") * F.stddev_pop("d2")).alias("assortativity"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a before b before c in the order of degree: wedges only at the end of lower degree."""
    d = degrees(edges).select("id", "degree")
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst")
    first = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    o = e.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b"))
    low, high = F.least("b", "b2"), F.greatest("b", "b2")
    wedges = o.join(o.select("a", F.col("b").alias("b2")), "a").where("b < b2").select("a", low.alias("src"), high.alias("dst"))
    return wedges.join(edges.select("src", "dst"), ["src", "dst"]).select("a", F.col("src").alias("b"), F.col("dst").alias("c"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering); 0 below two neighbours."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = degrees(edges).join(t, "id", "left").select("id", "degree", F.coalesce("t", F.lit(0)).alias("triangles"))
    return d.withColumn("clustering", F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def transitivity(edges: DataFrame) -> DataFrame:
    c = local_clustering(edges)
    return c.agg((2 * F.sum("triangles") / F.sum(F.col("degree") * (F.col("degree") - 1))).alias("transitivity"), F.avg("clustering").alias("avg_clustering"))


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """(degree, knn): mean over the nodes of a degree of their neighbours' mean degree."""
    d = degrees(edges).select("id", "degree")
    near = both_ways(edges).join(d.select(F.col("id").alias("other"), F.col("degree").alias("d2")), "other").groupBy("id").agg(F.avg("d2").alias("m"))
    return near.join(d, "id").groupBy("degree").agg(F.avg("m").alias("knn"))


def edge_overlap(edges: DataFrame) -> DataFrame:
    """(src, dst, overlap): common neighbours over all others of either end; 0 if there are none."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("e"))
    common = sides.groupBy("e.src", "e.dst").agg(F.count("*").alias("common"))
    d = degrees(edges).select("id", "degree")
    e = edges.select("src", "dst").join(common, ["src", "dst"], "left").join(d.select(F.col("id").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst")
    c = F.coalesce("common", F.lit(0))
    union = F.col("d1") - 1 + F.col("d2") - 1 - c
    return e.select("src", "dst", F.when(union > 0, c / union).otherwise(0.0).alias("overlap"))


def centralisation(edges: DataFrame) -> DataFrame:
    """Freeman centralisation of degree, and the relative one of strength."""
    d = degrees(edges).agg(F.count("*").alias("n"), F.max("degree").alias("k"), F.sum("degree").alias("sk"), F.max("strength").alias("s"), F.sum("strength").alias("ss"))
    n = F.col("n")
    return d.select(((n * F.col("k") - F.col("sk")) / ((n - 1) * (n - 2))).alias("degree_centralisation"), ((n - F.col("ss") / F.col("s")) / (n - 1)).alias("strength_centralisation"))


def joint_degrees(edges: DataFrame) -> DataFrame:
    """(k1, k2, p) with k1 <= k2: share of edges between degrees."""
    d = degrees(edges).select("id", "degree")
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d2")), "dst")
    n = e.groupBy(F.least("d1", "d2").alias("k1"), F.greatest("d1", "d2").alias("k2")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def constraint(edges: DataFrame) -> DataFrame:
    """(id, constraint): Burt's constraint, the sum over neighbours of (p_ij + sum_q p_iq p_qj) squared.

    A two-path i, q, j only counts where i and j are tied as well, so the sums run over the
    triangles, each of which gives one product to either direction of its three sides.
    """
    edges = cut(edges)
    s = degrees(edges).select("id", "strength")
    ends = edges.join(s.withColumnsRenamed({"id": "src", "strength": "s1"}), "src").join(s.withColumnsRenamed({"id": "dst", "strength": "s2"}), "dst")
    p = ends.select("src", "dst", (F.col("weight") / F.col("s1")).alias("out"), (F.col("weight") / F.col("s2")).alias("back"))
    t = triangles(edges).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    t = t.select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))
    for one, two in ("xy", "xz", "yz"):
        side = p.select(F.col("src").alias(one), F.col("dst").alias(two), F.col("out").alias(one + two), F.col("back").alias(two + one))
        t = t.join(side, [one, two])
    through = [(i, j, q) for i in "xyz" for j in "xyz" for q in "xyz" if len({i, j, q}) == 3]
    via = t.select(F.explode(F.array(*[F.struct(F.col(i).alias("id"), F.col(j).alias("other"), (F.col(i + q) * F.col(q + j)).alias("v")) for i, j, q in through])).alias("e"))
    via = via.groupBy("e.id", "e.other").agg(F.sum("e.v").alias("via"))
    both = p.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("out").alias("p")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.col("back").alias("p")))).alias("e")).select("e.*")
    return both.join(via, ["id", "other"], "left").groupBy("id").agg(F.sum(F.pow(F.col("p") + F.coalesce("via", F.lit(0.0)), F.lit(2))).alias("constraint"))


def effective_size(edges: DataFrame) -> DataFrame:
    """(id, effective_size): k - 2t / k with t ties among the neighbours."""
    return local_clustering(edges).select("id", (F.col("degree") - 2 * F.col("triangles") / F.col("degree")).alias("effective_size"))


def log_binned_pdf(edges: DataFrame, per_decade: int = 10) -> DataFrame:
    """(bin, n, density): nodes by logarithmic degree bin, over all nodes and the bin's width."""
    n = degrees(edges).groupBy(F.floor(F.log10(F.col("degree").cast("double")) * per_decade + 1e-9).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    width = F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade) - F.pow(F.lit(10.0), F.col("bin") / per_decade)
    return beside(n, n.agg(F.sum("n").alias("all"))).select("bin", "n", (F.col("n") / (F.col("all") * width)).alias("density"))


def power_law_binned(edges: DataFrame, least: int = 5) -> DataFrame:
    """(alpha, r2): a line through log bin centres and the bins' mean frequencies, to which every node gives its own degree's count."""
    c = degrees(edges).where(F.col("degree") >= least).groupBy("degree").agg(F.count("*").alias("f"))
    b = F.floor(F.log(F.col("degree") / float(least)) / F.log(F.lit(10**0.1)) + 1e-9)
    y = c.groupBy(b.alias("bin")).agg((F.sum(F.col("f") * F.col("f")) / F.sum("f")).alias("y"))
    at = (F.col("bin") + 0.5) / 10
    return y.agg((-F.regr_slope(F.log10("y"), at)).alias("alpha"), F.regr_r2(F.log10("y"), at).alias("r2"))


def rich_club(edges: DataFrame) -> DataFrame:
    """(k, nodes, edges, phi): for every degree that some node exceeds, the nodes above it and the density of ties among them.

    An edge counts for all k below its lower end: both are running sums over distinct degrees.
    """
    d = degrees(edges).select("id", "degree")
    ends = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
    low = ends.groupBy(F.least("a", "b").alias("k")).agg(F.count("*").alias("m"))
    n = d.groupBy(F.col("degree").alias("k")).agg(F.count("*").alias("n")).join(low, "k", "left").na.fill(0, ["m"])
    # A row per distinct degree, which are few beside the nodes.
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    run = n.select("k", F.sum("n").over(above).alias("nodes"), F.sum("m").over(above).alias("edges")).where("nodes is not null")
    return run.withColumn("phi", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))))


def freeman(scores: DataFrame, column: str) -> DataFrame:
    """(n, centralisation) of normalised closeness or betweenness, 1 for a star; null below three nodes.

    `scores` holds one row per node; `column`, "closeness" or "betweenness", names the score and
    with it the largest sum of gaps to the maximum that a graph of n nodes can have.
    """
    n = F.col("n")
    most = {"closeness": (n - 1) * (n - 2) / (2 * n - 3), "betweenness": n - 1}[column]
    out = scores.agg(F.count("*").alias("n"), F.max(column).alias("top"), F.sum(column).alias("sum"))
    return out.select("n", F.when(n > 2, (n * F.col("top") - F.col("sum")) / most).alias("centralisation"))
