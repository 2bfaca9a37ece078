"""Statistics of a graph under a given partition(id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import both_ways
from tessella.operators.ranking import beside


def labelled(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, other, weight, label, label2): both ways, with the labels of either end."""
    return both_ways(edges).join(partition, "id").join(partition.select(F.col("id").alias("other"), F.col("label").alias("label2")), "other")


def ei_index(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(label, ei, mean_ei): (external - internal) / all ends of a community, and the mean of its members' own."""
    each = labelled(edges, partition).groupBy("label", "id").agg(F.count_if(F.col("label") != F.col("label2")).alias("e"), F.count_if(F.col("label") == F.col("label2")).alias("i"))
    own = (F.col("e") - F.col("i")) / (F.col("e") + F.col("i"))
    return each.groupBy("label").agg(((F.sum("e") - F.sum("i")) / (F.sum("e") + F.sum("i"))).alias("ei"), F.avg(own).alias("mean_ei"))


def participation(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, label, internal, p, z): participation over labels, and the z-score of the strength inside the own one (0 if it doesn't vary)."""
    to = labelled(edges, partition).groupBy("id", "label", "label2").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("id"))
    each = to.withColumn("share", F.col("w") / total).groupBy("id", "label").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("p"), F.coalesce(F.sum(F.when(F.col("label") == F.col("label2"), F.col("w"))), F.lit(0)).alias("internal"))
    return scored(each)


def scored(each: DataFrame) -> DataFrame:
    """(id, label, internal, p) with the z-score of internal inside the label, 0 if it doesn't vary."""
    own = each.groupBy("label").agg(F.avg("internal").alias("m"), F.stddev_pop("internal").alias("sd"))
    return each.join(own, "label").select("id", "label", "internal", "p", F.when(F.col("sd") > 0, (F.col("internal") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))


def roles(parts: DataFrame) -> DataFrame:
    """Add the seven cartographic roles by (z, p)."""
    z, p = F.col("z"), F.col("p")
    low = F.when(p <= 0.05, "ultra_peripheral").when(p <= 0.62, "peripheral").when(p <= 0.80, "connector").otherwise("kinless")
    high = F.when(p <= 0.30, "provincial_hub").when(p <= 0.75, "connector_hub").otherwise("kinless_hub")
    return parts.withColumn("role", F.when(z < 2.5, low).otherwise(high))


def block_matrix(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(label, label2, weight): symmetric; inside a block every edge counts once."""
    w = labelled(edges, partition)
    return w.groupBy("label", "label2").agg(F.sum("weight").alias("w")).select("label", "label2", F.when(F.col("label") == F.col("label2"), F.col("w") / 2).otherwise(F.col("w")).cast("double").alias("weight"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(q): weighted modularity of the partition."""
    w = labelled(edges, partition)
    per = w.groupBy("label").agg(F.sum(F.when(F.col("label") == F.col("label2"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("deg"))
    total = F.sum("deg").over(Window.partitionBy())
    return per.select((F.col("inside") / total - F.pow(F.col("deg") / total, F.lit(2))).alias("q")).agg(F.sum("q").alias("q"))


def tf_idf(terms: DataFrame, k: int = 6) -> DataFrame:
    """(label, term, n, score, rank): the k best terms of each community from (label, term); idf = ln(N / (df + 1)) + 1."""
    n = terms.groupBy("label", "term").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("label"))
    df = F.count("*").over(Window.partitionBy("term"))
    scored = beside(n.withColumn("tf", F.col("n") / size).withColumn("df", df), terms.agg(F.countDistinct("label").alias("labels")))
    scored = scored.withColumn("score", F.round(F.col("tf") * (F.log(F.col("labels") / (F.col("df") + 1)) + 1), 9))
    best = Window.partitionBy("label").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("label", "term", "n", "score", "rank")


def binned_adjacency(edges: DataFrame, nodes: DataFrame, bins: int) -> DataFrame:
    """(bin1, bin2, weight) with bin1 <= bin2: nodes(id, position, n) in equal stretches of a ranking."""
    b = nodes.select("id", F.floor(F.col("position") * bins / F.col("n")).cast("long").alias("b"))
    met = edges.join(b.select(F.col("id").alias("src"), F.col("b").alias("b1")), "src").join(b.select(F.col("id").alias("dst"), F.col("b").alias("b2")), "dst")
    return met.groupBy(F.least("b1", "b2").alias("bin1"), F.greatest("b1", "b2").alias("bin2")).agg(F.sum("weight").alias("weight"))


def layers(ranked: DataFrame) -> DataFrame:
    """Add the layer to (id, position, n), positions running from the most peripheral node to the core: the first 35 % periphery, up to 85 % semi_core, then core."""
    k1, k2 = F.floor(F.col("n") * 0.35), F.floor(F.col("n") * 0.85)
    return ranked.withColumn("layer", F.when(F.col("position") < k1, "periphery").when(F.col("position") < k2, "semi_core").otherwise("core"))


def summary(partition: DataFrame, metrics: DataFrame) -> DataFrame:
    """(label, size, mean_g, max_g, mean_h, mean_papers, total_cites) from partition(id, label) and the author metrics."""
    met = partition.join(metrics.withColumnRenamed("author_id", "id"), "id", "left")
    return met.groupBy("label").agg(F.count("*").alias("size"), F.avg("g_index").alias("mean_g"), F.max("g_index").alias("max_g"), F.avg("h_index").alias("mean_h"), F.avg("papers").alias("mean_papers"), F.coalesce(F.sum("total_cites"), F.lit(0)).alias("total_cites"))


def papers_by_year(facts: DataFrame, partition: DataFrame) -> DataFrame:
    """(label, year, size, papers, cites, cites_per_paper): cumulative to each year; a paper counts once in a community, an author too."""
    met = facts.join(partition.withColumnRenamed("id", "author_id"), "author_id")
    once = met.groupBy("label", "paper_id").agg(F.min("year").alias("year"), F.max("times_cited").alias("cites"))
    papers = once.groupBy("label", "year").agg(F.count("*").alias("papers"), F.sum("cites").alias("cites"))
    authors = met.groupBy("label", "author_id").agg(F.min("year").alias("year")).groupBy("label", "year").agg(F.count("*").alias("size"))
    run = Window.partitionBy("label").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    both = papers.join(authors, ["label", "year"], "full").na.fill(0)
    out = both.select("label", "year", *[F.sum(c).over(run).alias(c) for c in ("size", "papers", "cites")])
    return out.withColumn("cites_per_paper", F.col("cites") / F.col("papers"))


def cross_edges(yearly: DataFrame, partition: DataFrame) -> DataFrame:
    """(c1, c2, year, new, total): distinct pairs of yearly(year, src, dst) between two communities that first meet in a year, and their running sum."""
    first = yearly.groupBy("src", "dst").agg(F.min("year").alias("year"))
    at = lambda end, name: partition.select(F.col("id").alias(end), F.col("label").alias(name))
    met = first.join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a <> b")
    new = met.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"), "year").agg(F.count("*").alias("new"))
    return new.withColumn("total", F.sum("new").over(Window.partitionBy("c1", "c2").orderBy("year")))


def start_years(sizes: DataFrame, share: float = 0.1) -> DataFrame:
    """(label, start): the first year in which a community of sizes(label, year, size) has `share` of its last size, and one member at least."""
    last = sizes.groupBy("label").agg(F.max_by("size", "year").alias("final"))
    return sizes.join(last, "label").where(F.col("size") >= F.greatest(F.lit(1.0), share * F.col("final"))).groupBy("label").agg(F.min("year").alias("start"))


def ei_members(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, label, external, internal, ei) of every node with an edge."""
    each = labelled(edges, partition).groupBy("id", "label").agg(F.count_if(F.col("label") != F.col("label2")).alias("external"), F.count_if(F.col("label") == F.col("label2")).alias("internal"))
    return each.withColumn("ei", (F.col("external") - F.col("internal")) / (F.col("external") + F.col("internal")))


def dyads(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(kind, edges, weight, possible, density): ties within and between labels over the pairs there could be, which are counted and never formed."""
    kind = F.when(F.col("label") == F.col("label2"), "within").otherwise("between")
    seen = labelled(edges, partition).groupBy(kind.alias("kind")).agg((F.count("*") / 2).cast("long").alias("edges"), (F.sum("weight") / 2).alias("weight"))
    n = partition.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("within"))
    possible = n.select(F.explode(F.array(F.struct(F.lit("within").alias("kind"), F.col("within").alias("possible")), F.struct(F.lit("between").alias("kind"), (F.col("n") * (F.col("n") - 1) / 2 - F.col("within")).alias("possible")))).alias("x")).select("x.*")
    out = possible.join(seen, "kind", "left").na.fill(0, ["edges", "weight"])
    return out.select("kind", "edges", "weight", "possible", F.when(F.col("possible") > 0, F.col("edges") / F.col("possible")).alias("density"))


def prefix_labels(paths: DataFrame, level: int) -> DataFrame:
    """(id, label): the nodes of paths(id, path) numbered by the first `level` elements of their path, in its order; shorter paths are padded with 0."""
    from tessella.operators.ranking import positions

    cut_ = F.slice(F.concat("path", F.array_repeat(F.lit(0).cast(paths.schema["path"].dataType.elementType), level)), 1, level)
    short = paths.select("id", cut_.alias("prefix"))
    names = positions(short.select("prefix").distinct(), "prefix").select("prefix", (F.col("position") + 1).alias("label"))
    return short.join(names, "prefix").select("id", "label")


def hubs(edges: DataFrame, partition: DataFrame, k: int = 4) -> DataFrame:
    """(label, id, strength, rank): the k strongest members of a community by the weight of ties inside it, of equals the least."""
    inside = labelled(edges, partition).where("label = label2").groupBy("label", "id").agg(F.sum("weight").alias("strength"))
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("strength"), "id"))).where(F.col("rank") <= k)
