"""Author-level statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import both_ways


def team_sizes(facts: DataFrame) -> DataFrame:
    """(team, papers, share): papers by number of authors, 6 standing for more, percent to 4 places."""
    n = facts.groupBy("paper_id").agg(F.countDistinct("author_id").alias("k")).groupBy(F.least("k", F.lit(6)).cast("int").alias("team")).agg(F.count("*").alias("papers"))
    return n.withColumn("share", F.round(100 * F.col("papers") / F.sum("papers").over(Window.partitionBy()), 4))


def team_sizes_by_year(facts: DataFrame) -> DataFrame:
    """A row per year with a column for each team size, 0 where there is none, and the total."""
    n = facts.groupBy("paper_id").agg(F.countDistinct("author_id").alias("k"), F.max("year").alias("year")).withColumn("team", F.least("k", F.lit(6)).cast("int"))
    cells = n.groupBy("year").pivot("team", [1, 2, 3, 4, 5, 6]).count().na.fill(0)
    cells = cells.select("year", *[F.col(str(k)).alias(f"n{k}") for k in range(1, 7)])
    return cells.withColumn("total", sum(F.col(f"n{k}") for k in range(1, 7)))


def author_metrics(facts: DataFrame) -> DataFrame:
    """(author_id, papers, first_year, last_year, span, total_cites, avg_cites, h_index, g_index) of de-duplicated facts."""
    order = Window.partitionBy("author_id").orderBy(F.desc("times_cited"), "paper_id")
    ranked = facts.withColumn("r", F.row_number().over(order)).withColumn("c", F.sum("times_cited").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    h = F.max(F.when(F.col("times_cited") >= F.col("r"), F.col("r"))).alias("h")
    g = F.max(F.when(F.col("c") >= F.col("r") * F.col("r"), F.col("r"))).alias("g")
    out = ranked.groupBy("author_id").agg(F.count("*").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("times_cited").alias("total_cites"), F.avg("times_cited").alias("avg_cites"), h, g)
    span = (F.col("last_year") - F.col("first_year")).alias("span")
    return out.select("author_id", "papers", "first_year", "last_year", span, "total_cites", F.round("avg_cites", 6).alias("avg_cites"), F.coalesce("h", F.lit(0)).cast("long").alias("h_index"), F.coalesce("g", F.lit(0)).cast("long").alias("g_index"))


def author_roles(lines: DataFrame) -> DataFrame:
    """(author_id, single, first, last): distinct papers in a role, from (author_id, paper_id, position)."""
    per = lines.groupBy("paper_id").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.countDistinct("author_id").alias("n"))
    met = lines.join(per, "paper_id")
    role = lambda when, name: F.countDistinct(F.when(when, F.col("paper_id"))).alias(name)
    return met.groupBy("author_id").agg(role(F.col("n") == 1, "single"), role(F.col("position") == F.col("lo"), "first"), role(F.col("position") == F.col("hi"), "last"))


def neighbour_influence(edges: DataFrame, influence: DataFrame) -> DataFrame:
    """(author_id, collaborators, mean_influence, above): own value strictly above the collaborators' mean, from influence(id, value)."""
    other = influence.select(F.col("id").alias("other"), F.col("value").alias("v2"))
    near = both_ways(edges).join(other, "other", "left").groupBy("id").agg(F.countDistinct("other").alias("collaborators"), F.avg("v2").alias("mean_influence"))
    return near.join(influence, "id").select(F.col("id").alias("author_id"), "collaborators", F.round("mean_influence", 6).alias("mean_influence"), (F.col("value") > F.col("mean_influence")).alias("above"))


def top_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    """(id, w1..wn, sum1..sumn): an author's n largest weights, 0 where missing, and their running sums."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "other")
    top = both_ways(edges).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    cells = top.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("r") == k, F.col("weight"))), F.lit(0)).alias(f"w{k}") for k in range(1, n + 1)])
    return cells.select("id", *[f"w{k}" for k in range(1, n + 1)], *[sum(F.col(f"w{j}") for j in range(1, k + 1)).alias(f"sum{k}") for k in range(1, n + 1)])


def shannon(facts: DataFrame, group: str, label: str) -> DataFrame:
    """(group, labels, entropy, entropy_norm) of a label's shares inside each group."""
    n = facts.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    out = p.groupBy(group).agg(F.count("*").alias("labels"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    return out.select(group, "labels", F.round("h", 6).alias("entropy"), F.when(F.col("labels") > 1, F.round(F.col("h") / F.log("labels"), 6)).otherwise(0.0).alias("entropy_norm"))


def team_sizes_with_missing(papers: DataFrame, facts: DataFrame) -> DataFrame:
    """(team, papers, share) over all `papers` (paper_id): teams of 6 stand for larger ones, papers without authors
    have a null team and no share, which is of papers with authors."""
    sizes = facts.groupBy("paper_id").agg(F.least(F.countDistinct("author_id"), F.lit(6)).cast("int").alias("team"))
    binned = papers.select("paper_id").distinct().join(sizes, "paper_id", "left").groupBy("team").agg(F.count("*").alias("papers"))
    valid = F.sum(F.when(F.col("team").isNotNull(), F.col("papers"))).over(Window.partitionBy())  # seven rows at most
    return binned.select("team", "papers", F.when(F.col("team").isNotNull(), F.round(100.0 * F.col("papers") / valid, 4)).alias("share"))


def fractional_entropy(labels: DataFrame, group: str) -> DataFrame:
    """Shannon entropy of labels by `group`, each paper's weight split evenly over its distinct labels.

    `labels` holds (group, paper_id, label); a null label counts as the label 'missing'. With one
    label the evenness is null.
    """
    distinct = labels.select(group, "paper_id", F.coalesce("label", F.lit("missing")).alias("label")).distinct()
    sizes = distinct.groupBy(group, "paper_id").agg(F.count("*").alias("k"))
    mass = distinct.join(sizes, [group, "paper_id"]).groupBy(group, "label").agg(F.sum(1 / F.col("k")).alias("m"))
    total = mass.groupBy(group).agg(F.sum("m").alias("total"))
    p = F.col("m") / F.col("total")
    out = mass.join(total, group).groupBy(group).agg(F.count("*").alias("labels"), F.sum(-p * F.log(p)).alias("entropy"))
    return out.withColumn("evenness", F.when(F.col("labels") > 1, F.col("entropy") / F.log("labels")))


def ego_edge_stats(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, other, freq, avg_year, first_year, last_year, duration) for the seeds (id) and those they write with."""
    own = facts.join(seeds, facts["author_id"] == seeds["id"]).select("paper_id", "year", F.col("id").alias("seed"))
    met = own.join(facts.select("paper_id", F.col("author_id").alias("other")), "paper_id").where("seed <> other")
    out = met.groupBy("seed", "other").agg(F.count("*").alias("freq"), F.avg("year").alias("avg_year"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.withColumn("duration", F.col("last_year") - F.col("first_year"))


def community_sizes_by_year(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(year, nodes, communities, avg_size): authors of a year that have a label (id, label); null size without one."""
    active = facts.select("year", F.col("author_id").alias("id")).distinct().join(labels, "id", "left")
    out = active.groupBy("year").agg(F.count("label").alias("nodes"), F.countDistinct("label").alias("communities"))
    return out.withColumn("avg_size", F.when(F.col("communities") > 0, F.col("nodes") / F.col("communities")))
