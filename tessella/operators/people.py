"""Author disambiguation: similar names in blocks, merged where keywords, addresses or co-authors agree."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.session import cut

#: Similarity of names and of addresses that counts, and values of a block that one task compares with as many others.
NAMES, ADDRESSES, PART = 0.8, 0.9, 2_000


def ratio(a: str, b: str, least: float) -> bool:
    """Whether two texts' matching-blocks similarity reaches `least`; its cheap upper bounds come first."""
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    match = SequenceMatcher(None, a, b)
    return match.quick_ratio() >= least and match.ratio() >= least


def similar_pairs(values: DataFrame, least: float) -> DataFrame:
    """(block, a, b) with a < b: the distinct values(block, value) of a block whose similarity is `least` or more.

    Only values are compared, however many rows have them. A large block is dealt to pairs of
    parts, so that no task holds more than two parts; only pairs that are similar are written.
    """
    distinct = values.where("block is not null and value is not null").select("block", "value").distinct()
    parts = distinct.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = distinct.join(parts, "block").withColumn("part", F.expr("cast(pmod(xxhash64(value), parts) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("value")
        left, right = (frame["value"][frame["part"] == key[k]].tolist() for k in (1, 2))
        pairs = ((min(a, b), max(a, b)) for a in left for b in right if a < b or (key[1] != key[2] and a != b))
        found = [(key[0], a, b) for a, b in pairs if ratio(a, b, least)]
        return pd.DataFrame(found, columns=["block", "a", "b"])

    met = dealt.select("block", "value", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    return met.groupBy("block", "p", "q").applyInPandas(run, "block string, a string, b string")


def stars(groups: DataFrame) -> DataFrame:
    """(src, dst): ties that join the members of groups(key, inst, paper_id) of different papers, at most one per member.

    All join the least instance, but those on its own paper, who join the least instance of another.
    """
    hub = groups.groupBy("key").agg(F.min(F.struct("inst", "paper_id")).alias("one"))
    met = groups.join(hub, "key")
    two = met.where(F.col("paper_id") != F.col("one.paper_id")).groupBy("key").agg(F.min("inst").alias("two"))
    met = met.join(two, "key")
    dst = F.when(F.col("paper_id") == F.col("one.paper_id"), F.col("two")).otherwise(F.col("one.inst"))
    return met.select(F.col("inst").alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def _keyed(instances: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """Instances under the name of every similar pair their value is in, and under their value alone."""
    sides = pairs.select(F.col("block"), F.explode(F.array("a", "b")).alias(on), F.concat_ws("\u0001", "block", "a", "b").alias("pair"))
    alone = instances.withColumn("pair", F.concat_ws("\u0001", "block", on))
    return alone.unionByName(instances.join(sides, ["block", on]).select(*instances.columns, "pair"))


def token_key(name: Column) -> Column:
    """Equal for names with equal, reversed or set-equal words."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(name, " "))), " ")


def disambiguate(instances: DataFrame, names: float = NAMES, addresses: float = ADDRESSES) -> DataFrame:
    """(inst, author): instances(inst, paper_id, name, block, address, keywords) merged into authors, named by their least instance.

    Only instances of equal block (initials) on different papers merge. Those with the same words
    as names merge at once if they share a keyword or have similar addresses (both known). Those
    with similar names merge if a co-author of the one and a co-author of the other are by now one
    author; this is repeated until nothing changes. Null names never merge.
    """
    inst = cut(instances.select("inst", "paper_id", "name", "block", "address", "keywords").where("name is not null and paper_id is not null"))
    whole = inst.withColumn("same", F.concat_ws("\u0001", "block", token_key(F.col("name")))).where("trim(coalesce(address, '')) <> ''")
    shared = whole.select("same", F.explode("keywords").alias("word"), "inst", "paper_id").select(F.concat_ws("\u0001", "same", "word").alias("key"), "inst", "paper_id")
    placed = whole.select("inst", "paper_id", F.col("same").alias("block"), "address")
    near = similar_pairs(placed.select("block", F.col("address").alias("value")), addresses)
    located = _keyed(placed, near, "address").select(F.col("pair").alias("key"), "inst", "paper_id")
    ties = cut(stars(shared).unionByName(stars(located)))

    alike = cut(_keyed(inst.select("inst", "paper_id", "block", "name"), similar_pairs(inst.select("block", F.col("name").alias("value")), names), "name").select("inst", "paper_id", "pair"))
    everyone = inst.select("inst", "paper_id")
    before = -1
    while True:
        found = connected_components(ties)
        roots = cut(everyone.join(found.withColumnRenamed("id", "inst"), "inst", "left").select("inst", "paper_id", F.coalesce("component", "inst").alias("author")))
        now = roots.select("author").distinct().count()
        if now == before:
            return roots.select("inst", "author").unionByName(instances.join(inst, "inst", "left_anti").select("inst", F.col("inst").alias("author")))
        before = now
        # A co-author root that meets one instance only ties nothing, so only merged roots are looked at.
        big = roots.groupBy("author").agg(F.count("*").alias("n")).where("n > 1").select("author")
        beside = roots.join(big, "author").select("paper_id", F.col("author").alias("near"), F.col("inst").alias("by"))
        met = alike.join(beside, "paper_id").where("inst <> by").select(F.concat_ws("\u0002", "pair", F.col("near").cast("string")).alias("key"), "inst", "paper_id").distinct()
        ties = cut(ties.unionByName(stars(met)).distinct())


def author_summary(records: DataFrame) -> DataFrame:
    """(author_id, papers, years, addresses, keywords, total_cites, paper_count, top_address, author_name).

    records: author_id, paper_id, year, address, keywords (array), times_cited, raw_name. Lists are
    sorted and distinct but for the keywords, which keep repeats. A paper's citations count once.
    The commonest address and name stand for the author; of equally common ones the least.
    """
    from tessella.operators.tabulate import modal

    cites = records.groupBy("author_id", "paper_id").agg(F.max("times_cited").alias("c")).groupBy("author_id").agg(F.sum("c").alias("total_cites"))
    lists = records.groupBy("author_id").agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in (("paper_id", "papers"), ("year", "years"), ("address", "addresses"))], F.array_sort(F.flatten(F.collect_list("keywords"))).alias("keywords"))
    top = modal(records, "author_id", "address").withColumnRenamed("address", "top_address")
    name = modal(records, "author_id", "raw_name").withColumnRenamed("raw_name", "author_name")
    return lists.withColumn("paper_count", F.size("papers")).join(cites, "author_id").join(top, "author_id", "left").join(name, "author_id", "left")
