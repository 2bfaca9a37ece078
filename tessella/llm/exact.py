"""Exact dedup: group by 128-bit content hash, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut

#: Up to so many shared hashes of 16 bytes are broadcast to fetch the texts to compare; beyond, they are joined.
BROADCAST_HASHES = 500_000
#: A group over this many rows, or over this share of all rows, is looked up by broadcast: at most 1 / share such groups exist.
LARGE, LARGE_SHARE = 1_000, 1e-5


def _best(keep: str) -> Column:
    """(doc_id, row) of the row that stays: of its equals the one read first; a null id loses to any other."""
    if keep == "max":
        return F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    """(h, keep_id, group_size, winner) by one partial aggregate, however many rows share a hash."""
    found = rows.groupBy("h").agg(_best(keep).alias("best"), F.count("*").alias("group_size"))
    return found.select("h", F.col("best.doc_id").alias("keep_id"), "group_size", F.abs("best.row").alias("winner"))


def _joined(rows: DataFrame, groups: DataFrame, large: float) -> DataFrame:
    """Rows with their group: the few large groups by broadcast, the rest on the hash."""
    big = F.broadcast(groups.where(F.col("group_size") > large))
    return rows.join(big, "h").unionByName(rows.join(big.select("h"), "h", "left_anti").join(groups.where(F.col("group_size") <= large), "h"))


def exact_duplicates(docs: DataFrame, content_hash: Column | None = None, keep: str = "min", broadcast_hashes: int = BROADCAST_HASHES, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. `keep` names which id of equal texts stays, "min" or "max".
    Documents meet by a 128-bit hash (md5, unless `content_hash`, an expression over `text`,
    is given); only hashes and ids travel for that. The bytes are fetched for hashes that more
    than one row has, and compared by a partial aggregate whose key holds the whole text, so
    copies collapse before the shuffle however many there are. Texts that differ but share a
    hash are told apart by their rank in it. Of repeated rows with the winning id exactly one is
    kept. A null id loses to any other; an empty table gives an empty result. Extra columns are
    not read, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.unhex(F.md5("text")) if content_hash is None else content_hash
    base = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("h", hashed)
    rows = cut(base.select("doc_id", "row", "h", F.sha2("text", 256).alias("text_sha256")))
    groups = cut(_groups(rows, keep))
    totals = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n"), F.count_if(F.col("group_size") > 1).alias("shared")).first()
    threshold = max(large, totals["n"] * LARGE_SHARE)
    shared = groups.where("group_size > 1").select("h")
    few = totals["shared"] <= broadcast_hashes
    fetched = base.select("h", "text").join(F.broadcast(shared) if few else shared, "h", "left_semi")
    collided = cut(fetched.groupBy("h", "text").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    if collided.isEmpty():
        out = _joined(rows, groups, threshold)
    else:
        # Rows of hashes that differing texts share are read again, and their hash gets the text's rank.
        mixed = base.join(collided, "h", "left_semi")
        ranked = mixed.select("h", "text").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("text")))
        told = mixed.join(ranked, ["h", "text"]).select("doc_id", "row", F.concat_ws("#", F.col("h").cast("string"), F.col("rank").cast("string")).alias("h"), F.sha2("text", 256).alias("text_sha256"))
        told = cut(told)
        clean = _joined(rows.join(collided, "h", "left_anti"), groups.join(collided, "h", "left_anti"), threshold)
        out = clean.drop("h").unionByName(_joined(told, _groups(told, keep), threshold).drop("h"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("winner")).alias("kept"), "text_sha256")


def query(docs: DataFrame) -> DataFrame:
    """The op10 digest: of equal texts the row with the largest id stays."""
    return exact_duplicates(docs, keep="max")


ORACLE = """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 kept, sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
