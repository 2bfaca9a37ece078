"""Sharding by a hierarchical weighted hash tree (region, rack, shard)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


@dataclass(frozen=True)
class Node:
    """A subtree: a shard if it has no children. Names are unique among siblings."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(child.total for child in self.children) if self.children else self.weight


def topology(shards: int, racks: int = 2, per_rack: int = 4) -> Node:
    """Regions of `racks` times `per_rack` equal shards; each shard beyond whole regions is a region of its own.

    This lays a cluster out anew. Between two layouts with as many whole regions keys move only
    into or out of spare regions, but where spares become a whole region (from 23 to 24) keys move
    between old shards too. A running cluster is therefore grown by grow(), not by a new layout.
    """
    size, regions = racks * per_rack, []
    for r in range(shards // size):
        rack = tuple(Node(f"rack{k}", children=tuple(Node(f"shard{j}", shard=r * size + k * per_rack + j) for j in range(per_rack))) for k in range(racks))
        regions.append(Node(f"region{r}", children=rack))
    tree = Node("root", children=tuple(regions))
    for s in range(shards // size * size, shards):
        tree = grow(tree, s)
    return tree


def grow(tree: Node, shard: int) -> Node:
    """The tree with a new region that holds one shard: all else stays where it is, so keys move into that shard alone."""
    return Node(tree.name, tree.weight, None, (*tree.children, Node(f"spare{shard}", children=(Node("rack0", children=(Node("shard0", shard=shard),)),))))


def place(key: Column, tree: Node, path: str = "") -> Column:
    """The shard of a key: at each level the child with the least draw -ln(u) / weight wins.

    u is a hash of the key and the child's path alone, so a changed weight only moves keys
    into or out of that child, and the draws inside other subtrees stay as they are. Children
    without weight never win; ties (draws equal to the last bit) go to the first child.
    """
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    live = [child for child in tree.children if child.total > 0]
    if not live:
        raise ValueError(f"no weight below {path or 'the root'}")
    if len(live) == 1:
        return place(key, live[0], f"{path}/{live[0].name}")
    draws = []
    for child in live:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{child.name}")), 11) + 1) * F.lit(2.0**-53)
        draws.append(-F.log(u) / F.lit(float(child.total)))
    draw = F.array(*draws)
    won = F.array_position(draw, F.array_min(draw))
    out = place(key, live[-1], f"{path}/{live[-1].name}")
    for k, child in reversed(list(enumerate(live[:-1]))):
        out = F.when(won == k + 1, place(key, child, f"{path}/{child.name}")).otherwise(out)
    return out


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): where each row goes and its place there.

    size is the UTF-8 length plus 1 and text_crc32 the checksum of the text (null: empty). The
    key alone decides the shard, so repeated keys share one; a null key is a key like any other.
    slot is gapless from 0 in each shard: rows are numbered inside their input partition and
    shifted by the rows of the partitions before it, so no shard is ever sorted or gathered. The
    small rows are written out first, and both passes over them read the same numbers. Texts of any
    length are only measured, where they lie; repeated rows are placed each; an empty table gives no
    rows; columns other than the key and the text are not read, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    where = F.col(key).cast("string")
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(where, tree).alias("shard"),
        (place(where, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = cut(rows)
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "__part", before.alias("__start"))
    local = rows.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row")) - 1)
    out = local.join(starts, ["shard", "__part"])
    return out.select(key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot"), "grown_shard")


def query(docs: DataFrame) -> DataFrame:
    """The op9 digest: 16 shards under the key law, and the shard with one more."""
    tree = topology(16)
    return assign(docs, tree, grow(tree, 16)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
