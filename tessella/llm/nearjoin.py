"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Each text becomes a signature of `trees` times `depth` bytes. A tree's bytes, in order, are a
   path in its prefix tree. Equal texts share one signature from here on.
2. The trees are descended from the full depth to ever shorter prefixes. At a depth, texts whose
   paths in some tree share that prefix meet, in the order of their paths, and are tied if their
   signatures agree well enough. A prefix is only opened if it brings together texts that longer
   ones did not tie into one family, and only texts of different families are compared in it.
3. After each depth the recall is measured: by how far the signatures of the tied pairs agree, with
   what chance are pairs like them met in some tree? Texts of a size whose recall is below the
   target go on to the next shorter prefix, the others stop.
4. A family's texts are fetched, dealt in blocks, and all pairs of it that can be similar by their
   sizes are verified exactly by a product of its shingle table; the pairs are counted, never written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.session import cut

#: Production parameters: words of a shingle, similarity, trees and their full depth, recall of a pair at the threshold, texts of a block.
WORDS, SIMILAR, TREES, DEPTH, RECALL, BLOCK = 5, 0.8, 24, 6, 0.9999, 1024
#: Up to so many rows of ids are broadcast to fetch or to drop texts where they lie; beyond, texts are shuffled to them.
BROADCAST_ROWS = 300_000
#: Words that a worker remembers at most, and shingles of a family that it compares at once.
CACHE, COLUMNS = 100_000, 1024
SEED = 20_011


class Hashes(dict):
    """64-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_digest(word)
        return found


def shingles(text: str, hashes: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter text is one shingle, an empty one none."""
    # bytes.split() parts at the six ASCII blanks and nothing else.
    h = np.frombuffer(b"".join([hashes[w] for w in text.encode("utf-8", "surrogatepass").split()]), np.uint64)
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def met_share(depth: int, trees: int = TREES, similar: float = SIMILAR) -> float:
    """The chance that a pair of this similarity shares a prefix of `depth` in some tree."""
    return 1 - (1 - similar**depth) ** trees


def least_agreement(values: int, similar: float = SIMILAR) -> int:
    """Signature bytes that a pair at the threshold shares at least, but for a chance below one in a million (five deviations)."""
    return max(0, math.floor(values * similar - 5 * math.sqrt(values * similar * (1 - similar))))


def _signatures(n: int, values: int) -> Callable:
    rng = np.random.default_rng(SEED)
    a = (rng.integers(0, 1 << 31, values, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, values, np.uint32)[:, None]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for frame in frames:
            sizes, signs = [], []
            for text in frame["text"]:
                s = shingles(text, hashes, n)
                x = (s >> np.uint64(32)).astype(np.uint32)
                least = np.full(values, 0xFFFFFFFF, np.uint32)
                for k in range(0, len(x), 2048):
                    least = np.minimum(least, (x[None, k : k + 2048] * a + b).min(axis=1))
                sizes.append(len(s))
                signs.append((least * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"row": frame["row"], "doc": frame["doc"], "key": frame["key"], "size": sizes, "sign": signs})

    return run


def _tie(sign: np.ndarray, ids: np.ndarray, family: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Ties of one meeting: a forest over its families, some of whose signatures agree in `least` bytes.

    The texts come in the order of their paths, so those with the longest shared prefix are
    compared first. A family that is tied joins those already reached, with all its texts.
    """
    src, dst, free = [], [], np.arange(len(ids))
    while len(free):
        reached = family[free] == family[free[0]]
        queue, free = free[reached].tolist(), free[~reached]
        while queue and len(free):
            at = queue.pop()
            near = free[np.concatenate([(sign[free[k : k + 8192]] == sign[at]).sum(axis=1) >= least for k in range(0, len(free), 8192)])]
            if not len(near):
                continue
            new, first = np.unique(family[near], return_index=True)
            src += [ids[at]] * len(new)
            dst += ids[near[first]].tolist()
            reached = np.isin(family[free], new)
            queue += free[reached].tolist()
            free = free[~reached]
    return src, dst


def _ties(least: int) -> Callable:
    """Ties of the meetings of a partition whose rows are sorted by meeting and path; one meeting is held at a time."""
    names = ["tree", "path", "p", "q"]

    def tied(rest: pd.DataFrame) -> pd.DataFrame:
        new = np.append(True, np.any([rest[c].to_numpy()[1:] != rest[c].to_numpy()[:-1] for c in names], axis=0))
        starts = np.append(np.flatnonzero(new), len(rest))
        sign = np.frombuffer(b"".join(rest["sign"]), np.uint8).reshape(len(rest), -1)
        ids, family, src, dst = rest["row"].to_numpy(), rest["family"].to_numpy(), [], []
        for a, b in zip(starts[:-1], starts[1:]):
            one = _tie(sign[a:b], ids[a:b], family[a:b], least)
            src += one[0]
            dst += one[1]
        return pd.DataFrame({"src": np.asarray(src, np.int64), "dst": np.asarray(dst, np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = np.all([held[c].to_numpy() == held[c].iloc[-1] for c in names], axis=0)
            if not last[0]:
                yield tied(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield tied(held)

    return run


def _meet(texts: DataFrame, at: int, trees: int, depth: int, part: int, across: bool, least: int) -> tuple[DataFrame, bool]:
    """Ties (src, dst) at prefixes of `at` bytes among texts(row, size, sign, family), and whether all that meet were compared.

    A meeting of more than `part` texts is dealt to parts. Each is compared by itself, or, `across`,
    with every other: then each text travels once for each part, which pays once families are tied.
    """
    # Paths travel in hexadecimal: as raw bytes, ones that end in a zero byte would not compare in numpy.
    paths = texts.select("row", "family", F.posexplode(F.array(*[F.hex(F.substring("sign", t * depth + 1, at)) for t in range(trees)])).alias("tree", "path"))
    crowd = paths.groupBy("tree", "path").agg(F.count("*").alias("n"), F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi")
    crowd = cut(crowd.select("tree", "path", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    met = paths.join(crowd, ["tree", "path"]).withColumn("part", F.expr("cast(pmod(xxhash64(row), parts) as int)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if across else F.col("part"))
    met = met.select("row", "family", "tree", "path", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).join(texts.select("row", "sign"), "row")
    met = met.repartition("tree", "path", "p", "q").withColumn("steps", F.substring("sign", F.col("tree") * depth + 1, F.lit(depth))).sortWithinPartitions("tree", "path", "p", "q", "steps")
    ties = cut(met.select("row", "family", "tree", "path", "p", "q", "sign").mapInPandas(_ties(least), "src long, dst long"))
    return ties, across or crowd.where("parts > 1").isEmpty()


def measured(ties: DataFrame, texts: DataFrame, at: int, trees: int, similar: float) -> DataFrame:
    """(band, recall): of the pairs like those tied that look similar enough, the share that prefixes of `at` bytes find.

    The share of signature bytes in which a tied pair agrees tells its similarity, and this with what chance
    such a pair meets at all. A band is a power of two of the size.
    """
    ends = ties.join(texts.select(F.col("row").alias("src"), F.col("sign").alias("a"), "band"), "src").join(texts.select(F.col("row").alias("dst"), F.col("sign").alias("b")), "dst")
    byte = lambda c: F.split(F.regexp_replace(F.hex(c), "(..)", "$1 "), " ")
    agree = F.aggregate(F.zip_with(byte("a"), byte("b"), lambda x, y: ((x == y) & (x != "")).cast("int")), F.lit(0), lambda n, x: n + x)
    ends = ends.select("band", (agree / F.octet_length("a")).alias("s")).where(F.col("s") >= similar)
    return ends.groupBy("band").agg(F.avg(1 - F.pow(1 - F.pow("s", F.lit(at)), F.lit(trees))).alias("recall"))


def forest(texts: DataFrame, trees: int = TREES, depth: int = DEPTH, similar: float = SIMILAR, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, component): families of texts(row, size, sign), found from the longest prefixes to the shortest that the recall asks for.

    A size without ties is judged by what a pair right at the threshold would meet with. At the full
    depth large meetings are tied part by part; shorter prefixes then compare what is left of them.
    """
    least = least_agreement(trees * depth, similar)
    texts = cut(texts.withColumn("band", F.floor(F.log2("size")).cast("int")))
    bands = [r["band"] for r in texts.select("band").distinct().collect()]  # at most 31
    open_, ties, families = set(bands), None, None
    for at in range(depth, 0, -1):
        some = texts if len(open_) == len(bands) else texts.where(F.col("band").isin(sorted(open_)))
        if families is None:
            some = some.withColumn("family", F.col("row"))
        else:
            some = cut(some.join(families.withColumnRenamed("id", "row"), "row", "left").withColumn("family", F.coalesce("component", "row")))
        new, whole = _meet(some, at, trees, depth, block if at == depth else 2 * block, at < depth or depth == 1, least)
        if families is None or not new.isEmpty():
            ties = new if ties is None else ties.unionByName(new)
            families = cut(connected_components(ties))
        seen = {r["band"]: r["recall"] for r in measured(ties, texts, at, trees, similar).collect()}
        low = {b for b in open_ if not whole or seen.get(b, met_share(at, trees, similar)) < recall}
        # A pair's sizes differ by less than a power of two, so the bands beside one that goes on do so too.
        open_ = {b for b in bands if {b - 1, b, b + 1} & low}
        if not open_:
            break
    return families


def _verify(n: int, similar: float) -> Callable:
    """Exact links of one block, or between two: per text the copies linked to it, and a forest over the links."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = Hashes()
        frame = frame.drop_duplicates("row").sort_values("row")
        ids, copies, block = (frame[c].to_numpy(np.int64) for c in ("row", "copies", "block"))
        left, right = (np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2]))
        sets = [shingles(t, hashes, n) for t in frame["text"]]
        sizes = np.asarray([len(s) for s in sets], np.int64)
        _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        at = np.repeat(np.arange(len(sets)), sizes)
        shared = often[col] > 1
        at, (_, col) = at[shared], np.unique(col[shared], return_inverse=True)
        inter = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        at, col = at[order], col[order]
        for begin in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            a, b = np.searchsorted(col, (begin, begin + COLUMNS))
            table = np.zeros((len(sets), COLUMNS), np.float32)
            table[at[a:b], col[a:b] - begin] = 1
            inter += table[left] @ table[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - inter
        linked = (inter >= similar * union - 1e-6) & (union > 0)
        if key[1] == key[2]:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[left] += linked @ copies[right]
        if key[1] != key[2]:
            links[right] += copies[left] @ linked
        src, dst = _forest(left, right, linked, len(ids))
        none = [None] * len(src)
        counted = links > 0
        return pd.DataFrame({"row": [*ids[counted], *none], "links": [*links[counted], *none], "src": [*[None] * int(counted.sum()), *ids[src]], "dst": [*[None] * int(counted.sum()), *ids[dst]]}, dtype="Int64")

    return run


def _forest(left: np.ndarray, right: np.ndarray, linked: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Edges that join what `linked` joins, one less than its texts for each group."""
    rows, cols = {int(g): k for k, g in enumerate(left)}, {int(g): k for k, g in enumerate(right)}
    src, dst, fresh = [], [], np.ones(n, bool)
    for root in [*left.tolist(), *right.tolist()]:
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            at = queue.pop()
            near = np.concatenate([right[linked[rows[at]]] if at in rows else left[:0], left[linked[:, cols[at]]] if at in cols else left[:0]])
            near = np.unique(near[fresh[near]])
            fresh[near] = False
            src += [at] * len(near)
            dst += near.tolist()
            queue += near.tolist()
    return src, dst


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, class_size, kept, text_md5, and the column `row` if it is named.

    Two documents are linked if the sets of their word shingles have a Jaccard similarity of
    `similar` or more; equal texts are linked as well. n_links counts the other documents linked
    to one, copies included; class_id is the least id of those reached by links; `kept` marks one
    document of a class, the one read first. Texts under `words` words are a single shingle of all
    their words. Null and blank texts have no shingles: they are linked to equal texts only. Null
    ids are carried along and never name a class that has another id. Repeated rows are documents
    of their own. An empty table gives no rows; extra columns are not read, whatever their names.
    The shorter prefixes are opened until the measured share of similar pairs that meet is
    `recall`; all that meet are verified on whole texts; there is no cap on partners. `row` names
    a column of unique longs, which otherwise are drawn here.
    """
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    base = docs.select(number.alias("row"), F.col("doc_id").cast("string").alias("doc"), F.md5(text).alias("key"), text.alias("text"))
    signed = cut(base.mapInPandas(_signatures(words, trees * depth), "row long, doc string, key string, size int, sign binary"))
    signed = signed.withColumn("doc", F.col("doc").cast(kind))
    texts = cut(signed.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("doc").alias("doc"), F.max("size").alias("size")))

    reps = signed.join(texts.select("row"), "row", "left_semi").where("size > 0").select("row", "size", "sign")
    families = forest(reps, trees, depth, similar, recall, block)
    families = cut(families.withColumnRenamed("id", "row").join(texts, "row"))

    # A family over one block is dealt by size, in steps of the similarity: only texts of one step or of neighbours can be similar.
    many = families.groupBy("component").agg(F.count("*").alias("n")).select("component", (F.col("n") > block).alias("big"))
    step = F.when(F.col("big"), F.floor(F.log("size") / -math.log(similar))).otherwise(0).cast("long")
    own = families.join(many, "component").withColumn("step", step).select("component", "row", "copies", "key", "doc", "step")
    blocks = own.groupBy("component", "step").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    beside = blocks.select("component", F.col("step").alias("other_step"), F.col("blocks").alias("others"), F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("step"))
    dealt = own.join(blocks, ["component", "step"]).withColumn("block", F.col("step") * (1 << 32) + F.expr("pmod(xxhash64(row), blocks)"))
    dealt = dealt.join(beside, ["component", "step"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.withColumn("other", F.col("other_step") * (1 << 32) + F.col("other"))
    named = dealt.select(F.col("key").alias("k"), F.col("doc").alias("d"), "component", "row", "copies", "block", "other")
    if families.count() <= BROADCAST_ROWS // 4:
        named = F.broadcast(named)
    whole = base.select("key", F.col("doc").cast(kind).alias("doc"), "text")
    fetched = whole.join(named, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")))
    fetched = fetched.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "row", "copies", "block", "text")
    found = cut(fetched.groupBy("component", "p", "q").applyInPandas(_verify(words, similar), "row long, links long, src long, dst long"))

    links = found.where("row is not null").groupBy("row").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("src is not null").select("src", "dst"))
    named = texts.join(classes.withColumnRenamed("id", "row"), "row", "left").join(links, "row", "left")
    named = named.select("key", "copies", "doc", F.coalesce("component", "row").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = cut(named)
    heads = named.groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(heads, "root")
    out = signed.select("row", "doc", "key").join(named.select("key", "copies", "root", "links", "class_id", "class_size"), "key")
    own_row = [] if row is None else [F.col("row").alias(row)]
    return out.select(F.col("doc").alias("doc_id"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "class_size", (F.col("row") == F.col("root")).alias("kept"), F.col("key").alias("text_md5"), *own_row)


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, all columns, of which one stays per class.

    The rows are numbered and written out; what is not kept is dropped by its number where it lies.
    """
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    gone = cut(near_duplicates(numbered, row="__row", **settings).where("not kept").select("__row"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return numbered.join(gone, "__row", "left_anti").drop("__row")


def query(docs: DataFrame) -> DataFrame:
    """op2: class and number of links of every document."""
    return near_duplicates(docs).drop("text_md5")
