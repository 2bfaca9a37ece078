"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_CHAR, with_text
from tessella.session import cut

#: Production parameters: a line on more than a tenth of a site's pages, and on five at least, is boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 5
#: Standard errors by which a line's count may lie under its share by chance; 0 leaves the bare threshold.
CHANCE = 3.0
#: Up to so many (site, line) pairs of 8 bytes and a site name are broadcast; beyond, sites are joined with salt.
BROADCAST_LINES = 100_000
SALTS = 64


def _above(n: str, pages: str, max_ratio: float, margin: float) -> Column:
    """Whether `n` of `pages` is above the ratio, or at most `margin` standard errors of a count (1/2 on its root) below."""
    if not margin:
        return F.col(n) > F.col(pages) * F.lit(max_ratio)
    return F.pow(F.sqrt(F.col(n)) + margin / 2, F.lit(2)) > F.col(pages) * F.lit(max_ratio)


def boilerplate(docs: DataFrame, host: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, margin: float = 0.0) -> DataFrame:
    """(site, lines): per site the 64-bit hashes of the lines on more than `max_ratio` of its pages.

    A page counts once for each of its distinct lines; lines without a word are never counted.
    A site's list has at most (distinct lines a page) / max_ratio entries.

    With a `margin` a line stays only if its count is clearly, by so many standard errors,
    under the ratio, so a line at the ratio goes from all sites and not from those where
    chance put it above. A line that the whole corpus has at that rate needs no `min_pages`
    in the site, so small sites lose it too.
    """
    site = F.coalesce(host.cast("string"), F.lit(""))
    lines = F.expr(f"array_distinct(transform(filter(split(text, '\\n', -1), x -> x rlike r'{WORD_CHAR}'), x -> xxhash64(x)))")
    pages = docs.select(site.alias("site"), F.col("text").cast("string").alias("text")).select("site", lines.alias("lines"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    counts = pages.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    if margin:
        everywhere = counts.groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
        everywhere = everywhere.join(F.broadcast(totals.agg(F.sum("pages").alias("pages"))), how="cross").where(_above("n", "pages", max_ratio, margin))
        counts = counts.join(F.broadcast(everywhere.select("line", F.lit(True).alias("common"))), "line", "left").where((F.col("n") >= min_pages) | F.col("common"))
    else:
        counts = counts.where(F.col("n") >= min_pages)
    return counts.join(totals, "site").where(_above("n", "pages", max_ratio, margin)).groupBy("site").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: Column | None = None, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, margin: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns, without their site's boilerplate lines, plus the long
    columns `n_lines` and `n_dropped` (which replace columns of these names).

    `host` is the site (the column `source` unless given); null is a site of its own. Null
    texts stay null with 0 lines. Lines without a word are kept; a text may become empty but
    its row stays. Repeated rows are pages of their own. Texts are only moved if the lists
    exceed `broadcast_lines` entries; the site is then joined under salt, so that a site with a
    third of the pages is spread over the cluster.
    """
    host = F.col("source") if host is None else host
    lists = cut(boilerplate(docs, host, max_ratio, min_pages, margin))
    entries = lists.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    site = F.coalesce(host.cast("string"), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), site.alias("site"))
    lists = lists.withColumnRenamed("lines", "gone")
    if entries <= broadcast_lines:
        met = whole.join(F.broadcast(lists), "site", "left")
    else:
        spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = whole.withColumn("salt", F.expr(f"cast(pmod(xxhash64(text, monotonically_increasing_id()), {SALTS}) as int)")).join(spread, ["site", "salt"], "left")
    met = met.select("row", "text", "gone", F.split("text", "\n", -1).alias("all"))
    left = F.expr(f"case when gone is null then all else filter(all, x -> not (array_contains(gone, xxhash64(x)) and x rlike r'{WORD_CHAR}')) end")
    met = met.select("row", F.size("all").alias("n"), "text", "all", left.alias("left"))
    kept = F.when(F.size("left") == F.size("all"), F.col("text")).otherwise(F.array_join("left", "\n"))
    n = F.coalesce(F.size("all"), F.lit(0)).cast("long")
    flat = met.select("row", kept.alias("__new"), F.when(F.col("all").isNull(), 0).otherwise(n).cast("long").alias("__lines"), F.when(F.col("all").isNull(), 0).otherwise(n - F.size("left")).cast("long").alias("__dropped"))
    out = with_text(flat.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "__new", "__lines", "__dropped"), F.col("__new"))
    return out.withColumn("n_lines", F.col("__lines")).withColumn("n_dropped", F.col("__dropped")).drop("__new", "__lines", "__dropped")


def query(docs: DataFrame) -> DataFrame:
    """op6: each document's text without the boilerplate of its source."""
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = r"""
with d as (select row_number() over () id, doc_id, coalesce(source, '') site, text, str_split(text, chr(10)) l from documents),
u as (select distinct id, site, unnest(l) line from d),
b as (
  select site, line from u join (select site, count(*) pages from d group by site) using (site)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by site, line, pages having count(*) >= 5 and count(*) > pages * 0.1::double),
s as (select site, list(line) gone from b group by site)
select doc_id, array_to_string(list_filter(l, lambda x: not list_contains(coalesce(gone, []), x)), chr(10)) as text,
       coalesce(len(l), 0)::bigint n_lines, coalesce(len(l) - len(list_filter(l, lambda x: not list_contains(coalesce(gone, []), x))), 0)::bigint n_dropped
from d left join s using (site)
"""
