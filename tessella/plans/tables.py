"""Queries of tables, joins, windows and yearly statistics, each next to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.facts import authorships, coactive, table
from tessella.functions import text as T
from tessella.operators import authors, community, graph, kernels, metrics, paths, people, project, tabulate, temporal, twins
from tessella.operators.ranking import beside, positions
from tessella.session import cut
from tessella.plans.registry import _ALPHA, _PART, _RAW, _REACH, _TRI, _YE, FACTS, SMALL, SPARSE, counted, parts, query, r6, simple, small, sparse, sparse_facts

_METRICS = ", rk as (select *, row_number() over w i, sum(cites) over w c from f window w as (partition by author_id order by cites desc, paper_id)), am as (select author_id id, count(*) papers, min(yr) y1, max(yr) y2, sum(cites) total_cites, coalesce(max(case when cites >= i then i end), 0) h, coalesce(max(case when c >= i * i then i end), 0) g from rk group by author_id)"
#: Brands stand for communities of the parts.
_BRAND = ", br as (select p_partkey::bigint id, p_brand label from part)"


def brands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("label"))


def counts(facts: DataFrame) -> DataFrame:
    return project.paper_counts(facts).withColumnRenamed("author_id", "id")


# --- filters and projections
query("newman_prefiltered", FACTS + ", k as (select author_id from f group by all having count(*) >= 30), g as (select * from f where author_id in (from k)), gn as (select paper_id, count(*) n from g group by all) select a.author_id src, b.author_id dst, round(sum(1.0::double / (n - 1)), 6) weight from g a join g b on a.paper_id = b.paper_id and a.author_id < b.author_id join gn on gn.paper_id = a.paper_id group by all")(
    lambda s, d: r6(project.newman(authorships(s, d).join(project.paper_counts(authorships(s, d)).where("papers >= 30"), "author_id", "left_semi")), "weight")
)
query("co_binary", f"with {_RAW}, f as (select distinct author_id, paper_id from raw) select a.author_id src, b.author_id dst, count(*)::bigint weight from f a join f b on a.paper_id = b.paper_id and a.author_id < b.author_id group by all")(lambda s, d: project.full(authorships(s, d, "binary")))
_GLOBAL = _YE + ", wl as (select id from d where degree >= 12), bb as (select src, dst from e where weight >= 2), yr2 as (select yr, src, dst from ye where src in (from wl) and dst in (from wl))"


def _slice_in_global(s: SparkSession, d: str, with_pairs: bool) -> DataFrame:
    e = small(s, d)
    yearly = temporal.yearly_edges(coactive(s, d))
    kept = graph.whitelisted(yearly, graph.degrees(e).where("degree >= 12"), e.where("weight >= 2") if with_pairs else None)
    return kept.select("year", "src", "dst")


query("global_first_nodes", SMALL + _GLOBAL + " select yr as year, src, dst from yr2")(lambda s, d: _slice_in_global(s, d, False))
query("global_first_edges", SMALL + _GLOBAL + " select yr as year, src, dst from yr2 semi join bb using (src, dst)")(lambda s, d: _slice_in_global(s, d, True))
simple("largest_communities", lambda e: graph.largest_communities(parts(e), 3, 10), SMALL + ", l as (select id, id % 10 label from d), z as (select label from l group by label having count(*) >= 10 order by count(*) desc, label limit 3) select id, label from l where label in (from z)")
query("pairs_in_edge_set", FACTS + ", es as (select src, dst from e where weight >= 2) select src, dst, count(*)::bigint freq, round(avg(yr), 6) avg_year, min(yr) first_year, max(yr) last_year from pr semi join es using (src, dst) group by src, dst")(
    lambda s, d: r6(_pair_years(s, d).join(project.full(authorships(s, d)).where("weight >= 2"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("freq"), F.avg("year").alias("avg_year"), F.min("year").alias("first_year"), F.max("year").alias("last_year")), "avg_year")
)


def _pair_years(s: SparkSession, d: str) -> DataFrame:
    facts = authorships(s, d)
    return project.pairs(facts).join(facts.groupBy("paper_id").agg(F.max("year").alias("year")), "paper_id")


# --- joins
query("edge_duration_backfill", SMALL + ", y as (select src, dst, min(yr) a, max(yr) b from pr group by all having min(yr) < 10) select e.src, e.dst, coalesce(b - a, 0)::int duration from e left join y on y.src = e.src and y.dst = e.dst")(
    lambda s, d: small(s, d).select("src", "dst").join(project.edge_years(coactive(s, d)).where("first_year < 10").select("src", "dst", "duration"), ["src", "dst"], "left").na.fill(0, ["duration"])
)
query("partition_mapping", SPARSE + ", l as (select id, id % 10 label from d) select distinct f.author_id id, coalesce(label, 0)::bigint label from f left join l on l.id = f.author_id")(
    lambda s, d: sparse_facts(s, d).select(F.col("author_id").alias("id")).distinct().join(parts(sparse(s, d)), "id", "left").na.fill(0, ["label"])
)
query("author_master", FACTS + _BRAND + ", one as (select author_id, count(*) n from f join np using (paper_id) where np.n = 1 group by all), big as (select author_id, count(*) n from f join np using (paper_id) where np.n >= 6 group by all) select br.id author_id, label, coalesce(c.n, 0)::bigint papers, coalesce(one.n, 0)::bigint single, coalesce(big.n, 0)::bigint large from br left join (select author_id, count(*) n from f group by all) c on c.author_id = br.id left join one on one.author_id = br.id left join big on big.author_id = br.id")(
    lambda s, d: _master(s, d)
)


def _master(s: SparkSession, d: str) -> DataFrame:
    facts = authorships(s, d)
    team = facts.groupBy("paper_id").agg(F.count("*").alias("n"))
    met = facts.join(team, "paper_id")
    by = lambda rows, name: rows.groupBy("author_id").agg(F.count("*").alias(name))
    return tabulate.zero_filled(brands(s, d).withColumnRenamed("id", "author_id"), "author_id", by(facts, "papers"), by(met.where("n = 1"), "single"), by(met.where("n >= 6"), "large"))


query("ordinal_flags", "with o as (select l_orderkey paper_id, l_partkey author_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) k from (select l_orderkey, l_partkey, min(l_linenumber) l_linenumber from lineitem group by all)), fl as (select o_orderkey paper_id, 1 + o_custkey % 3 k from orders) select author_id, count(*)::bigint papers, count(fl.k)::bigint corresponding from o left join fl on fl.paper_id = o.paper_id and fl.k = o.k group by author_id")(
    lambda s, d: _ordinal(s, d)
)


def _ordinal(s: SparkSession, d: str) -> DataFrame:
    """Author order within a paper, and flags joined by that order."""
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("author_id")).agg(F.min("l_linenumber").alias("line"))
    placed = lines.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy("line", "author_id")))
    flags = table(s, d, "orders").select(F.col("o_orderkey").alias("paper_id"), (1 + F.col("o_custkey") % 3).alias("k"), F.lit(1).alias("flag"))
    return placed.join(flags, ["paper_id", "k"], "left").groupBy("author_id").agg(F.count("*").alias("papers"), F.count("flag").alias("corresponding"))


query("papers_by_dense_year", FACTS + " select y::int as year, coalesce(n, 0)::bigint papers from unnest(range(1990, 2005)) t(y) left join (select yr, count(*) n from np group by yr) on yr = y")(
    lambda s, d: tabulate.dense(authorships(s, d).groupBy("paper_id").agg(F.max("year").alias("year")).groupBy("year").agg(F.count("*").alias("papers")), "year", 1990, 2004)
)

# --- aggregations
query("discipline_avg", "with k as (select l_orderkey, count(distinct p_type) k from lineitem join part on l_partkey = p_partkey group by all), f as (select distinct l_partkey author_id, l_orderkey from lineitem) select author_id, count(*)::bigint papers, round(sum(greatest(k, 1)) / count(*)::double, 4) avg_disciplines from f join k using (l_orderkey) group by author_id")(
    lambda s, d: _discipline_avg(s, d)
)


def _discipline_avg(s: SparkSession, d: str) -> DataFrame:
    """Disciplines per paper, averaged over an author's papers; a paper without any counts one."""
    facts = table(s, d, "lineitem").select(F.col("l_partkey").alias("author_id"), F.col("l_orderkey").alias("paper_id")).distinct()
    kinds = facts.join(table(s, d, "part").select(F.col("p_partkey").alias("author_id"), "p_type"), "author_id").groupBy("paper_id").agg(F.greatest(F.lit(1), F.countDistinct("p_type")).alias("k"))
    return facts.join(kinds, "paper_id").groupBy("author_id").agg(F.count("*").alias("papers"), F.round(F.sum("k") / F.count("*"), 4).alias("avg_disciplines"))


query("community_summary", FACTS + _METRICS + _BRAND + " select label, count(*)::bigint size, round(avg(g), 6) mean_g, max(g)::bigint max_g, round(avg(h), 6) mean_h, round(avg(papers), 6) mean_papers, coalesce(sum(total_cites), 0)::bigint total_cites from br left join am using (id) group by label")(
    lambda s, d: r6(community.summary(brands(s, d), authors.author_metrics(authorships(s, d))), "mean_g", "mean_h", "mean_papers")
)
query("community_by_year", FACTS + _BRAND + ", m as (select label, paper_id, author_id, yr, cites from f join br on br.id = author_id), o as (select label, paper_id, min(yr) yr, max(cites) c from m group by all), q as (select label, yr, count(*) p, sum(c) c from o group by all), w as (select label, author_id, min(yr) yr from m group by all), z as (select label, yr, count(*) n from w group by all), b as (select coalesce(q.label, z.label) label, coalesce(q.yr, z.yr) yr, coalesce(n, 0) n, coalesce(p, 0) p, coalesce(c, 0) c from q full join z on q.label = z.label and q.yr = z.yr) select label, yr as year, (sum(n) over v)::bigint size, (sum(p) over v)::bigint papers, (sum(c) over v)::bigint cites, round((sum(c) over v) / (sum(p) over v)::double, 6) cites_per_paper from b window v as (partition by label order by yr)")(
    lambda s, d: r6(community.papers_by_year(authorships(s, d), brands(s, d)), "cites_per_paper")
)
query("network_rich_metrics", FACTS + _METRICS + " select sum(total_cites)::bigint total_cites, round(avg(total_cites), 6) mean_cites, round(avg(g), 6) mean_g, max(g)::bigint max_g, round(avg(h), 6) mean_h, round(avg(papers), 6) mean_papers from am")(
    lambda s, d: r6(authors.author_metrics(authorships(s, d)).agg(F.sum("total_cites").alias("total_cites"), F.avg("total_cites").alias("mean_cites"), F.avg("g_index").alias("mean_g"), F.max("g_index").alias("max_g"), F.avg("h_index").alias("mean_h"), F.avg("papers").alias("mean_papers")), "mean_cites", "mean_g", "mean_h", "mean_papers")
)
query("cross_community_edges", SMALL + _YE + ", fy as (select src, dst, min(yr) yr from ye group by all), x as (select least(src % 10, dst % 10) c1, greatest(src % 10, dst % 10) c2, yr, count(*) n from fy where src % 10 <> dst % 10 group by all) select c1, c2, yr as year, n::bigint as new, (sum(n) over (partition by c1, c2 order by yr))::bigint total from x")(
    lambda s, d: community.cross_edges(temporal.yearly_edges(coactive(s, d)), parts(small(s, d)))
)
query("community_start_years", FACTS + _BRAND + ", w as (select label, author_id, min(yr) yr from f join br on br.id = author_id group by all), z as (select label, yr, sum(count(*)) over (partition by label order by yr) size from w group by label, yr), l as (select label, max(size) final from z group by label) select label, min(yr)::int as start from z join l using (label) where size >= greatest(1, 0.5::double * final) group by label")(
    lambda s, d: community.start_years(community.papers_by_year(authorships(s, d), brands(s, d)), 0.5)
)
simple("ei_members", lambda e: community.ei_members(e, parts(e)), SMALL + _PART + " select id, label, count(*) filter (label <> label2)::bigint external, count(*) filter (label = label2)::bigint internal, round((count(*) filter (label <> label2) - count(*) filter (label = label2)) / count(*)::double, 6) ei from x group by id, label", "ei")
simple("dyad_density", lambda e: community.dyads(e, parts(e)), SMALL + _PART + ", n as (select label, count(*) n from lab group by all), p as (select sum(n) n, sum(n * (n - 1) / 2) w from n), o as (select case when label = label2 then 'within' else 'between' end kind, count(*) / 2 m, sum(weight) / 2 w from x group by 1) select kind, m::bigint edges, o.w::double weight, case when kind = 'within' then p.w else n * (n - 1) / 2 - p.w end::double possible, round(m / case when kind = 'within' then p.w else n * (n - 1) / 2 - p.w end::double, 6) density from o, p", "weight", "possible", "density")
simple("community_hubs", lambda e: community.hubs(e, parts(e)), SMALL + _PART + ", y as (select label, id, sum(weight)::bigint strength from x where label = label2 group by all) select label, id, strength, row_number() over (partition by label order by strength desc, id)::int rank from y qualify rank <= 4")
query("layer_crosstab", "select p_type as kind, p_brand brand, count(*)::bigint n, round(count(*) / sum(count(*)) over (partition by p_type)::double, 6) share from part group by p_type, p_brand")(lambda s, d: r6(tabulate.crosstab(table(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")), "kind", "brand"), "share"))
query("layer_stats", "select p_type as kind, count(*)::bigint n, round(avg(p_size), 6) p_size_mean, median(p_size) p_size_median, round(stddev_samp(p_size), 6) p_size_sd, round(avg(p_retailprice), 6) p_retailprice_mean, round(median(p_retailprice), 6) p_retailprice_median, round(stddev_samp(p_retailprice), 6) p_retailprice_sd from part group by 1")(
    lambda s, d: r6(tabulate.numeric_by_group(table(s, d, "part").withColumnRenamed("p_type", "kind"), "kind", "p_size", "p_retailprice"), "p_size_mean", "p_size_sd", "p_retailprice_mean", "p_retailprice_median", "p_retailprice_sd")
)
query("group_profile", "with c as (select p_brand, p_type, count(*) c from part group by all), p as (select *, c / sum(c) over (partition by p_brand)::double p, row_number() over (partition by p_brand order by c desc, p_type) r from c) select p_brand, sum(c)::bigint n, count(*)::bigint labels, round(max(p), 6) purity, round(sum(-p * ln(p)), 6) entropy, round(case when count(*) > 1 then sum(-p * ln(p)) / ln(count(*)) else 0 end, 6) entropy_norm, round(coalesce(max(p) filter (r = 1), 0), 6) share1, round(coalesce(max(p) filter (r = 2), 0), 6) share2, round(coalesce(max(p) filter (r = 3), 0), 6) share3 from p group by p_brand")(
    lambda s, d: r6(tabulate.group_profile(table(s, d, "part"), "p_brand", "p_type"), "purity", "entropy", "entropy_norm", "share1", "share2", "share3")
)
query("modal_name", "with c as (select p_brand, p_name, count(*) n from part group by all) select p_brand, p_name from c qualify row_number() over (partition by p_brand order by n desc, p_name) = 1")(lambda s, d: tabulate.modal(table(s, d, "part"), "p_brand", "p_name"))
query("yearly_rates", FACTS + " select yr as year, count(*)::bigint papers, round(avg((n = 1)::int), 6) single_rate, round(avg((n >= 4)::int), 6) large_rate from np group by yr")(
    lambda s, d: r6(authorships(s, d).groupBy("paper_id").agg(F.count("*").alias("n"), F.max("year").alias("year")).groupBy("year").agg(F.count("*").alias("papers"), F.avg((F.col("n") == 1).cast("int")).alias("single_rate"), F.avg((F.col("n") >= 4).cast("int")).alias("large_rate")), "single_rate", "large_rate")
)
query("year_log_histogram", FACTS + " select yr as year, floor(log10(cites::double) * 10 + 0.000000001)::bigint bin, count(*)::bigint n from f where cites > 0 group by all")(lambda s, d: tabulate.log_histogram(authorships(s, d), "year", "times_cited"))
query("run_stats", "select day(ts)::int step, count(*)::bigint runs, round(avg(value), 6) value_mean, round(stddev_pop(value), 6) value_std from events group by 1")(lambda s, d: r6(tabulate.run_stats(table(s, d, "events").select(F.dayofmonth("ts").alias("step"), "value"), "step", "value"), "value_mean", "value_std"))
query("region_percent", "select r_name region, count(*)::bigint n, round(100.0::double * count(*) / sum(count(*)) over (), 4) percent from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")(
    lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n")).transform(lambda n: beside(n, n.agg(F.sum("n").alias("all"))).select("region", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("percent")))
)
query("graph_summary_line", SPARSE + ", walk(id, c) as (select id, id from d union select s.other, w.c from walk w join s on s.id = w.id), z as (select c, count(*) n from (select id, min(c) c from walk group by id) group by c) select (select count(distinct author_id) from f)::bigint nodes, (select count(*) from e)::bigint edges, ((select count(distinct author_id) from f) - (select count(*) from d))::bigint isolates, ((select count(*) from z) + (select count(distinct author_id) from f) - (select count(*) from d))::bigint components, (select max(n) from z)::bigint largest, min(weight)::bigint min_weight, median(weight) median_weight, max(weight)::bigint max_weight from e")(
    lambda s, d: _summary_line(s, d)
)


def _summary_line(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = sparse_facts(s, d).select(F.col("author_id").alias("id")).distinct(), sparse(s, d)
    sizes = graph.component_labels(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    line = beside(sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes")), graph.isolates(nodes, edges).agg(F.count("*").alias("isolates")))
    return beside(line, edges.agg(F.count("*").alias("edges"), F.min("weight").alias("min_weight"), F.median("weight").alias("median_weight"), F.max("weight").alias("max_weight")))


# --- windows and order
_DAILY = "with v as (select day(ts)::int t, sum(value) v from events group by 1)"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.dayofmonth("ts").alias("t")).agg(F.sum("value").alias("v"))


query("moving_average", _DAILY + ", p as (select t, v from v union all select -k, (select v from v order by t limit 1) from range(1, 3) r(k) union all select 1000 + k, (select v from v order by t desc limit 1) from range(1, 3) r(k)), m as (select t, avg(v) over (order by t rows between 2 preceding and 2 following) x from p) select v.t, round(v.v, 6) v, round(x, 6) smooth from v join m using (t)")(lambda s, d: r6(tabulate.moving_average(_daily(s, d), "t", "v", 5), "v", "smooth"))
query("differences", _DAILY + ", a as (select t, v, v - lag(v) over (order by t) slope from v) select t, round(v, 6) v, round(slope, 6) slope, round(slope - lag(slope) over (order by t), 6) curvature from a")(lambda s, d: r6(tabulate.differences(_daily(s, d), "t", "v"), "v", "slope", "curvature"))
simple("position_intervals", lambda e: positions(graph.degrees(e), F.desc("degree"), F.asc("id")).groupBy((F.col("id") % 10).alias("label")).agg(F.min("position").alias("first"), F.max("position").alias("last")), SMALL + ", p as (select id, row_number() over (order by degree desc, id) - 1 p from d) select id % 10 label, min(p)::bigint as first, max(p)::bigint as last from p group by 1")
simple("degree_cut", lambda e: tabulate.top_share_cut(graph.degrees(e), "degree"), SMALL + " select greatest(2, max(degree))::bigint cut from (select degree, sum(count(*)) over (order by degree desc) a from d group by degree) where a >= greatest(1, floor((select count(*) from d) * 0.2::double))")
simple("node_permutation", lambda e: positions(graph.degrees(e).withColumn("label", F.col("id") % 10), F.asc("label"), F.desc("strength"), F.desc("degree"), F.asc("id")).select("id", "position"), SMALL + " select id, row_number() over (order by id % 10, strength desc, degree desc, id) - 1 as position from d")
query("attack_seeds", "select r::bigint run_id, 20260207 + 100000 + r node_seed, 20260207 + 200000 + r edge_seed from range(200) t(r)")(lambda s, d: s.range(200).select(F.col("id").alias("run_id"), (F.lit(20260207 + 100000) + F.col("id")).alias("node_seed"), (F.lit(20260207 + 200000) + F.col("id")).alias("edge_seed")))
for _name, _dir in (("strong", "desc"), ("weak", "asc")):
    simple(f"edge_order_{_name}", lambda e, dir_=_dir: positions(e, F.desc("weight") if dir_ == "desc" else F.asc("weight"), F.asc("src"), F.asc("dst")).select("src", "dst", F.col("position").alias("rank")), SMALL + f" select src, dst, row_number() over (order by weight {_dir}, src, dst) - 1 as rank from e")
counted("edge_order_overlap", lambda f: positions(twins.edge_overlap(f).withColumn("o", F.round("overlap", 9)), F.asc("o"), F.asc("src"), F.asc("dst")).select("src", "dst", F.col("position").alias("rank")), SMALL + ", c as (select e.src, e.dst, count(*) c from e join s a on a.id = e.src join s b on b.id = e.dst and b.other = a.other group by all), o as (select e.src, e.dst, case when x.degree + y.degree - 2 - coalesce(c, 0) > 0 then round(coalesce(c, 0) / (x.degree + y.degree - 2 - coalesce(c, 0))::double, 9) else 0.0::double end o from e left join c using (src, dst) join d x on x.id = e.src join d y on y.id = e.dst) select src, dst, row_number() over (order by o, src, dst) - 1 as rank from o")
counted("node_order_effective_size", lambda f: positions(twins.effective_size(f).withColumn("v", F.round("effective_size", 9)), F.desc("v"), F.asc("id")).select("id", F.col("position").alias("rank")), SMALL + _TRI + " select id, row_number() over (order by round(degree - 2.0::double * triangles / degree, 9) desc, id) - 1 as rank from lc")
simple("node_order_strength", lambda e: positions(graph.degrees(e), F.desc("strength"), F.asc("id")).select("id", F.col("position").alias("rank")), SMALL + " select id, row_number() over (order by strength desc, id) - 1 as rank from d")

# --- time
query("dynamic_tracker", SMALL + ", y as (select src, dst, yr, sum(1.0::double / (n - 1)) w from pr group by all) select src, dst, min(yr) first_year, max(yr) last_year, count(*)::bigint as years, round(sum(w), 4) weight from y group by src, dst")(lambda s, d: temporal.tracker(coactive(s, d)))
query("cumulative_network", SMALL + ", fe as (select src, dst, min(yr) yr from pr group by all), fv as (select id, min(yr) yr from (select src id, yr from fe union all select dst, yr from fe) group by id), y as (select unnest(range(1, 31))::int yr), n as (select y.yr, count(*) n from y join fv on fv.yr <= y.yr group by y.yr), m as (select y.yr, count(*) m from y join fe on fe.yr <= y.yr group by y.yr) select yr as year, n::bigint nodes, m::bigint edges, round(2.0::double * m / n, 6) avg_degree, round(2.0::double * m / (n * (n - 1)), 6) density from n join m using (yr)")(lambda s, d: r6(temporal.cumulative_degrees(coactive(s, d), list(range(1, 31))), "avg_degree", "density"))
query("node_membership", SMALL + _ALPHA + ", fy as (select author_id id, min(yr) first_year from f group by all), ac as (select id from d where degree >= 12), ae as (select e.* from e where src in (from ac) and dst in (from ac)), ad as (select id, count(*) k from (select src id from ae union all select dst from ae) group by id), bd as (select id, count(*) k from (select src id from al where au < 0.1 or av < 0.1 union all select dst from al where au < 0.1 or av < 0.1) group by id), x as (select id, first_year, coalesce(d.degree, 0) o, coalesce(ad.k, 0) a, coalesce(bd.k, 0) b from fy left join d using (id) left join ad using (id) left join bd using (id)) select id, first_year, greatest(o, a, b)::bigint degree_overall, greatest(a, b)::bigint degree_active, b::bigint degree_backbone, case when b > 0 then 'backbone' when a > 0 then 'active' when o > 0 then 'overall' else 'outside' end membership from x")(
    lambda s, d: _membership(s, d)
)


def _membership(s: SparkSession, d: str) -> DataFrame:
    facts = coactive(s, d)
    found = cut(twins.network_degrees(facts))
    nets = {name: found.where(F.col(name) > 0).select("id", F.col(name).alias("degree")) for name in ("overall", "active", "backbone")}
    first = facts.groupBy(F.col("author_id").alias("id")).agg(F.min("year").alias("first_year"))
    return temporal.membership(first, nets)


# --- structure
simple("degree_centrality", lambda e: beside(graph.degrees(e), graph.degrees(e).agg(F.count("*").alias("n"))).select("id", (F.col("degree") / (F.col("n") - 1)).alias("centrality")), SMALL + " select id, round(degree / (count(*) over () - 1)::double, 6) centrality from d", "centrality")
_BIN = "floor(log10(degree::double) * 10 + 0.000000001)::bigint"
simple("degree_pdf_logbin", metrics.log_binned_pdf, SMALL + f", b as (select {_BIN} bin, count(*) n from d group by 1) select bin, n::bigint n, round(n / (sum(n) over () * (pow(10.0::double, (bin + 1) / 10.0::double) - pow(10.0::double, bin / 10.0::double))), 6) density from b", "density")
simple("powerlaw_logbin", metrics.power_law_binned, SMALL + f", c as (select degree, count(*) f from d where degree >= 5 group by degree), b as (select floor(ln(degree / 5.0::double) / ln(pow(10.0::double, 0.1::double)) + 0.000000001) bin, sum(f * f) / sum(f)::double y from c group by 1) select round(-regr_slope(log10(y), (bin + 0.5::double) / 10), 6) alpha, round(regr_r2(log10(y), (bin + 0.5::double) / 10), 6) r2 from b", "alpha", "r2")
simple("box_dimension", lambda e: tabulate.line_fit(metrics.degree_distribution(e), F.log("degree"), F.log("n"), 1.96), SMALL + ", n as (select ln(degree) x, ln(count(*)) y from d group by degree), a as (select count(*) n, regr_slope(y, x) b, regr_intercept(y, x) i, regr_r2(y, x) r2, regr_sxx(y, x) sxx, regr_syy(y, x) syy from n) select n::bigint n, round(b, 6) slope, round(i, 6) intercept, round(r2, 6) r2, round(b - 1.96::double * sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) low, round(b + 1.96::double * sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) high from a", "slope", "intercept", "r2", "low", "high")
simple("rich_club", metrics.rich_club, SMALL + ", k as (select distinct degree k from d), n as (select k, count(*) n from k join d on degree > k group by k), m as (select k, count(*) m from k join e on true join d a on a.id = src join d b on b.id = dst where a.degree > k and b.degree > k group by k) select k::bigint k, n::bigint nodes, coalesce(m, 0)::bigint edges, case when n > 1 then round(2.0::double * coalesce(m, 0) / (n * (n - 1)), 6) end phi from n left join m using (k)", "phi")
counted("small_world", lambda f: beside(twins.local_clustering(f).agg(F.avg("clustering").alias("avg_clustering"), F.avg("degree").alias("avg_degree"), F.count("*").alias("nodes")), twins.path_summary(f)).select(((F.col("avg_clustering") / (F.col("avg_degree") / (F.col("nodes") - 1))) / (F.col("avg_path") / (F.log("nodes") / F.log("avg_degree")))).alias("sigma")), SMALL + _TRI + ", walk(source, id, h) as (select id, id, 0 from d union select w.source, s.other, w.h + 1 from walk w join s on s.id = w.id where w.h < 9), hop as (select source, id, min(h) h from walk group by all), q as (select (select avg(clustering) from lc) c, (select avg(h) from hop where h > 0) l, (select count(*) from d) n, (select avg(degree) from d) k) select round((c / (k / (n - 1))) / (l / (ln(n) / ln(k))), 6) sigma from q", "sigma")

# --- strings
query("string_scalars", "select p_partkey, coalesce(len(list_filter(string_split(p_name, ' '), lambda x: trim(x) <> '')), 0)::int words, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as key, try_cast(nullif(regexp_extract(p_brand || '-1987x', '([0-9]{4})', 1), '') as int) as year, round(1 / (1 + p_size)::double, 6) shifted, round(case when p_size > 1 then p_size / 100.0::double else p_size end, 6) fraction from part")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.part_count(F.col("p_name"), " ").alias("words"), T.squeeze(F.col("p_name")).alias("key"), T.year_of(F.concat("p_brand", F.lit("-1987x"))).alias("year"), F.round(T.distance(F.col("p_size"), "shifted"), 6).alias("shifted"), F.round(T.fraction(F.col("p_size").cast("double")), 6).alias("fraction"))
)
query("component_sizes_json", SPARSE + ", walk(id, c) as (select id, id from d union select s.other, w.c from walk w join s on s.id = w.id), z as (select count(*) n from (select id, min(c) c from walk group by id) group by c) select '[' || string_agg(n::varchar, ',' order by n desc) || ']' sizes from z")(
    lambda s, d: graph.component_labels(graph.degrees(sparse(s, d)).select("id"), sparse(s, d)).groupBy("component").agg(F.count("*").alias("n")).agg(F.to_json(F.sort_array(F.collect_list("n"), False)).alias("sizes"))
)
query("attack_curve_edges_weak")(lambda s, d: kernels.ranked_edge_curve(positions(small(s, d), F.asc("weight"), F.asc("src"), F.asc("dst")).select("src", "dst", F.col("position").alias("rank"))))


# --- people: orders as papers, part names as author names, brands as addresses
def _records(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select(F.col("p_partkey").alias("author_id"), F.col("p_name").alias("raw_name"), F.col("p_brand").alias("address"), F.array("p_type").alias("keywords"))
    return authorships(s, d).join(part, "author_id")


def _instances(s: SparkSession, d: str) -> DataFrame:
    """An instance for every part on an order."""
    name = T.clean_text(F.col("raw_name"))
    return _records(s, d).select((F.col("paper_id") * 10_000_000 + F.col("author_id")).alias("inst"), "paper_id", name.alias("name"), T.initials(name).alias("block"), "address", "keywords")


query("similar_names")(lambda s, d: people.similar_pairs(_instances(s, d).select("block", F.col("name").alias("value")), 0.6))
query("author_summary", FACTS + " select author_id, (list_sort(list(distinct paper_id)))::varchar papers, (list_sort(list(distinct yr)))::varchar as years, count(distinct paper_id)::int paper_count, sum(cites)::bigint total_cites, any_value(p_brand) top_address, any_value(p_name) author_name from f join part on p_partkey = author_id group by author_id")(
    lambda s, d: people.author_summary(_records(s, d)).select("author_id", *[F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c) for c in ("papers", "years")], "paper_count", "total_cites", "top_address", "author_name")
)


# --- teams with missing ones, fractional labels, egos and sizes of communities
def _labelled(s: SparkSession, d: str) -> DataFrame:
    kinds = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return kinds.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.year("o_orderdate").alias("year"), F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("label"))


query("team_sizes_with_missing", f"with {_RAW}, n as (select paper_id, least(count(distinct author_id), 6)::int team from raw where pos > 1 group by all), b as (select team, count(*)::bigint papers from orders left join n on paper_id = o_orderkey group by all) select team, papers, case when team is not null then round(100.0::double * papers / sum(papers) filter (team is not null) over (), 4) end share from b")(
    lambda s, d: authors.team_sizes_with_missing(
        table(s, d, "orders").select(F.col("o_orderkey").alias("paper_id")), table(s, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("author_id"))
    )
)
query("discipline_entropy_fractional", "with x as (select distinct year(o_orderdate)::int as year, l_orderkey p, coalesce(p_type, 'missing') t from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey), w as (select year, t, 1 / count(*) over (partition by year, p)::double w from x), m as (select year, t, sum(w) m from w group by all), q as (select year, m / sum(m) over (partition by year) p from m) select year, count(*)::bigint labels, round(sum(-p * ln(p)), 6) entropy, round(case when count(*) > 1 then sum(-p * ln(p)) / ln(count(*)) end, 6) evenness from q group by all")(
    lambda s, d: r6(authors.fractional_entropy(_labelled(s, d), "year"), "entropy", "evenness")
)
query("ego_edge_stats", FACTS + ", c as (select author_id, count(*) n from f group by all), z as (select author_id seed from c where n = (select max(n) from c)) select seed, o.author_id other, count(*)::bigint freq, round(avg(a.yr), 6) avg_year, min(a.yr) first_year, max(a.yr) last_year, max(a.yr) - min(a.yr) duration from z join f a on a.author_id = seed join f o on o.paper_id = a.paper_id and o.author_id <> seed group by all")(
    lambda s, d: r6(authors.ego_edge_stats(authorships(s, d), _busiest(s, d)), "avg_year")
)


def _busiest(s: SparkSession, d: str) -> DataFrame:
    """The authors with the most papers."""
    n = counts(authorships(s, d))
    return n.join(F.broadcast(n.agg(F.max("papers").alias("papers"))), "papers", "left_semi").select("id")


query("community_sizes_by_year", FACTS + _BRAND + " select yr as year, count(distinct author_id)::bigint nodes, count(distinct label)::bigint communities, round(count(distinct author_id) / count(distinct label)::double, 6) avg_size from f join br on id = author_id group by all")(
    lambda s, d: r6(authors.community_sizes_by_year(authorships(s, d), brands(s, d)), "avg_size")
)
counted("closeness_centralisation", lambda f: metrics.freeman(twins.closeness(f), "closeness"), SMALL + _REACH + ", c as (select source id, count(*) - 1 r, sum(h) t from hop group by source), v as (select case when t > 0 then (r / t::double) * (r / ((select count(*) from d) - 1)::double) else 0.0::double end x from c) select count(*)::bigint n, round((count(*) * max(x) - sum(x)) / ((count(*) - 1) * (count(*) - 2) / (2 * count(*) - 3)::double), 6) centralisation from v", "centralisation")
