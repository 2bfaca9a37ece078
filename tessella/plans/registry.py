"""The queries over the driver tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.facts import authorships, coactive, table
from tessella.functions import text as T
from tessella.operators import authors, community, graph, kernels, metrics, paths, project, temporal, twins
from tessella.operators.ranking import beside, positions, ranks
from tessella.session import cut
from tessella.streaming.growth import activity

Query = Callable[[SparkSession, str], DataFrame]

_PAIRS = """
np as (select paper_id, count(*) n, max(yr) yr from f group by all),
pr as (select a.paper_id, n, np.yr, a.author_id src, b.author_id dst from f a join f b on a.paper_id = b.paper_id and a.author_id < b.author_id join np on np.paper_id = a.paper_id),
e as (select src, dst, count(*)::bigint weight from pr group by all),
s as (select src id, dst other, weight from e union all select dst, src, weight from e),
d as (select id, count(*)::bigint degree, sum(weight)::bigint strength from s group by id)"""
_RAW = """raw as (select l_partkey::bigint author_id, l_orderkey::bigint paper_id, year(o_orderdate)::int yr, floor(o_totalprice / 10000)::int cites, l_linenumber pos from lineitem join orders on l_orderkey = o_orderkey)"""
#: Parts on orders.
FACTS = f"with {_RAW}, f as (select author_id, paper_id, max(yr) yr, max(cites) cites from raw group by all),{_PAIRS}"
#: Users in the same minute.
SMALL = f"with recursive f as (select distinct user_id::bigint author_id, date_trunc('minute', ts) paper_id, day(ts)::int yr from events),{_PAIRS}"
#: Users in the same minute of the first day: many components, leaves and isolates.
SPARSE = SMALL.replace("from events)", "from events where day(ts) = 1)", 1)
_TRI = ", t as (select a.src a, a.dst b, b.dst c from e a join e b on a.dst = b.src join e x on x.src = a.src and x.dst = b.dst), tc as (select id, count(*) t from (select unnest([a, b, c]) id from t) group by id), lc as (select d.id, degree, strength, coalesce(t, 0)::bigint triangles, case when degree < 2 then 0.0::double else 2.0::double * coalesce(t, 0) / (degree * (degree - 1)) end clustering from d left join tc using (id))"
_REACH = ", walk(source, id, h) as (select id, id, 0 from d union select w.source, s.other, w.h + 1 from walk w join s on s.id = w.id where w.h < 9), hop as (select source, id, min(h) h from walk group by all)"
_COMP = ", walk(id, c) as (select id, id from d union select s.other, w.c from walk w join s on s.id = w.id), lab as (select id, min(c) component from walk group by id)"
_PART = ", lab as (select id, id % 10 label from d), x as (select s.*, a.label, b.label label2 from s join lab a on a.id = s.id join lab b on b.id = s.other)"
_ALPHA = ", n as (select src, dst, sum(1.0::double / (n - 1)) weight from pr group by all), ns as (select src id, weight from n union all select dst, weight from n), nd as (select id, count(*) k, sum(weight) s from ns group by id), al as (select n.*, case when a.k <= 1 then 0 else power(greatest(0, 1 - weight / a.s), a.k - 1) end au, case when b.k <= 1 then 0 else power(greatest(0, 1 - weight / b.s), b.k - 1) end av from n join nd a on a.id = src join nd b on b.id = dst)"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def small(spark: SparkSession, d: str) -> DataFrame:
    return project.full(coactive(spark, d))


def sparse_facts(spark: SparkSession, d: str) -> DataFrame:
    return coactive(spark, d).where("year = 1")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return project.full(sparse_facts(spark, d))


def parts(edges: DataFrame) -> DataFrame:
    return graph.degrees(edges).select("id", (F.col("id") % 10).alias("label"))


def _linked_parts(facts: DataFrame) -> DataFrame:
    """`parts` of the facts' edges: who shares a paper has an edge, so none is formed."""
    known = facts.where("author_id is not null and paper_id is not null")
    shared = known.groupBy("paper_id").agg(F.countDistinct("author_id").alias("n")).where("n > 1")
    return known.join(shared, "paper_id", "left_semi").select(F.col("author_id").alias("id")).distinct().withColumn("label", F.col("id") % 10)


def simple(name: str, on: Callable[[DataFrame], DataFrame], sql: str, *rounded: str) -> None:
    """A query over the small graph's edges."""
    query(name, sql)(lambda spark, d: r6(on(small(spark, d)), *rounded))


def counted(name: str, on: Callable[[DataFrame], DataFrame], sql: str, *rounded: str) -> None:
    """A query over the small graph's facts."""
    query(name, sql)(lambda spark, d: r6(on(coactive(spark, d)), *rounded))


# --- projection and filters
query("co_full", FACTS + " select * from e")(lambda s, d: project.full(authorships(s, d)))
query("co_newman", FACTS + " select src, dst, round(sum(1.0::double / (n - 1)), 6) weight from pr group by all")(lambda s, d: r6(project.newman(authorships(s, d)), "weight"))
query("co_newman_raw", f"with {_RAW}, p as (select paper_id, author_id, count(*) m from raw group by all), q as (select paper_id, sum(m) n from p group by all) select a.author_id src, b.author_id dst, round(sum(a.m * b.m / (n - 1)::double), 6) weight from p a join p b on a.paper_id = b.paper_id and a.author_id < b.author_id join q on q.paper_id = a.paper_id group by all")(lambda s, d: r6(project.newman_rows(authorships(s, d, "none")), "weight"))
query("co_jaccard", FACTS + ", c as (select author_id id, count(*) p from f group by all) select src, dst, round(weight / (a.p + b.p - weight)::double, 6) weight from e join c a on a.id = src join c b on b.id = dst")(lambda s, d: r6(project.jaccard(authorships(s, d)), "weight"))
query("edge_duration", FACTS + " select src, dst, count(*)::bigint weight, min(yr) first_year, max(yr) last_year, (max(yr) - min(yr))::int duration from pr group by all")(lambda s, d: project.edge_years(authorships(s, d)))
query("nodes_min_papers", FACTS + " select author_id, count(*)::bigint papers from f group by all having count(*) >= 2")(lambda s, d: project.paper_counts(authorships(s, d)).where("papers >= 2"))
query("backbone_disparity_or", FACTS + _ALPHA + " select src, dst, round(weight, 6) weight from al where au < 0.1 or av < 0.1")(lambda s, d: r6(graph.backbone(project.newman(authorships(s, d))), "weight"))
query("backbone_disparity_and", FACTS + _ALPHA + " select src, dst, round(weight, 6) weight from al where au < 0.1 and av < 0.1")(lambda s, d: r6(graph.backbone(project.newman(authorships(s, d)), rule="and"), "weight"))
for _rule in ("or", "and"):
    query(f"backbone_with_leaves_{_rule}", SPARSE + _ALPHA + f" select src, dst, round(weight, 6) weight from al where au < 0.1 {_rule} av < 0.1")(lambda s, d, rule=_rule: r6(graph.backbone(project.newman(sparse_facts(s, d)), rule=rule), "weight"))
query("isolates", SPARSE + " select distinct author_id id from f where author_id not in (select id from d)")(lambda s, d: graph.isolates(sparse_facts(s, d).select(F.col("author_id").alias("id")).distinct(), sparse(s, d)))
query("induced_min_papers", FACTS + ", k as (select author_id from f group by all having count(*) >= 30) select e.* from e where src in (from k) and dst in (from k)")(lambda s, d: graph.induced(project.full(authorships(s, d)), project.paper_counts(authorships(s, d)).where("papers >= 30").select(F.col("author_id").alias("id"))))
query("components", SPARSE + _COMP + " select id, component from lab")(lambda s, d: graph.component_labels(graph.degrees(sparse(s, d)).select("id"), sparse(s, d)))
query("lcc_nodes", SPARSE + _COMP + ", z as (select component, count(*) n from lab group by all) select id from lab where component = (select component from z order by n desc, component limit 1)")(lambda s, d: graph.largest_component(graph.degrees(sparse(s, d)).select("id"), sparse(s, d)))
query("component_size_dist", SPARSE + _COMP + ", z as (select component, count(*)::bigint size from lab group by all) select size, count(*)::bigint n from z group by size")(lambda s, d: graph.component_labels(graph.degrees(sparse(s, d)).select("id"), sparse(s, d)).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n")))


@query("component_size_dist_no_lcc", SPARSE + _COMP + ", z as (select component, count(*)::bigint size from lab group by all), y as (select size, count(*)::bigint n from z group by size) select size, (n - (size = (select max(size) from y))::int)::bigint n from y where n > (size = (select max(size) from y))::int")
def _no_lcc(s: SparkSession, d: str) -> DataFrame:
    n = QUERIES["component_size_dist"](s, d)
    top = F.max("size").over(Window.partitionBy())
    return n.withColumn("n", F.col("n") - F.when(F.col("size") == top, 1).otherwise(0)).where("n > 0")


query("coverage_stats", FACTS + ", p as (select distinct paper_id from pr) select (select count(*) from p)::bigint covered, round((select count(*) from f)::double / (select count(distinct author_id) from f), 6) papers_per_author")(lambda s, d: project.pairs(authorships(s, d)).agg(F.countDistinct("paper_id").alias("covered")).transform(beside, authorships(s, d).agg(F.round(F.count("*") / F.countDistinct("author_id"), 6).alias("papers_per_author"))))
query("paper_count_dist", FACTS + ", c as (select author_id, count(*)::bigint papers from f group by all) select papers, count(*)::bigint n, round(count(*) / sum(count(*)) over ()::double, 4) ratio from c group by papers")(lambda s, d: project.paper_counts(authorships(s, d)).groupBy("papers").agg(F.count("*").alias("n")).withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4)))

# --- authors
query("team_size_dist", FACTS + " select least(n, 6)::int team, count(*)::bigint papers, round(100.0::double * count(*) / sum(count(*)) over (), 4) share from np group by 1")(lambda s, d: authors.team_sizes(authorships(s, d)))
query("team_size_by_year", FACTS + " select yr as year, " + ", ".join(f"count(*) filter (least(n, 6) = {k})::bigint n{k}" for k in range(1, 7)) + ", count(*)::bigint total from np group by yr")(lambda s, d: authors.team_sizes_by_year(authorships(s, d)))
query("author_metrics_hg", FACTS + ", r as (select *, row_number() over w i, sum(cites) over w c from f window w as (partition by author_id order by cites desc, paper_id)) select author_id, count(*)::bigint papers, min(yr) first_year, max(yr) last_year, (max(yr) - min(yr))::int span, sum(cites)::bigint total_cites, round(avg(cites), 6) avg_cites, coalesce(max(case when cites >= i then i end), 0)::bigint h_index, coalesce(max(case when c >= i * i then i end), 0)::bigint g_index from r group by author_id")(lambda s, d: authors.author_metrics(authorships(s, d)))
query("role_counts", f"with {_RAW}, p as (select paper_id, min(pos) lo, max(pos) hi, count(distinct author_id) n from raw group by all) select author_id, count(distinct case when n = 1 then paper_id end)::bigint single, count(distinct case when pos = lo then paper_id end)::bigint \"first\", count(distinct case when pos = hi then paper_id end)::bigint \"last\" from raw join p using (paper_id) group by author_id")(lambda s, d: authors.author_roles(table(s, d, "lineitem").select(F.col("l_partkey").cast("long").alias("author_id"), F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"))))
query("neighbor_influence", SMALL + ", m as (select id, count(distinct other)::bigint c, avg(o.strength) v from s join d o on o.id = s.other group by s.id) ".replace("select id,", "select s.id,") + "select d.id author_id, c collaborators, round(v, 6) mean_influence, d.strength > v above from m join d using (id)")(lambda s, d: authors.neighbour_influence(small(s, d), graph.degrees(small(s, d)).select("id", F.col("strength").alias("value"))))
query("top_edges", SMALL + ", r as (select *, row_number() over (partition by id order by weight desc, other) k from s), z as (select id, coalesce(max(weight) filter (k = 1), 0) w1, coalesce(max(weight) filter (k = 2), 0) w2, coalesce(max(weight) filter (k = 3), 0) w3 from r group by id) select *, w1 sum1, w1 + w2 sum2, w1 + w2 + w3 sum3 from z")(lambda s, d: authors.top_edges(small(s, d)))
query("discipline_entropy", "with n as (select l_orderkey % 100 g, p_type t, count(*) n from lineitem join part on l_partkey = p_partkey group by all), p as (select *, n / sum(n) over (partition by g)::double p from n) select g, count(*)::bigint labels, round(sum(-p * ln(p)), 6) entropy, case when count(*) > 1 then round(sum(-p * ln(p)) / ln(count(*)), 6) else 0.0::double end entropy_norm from p group by g")(lambda s, d: authors.shannon(table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") % 100).alias("g"), F.col("p_type").alias("t")), "g", "t"))
query("discipline_count_dist", "with k as (select l_orderkey, count(distinct p_type)::bigint k from lineitem join part on l_partkey = p_partkey group by all) select k disciplines, count(*)::bigint papers from k group by k")(lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.countDistinct("p_type").alias("disciplines")).groupBy("disciplines").agg(F.count("*").alias("papers")))


@query("role_tagging", FACTS + ", c as (select author_id, count(*) p from f group by all) select author_id, case when p >= 40 then 'core' when p >= 25 then 'active' else 'marginal' end as role from c")
def _tags(s: SparkSession, d: str) -> DataFrame:
    n = project.paper_counts(authorships(s, d))
    core = n.where("papers >= 40").select("author_id", F.lit(True).alias("core"))
    active = n.where("papers >= 25").select("author_id", F.lit(True).alias("active"))
    return n.join(core, "author_id", "left").join(active, "author_id", "left").select("author_id", F.when(F.col("core"), "core").when(F.col("active"), "active").otherwise("marginal").alias("role"))


# --- time
def _slices(name: str, mode: str, found: str) -> None:
    sql = f"with {_RAW}, f as (select author_id, paper_id, max(yr) yr from raw group by all), sl as ({found}) select a first_year, b last_year, count(*)::bigint rows_in, count(distinct author_id)::bigint authors from f join sl on yr <= b and (a is null or yr >= a) group by all"
    query(name, sql)(lambda s, d: temporal.sliced(authorships(s, d), temporal.slices(1995, 2001, mode, 3)).groupBy("first_year", "last_year").agg(F.count("*").alias("rows_in"), F.countDistinct("author_id").alias("authors")))


_slices("slices_disjoint", "disjoint", "select unnest([1995, 1998, 2001]) a, unnest([1997, 2000, 2001]) b")
_slices("slices_sliding", "sliding", "select unnest(range(1995, 2000))::int a, unnest(range(1997, 2002))::int b")
_slices("slices_cumulative", "cumulative", "select null::int a, unnest(range(1997, 2002))::int b")
query("cumulative_sizes", SMALL + ", fe as (select src, dst, min(yr) yr from pr group by all), fv as (select id, min(yr) yr from (select src id, yr from fe union all select dst, yr from fe) group by id), n as (select yr, count(*) ne from fe group by yr), v as (select yr, count(*) nv from fv group by yr) select yr as year, coalesce(nv, 0)::bigint new_nodes, ne::bigint new_edges, (sum(coalesce(nv, 0)) over (order by yr))::bigint nodes, (sum(ne) over (order by yr))::bigint edges from n left join v using (yr)")(lambda s, d: temporal.cumulative_sizes(coactive(s, d)))
_YE = ", ye as (select distinct yr, src, dst from pr), yv as (select distinct yr, unnest([src, dst]) id from ye)"
query("active_jaccard", SMALL + _YE + ", a as (select yr, count(*) n from yv group by yr), b as (select yr, count(*) n from ye group by yr), ca as (select x.yr, count(*) c from yv x join yv y on y.yr = x.yr - 1 and x.id = y.id group by x.yr), cb as (select x.yr, count(*) c from ye x join ye y on y.yr = x.yr - 1 and x.src = y.src and x.dst = y.dst group by x.yr) select a.yr as year, a.n::bigint nodes, round(coalesce(ca.c, 0) / (a.n + pa.n - coalesce(ca.c, 0))::double, 6) node_jaccard, b.n::bigint edges, round(coalesce(cb.c, 0) / (b.n + pb.n - coalesce(cb.c, 0))::double, 6) edge_jaccard from a join b using (yr) left join a pa on pa.yr = a.yr - 1 left join b pb on pb.yr = a.yr - 1 left join ca on ca.yr = a.yr left join cb on cb.yr = a.yr")(lambda s, d: temporal.active_jaccard(coactive(s, d)))
query("annual_avg_degree", SMALL + _YE + " select yr as year, round(2.0::double * m / n, 6) avg_degree from (select yr, count(*) m from ye group by yr) join (select yr, count(*) n from yv group by yr) using (yr)")(lambda s, d: temporal.annual_average_degree(coactive(s, d)))
query("evolution_types", SMALL + _YE + ", ys as (select distinct yr from ye), old as (select distinct ys.yr, src, dst from ys join ye on ye.yr < ys.yr), os as (select yr, src id, dst other from old union all select yr, dst, src from old), walk(yr, id, c) as (select yr, id, id from os union select os.yr, os.other, w.c from walk w join os on os.yr = w.yr and os.id = w.id), lab as (select yr, id, min(c) c from walk group by all) select ye.yr as year, case when o.src is not null then 'repeated' when a.c = b.c then 'intra_component' when a.c is not null and b.c is not null then 'merge' when a.c is not null or b.c is not null then 'growth' else 'new_cluster' end kind, count(*)::bigint n from ye left join old o on o.yr = ye.yr and o.src = ye.src and o.dst = ye.dst left join lab a on a.yr = ye.yr and a.id = ye.src left join lab b on b.yr = ye.yr and b.id = ye.dst group by all")(lambda s, d: temporal.classify_slices(coactive(s, d)))
query("dynamic_intervals", SMALL + " select id author_id, min(yr) first_year, max(yr) last_year from (select src id, yr from pr union all select dst, yr from pr) group by id")(lambda s, d: temporal.intervals(coactive(s, d)))
query("daily_activity", "select date_trunc('day', ts) as start, event_type, count(*)::bigint n from events group by all")(lambda s, d: activity(table(s, d, "events")).drop("users"))

# --- structure
simple("network_summary", metrics.summary, SMALL + " select count(*)::bigint nodes, (sum(degree) / 2)::bigint edges, round(sum(degree) / (count(*) * (count(*) - 1))::double, 6) density, round(sum(degree) / count(*)::double, 6) avg_degree, round(sum(strength) / count(*)::double, 6) avg_strength from d", "density", "avg_degree", "avg_strength")
simple("degree_strength", graph.degrees, SMALL + " select * from d")
simple("degree_dist", metrics.degree_distribution, SMALL + " select degree, count(*)::bigint n, round(count(*) / sum(count(*)) over ()::double, 6) p from d group by degree", "p")
simple("powerlaw_raw", metrics.power_law, SMALL + ", n as (select degree, count(*) n from d group by degree) select round(-regr_slope(ln(n), ln(degree)), 6) alpha, round(regr_r2(ln(n), ln(degree)), 6) r2 from n", "alpha", "r2")
simple("hhi", metrics.hhi, SMALL + ", h as (select s.id, sum(power(weight / strength::double, 2)) h from s join d using (id) group by s.id) select round(avg(h), 6) hhi from h", "hhi")
simple("struct_entropy", metrics.structural_entropy, SMALL + ", n as (select degree, count(*) n from d group by degree), p as (select *, (degree + 1) * (1 - n / sum(n) over ()::double) r from n), i as (select n, r / sum(r * n) over () i from p) select round(-sum(case when i > 0 then n * i * ln(i) else 0 end), 6) entropy, round(-sum(case when i > 0 then n * i * ln(i) else 0 end) / ln(sum(n)), 6) entropy_norm from i", "entropy", "entropy_norm")
simple("struct_entropy_delta", lambda e: metrics.structural_entropy(e, 1e-4), SMALL + ", n as (select degree, count(*) n from d group by degree), p as (select *, (degree + 1) * (1 - n / sum(n) over ()::double + 0.0001) r from n), i as (select n, r / sum(r * n) over () i from p) select round(-sum(case when i > 0 then n * i * ln(i) else 0 end), 6) entropy, round(-sum(case when i > 0 then n * i * ln(i) else 0 end) / ln(sum(n)), 6) entropy_norm from i", "entropy", "entropy_norm")
simple("assortativity", metrics.assortativity, SMALL + " select round(corr(a.degree, b.degree), 6) assortativity from s join d a on a.id = s.id join d b on b.id = s.other", "assortativity")
counted("avg_clustering", twins.local_clustering, SMALL + _TRI + " select id, degree, triangles, round(clustering, 6) clustering from lc", "clustering")
counted("transitivity", twins.transitivity, SMALL + _TRI + " select round(2.0::double * sum(triangles) / sum(degree * (degree - 1)), 6) transitivity, round(avg(clustering), 6) avg_clustering from lc", "transitivity", "avg_clustering")
counted("clustering_logbin", lambda f: twins.local_clustering(f).where("degree >= 5 and clustering > 0").groupBy(T.log_bin(F.col("degree"), 5).alias("bin")).agg(F.count("*").alias("n"), F.avg("clustering").alias("mean"), F.median("clustering").alias("median")), SMALL + _TRI + " select floor(ln(degree / 5.0::double) / ln(pow(10.0::double, 0.1::double)) + 0.000000001)::bigint bin, count(*)::bigint n, round(avg(clustering), 6) mean, round(median(clustering), 6) median from lc where degree >= 5 and clustering > 0 group by bin", "mean", "median")
simple("knn_by_degree", metrics.neighbour_degree, SMALL + ", m as (select s.id, avg(d.degree) m from s join d on d.id = s.other group by s.id) select degree, round(avg(m), 6) knn from m join d using (id) group by degree", "knn")
counted("edge_overlap", twins.edge_overlap, SMALL + ", c as (select e.src, e.dst, count(*) c from e join s a on a.id = e.src join s b on b.id = e.dst and b.other = a.other group by all) select e.src, e.dst, case when x.degree + y.degree - 2 - coalesce(c, 0) > 0 then round(coalesce(c, 0) / (x.degree + y.degree - 2 - coalesce(c, 0))::double, 6) else 0.0::double end overlap from e left join c using (src, dst) join d x on x.id = e.src join d y on y.id = e.dst", "overlap")
simple("centralization", metrics.centralisation, SMALL + " select round((count(*) * max(degree) - sum(degree)) / ((count(*) - 1) * (count(*) - 2))::double, 6) degree_centralisation, round((count(*) - sum(strength) / max(strength)::double) / (count(*) - 1), 6) strength_centralisation from d", "degree_centralisation", "strength_centralisation")
simple("joint_degree_real", metrics.joint_degrees, SMALL + " select least(a.degree, b.degree) k1, greatest(a.degree, b.degree) k2, count(*)::bigint n, round(count(*) / sum(count(*)) over ()::double, 6) p from e join d a on a.id = src join d b on b.id = dst group by 1, 2", "p")
counted("constraint_burt", twins.constraint, SMALL + ", p as (select s.id, other, weight / strength::double p from s join d using (id)), v as (select a.id, b.other, sum(a.p * b.p) v from p a join p b on b.id = a.other where a.id <> b.other group by all) select p.id, round(sum(power(p.p + coalesce(v, 0), 2)), 6) \"constraint\" from p left join v on v.id = p.id and v.other = p.other group by p.id", "constraint")
counted("effective_size", twins.effective_size, SMALL + _TRI + " select id, round(degree - 2.0::double * triangles / degree, 6) effective_size from lc", "effective_size")

# --- paths
counted("hop_distances", lambda f: twins.hops(f).withColumn("d", F.col("d").cast("long")), SMALL + _REACH + " select source, id, h::bigint d from hop")
counted("closeness", twins.closeness, SMALL + _REACH + ", c as (select source id, count(*) - 1 r, sum(h) t from hop group by source) select id, case when t > 0 then round((r / t::double) * (r / ((select count(*) from d) - 1)::double), 6) else 0.0::double end closeness from c", "closeness")
counted("path_summary", twins.path_summary, SMALL + _REACH + " select round(avg(h), 6) avg_path, max(h)::bigint diameter, round(sum(1.0::double / h) / ((select count(*) from d) * ((select count(*) from d) - 1)), 6) efficiency from hop where h > 0", "avg_path", "efficiency")
for _r in (1, 2):
    counted(f"ego_{_r}", lambda f, r=_r: twins.ego(f, 6, r), SMALL + f", seed as (select id from d order by degree desc, id limit 6), walk(source, id, h) as (select id, id, 0 from seed union select w.source, s.other, w.h + 1 from walk w join s on s.id = w.id where w.h < {_r}), m as (select distinct source, id from walk) select m.source seed, src, dst, weight from e join m on m.id = src join m k on k.source = m.source and k.id = dst")
simple("katz_fixed_iter", lambda e: paths.katz(e, 0.01, 3), SMALL + ", k1 as (select id, 1 + 0.01::double * count(*) x from s group by id), k2 as (select s.id, 1 + 0.01::double * sum(x) x from s join k1 on k1.id = s.other group by s.id) select s.id, round(1 + 0.01::double * sum(x), 6) katz from s join k2 on k2.id = s.other group by s.id", "katz")
simple("kcore2", graph.k_core, SMALL + ", one as (select id from d where degree < 2), e2 as (select * from e where src not in (from one) and dst not in (from one)), d2 as (select id, count(*) k from (select src id from e2 union all select dst from e2) group by id), two as (select id from d2 where k < 2), e3 as (select * from e2 where src not in (from two) and dst not in (from two)), d3 as (select id, count(*) k from (select src id from e3 union all select dst from e3) group by id), three as (select id from d3 where k < 2) select * from e3 where src not in (from three) and dst not in (from three)")
query("leaderrank")(lambda s, d: r6(twins.leader_rank(coactive(s, d), 10), "score"))

# --- communities, with a partition that SQL can name
simple("ei_index", lambda e: community.ei_index(e, parts(e)), SMALL + _PART + ", y as (select label, id, count(*) filter (label <> label2) e, count(*) filter (label = label2) i from x group by all) select label, round((sum(e) - sum(i)) / sum(e + i)::double, 6) ei, round(avg((e - i) / (e + i)::double), 6) mean_ei from y group by label", "ei", "mean_ei")
_PZ = _PART + ", y as (select id, label, label2, sum(weight) w from x group by all), q as (select *, w / sum(w) over (partition by id)::double h from y), g as (select id, label, 1 - sum(h * h) p, coalesce(sum(case when label = label2 then w end), 0)::bigint internal from q group by all), z as (select label, avg(internal) m, stddev_pop(internal) sd from g group by label), zz as (select id, g.label, internal, p, case when sd > 0 then (internal - m) / sd else 0 end z from g join z on z.label = g.label)"
counted("participation_z", lambda f: twins.participation(f, _linked_parts(f)), SMALL + _PZ + " select id, label, internal, round(p, 6) p, round(z, 6) z from zz", "p", "z")
simple("role_distribution", lambda e: community.roles(community.participation(e, parts(e))).groupBy("role").agg(F.count("*").alias("n")), SMALL + _PZ + " select case when z < 2.5 then case when p <= 0.05 then 'ultra_peripheral' when p <= 0.62 then 'peripheral' when p <= 0.80 then 'connector' else 'kinless' end else case when p <= 0.30 then 'provincial_hub' when p <= 0.75 then 'connector_hub' else 'kinless_hub' end end as role, count(*)::bigint n from zz group by 1")
simple("block_matrix", lambda e: community.block_matrix(e, parts(e)), SMALL + _PART + " select label, label2, (sum(weight) / case when label = label2 then 2 else 1 end)::double weight from x group by label, label2")
simple("modularity", lambda e: community.modularity(e, parts(e)), SMALL + _PART + ", y as (select label, sum(case when label = label2 then weight else 0 end) i, sum(weight) g from x group by label) select round(sum(q), 6) q from (select i / sum(g) over ()::double - power(g / sum(g) over ()::double, 2) q from y)", "q")


def _positions(edges: DataFrame) -> DataFrame:
    """From the most peripheral node to the core."""
    return positions(graph.degrees(edges).select("id", "degree"), "degree", "id")


_POS = ", ps as (select id, row_number() over (order by degree, id) - 1 p, count(*) over () n from d)"
simple("binned_adjacency", lambda e: community.binned_adjacency(e, _positions(e), 8), SMALL + _POS + ", b as (select id, floor(p * 8 / n::double)::bigint b from ps) select least(x.b, y.b) bin1, greatest(x.b, y.b) bin2, sum(weight)::bigint weight from e join b x on x.id = src join b y on y.id = dst group by 1, 2")
simple("layers", lambda e: community.layers(_positions(e)).select("id", "layer"), SMALL + _POS + " select id, case when p < floor(n * 0.35::double) then 'periphery' when p < floor(n * 0.85::double) then 'semi_core' else 'core' end layer from ps")
query("community_tfidf", "with w as (select p_brand label, unnest(string_split(p_name, ' ')) term from part), n as (select label, term, count(*)::bigint n from w group by all), c as (select *, n / sum(n) over (partition by label)::double tf, count(*) over (partition by term) df, (select count(distinct label) from w) nl from n), z as (select label, term, n, round(tf * (ln(nl / (df + 1)::double) + 1), 9) score from c) select *, row_number() over (partition by label order by score desc, term)::int rank from z qualify rank <= 6")(lambda s, d: community.tf_idf(table(s, d, "part").select(F.col("p_brand").alias("label"), F.explode(F.split("p_name", " ")).alias("term"))))


# --- statistics of attributes
def _correlations(s: SparkSession, d: str) -> DataFrame:
    m = authors.author_metrics(authorships(s, d))
    return m.select(*[F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in (("papers", "total_cites"), ("papers", "h_index"), ("span", "g_index"))])


query("attr_correlation", FACTS + ", r as (select *, row_number() over w i, sum(cites) over w c from f window w as (partition by author_id order by cites desc, paper_id)), m as (select author_id, count(*) papers, max(yr) - min(yr) span, sum(cites) total_cites, coalesce(max(case when cites >= i then i end), 0) h_index, coalesce(max(case when c >= i * i then i end), 0) g_index from r group by author_id) select round(corr(papers, total_cites), 6) papers_total_cites, round(corr(papers, h_index), 6) papers_h_index, round(corr(span, g_index), 6) span_g_index from m")(_correlations)


def _spearman(e: DataFrame) -> DataFrame:
    d = cut(graph.degrees(e))
    x = ranks(d.select("id", "degree"), "degree", "id", "average").select("id", F.col("rank").alias("a"))
    y = ranks(d.select("id", "strength"), "strength", "id", "average").select("id", F.col("rank").alias("b"))
    return x.join(y, "id").agg(F.corr("a", "b").alias("rho"))


simple("spearman", _spearman, SMALL + ", r as (select rank() over (order by degree) + (count(*) over (partition by degree) - 1) / 2.0::double a, rank() over (order by strength) + (count(*) over (partition by strength) - 1) / 2.0::double b from d) select round(corr(a, b), 6) rho from r", "rho")


def _zscore(e: DataFrame) -> DataFrame:
    x = graph.degrees(e).select("id", F.log1p("strength").alias("x"))
    both = beside(x, x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))
    return both.select("id", F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))


simple("zscore_log1p", _zscore, SMALL + ", x as (select id, ln(1 + strength) x from d) select id, round((x - avg(x) over ()) / stddev_samp(x) over (), 6) z from x", "z")
simple("attribute_summary", lambda e: graph.degrees(e).agg(F.avg("strength").alias("mean"), F.stddev_samp("strength").alias("sd"), F.min("strength").alias("min"), F.percentile("strength", 0.25).alias("q25"), F.median("strength").alias("median"), F.percentile("strength", 0.75).alias("q75"), F.max("strength").alias("max")), SMALL + " select round(avg(strength), 6) mean, round(stddev_samp(strength), 6) sd, min(strength) min, quantile_cont(strength, 0.25) q25, median(strength) median, quantile_cont(strength, 0.75) q75, max(strength) max from d", "mean", "sd")
simple("mixing_highlow", lambda e: e.join(graph.degrees(e).select(F.col("id").alias("src"), (F.col("degree") >= 15).cast("int").alias("h1")), "src").join(graph.degrees(e).select(F.col("id").alias("dst"), (F.col("degree") >= 15).cast("int").alias("h2")), "dst").groupBy((F.col("h1") + F.col("h2")).alias("high_ends")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")), SMALL + " select ((a.degree >= 15)::int + (b.degree >= 15)::int)::int high_ends, count(*)::bigint edges, sum(weight)::bigint weight from e join d a on a.id = src join d b on b.id = dst group by 1")
simple("discretised_weights", lambda e: e.select("src", "dst", F.ceil(F.col("weight") / 2).cast("long").alias("level")), SMALL + " select src, dst, ceil(weight / 2.0::double)::bigint level from e")

# --- names
query("name_blocks", "with n as (select distinct p_name from part) select list_aggregate(list_transform(string_split(regexp_replace(trim(lower(p_name)), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: left(x, 1)), 'string_agg', '') block, count(*)::bigint names from n group by 1")(lambda s, d: table(s, d, "part").select("p_name").distinct().groupBy(T.initials(T.clean_text(F.col("p_name"))).alias("block")).agg(F.count("*").alias("names")))

# --- sequential kernels: checked by invariants in the tests
query("betweenness")(lambda s, d: r6(twins.betweenness(coactive(s, d)), "betweenness"))
query("attack_curve_degree")(lambda s, d: twins.attack_curve_by_degree(coactive(s, d)))
query("box_counts")(lambda s, d: twins.box_counts(coactive(s, d)))
query("core_hd")(lambda s, d: twins.core_hd(coactive(s, d)))
query("spanning_tree")(lambda s, d: twins.spanning_tree(coactive(s, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, fractional projection, authors of two papers at least, backbone, the strongest nodes."""
    facts = authorships(spark, sf_dir)
    edges = cut(project.newman(facts))
    counts = project.paper_counts(facts).withColumnRenamed("author_id", "id")
    _, kept = graph.run_steps(counts.select("id"), edges, counts, ["S5", "S3"])
    return r6(graph.degrees(kept), "strength").orderBy(F.desc("strength"), "id")


query("flagship", FACTS.replace("with ", "with ", 1) + ", c as (select author_id id from f group by all having count(*) >= 2), n as (select src, dst, sum(1.0::double / (n - 1)) weight from pr where src in (from c) and dst in (from c) group by all), ns as (select src id, weight from n union all select dst, weight from n), nd as (select id, count(*) k, sum(weight) s from ns group by id), al as (select n.*, case when a.k <= 1 then 0 else power(greatest(0, 1 - weight / a.s), a.k - 1) end au, case when b.k <= 1 then 0 else power(greatest(0, 1 - weight / b.s), b.k - 1) end av from n join nd a on a.id = src join nd b on b.id = dst), k as (select * from al where au < 0.1 or av < 0.1), ks as (select src id, weight from k union all select dst, weight from k) select id, count(*)::bigint degree, round(sum(weight), 6) strength from ks group by id")(flagship)
