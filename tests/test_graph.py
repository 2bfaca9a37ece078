"""Micro-graphs with answers known in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import authors, community, graph, kernels, metrics, paths, project, temporal
from tessella.operators.components import connected_components
from tessella.operators.ranking import positions, ranks


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")


def facts(spark, *rows):
    return spark.createDataFrame(rows, "paper_id string, author_id string, year int, times_cited int")


def rows(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_projection(spark):
    f = facts(spark, ("p1", "a", 1, 0), ("p1", "b", 1, 0), ("p1", "c", 1, 0), ("p2", "a", 1, 0), ("p2", "b", 1, 0), ("p3", "z", 1, 0))
    assert rows(project.full(f), "src", "dst", "weight") == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert rows(project.newman(f), "src", "dst", "weight") == {("a", "b"): 1.5, ("a", "c"): 0.5, ("b", "c"): 0.5}
    assert rows(project.jaccard(f), "src", "dst", "weight") == {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): 0.5}


def test_repeated_rows_count_as_places(spark):
    f = facts(spark, ("p", "a", 1, 0), ("p", "a", 1, 0), ("p", "b", 1, 0), ("p", "c", 1, 0))
    got = rows(project.newman_rows(f), "src", "dst", "weight")
    assert got == pytest.approx({("a", "b"): 2 / 3, ("a", "c"): 2 / 3, ("b", "c"): 1 / 3})


def test_star(spark):
    e = edges(spark, (0, 1), (0, 2), (0, 3), (0, 4))
    # A leaf's alpha is 0, the centre's 0.75 ** 3 = 0.42.
    assert graph.backbone(e, 0.1).count() == 4 and graph.backbone(e, 0.1, "and").count() == 0 and graph.backbone(e, 0.5, "and").count() == 4
    assert graph.backbone(edges(spark, (7, 8)), 0.1, "and").count() == 1
    assert {r["id"]: r["layer"] for r in community.layers(positions(graph.degrees(e), "degree", "id")).collect()}[0] == "core"
    assert metrics.centralisation(e).first()[0] == 1
    assert metrics.transitivity(e).first()[0] == 0
    assert metrics.assortativity(e).first()[0] == pytest.approx(-1)
    got = paths.path_summary(e).first()
    assert (got["avg_path"], got["efficiency"]) == pytest.approx((1.6, 0.7))
    assert rows(kernels.betweenness(e), "id", "betweenness")[(0,)] == pytest.approx(1)


def test_path_and_triangle(spark):
    p4 = edges(spark, (1, 2), (2, 3), (3, 4))
    got = paths.path_summary(p4).first()
    assert (got["avg_path"], got["diameter"], got["efficiency"]) == pytest.approx((5 / 3, 3, 13 / 18))
    assert rows(kernels.betweenness(p4), "id", "betweenness") == pytest.approx({(1,): 0, (2,): 2 / 3, (3,): 2 / 3, (4,): 0})
    t = edges(spark, (1, 2), (1, 3), (2, 3), (1, 4))
    assert rows(metrics.local_clustering(t), "id", "clustering") == pytest.approx({(1,): 1 / 3, (2,): 1, (3,): 1, (4,): 0})
    assert metrics.transitivity(t).first()["transitivity"] == pytest.approx(3 / 5)
    assert rows(metrics.edge_overlap(t), "src", "dst", "overlap") == pytest.approx({(1, 2): 0.5, (1, 3): 0.5, (2, 3): 1, (1, 4): 0})
    assert graph.k_core(t).count() == 3


def test_clique_entropy(spark):
    k4 = edges(spark, *[(a, b) for a in range(4) for b in range(a + 1, 4)])
    assert metrics.structural_entropy(k4).first()["entropy"] is None or metrics.structural_entropy(k4).first()["entropy"] == 0
    got = metrics.structural_entropy(k4, 1e-4).first()
    assert (got["entropy"], got["entropy_norm"]) == pytest.approx((math.log(4), 1))
    assert metrics.assortativity(k4).first()[0] is None


def test_h_and_g(spark):
    f = facts(spark, *[(f"p{k}", "x", 1, c) for k, c in enumerate((10, 8, 5, 4, 3))], ("q1", "y", 1, 0), ("q2", "y", 1, 0), ("r", "z", 1, 9))
    got = {r["author_id"]: (r["h_index"], r["g_index"]) for r in authors.author_metrics(f).collect()}
    assert got == {"x": (4, 5), "y": (0, 0), "z": (1, 1)}


def test_evolution(spark):
    years = {1: ["ab", "cd"], 2: ["ab", "bc", "ae", "fg"], 3: ["ad"]}
    f = facts(spark, *[(f"{y}{p}", a, y, 0) for y, ps in years.items() for p in ps for a in p])
    assert [r["edges"] for r in temporal.cumulative_sizes(f).orderBy("year").collect()] == [2, 5, 6]


def test_every_slice_is_classified(spark):
    years = {1: ["ab", "cd"], 2: ["ab", "bc", "ae", "fg"], 3: ["ad"], 5: ["dg", "xy"], 6: ["ef", "ay", "dg"]}
    f = facts(spark, *[(f"{y}{p}", a, y, 0) for y, ps in years.items() for p in ps for a in p])
    want = {1: {"new_cluster": 2}, 2: {"repeated": 1, "merge": 1, "growth": 1, "new_cluster": 1}, 3: {"intra_component": 1}, 5: {"merge": 1, "new_cluster": 1}, 6: {"intra_component": 1, "merge": 1, "repeated": 1}}
    assert rows(temporal.classify_slices(f), "year", "kind", "n") == {(y, k): n for y, kinds in want.items() for k, n in kinds.items()}
    assert temporal.classify_slices(f.limit(0)).count() == 0


def test_slices():
    assert len(temporal.slices(2006, 2025)) == 4 and len(temporal.slices(2006, 2025, "sliding")) == 16 and len(temporal.slices(2006, 2025, "cumulative")) == 16
    assert temporal.slices(2006, 2008, "cumulative", 2) == [(None, 2007), (None, 2008)] and temporal.slices(1, 3, "full") == [(1, 3)]
    assert temporal.slices(2006, 2012, size=5) == [(2006, 2010), (2011, 2012)] and temporal.slices(2006, 2012, size=5, partial="drop") == [(2006, 2010)]


def test_roles(spark):
    p = spark.createDataFrame([(0.0, 0.05), (0.0, 0.06), (0.0, 0.7), (0.0, 0.9), (2.5, 0.3), (2.5, 0.5), (3.0, 0.8)], "z double, p double")
    assert [r["role"] for r in community.roles(p).collect()] == ["ultra_peripheral", "peripheral", "connector", "kinless", "provincial_hub", "connector_hub", "kinless_hub"]


def test_components_edge_cases(spark):
    e = spark.createDataFrame([(5, 4), (4, 5), (4, 3), (9, 9), (None, 1), (8, 7), (8, 7)], "src long, dst long")
    assert rows(connected_components(e), "id", "component") == {(3,): 3, (4,): 3, (5,): 3, (9,): 9, (7,): 7, (8,): 7}
    assert connected_components(e.limit(0)).count() == 0
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(chain).select("component").distinct().collect()[0][0] == 0


def test_positions_and_ranks(spark):
    values = [5, 3, 3, 9, 3, 1, 9]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(5)
    got = {r["id"]: r["position"] for r in positions(df, "v", "id").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {r["id"]: r["rank"] for r in ranks(df, "v", "id").collect()} == {i: sorted(values).index(v) + 1 for i, v in enumerate(values)}
    assert {r["id"]: r["rank"] for r in ranks(df, "v", "id", "average").collect()} == {0: 5, 1: 3, 2: 3, 3: 6.5, 4: 3, 5: 1, 6: 6.5}
    assert positions(df.limit(0), "v", "id").count() == 0


def test_constraint(spark):
    """A triangle with a pendant, weights 2, 1, 1, 3, against the formula over all two-paths."""
    w = {(1, 2): 2, (1, 3): 1, (2, 3): 1, (1, 4): 3}
    e = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, weight long")
    both = w | {(b, a): x for (a, b), x in w.items()}
    s = {i: sum(x for (a, _), x in both.items() if a == i) for i in range(1, 5)}
    p = lambda i, j: both.get((i, j), 0) / s[i]
    want = {(i,): sum((p(i, j) + sum(p(i, q) * p(q, j) for q in s if q not in (i, j))) ** 2 for j in s if (i, j) in both) for i in s}
    assert rows(metrics.constraint(e), "id", "constraint") == pytest.approx(want)


def test_attack_and_boxes(spark):
    e = edges(spark, (0, 1), (0, 2), (0, 3), (0, 4))
    order = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], "id long, rank long")
    got = [(r["removed"], r["lcc"], r["components"]) for r in kernels.attack_curve(e, order, 5).orderBy("step").collect()]
    assert got == [(0, 5, 1), (1, 1, 4), (2, 1, 3), (3, 1, 2), (4, 1, 1), (5, 0, 0)]
    capacity = spark.createDataFrame([(0, 5.0), (2, None), (3, 2.0)], "id long, value double")
    full = kernels.attack_curve(e, order, 5, capacity).orderBy("step").collect()
    assert [(r["pairs"], r["capacity"]) for r in full] == [(10, 10.0), (0, 5.0), (0, 4.0), (0, 3.0), (0, 1.0), (0, 0.0)] and full[0]["capacity_lcc"] == 10
    weak = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 3)], "src long, dst long, rank long")
    assert [(r["removed"], r["lcc"], r["components"], r["pairs"]) for r in kernels.edge_attack_curve(e, weak, 4).orderBy("step").collect()] == [(0, 5, 1, 10), (1, 4, 2, 6), (2, 3, 3, 3), (3, 2, 4, 1), (4, 1, 5, 0)]
    assert rows(kernels.box_counts(e, range(2, 4)), "box_size", "boxes") == {(2,): 1, (3,): 1}
    weighted = spark.createDataFrame([(1, 2, 3), (2, 3, 2), (1, 3, 1)], "src long, dst long, weight long")
    assert rows(kernels.spanning_tree(weighted), "src", "dst", "weight") == {(1, 2): 3, (2, 3): 2}
