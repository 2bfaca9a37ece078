"""Author statistics and centralisation on tables small enough to count by hand."""

import math

from tessella.operators import authors, kernels, metrics, paths


def test_missing_teams_have_no_share(spark):
    papers = spark.createDataFrame([(k,) for k in range(1, 6)], "paper_id long")
    facts = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)] + [(4, k) for k in range(8)], "paper_id long, author_id long")
    got = {r["team"]: (r["papers"], r["share"]) for r in authors.team_sizes_with_missing(papers, facts).collect()}
    assert got == {None: (1, None), 1: (2, 50.0), 2: (1, 25.0), 6: (1, 25.0)}
    assert authors.team_sizes_with_missing(papers.limit(0), facts).count() == 0


def test_fractional_entropy(spark):
    """Paper 1 gives half to each of two labels, paper 2 all to one: masses 1.5 and 0.5; a null label is one of its own."""
    rows = [("g", 1, "a"), ("g", 1, "b"), ("g", 1, "b"), ("g", 2, "a"), ("h", 3, None)]
    got = {r["g"]: r for r in authors.fractional_entropy(spark.createDataFrame(rows, "g string, paper_id long, label string"), "g").collect()}
    want = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert abs(got["g"]["entropy"] - want) < 1e-12 and abs(got["g"]["evenness"] - want / math.log(2)) < 1e-12
    assert got["h"]["labels"] == 1 and got["h"]["entropy"] == 0 and got["h"]["evenness"] is None


def test_ego_edges(spark):
    facts = spark.createDataFrame([(1, 1, 2000), (1, 2, 2000), (2, 1, 2004), (2, 2, 2004), (3, 2, 2005), (3, 3, 2005)], "paper_id long, author_id long, year int")
    seeds = spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in authors.ego_edge_stats(facts, seeds).collect()] == [(1, 2, 2, 2002.0, 2000, 2004, 4)]


def test_years_without_communities(spark):
    facts = spark.createDataFrame([(1, 1, 2000), (1, 2, 2000), (2, 3, 2001)], "paper_id long, author_id long, year int")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "id long, label string")
    assert {tuple(r) for r in authors.community_sizes_by_year(facts, labels).collect()} == {(2000, 2, 1, 2.0), (2001, 0, 0, None)}


def test_freeman(spark):
    """A star is wholly centralised, a ring not at all, two nodes have no value."""
    star = spark.createDataFrame([(0, k, 1) for k in range(1, 6)], "src long, dst long, weight long")
    ring = spark.createDataFrame([(k, (k + 1) % 5, 1) for k in range(5)], "src long, dst long, weight long")
    for graph, want in ((star, 1.0), (ring, 0.0)):
        for scores, column in ((paths.closeness(graph), "closeness"), (kernels.betweenness(graph), "betweenness")):
            assert abs(metrics.freeman(scores, column).first()["centralisation"] - want) < 1e-9
    assert metrics.freeman(spark.createDataFrame([(0, 1.0), (1, 1.0)], "id long, closeness double"), "closeness").first()["centralisation"] is None
