"""Graphs with authors of the same papers, against plain loops over all pairs."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.operators import community, graph, kernels, metrics, paths, project, temporal, twins
from tessella.operators.ranking import positions

#: 0 and 3 have the same papers, so have 5, 6 and 7, and 8 and 9, who work with nobody else; 10 is alone.
PAPERS = {"a": (1, [0, 3, 1]), "b": (2, [0, 3, 2, 4]), "c": (2, [1, 2]), "d": (3, [4, 5, 6, 7]), "e": (4, [8, 9]), "f": (5, [8, 9]), "g": (5, [1, 4]), "h": (6, [5, 6, 7, 2]), "i": (6, [10]), "j": (7, [1, 2, 4])}


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(p, a, y) for p, (y, who) in PAPERS.items() for a in who], "paper_id string, author_id long, year int")


def weights():
    return Counter(pair for _, who in PAPERS.values() for pair in combinations(sorted(who), 2))


def test_evolution_counts_every_pair_of_twins(facts):
    want, known = Counter(), set()
    for year in sorted({y for y, _ in PAPERS.values()}):
        label = {}
        for a, b in known:
            label.setdefault(a, a), label.setdefault(b, b)
        for _ in label:
            for a, b in known:
                label[a] = label[b] = min(label[a], label[b])
        now = {pair for y, who in PAPERS.values() if y == year for pair in combinations(sorted(who), 2)}
        for a, b in now:
            x, y = label.get(a), label.get(b)
            kind = "repeated" if (a, b) in known else "new_cluster" if x is None and y is None else "growth" if x is None or y is None else "intra_component" if x == y else "merge"
            want[year, kind] += 1
        known |= now
    assert {(r["year"], r["kind"]): r["n"] for r in temporal.classify_slices(facts).collect()} == want
    assert temporal.classify_slices(facts.where("paper_id in ('a', 'c')")).count() == 2


def test_twins_are_one_class(facts):
    """Before, the history held every pair of authors for each later year; now it holds a tie per class and paper."""
    from tessella.operators.twins import collapse

    got = {r["rep"]: (r["size"], r["own"], r["ids"]) for r in collapse(facts).classes.collect()}
    assert got[0] == (2, 2, [0, 3]) and got[5] == (3, 2, [5, 6, 7]) and got[8] == (2, 2, [8, 9]) and got[10] == (1, 1, [10]) and len(got) == 7


def same(got, want):
    key = lambda r: tuple((c, round(x, 9) if isinstance(x, float) else x) for c, x in sorted(r.asDict().items()))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def edges_of(spark):
    return spark.createDataFrame([(a, b, w) for (a, b), w in weights().items()], "src long, dst long, weight long")


CASES = {
    "F2": lambda f, e: (twins.spanning_tree(f), kruskal(e)),
    "F3": lambda f, e: (twins.attack_curve_by_degree(f, 4), kernels.attack_curve(e, positions(graph.degrees(e), F.desc("degree"), F.asc("id")).withColumnRenamed("position", "rank"), 4)),
    "F4": lambda f, e: (kernels.ranked_edge_curve(ranked(e), 5), curve_by_hand(e, 5)),
    "F5": lambda f, e: (twins.betweenness(f), kernels.betweenness(e)),
    "F6": lambda f, e: (twins.box_counts(f, range(2, 5)), kernels.box_counts(e, range(2, 5))),
    "F7": lambda f, e: (twins.local_clustering(f), metrics.local_clustering(e)),
    "F8": lambda f, e: (twins.closeness(f), paths.closeness(e)),
    "F10": lambda f, e: (twins.core_hd(f, 4), kernels.core_hd(e, 4)),
    "F12": lambda f, e: (twins.constraint(f), metrics.constraint(e)),
    "F14": lambda f, e: (twins.edge_overlap(f), metrics.edge_overlap(e)),
    "F15": lambda f, e: (twins.leader_rank(f, 3), paths.leader_rank(e, 3)),
    "F16": lambda f, e: (twins.participation(f, halves(e)), community.participation(e, halves(e))),
    "F17": lambda f, e: (twins.hops(f), paths.hops(e)),
    "F18": lambda f, e: (twins.effective_size(f), metrics.effective_size(e)),
    "F20": lambda f, e: (twins.path_summary(f), paths.path_summary(e)),
    "F22": lambda f, e: (twins.transitivity(f), metrics.transitivity(e)),
    "F23": lambda f, e: (twins.ego(f, 3, 2), paths.ego(e, graph.degrees(e).orderBy(F.desc("degree"), "id").limit(3), 2)),
}


def halves(e):
    return graph.degrees(e).select("id", (F.col("id") % 2).alias("label"))


def ranked(e):
    return positions(e, "weight", "src", "dst").select("src", "dst", F.col("position").alias("rank"))


def kruskal(e):
    root, rows = {}, []
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for r in sorted(e.collect(), key=lambda r: (-r["weight"], r["src"], r["dst"])):
        if find(r["src"]) != find(r["dst"]):
            root[find(r["src"])] = find(r["dst"])
            rows.append(tuple(r))
    return e.sparkSession.createDataFrame(rows, e.schema)


def curve_by_hand(e, steps):
    """Components of what is left at each step, by repeated merging of sets."""
    order = sorted((r["weight"], r["src"], r["dst"]) for r in e.collect())
    nodes, per, rows = {v for r in order for v in r[1:]}, -(-len(order) // steps), []
    for step, mark in enumerate(sorted({min(len(order), k * per) for k in range(steps + 1)})):
        sets = [{v} for v in nodes]
        for _, a, b in order[mark:]:
            met = [s for s in sets if a in s or b in s]
            sets = [s for s in sets if s not in met] + [set().union(*met)]
        rows.append((step, mark, max(map(len, sets)), len(sets), sum(len(s) * (len(s) - 1) // 2 for s in sets)))
    return e.sparkSession.createDataFrame(rows, "step long, removed long, lcc long, components long, pairs long")


@pytest.mark.parametrize("finding", CASES)
def test_equals_the_edge_list(spark, facts, finding):
    """No query of these formed fewer rows than there are pairs of authors before."""
    same(*CASES[finding](facts, edges_of(spark)))


def test_membership_degrees(facts, spark):
    e = edges_of(spark)
    nets = {"overall": e, "active": graph.induced(e, graph.degrees(e).where("degree >= 4")), "backbone": graph.backbone(project.newman(facts), 0.5)}
    want = {name: {r["id"]: r["degree"] for r in graph.degrees(net).collect()} for name, net in nets.items()}
    got = twins.network_degrees(facts, 4, 0.5).collect()
    for name, by_id in want.items():
        assert {r["id"]: r[name] for r in got if r[name]} == by_id


@pytest.fixture
def no_links(monkeypatch):
    """The list of links must not be formed: it grows with the square of a paper's authors."""

    def refuse(*_):
        raise AssertionError("the list of links was formed")

    for module, name in ((project, "full"), (project, "pairs"), (temporal, "yearly_edges")):
        monkeypatch.setattr(module, name, refuse)


#: Findings of round 3 by their cases of round 2.
FROM_PAPERS = {
    "F1 attack_curve_degree": "F3",
    "F2 box_counts": "F6",
    "F15 betweenness": "F5",
    "F6 leaderrank": "F15",
    "F4 edge_order_overlap": "F14",
    "F5 ego_2": "F23",
    "F8 avg_clustering": "F7",
    "F9 closeness": "F8",
    "F10 constraint_burt": "F12",
    "F11 edge_overlap": "F14",
    "F17 core_hd": "F10",
    "F7 small_world": "F22",
    "F3 clustering_logbin": "F7",
    "F16 closeness_centralisation": "F8",
    "F18 effective_size": "F18",
    "F19 hop_distances": "F17",
    "F20 path_summary": "F20",
}


@pytest.mark.parametrize("finding", FROM_PAPERS)
def test_from_the_papers(spark, facts, no_links, finding):
    """Before, the classes' links were listed, and over a number of classes or links the authors' were."""
    same(*CASES[FROM_PAPERS[finding]](facts, edges_of(spark)))


def test_core_hd_goes_to_the_end(spark):
    """Before, it ended after 1700 removals. A paper's authors are removed by id until two are left, who have one link each."""
    got = twins.core_hd(spark.createDataFrame([(a, "p") for a in range(1800)], "author_id long, paper_id string")).collect()
    assert sorted((r["rank"], r["id"]) for r in got) == [(k + 1, k) for k in range(1798)]
    same(kernels.core_hd(edges_of(spark)), kernels.core_hd(edges_of(spark), 10**9))


def test_evolution_from_the_papers(spark, facts, no_links):
    test_evolution_counts_every_pair_of_twins(facts)
