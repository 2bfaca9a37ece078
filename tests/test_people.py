"""Disambiguation against a literal union-find, and the tables against small frames."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.operators import community, people, tabulate


def brute(rows):
    """rows of (inst, paper, name, block, address, keywords): author of each instance by a literal fixpoint."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a
        return a != b

    sim, later = lambda a, b: SequenceMatcher(None, *sorted((a, b))).ratio(), []
    for x, y in combinations(rows, 2):
        if x[3] != y[3] or x[1] == y[1]:
            continue
        if set(x[2].split()) == set(y[2].split()) and x[4] and y[4] and (set(x[5]) & set(y[5]) or sim(x[4], y[4]) >= 0.9):
            join(x[0], y[0])
        elif sim(x[2], y[2]) >= 0.8:
            later.append((x, y))
    near = {x[0]: [y[0] for y in rows if y[1] == x[1] and y[0] != x[0]] for x in rows}
    changed = True
    while changed:
        changed = False
        for x, y in later:
            if find(x[0]) != find(y[0]) and {find(k) for k in near[x[0]]} & {find(k) for k in near[y[0]]}:
                changed |= join(x[0], y[0])
    return {r[0]: find(r[0]) for r in rows}


@pytest.mark.parametrize("part", [2000, 1])
def test_disambiguation(spark, monkeypatch, part):
    monkeypatch.setattr(people, "PART", part)
    r, rows = random.Random(4), []
    names = ["ana lopez", "anna lopez", "ana lopes", "al ruiz", "bo chen", "bo cheng", "bob chen", "carl q diaz", "carl diaz"]
    for paper in range(18):
        for name in r.sample(names, r.randint(1, 4)):
            rows.append((len(rows), f"p{paper}", name, "".join(w[0] for w in name.split()), r.choice(["", "uni a, spain", "uni a, spain", "lab b, peru"]), r.sample(["x", "y", "z", "w", "v", "u"], 1)))
    df = spark.createDataFrame(rows + [(900, None, "ana lopez", "al", "", []), (901, "p1", None, None, None, None)], "inst long, paper_id string, name string, block string, address string, keywords array<string>")
    got = {x["inst"]: x["author"] for x in people.disambiguate(df).collect()}
    assert got == brute(rows) | {900: 900, 901: 901}
    assert len(set(got.values())) < len(got)


def test_author_summary(spark):
    rows = [("a", "p2", 2001, "u", ["k"], 3, "Ann"), ("a", "p1", 2000, "v", ["k", "j"], 2, "Ann"), ("a", "p1", 2000, "u", None, 2, "An"), ("b", "p9", None, None, [], 0, None)]
    df = spark.createDataFrame(rows, "author_id string, paper_id string, year int, address string, keywords array<string>, times_cited int, raw_name string")
    got = {x["author_id"]: x for x in people.author_summary(df).collect()}
    a = got["a"]
    assert (a["papers"], a["years"], a["addresses"], a["paper_count"], a["total_cites"], a["top_address"], a["author_name"]) == (["p1", "p2"], [2000, 2001], ["u", "v"], 2, 5, "u", "Ann")
    assert a["keywords"] == ["j", "k", "k"] and got["b"]["author_name"] is None


def test_windows(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 4.0, 9.0, 16.0])), "t long, v double")
    got = tabulate.differences(tabulate.moving_average(df, "t", "v", 3), "t", "v").orderBy("t").collect()
    assert [r["smooth"] for r in got] == pytest.approx([2, 14 / 3, 29 / 3, 41 / 3])
    assert [r["slope"] for r in got] == [None, 3, 5, 7] and [r["curvature"] for r in got] == [None, None, 2, 2]
    wide = tabulate.moving_average(df, "t", "v", 5).orderBy("t").collect()
    assert [r["smooth"] for r in wide] == pytest.approx([16 / 5, 31 / 5, 46 / 5, 61 / 5])
    with pytest.raises(ValueError):
        tabulate.moving_average(df, "t", "v", 2)


def test_prefix_labels(spark):
    paths = spark.createDataFrame([(1, [1, 1]), (2, [1, 2]), (3, [2]), (4, [1, 1, 5])], "id long, path array<int>")
    assert {r["id"]: r["label"] for r in community.prefix_labels(paths, 2).collect()} == {1: 1, 4: 1, 2: 2, 3: 3}
    assert {r["id"]: r["label"] for r in community.prefix_labels(paths, 1).collect()} == {1: 1, 2: 1, 4: 1, 3: 2}
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0)], "src long, dst long, weight double")
    lab = paths.select("id", (F.col("id") % 2).alias("label"))
    assert {r["kind"]: (r["edges"], r["possible"]) for r in community.dyads(e, lab).collect()} == {"within": (0, 2), "between": (3, 4)}
