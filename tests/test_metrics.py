"""Metrics on small graphs with known answers."""

import pytest

from knotwork.operators import metrics as m

GRAPHS = {
    "path3": [("a", "b"), ("b", "c")],
    "star4": [("x", "h"), ("y", "h"), ("z", "h")],
    "cycle3": [("a", "b"), ("b", "c"), ("c", "a")],
    "bowtie": [("a", "b"), ("b", "m"), ("m", "a"), ("m", "c"), ("c", "d"), ("d", "m")],
    "barbell": [("a", "b"), ("b", "p"), ("p", "a"), ("p", "q"), ("q", "c"), ("c", "d"), ("d", "q")],
}


def graph(spark, pairs, more=()):
    e = spark.createDataFrame([(a, b, "calls", None) for a, b in pairs], "source string, target string, relation string, context string")
    n = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p} | set(more))], "id string")
    return n, e


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("name,want", [("path3", {"b": 1.0}), ("star4", {"h": 1.0}), ("cycle3", {}), ("bowtie", {"m": 4 / 6}), ("barbell", {"p": 0.6, "q": 0.6})])
def test_betweenness(spark, name, want):
    got = values(m.betweenness(*graph(spark, GRAPHS[name])), "betweenness")
    assert all(got[i] == pytest.approx(want.get(i, 0.0)) for i in got)


@pytest.mark.parametrize("name,want", [("path3", {"b"}), ("star4", {"h"}), ("cycle3", set()), ("bowtie", {"m"}), ("barbell", {"p", "q"})])
def test_articulation_points(spark, name, want):
    assert {r.id for r in m.articulation_points(*graph(spark, GRAPHS[name])).collect()} == want


def test_betweenness_in_chunks_is_the_same(spark):
    n, e = graph(spark, GRAPHS["barbell"])
    assert values(m.betweenness(n, e, 3), "betweenness") == pytest.approx(values(m.betweenness(n, e), "betweenness"))


def test_no_edges_isolated_nodes_and_self_loops(spark):
    n, e = graph(spark, [("a", "a")], more=("b", "c"))
    assert set(values(m.betweenness(n, e), "betweenness").values()) == {0.0}
    assert m.articulation_points(n, e).count() == 0
    assert sorted(r.component_size for r in m.components(n, e).collect()) == [1, 1, 1]
    assert set(values(m.blast_radius(n, e), "blast_radius").values()) == {0}
    assert m.communities(n, e).select("community").distinct().count() == 3


def test_components_are_numbered_by_size(spark):
    n, e = graph(spark, [("a", "b"), ("c", "d"), ("d", "e")], more=("f",))
    assert {r.id: (r.component, r.component_size) for r in m.components(n, e).collect()} == {"c": (0, 3), "d": (0, 3), "e": (0, 3), "a": (1, 2), "b": (1, 2), "f": (2, 1)}


def test_communities_find_two_triangles(spark):
    n, e = graph(spark, GRAPHS["barbell"])
    got = values(m.communities(n, e), "community")
    assert got["a"] == got["b"] == got["p"] != got["q"] == got["c"] == got["d"]
    labels = m.communities(n, e).select("id", "community")
    assert m.modularity(e, labels).first().modularity == pytest.approx(6 / 7 - 0.5)


def test_parallel_edges_weigh_in_pagerank_and_degree(spark):
    n, e = graph(spark, [("a", "b"), ("a", "b"), ("a", "c")])
    got = values(m.pagerank(n, e), "pagerank")
    assert got == pytest.approx({"a": 0.2597, "b": 0.4069, "c": 0.3333}, abs=1e-4)
    assert values(m.degrees(e), "degree") == {"a": 3, "b": 2, "c": 1}


def test_classification_is_left_out_unless_wanted(spark):
    n, e = graph(spark, [("a", "b")], more=("L",))
    e = e.unionByName(spark.createDataFrame([("a", "L", "in_family", None), ("b", "L", "in_family", None), ("b", "?", "calls", None)], e.schema))
    assert m.dependency(n, e).count() == 1 and m.dependency(n, e, True).count() == 3
    row = {r.id: r for r in m.node_metrics(n, e).collect()}
    assert row["L"].degree == 2 and row["L"].dep_degree == 0 and row["a"].dep_degree == 1 and row["b"].blast_radius == 1


def test_ranks_are_unique_and_scores_share(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 2.0), ("d", 5.0)], "id string, v double")
    assert values(m.ranked(df, "v", "k"), "k") == {"d": 1, "a": 2, "c": 3, "b": 4}
    assert values(m.bridge_score(df, "v"), "bridge_score") == pytest.approx({"b": 0, "a": 100 / 3, "c": 100 / 3, "d": 100})


def rounds(nodes, pairs):
    """PageRank round by round, and how many rounds it takes."""
    out = {i: [b for a, b in pairs if a == i] for i in nodes}
    rank, k, moved = dict.fromkeys(nodes, 1 / len(nodes)), 0, 1.0
    while moved >= m.TOLERANCE and k < m.MOST_ROUNDS:
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(rank[i] for i in nodes if not out[i])) / len(nodes))
        for i in nodes:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank, k, moved = new, k + 1, sum(abs(new[i] - rank[i]) for i in nodes)
    return rank, k


@pytest.mark.parametrize(
    "pairs,tables",
    [
        ([(f"p{i}", f"t{i * j % 7}") for i in range(40) for j in (1, 2)] + [("t0", "u"), ("t1", "u"), ("p3", "u")], 14),
        ([(f"c{i}", f"c{i + 1}") for i in range(20)], None),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("s", "a")], None),
    ],
)
def test_pagerank_of_short_paths_needs_no_rounds(spark, monkeypatch, pairs, tables):
    n, e = graph(spark, pairs)
    written, real = [], m.Cuts.table
    monkeypatch.setattr(m.Cuts, "table", lambda self, *a: written.append(1) or real(self, *a))
    got = values(m.pagerank(n, e), "pagerank")
    want, k = rounds(sorted(got), pairs)
    assert got == pytest.approx(want, rel=1e-12, abs=1e-15)
    assert k > 20 and (tables is None or len(written) <= tables)
