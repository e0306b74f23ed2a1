"""Packed adjacency: numbers, blocks of hubs, slices and paths from it, and that edges are not shuffled again."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from knotwork.durable import Cuts
from knotwork.operators import adjacency as A
from knotwork.operators import metrics as m

EDGE = "source string, target string"


def graph(spark, seed=1, n=60, k=150):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(k)] + [("hub", f"v{i}") for i in range(n)] + [("v1", "v2")] * 3 + [("v3", "nobody"), (None, "v1")]
    return pairs, spark.createDataFrame([(f"v{i}",) for i in range(n)] + [("hub",), ("alone",), ("v1",), (None,)], "id string"), spark.createDataFrame(pairs, EDGE)


def test_numbers_have_no_gaps(spark):
    ids = spark.range(1000).select(F.concat(F.lit("x"), (F.col("id") % 700).cast("string")).alias("id"))
    rows = A.numbered(ids, Cuts(spark)).collect()
    assert sorted(r.n for r in rows) == list(range(700)) and len({r.id for r in rows}) == 700


@pytest.mark.parametrize("ways", ["out", "in", "both"])
def test_all_neighbours_with_their_weights_and_hubs_in_blocks(spark, monkeypatch, tmp_path, ways):
    monkeypatch.setattr(A, "BLOCK", 8)
    monkeypatch.setattr(A, "HOT", 20)
    pairs, nodes, edges = graph(spark)
    want = {}
    for a, b in pairs:
        if None in (a, b) or b == "nobody":
            continue
        for x, y in {"out": [(a, b)], "in": [(b, a)], "both": [(a, b), (b, a)] if a != b else []}[ways]:
            want[x, y] = 1.0 if ways == "both" else want.get((x, y), 0) + 1.0
    kept = A.pack(nodes, edges, ways, at=f"{tmp_path}/g")
    for packed in (kept, A.opened(spark, f"{tmp_path}/g")):
        name = {r.n: r.id for r in packed.vertices.collect()}
        front = packed.vertices.select(F.col("n").alias("s"), "parts", F.col("id").alias("x"))
        rows = packed.spread(front).collect()
        assert {(r.x, name[r.t]): r.w for r in rows} == want and len(rows) == len(want)
        assert packed.count == 62 and (ways == "in" or packed.vertices.where("id = 'hub'").first().parts > 4)


def hops(pairs, start):
    at, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for a, b in pairs:
            for y in ([b] if a == x else []) + ([a] if b == x else []):
                if y not in at and y not in (None, "nobody"):
                    at[y] = at[x] + 1
                    todo.append(y)
    return at


def test_slices_and_paths_as_a_plain_search_finds_them(spark):
    pairs, nodes, edges = graph(spark, n=60, k=30)
    pairs = [p for p in pairs if p[0] != "hub"]
    packed = A.pack(nodes, edges.where("source <> 'hub'"), "both")
    at = hops([p for p in pairs if None not in p], "v1")
    assert {r.id: r.hop for r in A.near(packed, "v1", 3).collect()} == {i: h for i, h in at.items() if h <= 3}
    far = max(at, key=lambda i: (at[i], i))
    steps = A.path(packed, "v1", far).orderBy("step").collect()
    assert len(steps) == at[far] > 2 and steps[0].source == "v1" and steps[-1].target == far
    assert all({(r.source, r.target), (r.target, r.source)} & set(pairs) for r in steps) and all(a.target == b.source for a, b in zip(steps, steps[1:], strict=False))
    assert A.path(packed, "v1", "alone").count() == A.path(packed, "v1", "v1").count() == A.path(packed, "v1", "nobody").count() == 0
    assert [tuple(r) for r in A.near(packed, "nobody", 2).collect()] == [("nobody", 0)]


def test_edges_are_not_shuffled_again(spark):
    _, nodes, edges = graph(spark)
    packed = A.pack(nodes, edges)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = packed.spread(packed.vertices.select(F.col("n").alias("s"), "parts"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_ranks_of_an_empty_graph_and_of_a_given_adjacency(spark):
    _, nodes, edges = graph(spark)
    assert m.pagerank(nodes.limit(0), edges).count() == 0
    packed = A.pack(nodes, edges)
    a = {r.id: r.pagerank for r in m.pagerank(nodes, edges, packed=packed).collect()}
    assert sum(a.values()) == pytest.approx(1) and len(a) == 62 and a == pytest.approx({r.id: r.pagerank for r in m.pagerank(nodes, edges).collect()})
