"""Strong components and blast radius on graphs with cycles, against plain searches."""

import random

import pytest

from knotwork.durable import Cuts
from knotwork.operators import reach as R


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    out = {x: {b for a, b in pairs if a == x} for x in nodes}
    reached = {}
    for x in nodes:
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reached[x] = seen
    return reached


def graphs():
    rng = random.Random(3)
    yield "random", [(rng.randrange(20), rng.randrange(20)) for _ in range(32)]
    yield "two cycles and a way between", [(1, 2), (2, 3), (3, 1), (3, 9), (9, 4), (4, 5), (5, 4), (5, 5), (6, 1), (4, 7), (7, 8)]
    yield "chain", [(k, k + 1) for k in range(6)]


@pytest.mark.parametrize("name,pairs", list(graphs()))
def test_components_and_radius(spark, name, pairs):
    reached = closure(pairs)
    want = {x: max(y for y in reached[x] if x in reached[y]) for x in reached if any(y != x and x in reached[y] for y in reached[x])}
    got = R.strong_components(spark.createDataFrame(pairs, "s long, t long"), Cuts(spark)).collect()
    assert {r.v: r.comp for r in got} == want and len(got) == len(want)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in [*pairs, *pairs[:5]]] + [(None, "n1"), ("n1", None)], "source string, target string")
    nodes = spark.createDataFrame([(f"n{x}",) for x in reached] + [("alone",)], "id string")
    radius = {f"n{x}": sum(x in reached[y] for y in reached if y != x) for x in reached} | {"alone": 0}
    assert {r.id: r.blast_radius for r in R.blast_radius(nodes, edges).collect()} == radius


def test_chunks_of_sources_add_up(spark, monkeypatch):
    pairs = [(f"s{k}", f"m{k % 3}") for k in range(70_000)] + [("m0", "m1"), ("m1", "end"), ("m2", "end")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in ("m0", "m1", "m2", "end", "s5")], "id string")
    want = {"m0": 23_334, "m1": 23_334 + 23_333 + 1, "m2": 23_333, "end": 70_003, "s5": 0}
    assert {r.id: r.blast_radius for r in R.blast_radius(nodes, edges, budget=1).collect()} == want  # a bucket of sources at a time


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "a")], "source string, target string")
    assert [tuple(r) for r in R.blast_radius(nodes, edges).collect()] == [("a", 0)] and R.blast_radius(nodes.limit(0), edges).count() == 0
