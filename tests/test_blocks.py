"""Blocks and betweenness by blocks on random graphs, against plain searches."""

import random
from collections import defaultdict, deque

import pytest

from knotwork.operators import blocks as B


def tangled(seed):
    """Two dense parts, chains, leaves and a second component."""
    rng = random.Random(seed)
    e = [(f"a{rng.randrange(7)}", f"a{rng.randrange(7)}") for _ in range(12)] + [(f"b{rng.randrange(5)}", f"b{rng.randrange(5)}") for _ in range(8)]
    e += [("a0", "c0"), ("c0", "c1"), ("c1", "b0"), ("a1", "l0"), ("a1", "l1"), ("b2", "l2"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "w")]
    return e


def plain(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, todo = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += paths[x]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def parted(nodes, pairs):
    def count(left):
        near = defaultdict(set)
        for a, b in pairs:
            if a in left and b in left:
                near[a].add(b)
                near[b].add(a)
        seen, n = set(), 0
        for x in left:
            if x not in seen:
                n, todo = n + 1, [x]
                while todo:
                    y = todo.pop()
                    if y not in seen:
                        seen.add(y)
                        todo += near[y]
        return n

    every = set(nodes)
    return {x for x in every if count(every - {x}) > count(every)}


@pytest.mark.parametrize("seed", [4])
def test_as_plain_searches_find_it(spark, seed):
    pairs = tangled(seed)
    nodes = sorted({x for p in pairs for x in p} | {"alone"})
    n, e = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(pairs, "source string, target string")
    given = B.found(n, e)
    got = {r.id: r.betweenness for r in B.betweenness(n, e, given=given).collect()}
    assert got == pytest.approx(plain(nodes, pairs))
    assert {r.id for r in B.articulation_points(n, e, given).collect()} == parted(nodes, pairs)
    w = B.work(given).first()
    simple = {frozenset(p) for p in pairs if p[0] != p[1]}
    assert w.edges == len(simple) and w.steps < w.steps_without / 2 and w.searched <= w.blocks
    for r in given.members.groupBy("block").agg({"weight": "sum"}).collect():
        size = 4 if r.block in "xyzw" else len(nodes) - 5
        assert r["sum(weight)"] == size


def test_budget_deals_sources_to_chunks(spark, monkeypatch):
    pairs = tangled(1)
    nodes = sorted({x for p in pairs for x in p})
    n, e = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(pairs, "source string, target string")
    seen, real = [], B._searched
    monkeypatch.setattr(B, "_searched", lambda *a: seen.append(a[2:]) or real(*a))
    got = {r.id: r.betweenness for r in B.betweenness(n, e, budget=40).collect()}
    assert len(seen) > 1 and got == pytest.approx(plain(nodes, pairs))


def test_nodes_with_the_same_neighbours_are_searched_as_one(spark, monkeypatch):
    pairs = [(f"p{k}{i}", f"t{t}") for k, ts in enumerate(((0, 1, 2), (2, 3), (3, 4, 5, 0))) for i in range(9) for t in ts]
    pairs += [("p00", "leaf"), ("p00", "more"), ("p11", "less"), ("p20", "p21"), ("u0", "v0"), ("u0", "v1"), ("u1", "v0"), ("u1", "v1")]
    nodes = sorted({x for p in pairs for x in p})
    n, e = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(pairs, "source string, target string")
    seen, real = [], B._searched
    monkeypatch.setattr(B, "_searched", lambda member, *a: seen.append(member.count()) or real(member, *a))
    got = {r.id: r.betweenness for r in B.betweenness(n, e).collect()}
    assert got == pytest.approx(plain(nodes, pairs))
    assert sum(seen) <= 14 and len(nodes) == 40
