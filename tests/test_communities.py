"""Communities against the algorithm that moves one node at a time, on fifty random graphs side by side; and that each is connected."""

import random
from collections import defaultdict

from knotwork.operators import metrics as m


def one_at_a_time(pairs):
    """Labels of Louvain by sweeps over the nodes in order, until no move gains, then over the communities."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b in pairs:
        near[a][b] = near[b][a] = 1.0
    label, total = {v: v for v in near}, sum(map(len, near.values()))
    while True:
        deg = {v: sum(n.values()) for v, n in near.items()}
        own, tot, moved = {v: v for v in near}, dict(deg), True
        while moved:
            moved = False
            for v in sorted(near):
                to = defaultdict(float)
                for u, w in near[v].items():
                    if u != v:
                        to[own[u]] += w
                tot[own[v]] -= deg[v]
                best = max([own[v], *sorted(to)], key=lambda c: to[c] - tot[c] * deg[v] / total)
                if to[best] - tot[best] * deg[v] / total <= to[own[v]] - tot[own[v]] * deg[v] / total + 1e-12:
                    best = own[v]
                moved |= best != own[v]
                own[v] = best
                tot[best] += deg[v]
        if len(set(own.values())) == len(near):
            return label
        label = {v: own[c] for v, c in label.items()}
        merged = defaultdict(lambda: defaultdict(float))
        for a, n in near.items():
            for b, w in n.items():
                merged[own[a]][own[b]] += w
        near = merged


def modularity(pairs, label):
    total, inside, deg = 2 * len(pairs), 0, defaultdict(int)
    for a, b in pairs:
        inside += 2 * (label[a] == label[b])
        deg[label[a]] += 1
        deg[label[b]] += 1
    return inside / total - sum(d * d for d in deg.values()) / total**2


def test_modularity_is_near_that_of_one_at_a_time_and_communities_are_connected(spark):
    rng, pairs = random.Random(8), set()
    for g in range(50):
        n, groups = rng.randrange(12, 28), rng.randrange(2, 4)
        for _ in range(4 * n):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b and (a % groups == b % groups or rng.random() < 0.15):
                pairs.add((f"g{g}n{min(a, b)}", f"g{g}n{max(a, b)}"))
    pairs = sorted(pairs)
    nodes = sorted({x for p in pairs for x in p})
    e, n = spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame([(x,) for x in nodes], "id string")
    label = {r.id: r.community for r in m.communities(n, e).collect()}
    assert modularity(pairs, label) >= 0.98 * modularity(pairs, one_at_a_time(pairs))
    near = defaultdict(set)
    for a, b in pairs:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(label.values()):
        own = {x for x in nodes if label[x] == c}
        seen, todo = set(), [next(iter(own))]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert seen == own
