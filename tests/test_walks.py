"""Relation paths against plain walks, and cards of a small graph."""

import random

from knotwork.operators import walks as W


def plain(edges, types, path, at):
    match path:
        case W.Rel(names):
            return {t for s, t, r in edges if s in at and r in names}
        case W.Back(of):
            every = {x for e in edges for x in e[:2]} | set(at) | set(types)
            return {x for x in every if plain(edges, types, of, {x}) & at}
        case W.Only(kinds):
            return {x for x in at if types.get(x) in kinds}
        case W.Sequence_(parts):
            for p in parts:
                at = plain(edges, types, p, at)
            return at
        case W.Choice(parts):
            return set().union(*(plain(edges, types, p, at) for p in parts))
        case W.Times(of, least, most):
            out = set()
            for k in range(most + 1):
                if k >= least:
                    out |= at
                at = plain(edges, types, of, at)
            return out


def test_paths_as_plain_walks_find_them(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("abc")) for _ in range(40)] + [("n1", "nobody", "a")]
    types = {f"n{k}": "xy"[k % 2] for k in range(12)}
    e = spark.createDataFrame(edges, "source string, target string, relation string")
    n = spark.createDataFrame(list(types.items()), "id string, type string")
    a, b, c = (W.rel(x) for x in "abc")
    front = spark.createDataFrame([(x, x) for x in types] + [("n1", "n1"), ("n1", None)], "start string, id string")
    for path in (W.rel("a", "b"), a / b, ~a, ~(a / ~b / c), (a | ~c) / W.only("x"), W.Times(a | b, 0, 2), ~W.Times(a / b, 1, 3), W.Times(c, 2, 30)):
        got = sorted(map(tuple, W.walk(front, e, n, path).select("start", "id").collect()))
        assert got == sorted((x, y) for x in types for y in plain(edges, types, path, {x})), path


def test_cards_by_type_and_layer(spark):
    nodes = [("app:A", "app", 4, "App"), ("panel:P", "appPanel", 4, "Panel"), ("wf:1", "workflow", 3, "One"), ("wf:2", "workflow", 2, "Two"), ("wf:3", "workflow", 2, "Three"), ("bo:B", "businessObject", 1, None), ("fn:F", "boFunction", 1, "Get"), ("step:S", "workflowNode", 0, "Step"), ("doc", "doc", None, "Doc")]
    edges = [("app:A", "panel:P", "contains"), ("app:A", "wf:1", "exposes_agent"), ("panel:P", "wf:1", "rendered_by"), ("wf:1", "wf:2", "calls"), ("wf:2", "wf:3", "invokes_workflow"), ("wf:3", "wf:1", "calls"), ("wf:1", "bo:B", "depends_on_data"), ("bo:B", "fn:F", "contains"), ("step:S", "fn:F", "calls_bo_function"), ("wf:1", "step:S", "contains"), ("doc", "wf:1", "documents")]
    n = spark.createDataFrame(nodes, "id string, type string, layer int, label string")
    e = spark.createDataFrame(edges, "source string, target string, relation string")
    got = {}
    for r in W.cards(n, e).collect():
        got.setdefault((r.id, r.fact), set()).add(r.other)
    assert got[("app:A", "agents")] == {"wf:1"} and got[("app:A", "panels")] == {"panel:P"} and got[("panel:P", "app")] == {"app:A"}
    assert got[("wf:1", "all that it runs")] == {"wf:1", "wf:2", "wf:3"} and got[("wf:1", "callers")] == {"wf:3"} and got[("wf:1", "apps")] == {"app:A", "panel:P"}
    assert got[("bo:B", "functions")] == {"fn:F"} and got[("bo:B", "users")] == {"wf:1"} and got[("fn:F", "steps that call it")] == {"step:S"} and got[("step:S", "workflow")] == {"wf:1"}
    assert not any(i == "doc" for i, _ in got)
    few = W.cards(n, e, of=n.where("id = 'bo:B'")).collect()
    assert {r.id for r in few} == {"bo:B"} and all(r.label in ("Get", "One") for r in few)
