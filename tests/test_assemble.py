"""Upserts: the first value that says anything, stubs that give way, in whatever order the candidates come."""

import random

from knotwork.operators import assemble

SCHEMA = "id string, seq struct<pass:int,n:int>, stub boolean, label string, lines long"


def plain(rows):
    out = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        real = next((r[1] for r in own if not r[2]), None)
        kept = [r for r in own if not r[2] or real is None or r[1] < real]
        pick = lambda k, kept=kept: next((r[k] for r in kept if r[k] not in (None, "")), None)
        out[i] = (own[0][1] if kept else None, all(r[2] for r in own), pick(3), pick(4))
    return out


def test_as_read_one_by_one(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", "d", None]), (rng.randrange(3), k), rng.random() < 0.5, rng.choice(["", None, f"l{k}"]), rng.choice([None, 0, k])) for k in range(60)]
    rows += [("hot", (1, k), k % 2 == 0, None if k < 300 else f"h{k}", k) for k in range(1000)] + [("stub", (0, 0), True, "s", None)]
    rng.shuffle(rows)
    got = assemble.upsert(spark.createDataFrame(rows, SCHEMA))
    assert {r.id: (tuple(r.seq), r.stub, r.label, r.lines) for r in got.collect()} == plain(rows)
    plan = assemble.upsert(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert assemble.upsert(spark.createDataFrame([], SCHEMA)).count() == 0


def test_candidates_are_made_once(spark):
    rows = [("a", (1, 0), False, "x", 1), ("a", (0, 0), True, None, 2), ("b", (0, 1), True, "y", None)]
    plan = assemble.upsert(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
