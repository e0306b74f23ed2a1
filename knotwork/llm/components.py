"""Distributed union-find: connected components by randomised contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts, empty


def components(spark: SparkSession, edges: DataFrame, cuts: Cuts, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round orders the nodes by a fresh hash, hooks every node to the least node among itself and its neighbours, and
    contracts the edges along these hooks. A constant share of the nodes goes in each round whatever the shape of the graph,
    chains included, so the rounds are logarithmic in the nodes. Minima combine before the shuffle, so hubs do no harm.
    Nulls on either side and self-loops are left out; no edges give no rows.
    """
    e = cuts.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges0")
    held, k = None, 0
    while not empty(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        hooks = both.groupBy("a").agg(F.min(at("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", at("a"))["n"].alias("to"))
        hooks = cuts.table(hooks, f"{name}-hooks{k}")
        new = e.join(hooks.toDF("a", "ta"), "a").join(hooks.toDF("b", "tb"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        new = cuts.table(new, f"{name}-edges{k + 1}")
        if held is None:
            held = hooks
        else:
            far = held.join(hooks.toDF("to", "next"), "to", "left")
            held = cuts.table(far.select("node", F.coalesce("next", "to").alias("to")), f"{name}-held{k}")
            cuts.drop(f"{name}-hooks{k}")
            if k > 1:
                cuts.drop(f"{name}-held{k - 1}")
        cuts.drop(f"{name}-edges{k}")
        e, k = new, k + 1
    if held is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = held.groupBy("to").agg(F.min("node").alias("component"))
    return cuts.table(held.join(least, "to").select("node", "component"), f"{name}-out")
