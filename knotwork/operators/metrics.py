"""Structural metrics of a typed graph: the views they are computed on, centrality, fragility, communities, ranks. Everything is joins, aggregations and loops of them; no task or driver holds a graph."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.durable import Cuts, cut, empty
from knotwork.functions.text import significant
from knotwork.operators.adjacency import Packed, pack
from knotwork.operators.blocks import articulation_points as articulation_points
from knotwork.operators.blocks import betweenness as betweenness
from knotwork.operators.blocks import found
from knotwork.operators.reach import blast_radius as blast_radius

DAMPING = 0.85
#: PageRank has converged when a round moves less than this in L1; rounds at most.
TOLERANCE, MOST_ROUNDS = 1e-9, 200
#: Steps along edges that PageRank sums up once for all rounds; where paths are longer, rounds are made one by one.
STEPS = 12
#: Sweeps of a level, levels, and the least gain that counts, when communities are sought.
SWEEPS, LEVELS, GAIN = 20, 20, 1e-12


def dependency(nodes: DataFrame, edges: DataFrame, include_all: bool = False) -> DataFrame:
    """The edges that path metrics are computed on: both ends are nodes, no self-loops, no relations that only classify (unless all are wanted). Parallel edges stay."""
    ids = nodes.select("id")
    kept = edges.where("source <> target")
    if not include_all:
        kept = kept.where(S.visible(F.col("relation")))
    return kept.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected pairs (a, b), each in both directions, without parallels and self-loops."""
    ends = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    return edges.where("source <> target").select(F.inline(ends)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every node that has an edge, parallel edges counted; one shuffle, pre-aggregated."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.inline(ends)).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = MOST_ROUNDS, tolerance: float | None = TOLERANCE, packed: Packed | None = None) -> DataFrame:
    """(id, pagerank) once a round moves less than the tolerance in L1, or after the rounds; without a tolerance all rounds are made.

    What nodes without out-edges hold is spread evenly over all. Parallel edges are one edge of that weight. The edges lie packed and
    partitioned (or are given so, packed along them). A round gives every node the same share and passes on what it had, so after k rounds
    a rank is a sum over steps j of what reaches the node from all others in j steps, times a factor that is the same for all nodes.
    Where paths are no longer than STEPS (without cycles), these sums are all there is: the factors of all rounds follow from their totals.
    Otherwise the rounds beyond are made one by one: a round shuffles ranks to the edges and what they pass on, summed before the shuffle,
    and tells in passing how much is to be spread and how far it moved.
    """
    packed = packed or pack(nodes, edges)
    cuts, total = Cuts(nodes.sparkSession), max(packed.count, 1)
    vertex = packed.vertices.select(F.col("n").alias("s"), "parts", "out")
    passed = lambda front, x: packed.spread(front.where("parts > 0").select("s", "parts", (F.col(x) / F.col("out")).alias("x"))).groupBy(F.col("t").alias("s")).agg((DAMPING * F.sum(F.col("x") * F.col("w"))).alias("x"))
    steps, held, whole = [vertex.withColumn("x", F.lit(1.0))], [float(vertex.where("parts = 0").count())], False
    while len(steps) <= min(STEPS, rounds):
        seen = Observation()
        watched = passed(steps[-1], "x").join(vertex, "s").observe(seen, F.sum(F.when(F.col("parts") == 0, F.col("x"))).alias("held"), F.count_if(F.col("parts") > 0).alias("going"))
        steps.append(cuts.table(watched, f"step{len(steps)}"))
        held.append(seen.get["held"] or 0.0)
        if not seen.get["going"]:
            whole = True
            break
    names = [f"x{j}" for j in range(len(steps))]
    sums = reduce(DataFrame.unionByName, [df.select("s", *((F.col("x") if i == j else F.lit(0.0)).alias(c) for i, c in enumerate(names))) for j, df in enumerate(steps)]).groupBy("s").agg(*(F.sum(c).alias(c) for c in names))
    sums = cuts.table(sums, "sums")
    last = rounds if whole else min(len(steps) - 1, rounds)
    even: list[float] = []  # what a round gives to every node
    factors = lambda k: [even[k - 1 - j] if j < k else 1.0 / total if j == k else 0.0 for j in range(len(steps))]
    mix = lambda by: reduce(lambda a, b: a + b, [F.col(c) * f for c, f in zip(names, by, strict=True)])
    for k in range(last):
        even.append((1 - DAMPING) / total + DAMPING * math.fsum(f * h for f, h in zip(factors(k), held, strict=True)) / total)
    # What a round moves becomes less with every round, so the first that moves little is sought by halves, many at once.
    low, high, settled = 0, last + 1, False
    while tolerance is not None and high - low > 1:
        tried = sorted({low + -(-(high - low) * i // 17) for i in range(1, 17)} - {low, high})
        moved = sums.agg(*(F.sum(F.abs(mix([a - b for a, b in zip(factors(k), factors(k - 1), strict=True)]))).alias(f"k{k}") for k in tried)).first()
        low = max([low, *(k for k in tried if (moved[f"k{k}"] or 0.0) >= tolerance)])
        high = min([high, *(k for k in tried if (moved[f"k{k}"] or 0.0) < tolerance)])
    if tolerance is not None and high <= last:
        last, settled = high, True
    rank = sums.select("s", mix(factors(last)).alias("r"))
    if not settled and last < rounds:
        rank = _rounds(packed, passed, cuts.table(vertex.join(rank, "s"), "rank"), last, rounds, tolerance, cuts)
    return rank.join(packed.vertices.select(F.col("n").alias("s"), "id"), "s").select("id", F.col("r").alias("pagerank"))


def _rounds(packed: Packed, passed: Callable[[DataFrame, str], DataFrame], rank: DataFrame, made: int, rounds: int, tolerance: float | None, cuts: Cuts) -> DataFrame:
    """rank (s, parts, out, r) after so many rounds, once more have been made one by one."""
    total, last = max(packed.count, 1), None
    lost = rank.where("parts = 0").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
    for k in range(made + 1, rounds + 1):
        new = rank.withColumnRenamed("r", "old").join(passed(rank, "r"), "s", "left")
        new = new.select("s", "parts", "out", "old", ((1 - DAMPING) / total + DAMPING * lost / total + F.coalesce("x", F.lit(0.0))).alias("r"))
        seen = Observation()
        watched = new.observe(seen, F.sum(F.when(F.col("parts") == 0, F.col("r")).otherwise(0.0)).alias("lost"), F.sum(F.abs(F.col("r") - F.col("old"))).alias("moved"))
        rank = cuts.table(watched.drop("old"), f"rank{k}")
        if last:
            cuts.drop(last)
        last, lost = f"rank{k}", seen.get["lost"] or 0.0
        if tolerance is not None and (seen.get["moved"] or 0.0) < tolerance:
            break
    return rank


def below(df: DataFrame, column: str) -> DataFrame:
    """(column, n_below, n): each value with how many rows have a smaller one, and how many have it.

    Values are counted first and ranged over partitions; each partition adds its own running count to what the ones before it hold.
    Only one number for each partition passes through a single task.
    """
    per = cut(df.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()))
    sums = per.groupBy("_p").agg(F.sum("n").alias("_s"))
    before = sums.select("_p", (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_s")).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return per.withColumn("_own", own).join(F.broadcast(before), "_p").select(column, (F.col("_own") + F.col("_before")).alias("n_below"), "n")


def bridge_score(df: DataFrame, column: str) -> DataFrame:
    """df with bridge_score: 100 times the share of other rows with a smaller value; ties share the lowest, one row alone has 0."""
    total = df.count()
    share = below(df, column).select(F.col(column).alias("_v"), (100.0 * F.col("n_below") / max(total - 1, 1)).alias("bridge_score"))
    return df.join(share, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def ranked(df: DataFrame, column: str, name: str, by: str = "id") -> DataFrame:
    """df with a rank from 1, the largest value first, ties by another column: ranks are unique."""
    first = below(df.select((-F.col(column)).alias("_v")), "_v").select("_v", "n_below")
    place = F.row_number().over(Window.partitionBy("_v").orderBy(by))
    return df.withColumn("_v", -F.col(column)).withColumn("_k", place).join(first, "_v").withColumn(name, F.col("n_below") + F.col("_k")).drop("_v", "_k", "n_below")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, component_size): components are numbered from 0 by size, the largest first, ties by least id; isolated nodes are components."""
    cuts = Cuts(nodes.sparkSession)
    least = contracted(both_ways(edges).where("a < b"), cuts)
    label = cuts.table(nodes.select("id").distinct().join(least.toDF("id", "c"), "id", "left").select("id", F.coalesce("c", "id").alias("label")), "labels")
    sizes = label.groupBy("label").agg(F.count("*").alias("component_size"))
    number = ranked(sizes, "component_size", "k", "label").select("label", "component_size", (F.col("k") - 1).cast("int").alias("component"))
    return label.join(number, "label").select("id", "component", "component_size")


def contracted(edges: DataFrame, cuts: Cuts, name: str = "cc") -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the least node reachable.

    In each round nodes hook to the least neighbour in a fresh random order and edges contract along the hooks: a constant share of
    the nodes goes whatever the shape of the graph, so rounds are logarithmic.
    """
    e = cuts.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    held, k = None, 0
    while not empty(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        at = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        hooks = cuts.table(both.groupBy("a").agg(F.min(at("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", at("a"))["n"].alias("to")), f"{name}-h{k}")
        e = cuts.table(e.join(hooks.toDF("a", "ta"), "a").join(hooks.toDF("b", "tb"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), f"{name}-e{k + 1}")
        cuts.drop(f"{name}-e{k}")
        held = hooks if held is None else cuts.table(held.join(hooks.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{name}-m{k}")
        k += 1
    if held is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return held.join(held.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering): twice the links among neighbours by d(d-1), 0 below two neighbours. Wedges start from the end of lower degree, so hubs make few."""
    return clustering_of_classes(nodes.withColumn("n", F.lit(1).cast("long")), edges.where("source <> target"))


def clustering_of_classes(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering) of the nodes that each class (id, n) stands for. An edge links all of one class to all of the other, and with both ends the same, all of a class to one another. An end that is no class is one node."""
    size = classes.select("id", "n")
    among = edges.where("source = target").select(F.col("source").alias("id")).distinct().join(size, "id").select("id", (F.col("n") - 1).alias("own"))
    size = cut(size.join(among, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own")))
    end = lambda c, n, own: size.select(F.col("id").alias(c), F.col("n").alias(n), F.col("own").alias(own))
    und = cut(both_ways(edges).join(end("b", "nb", "ownb"), "b", "left").na.fill({"nb": 1, "ownb": 0}))
    # A class links a node to its members; those that are linked among themselves close their own wedges.
    deg = cut(und.groupBy("a").agg(F.sum("nb").alias("d"), F.sum(F.col("nb").cast("double") * F.col("ownb") / 2).alias("inner")))
    rank = lambda d, i: F.struct(F.col(d), F.col(i))
    up = cut(und.join(deg.select("a", "d"), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").where(rank("d", "a") < rank("e", "b")).select("a", "b", "e", "nb").join(end("a", "na", "owna").drop("owna"), "a", "left").na.fill({"na": 1}))
    wedge = up.alias("x").join(up.alias("y"), F.col("x.a") == F.col("y.a")).where(F.struct("x.e", "x.b") < F.struct("y.e", "y.b"))
    wedge = wedge.select(F.col("x.a").alias("u"), F.col("x.b").alias("v"), F.col("y.b").alias("w"), F.col("x.na").alias("nu"), F.col("x.nb").alias("nv"), F.col("y.nb").alias("nw"))
    times = lambda x, y: F.col(x).cast("double") * F.col(y)
    closed = wedge.join(up.select("a", "b"), (F.col("v") == F.col("a")) & (F.col("w") == F.col("b"))).select(F.inline(F.array(F.struct(F.col("u").alias("id"), times("nv", "nw").alias("t")), F.struct(F.col("v").alias("id"), times("nu", "nw").alias("t")), F.struct(F.col("w").alias("id"), times("nu", "nv").alias("t")))))
    count = closed.groupBy("id").agg(F.sum("t").alias("t"))
    joined = size.join(deg.withColumnRenamed("a", "id"), "id", "left").join(count, "id", "left").na.fill(0, ["d", "inner", "t"])
    own, d = F.col("own").cast("double"), F.col("d").cast("double") + F.col("own")
    links = F.col("t") + F.col("inner") + own * F.col("d") + own * F.greatest(own - 1, F.lit(0.0)) / 2
    return joined.select("id", F.when(d > 1, 2.0 * links / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, modularity: of labels (id, label) over the undirected simple graph; 0 without edges."""
    und = both_ways(edges).join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    by = und.groupBy(F.col("la").alias("label")).agg(F.count("*").alias("tot"), F.count_if(F.col("la") == F.col("lb")).alias("inside"))
    sums = by.agg(F.sum("tot").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("tot").cast("double") * F.col("tot")).alias("sq"))
    return sums.select(F.coalesce(F.col("i") / F.col("m2") - F.col("sq") / (F.col("m2").cast("double") * F.col("m2")), F.lit(0.0)).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community, community_size): a distributed Louvain, community 0 the largest, ties by least id; isolated nodes are communities.

    In a sweep half of the nodes, by hash, may move to the neighbouring community of the largest gain in modularity; ties go to the least
    community. When two sweeps in a row move none, communities that fell apart are parted into what is connected, which never lowers the
    modularity, and become nodes, and the next level begins; a level that does not lower the count of communities is discarded and the
    last. The one-at-a-time order of the sequential algorithm is not kept, so that labels can differ from its; modularity is what to compare.
    """
    cuts = Cuts(nodes.sparkSession)
    links = cuts.table(both_ways(edges).withColumn("w", F.lit(1.0)), "links0")
    total = links.agg(F.sum("w")).first()[0]
    member = cuts.table(nodes.select("id", F.col("id").alias("c")), "member0")
    for level in range(LEVELS if total else 0):
        deg = cuts.table(links.groupBy("a").agg(F.sum("w").alias("d")), f"deg{level}")
        comm = cuts.table(deg.select("a", F.col("a").alias("c"), "d"), f"comm{level}")
        idle, moved_any = 0, False
        for sweep in range(SWEEPS):
            sums = comm.groupBy("c").agg(F.sum("d").alias("tot"))
            turn = comm.where(F.pmod(F.xxhash64(F.lit(sweep), "a"), F.lit(2)) == 0)
            near = links.where("a <> b").join(comm.select(F.col("a").alias("b"), F.col("c").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
            offer = turn.join(near, "a").join(sums.select(F.col("c").alias("to"), "tot"), "to")
            gain = F.col("w") - F.when(F.col("to") == F.col("c"), F.col("tot") - F.col("d")).otherwise(F.col("tot")) * F.col("d") / total
            offer = offer.withColumn("gain", gain)
            stay = turn.join(sums, "c").join(near.withColumnRenamed("to", "c"), ["a", "c"], "left").select("a", (F.coalesce("w", F.lit(0.0)) - (F.col("tot") - F.col("d")) * F.col("d") / total).alias("stay"))
            best = offer.where("to <> c").groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("best"))
            go = best.join(stay, "a").where(-F.col("best.g") > F.col("stay") + GAIN).select("a", F.col("best.to").alias("new"))
            go, moves = cuts.counted(go, f"go{level}-{sweep}")
            if not moves:
                idle += 1
                if idle > 1:
                    break
                continue
            idle, moved_any = 0, True
            comm = cuts.table(comm.join(go, "a", "left").select("a", F.coalesce("new", "c").alias("c"), "d"), f"comm{level}-{sweep}")
        if not moved_any:
            break
        inner = links.where("a < b").join(comm.select("a", F.col("c").alias("ca")), "a").join(comm.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
        whole = contracted(inner, cuts, f"whole{level}")
        comm, before = cuts.counted(comm.join(whole.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("component", "a").alias("c"), "d"), f"parted{level}")
        if comm.select("c").distinct().count() == before:
            break
        member = cuts.table(member.join(comm.select(F.col("a").alias("c"), F.col("c").alias("new")), "c", "left").select("id", F.coalesce("new", "c").alias("c")), f"member{level + 1}")
        name = lambda c, to: comm.select(F.col("a").alias(c), F.col("c").alias(to))  # noqa: B023, E731
        links = cuts.table(links.join(name("a", "x"), "a").join(name("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), f"links{level + 1}")
    sizes = member.groupBy("c").agg(F.count("*").alias("community_size"), F.min("id").alias("least"))
    number = ranked(sizes, "community_size", "k", "least").select("c", "community_size", (F.col("k") - 1).cast("int").alias("community"))
    return member.join(number, "c").select("id", "community", "community_size")


def node_metrics(nodes: DataFrame, edges: DataFrame, include_all: bool = False, chunks: int | None = None) -> DataFrame:
    """Every metric of every node in one table: ranks, scores and counts, over the dependency edges; degrees over all typed edges."""
    ids = nodes.select("id")
    full = edges.where("source <> target").join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    dep = cut(dependency(nodes, edges, include_all))
    rank = ranked(pagerank(nodes, dep), "pagerank", "pagerank_rank")
    parts_of = found(nodes, dep)
    score = bridge_score(betweenness(nodes, dep, chunks, given=parts_of), "betweenness")
    zero = lambda df, *cs: [F.coalesce(c, F.lit(0)).alias(c) for c in cs]
    parts = [rank, score, communities(nodes, dep), components(nodes, dep), clustering(nodes, dep), blast_radius(nodes, dep), articulation_points(nodes, dep, parts_of).withColumn("articulation", F.lit(True)), degrees(full), degrees(dep).select("id", F.col("degree").alias("dep_degree"))]
    out = reduce(lambda a, b: a.join(b, "id", "left"), parts, ids)
    return out.select(
        "id", significant(F.col("pagerank"), 6).alias("pagerank"), "pagerank_rank", significant(F.col("betweenness"), 6).alias("betweenness"), significant(F.col("bridge_score"), 4).alias("bridge_score"), "community", "community_size",
        "component", "component_size", significant(F.col("clustering"), 4).alias("clustering"), "blast_radius", F.coalesce("articulation", F.lit(False)).alias("articulation"), *zero(out, "in_degree", "out_degree", "degree", "dep_degree"),
    )


def spanned(df: DataFrame, column: str, name: str = "size") -> DataFrame:
    """df with a size from 3.4 to 15.4 by the root of a value's share of the largest, which is one row that is sent to all."""
    top = F.broadcast(df.agg(F.max(column).alias("_top")))
    share = F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)
    return df.join(top).withColumn(name, 3.4 + 12 * F.sqrt(share)).drop("_top")
