"""Blocks of a graph (its biconnected parts), the nodes that part it, and betweenness by blocks: only within a block are shortest paths sought, what hangs outside counts as weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.durable import Cuts, cut, empty

#: Rows (source, node) of searches that are held at once, on all executors together.
PAIRS = 1 << 31


@dataclass
class Blocks:
    """members: (block, v, weight, part, top) where weight counts v and what hangs at v outside of the block, part what lies beyond v within and behind the block, and top tells the member that the block hangs at; edges: (block, a, b) in both directions."""

    members: DataFrame
    edges: DataFrame


def blocks(undirected: DataFrame, least: DataFrame, cuts: Cuts) -> Blocks:
    """Blocks of an undirected simple graph (a, b) in both directions. least: (node, component) with the least node of each component.

    A spanning forest is grown level by level and numbered so that a subtree is a range. Two tree edges are in one block if a link
    outside the tree ties them (its ends are not above one another), or if something below the lower one reaches beyond the node between
    them. Blocks are components of that relation, named after one of their lower nodes; a link outside the tree is in the block of its
    deeper end's tree edge. Rounds are in proportion to the depth.
    """
    from knotwork.operators.metrics import contracted

    und = cuts.table(undirected, "und")
    roots, size = cuts.counted(least.where("node = component").select(F.col("node").alias("v"), F.lit(None).cast("string").alias("p")), "tree0")
    tree = [roots]
    while size:
        on = tree[-1].select(F.col("v").alias("a")).join(und, "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        known = reduce(DataFrame.unionByName, [x.select("v") for x in tree[-2:]])
        level, size = cuts.counted(on.join(known, "v", "left_anti"), f"tree{len(tree)}")
        tree.append(level)
    depth = len(tree) - 2
    none = und.sparkSession.createDataFrame([], "block string, v string, weight long, part long, top boolean")
    if depth < 1:
        return Blocks(none, und.select(F.lit("").alias("block"), "a", "b").limit(0))
    # Sizes of subtrees from the leaves up, then first numbers from the roots down.
    sized, below = [None] * (depth + 1), None
    for d in range(depth, -1, -1):
        own = tree[d].withColumn("size", F.lit(1).cast("long")) if below is None else tree[d].join(below, "v", "left").select("v", "p", (1 + F.coalesce("n", F.lit(0))).alias("size"))
        sized[d] = cuts.table(own, f"sized{d}")
        below = sized[d].groupBy(F.col("p").alias("v")).agg(F.sum("size").alias("n"))
    first = cuts.table(sized[0].select("v", "p", "size", F.lit(0).cast("long").alias("pre"), F.col("v").alias("root"), F.col("size").alias("all"), F.lit(0).alias("depth")), "pre0")
    numbered = [first]
    for d in range(1, depth + 1):
        before = F.sum("size").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        own = sized[d].withColumn("before", F.coalesce(before, F.lit(0))).join(numbered[-1].select(F.col("v").alias("p"), F.col("pre").alias("top"), "root", "all"), "p")
        numbered.append(cuts.table(own.select("v", "p", "size", (F.col("top") + 1 + F.col("before")).alias("pre"), "root", "all", F.lit(d).alias("depth")), f"pre{d}"))
    every = cuts.table(reduce(DataFrame.unionByName, numbered), "numbered")
    ends = lambda c: every.select(F.col("v").alias(c), F.col("p").alias(f"p{c}"), F.col("pre").alias(f"pre{c}"), F.col("size").alias(f"size{c}"))
    other = cuts.table(und.join(ends("a"), "a").join(ends("b"), "b").where("not (pa <=> b) and not (pb <=> a)"), "other")
    reach = other.groupBy(F.col("a").alias("v")).agg(F.min("preb").alias("lo"), F.max("preb").alias("hi"))
    lows, up = [None] * (depth + 1), None
    for d in range(depth, -1, -1):
        own = numbered[d].join(reach, "v", "left").select("v", "p", "size", "pre", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
        if up is not None:
            own = own.join(up, "v", "left").select("v", "p", "size", "pre", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        lows[d] = cuts.table(own, f"low{d}")
        up = lows[d].groupBy(F.col("p").alias("v")).agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
    low = reduce(DataFrame.unionByName, lows)
    apart = other.where("prea + sizea <= preb").select("a", "b")
    # A tree edge is named by its lower node.
    inner = low.where("p is not null").select(F.col("v").alias("a"), F.col("p").alias("b"), "lo", "hi").join(every.where("p is not null").select(F.col("v").alias("b"), "pre", "size"), "b")
    tied = apart.unionByName(inner.where("lo < pre or hi >= pre + size").select("a", "b"))
    block = contracted(tied, cuts, "blocks")
    named = every.join(block, every.v == block.node, "left").select("v", "p", "size", "all", "depth", F.when(F.col("p").isNotNull(), F.coalesce("component", "v")).alias("block"))
    named = cuts.table(named, "named")
    # Where a block's tree edge leads up to a node that is not below another of its edges, that node is the block's top.
    over = named.where("block is not null").join(named.select(F.col("v").alias("p"), F.col("block").alias("above")), "p")
    tops = cuts.table(over.where("above is null or above <> block").groupBy("block", "p").agg(F.sum("size").alias("hang"), F.max("all").alias("all")), "tops")
    hanging = tops.groupBy(F.col("p").alias("v")).agg(F.sum("hang").alias("hang"))
    low_members = named.where("block is not null").join(hanging, "v", "left").select("block", "v", (1 + F.coalesce("hang", F.lit(0))).alias("weight"), "all")
    members = low_members.select("block", "v", "weight", (F.col("all") - F.col("weight")).alias("part"), F.lit(False).alias("top"))
    members = members.unionByName(tops.select("block", F.col("p").alias("v"), (F.col("all") - F.col("hang")).alias("weight"), F.col("hang").alias("part"), F.lit(True).alias("top")))
    end = lambda c: named.select(F.col("v").alias(c), F.col("block").alias(f"block{c}"), F.col("depth").alias(f"d{c}"))
    edges = und.join(end("a"), "a").join(end("b"), "b").select(F.when(F.col("da") > F.col("db"), F.col("blocka")).when(F.col("da") < F.col("db"), F.col("blockb")).otherwise(F.least("blocka", "blockb")).alias("block"), "a", "b")
    return Blocks(cuts.table(members, "members"), cuts.table(edges, "block-edges"))


def found(nodes: DataFrame, edges: DataFrame) -> Blocks:
    """Blocks of the undirected simple graph of edges (source, target)."""
    from knotwork.operators.metrics import both_ways, contracted

    cuts = Cuts(nodes.sparkSession)
    und = cuts.table(both_ways(edges.where("source is not null and target is not null")), "both")
    return blocks(und, contracted(und.where("a < b"), cuts), cuts)


def articulation_points(nodes: DataFrame, edges: DataFrame, given: Blocks | None = None) -> DataFrame:
    """(id) of the nodes whose removal parts their component: those of two blocks or more."""
    members = (given or found(nodes, edges)).members
    return members.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")


def work(given: Blocks) -> DataFrame:
    """One row: nodes and edges of the graph, blocks, those that are searched, and the steps that searching takes by blocks and would take without them (sources times edges), members with the same neighbours counted one by one."""
    size = given.members.groupBy("block").agg(F.count("*").alias("n")).join(given.edges.groupBy("block").agg(F.count("*").alias("m")), "block")
    per = size.agg(F.count("*").alias("blocks"), F.count_if(F.col("n") > 2).alias("searched"), F.sum(F.when(F.col("n") > 2, F.col("n") * F.col("m")).otherwise(0)).alias("steps"), (F.sum("m") / 2).cast("long").alias("edges"))
    nodes = given.members.select(F.count_distinct("v").alias("nodes"))
    return nodes.join(per, F.lit(True)).select("nodes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "blocks", "searched", "steps")), F.coalesce(F.col("nodes") * F.col("edges") * 2, F.lit(0)).alias("steps_without"))


def betweenness(nodes: DataFrame, edges: DataFrame, chunks: int | None = None, budget: int = PAIRS, given: Blocks | None = None) -> DataFrame:
    """(id, betweenness): share of the pairs of other nodes whose shortest undirected paths pass through a node, each pair spread over its paths; 0 below three nodes.

    A pair that a node parts passes through it whatever the path, which is counted from the sizes of the parts. The rest is sought block by
    block: from every member of a block, weighted by what hangs at it, shortest paths grow level by level as rows (source, node, paths);
    then what each node passes on is added up from the farthest level back. Blocks of two nodes, such as leaves and bridges, need no search.
    Members of a block that have the same neighbours in it are searched as one, from which and to which there are as many paths as they are.
    The work is the sum of such classes times edges among them over blocks. Sources are dealt to chunks so that a chunk holds at most the
    budget of rows.
    """
    given = given or found(nodes, edges)
    total = nodes.count()
    pairs = (total - 1) * (total - 2)
    crossing = given.members.groupBy("v").agg((F.max(F.col("part") + F.col("weight")) - 1).alias("others"), F.sum(F.col("part").cast("double") * F.col("part")).alias("within")).select("v", (F.col("others").cast("double") * F.col("others") - F.col("within")).alias("dep"))
    parts = [crossing]
    size = given.members.groupBy("block").agg(F.count("*").alias("n")).where("n > 2")
    if not empty(size):
        outer = Cuts(nodes.sparkSession)
        member = outer.table(given.members.join(size, "block", "left_semi").select("block", "v", "weight"), "member")
        of, alike = _alike(member, given.edges, outer)
        end = alike.select("block", F.col("c").alias("b"), F.col("weight").alias("wb"), F.col("n").alias("nb"))
        # The edges of one of a class are those of all.
        near = given.edges.join(alike.select("block", F.col("c").alias("a")), ["block", "a"], "left_semi").join(of.select("block", F.col("v").alias("b"), "c"), ["block", "b"])
        step = outer.table(near.select("block", "a", F.col("c").alias("b")).distinct().join(end, ["block", "b"]), "step")
        # A row is held in its level and again on the way back.
        rows = alike.groupBy("block").agg(F.count("*").cast("double").alias("n")).agg(2 * F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        chunks = chunks or max(1, -int(-rows // budget))
        # Two of a class are two steps apart, by way of each neighbour alike.
        own = alike.where("n > 1").join(step.select("block", F.col("a").alias("c"), F.col("b").alias("to")), ["block", "c"]).select("block", F.col("to").alias("c"), (F.col("among") / F.col("degree")).alias("dep"))
        dep = reduce(DataFrame.unionByName, [own, *(cut(_searched(alike.withColumnRenamed("c", "v"), step, chunks, k)) for k in range(chunks))])
        parts.append(of.join(dep.groupBy("block", "c").agg(F.sum("dep").alias("dep")), ["block", "c"]).select("v", "dep"))
    if pairs <= 0:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("v").alias("id")).agg(F.sum("dep").alias("dep"))
    # Every pair is met from both of its ends, which makes up for halving and doubling.
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("dep", F.lit(0.0)) / pairs).alias("betweenness"))


def _alike(member: DataFrame, edges: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(block, v, c) with the class of every member, named after its least, and (block, c, n, weight, degree, among) of the classes.

    n counts members, weight sums up theirs, among sums up the products of weights of any two, degree counts the neighbours of each. Sets of
    neighbours are told apart by their number and 128 bits of hashes.
    """
    kind = ["block", "degree", "x", "y"]
    bits = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "b"))
    sets = edges.join(member.select("block").distinct(), "block", "left_semi").groupBy("block", F.col("a").alias("v")).agg(F.count("*").alias("degree"), bits("x").alias("x"), bits("y").alias("y"))
    sets = cuts.table(sets.join(member, ["block", "v"]), "sets")
    weight = F.col("weight").cast("double")
    alike = cuts.table(sets.groupBy(*kind).agg(F.min("v").alias("c"), F.count("*").alias("n"), F.sum("weight").alias("weight"), (F.sum(weight) * F.sum(weight) - F.sum(weight * weight)).alias("among")), "alike")
    return cuts.table(sets.join(alike.select(*kind, "c"), kind).select("block", "v", "c"), "of"), alike.select("block", "c", "n", "weight", "degree", "among")


def _searched(member: DataFrame, step: DataFrame, chunks: int, k: int) -> DataFrame:
    """(block, c, dep) of the sources of a chunk; dep is what each of a class passes on, summed over the weight of sources."""
    cuts = Cuts(member.sparkSession)
    starts = member.where(F.pmod(F.xxhash64("block", "v"), F.lit(chunks)) == k)
    # A path begins at one of the source's class.
    first, size = cuts.counted(starts.select("block", F.col("v").alias("s"), F.col("weight").alias("ws"), "v", F.col("weight").alias("wv"), F.lit(1).cast("long").alias("nv"), F.lit(1.0).alias("paths")), "level0")
    key, levels = ["block", "s", "v"], [first]
    while size:
        on = levels[-1].join(step.withColumnRenamed("a", "v"), ["block", "v"]).groupBy("block", "s", "ws", F.col("b").alias("v"), F.col("wb").alias("wv"), F.col("nb").alias("nv")).agg(F.sum(F.col("paths") * F.col("nv")).alias("paths"))
        # A node next to a level is in it, in the one before it, or new.
        old = reduce(DataFrame.unionByName, [x.select(*key) for x in levels[-2:]])
        level, size = cuts.counted(on.join(old, key, "left_anti"), f"level{len(levels)}")
        levels.append(level)
    through, passed = [], None
    for d in range(len(levels) - 2, 0, -1):
        own = levels[d].withColumn("dep", F.lit(0.0)) if passed is None else levels[d].join(passed, key, "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        own = cuts.table(own, f"own{d}")
        through.append(own.select("block", F.col("v").alias("c"), (F.col("dep") * F.col("ws")).alias("dep")))
        back = own.select("block", "s", F.col("v").alias("a"), ((F.col("wv") + F.col("nv") * F.col("dep")) / F.col("paths")).alias("x")).join(step, ["block", "a"]).select("block", "s", F.col("b").alias("v"), "x")
        passed = back.join(levels[d - 1].select(*key, "paths"), key).groupBy(*key).agg(F.sum(F.col("x") * F.col("paths")).alias("dep"))
    if not through:
        return member.select("block", F.col("v").alias("c"), F.lit(0.0).alias("dep")).limit(0)
    return reduce(DataFrame.unionByName, through).groupBy("block", "c").agg(F.sum("dep").alias("dep"))
