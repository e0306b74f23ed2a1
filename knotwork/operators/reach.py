"""Who reaches whom: strongly connected components, the levels of what is left, and bitmaps of sources carried along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from knotwork.durable import Cuts
from knotwork.operators.adjacency import numbered

#: Sources of a bitmap, and its bytes (fixed values: those of the bitmap functions).
BITS, BYTES = 32768, 4096
#: Bytes of bitmaps that are held at once: nodes times sources of a chunk / 8.
BUDGET = 64 << 30


def _ways(e: DataFrame) -> DataFrame:
    """(v, out, into): how often a node is a source and a target."""
    ends = F.array(F.struct(F.col("s").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return e.select(F.inline(ends)).groupBy("v").agg(F.sum("o").alias("out"), F.sum("i").alias("into"))


def _among(e: DataFrame, v: DataFrame) -> DataFrame:
    return e.join(v.toDF("s"), "s", "left_semi").join(v.toDF("t"), "t", "left_semi").select("s", "t")


def strong_components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(v, comp) of the nodes of edges (s, t) that lie on a cycle with another node; comp is the largest number of the component. Nodes of no such cycle have no row.

    Nodes that nothing enters or leaves are peeled off, as they are on no cycle. Of the rest each takes the largest number that reaches it
    as its colour; a colour's component is what reaches its namesake within the colour. What then remains begins anew. A peeling or a step
    is one join and one aggregation; there are as many as the longest path through the rest asks for.
    """
    e, size = cuts.counted(edges.select("s", "t").where("s <> t").distinct(), "scc-e0")
    found: list[DataFrame] = []
    k = 0
    while True:
        while size:
            before = size
            e, size = cuts.counted(_among(e, _ways(e).where("out > 0 and into > 0").select("v")), f"scc-e{k + 1}")
            cuts.drop(f"scc-e{k}")
            k += 1
            if size == before:
                break
        if not size:
            break
        # Colours go forward until none changes.
        colour = cuts.table(e.select(F.explode(F.array("s", "t")).alias("v")).distinct().withColumn("c", F.col("v")), f"scc-c{k}-0")
        step = 0
        while True:
            best = e.join(colour.toDF("s", "c"), "s").groupBy(F.col("t").alias("v")).agg(F.max("c").alias("m"))
            step += 1
            seen = Observation()
            new = colour.join(best, "v", "left").observe(seen, F.count_if(F.col("m") > F.col("c")).alias("moved"))
            colour = cuts.table(new.select("v", F.greatest("c", "m").alias("c")), f"scc-c{k}-{step}")
            cuts.drop(f"scc-c{k}-{step - 1}")
            if not seen.get.get("moved"):
                break
        # Back from each colour's namesake, within the colour.
        same = e.join(colour.toDF("s", "c"), "s").join(colour.toDF("t", "d"), "t").where("c = d").select("s", "t", "c")
        same = cuts.table(same, f"scc-s{k}")
        front = seen = colour.where("v = c")
        step, new = 0, 1
        while new:
            step += 1
            front, new = cuts.counted(same.join(front.select(F.col("v").alias("t")), "t").select(F.col("s").alias("v"), "c").distinct().join(seen.select("v"), "v", "left_anti"), f"scc-f{k}-{step}")
            seen = seen.unionByName(front)
        found.append(seen.select("v", F.col("c").alias("comp")))
        rest = e.join(seen.select(F.col("v").alias("s")), "s", "left_anti").join(seen.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
        e, size = cuts.counted(rest, f"scc-e{k + 1}")
        cuts.drop(f"scc-e{k}")
        k += 1
    if not found:
        return e.select(F.col("s").alias("v"), F.col("t").alias("comp"))
    every = reduce(DataFrame.unionByName, found)
    # A namesake alone was on the way between cycles.
    return every.join(every.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp"), "comp", "left_semi").select("v", "comp")


def levels(edges: DataFrame, nodes: DataFrame, cuts: Cuts, name: str = "lev") -> tuple[DataFrame, int, int]:
    """(v, level) of nodes (v): one more than the largest level of what enters a node, from 0; how many levels there are; and how many nodes have none, as a cycle leads to them."""
    into = edges.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("into"))
    wait, size = cuts.counted(nodes.join(into, "v", "left").select("v", F.coalesce("into", F.lit(0)).alias("into")), f"{name}0")
    k = 0
    # What waits for nothing has just come to its level; what waits for less than nothing had its own before.
    while size:
        gone = edges.join(wait.where("into = 0").select(F.col("v").alias("s")), "s").groupBy(F.col("t").alias("v")).agg(F.count("*").alias("gone"))
        seen = Observation()
        less = F.when(F.col("into") <= 0, F.lit(-1)).otherwise(F.col("into") - F.coalesce("gone", F.lit(0)))
        level = F.when(F.col("into") == 0, F.lit(k)).alias("level") if k == 0 else F.when(F.col("into") == 0, F.lit(k)).otherwise(F.col("level")).alias("level")
        new = wait.join(gone, "v", "left").select("v", level, less.cast("long").alias("into")).observe(seen, F.count_if(F.col("into") == 0).alias("now"), F.count_if(F.col("into") > 0).alias("wait"))
        k += 1
        wait = cuts.table(new, f"{name}{k}")
        cuts.drop(f"{name}{k - 1}")
        if not seen.get.get("now"):
            return wait.where("level is not null").select("v", "level"), k, seen.get.get("wait") or 0
    return nodes.select("v", F.lit(0).alias("level")), 0, 0


def blast_radius(nodes: DataFrame, edges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(id, blast_radius): how many other nodes reach a node along the edges.

    Nodes of a cycle reach the same and are one; of what is left, which is acyclic, each node takes over the sources of what enters it, as
    bitmaps of BITS sources, level by level. A bitmap is passed on once for each edge and united before it is shuffled, so a node that
    much enters does no harm. Sources go in chunks whose bitmaps take at most the budget (one bitmap a node at least). The edges that are
    given count, parallel ones once, whether their ends are nodes or not; nulls are left out.
    """
    spark = nodes.sparkSession
    cuts = Cuts(spark)
    ends = edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    ids, total = cuts.counted(numbered(ends.select(F.explode(F.array("source", "target")).alias("id")), cuts), "ids")
    of = lambda c, to: ids.select(F.col("id").alias(c), F.col("n").alias(to))
    dag = cuts.table(ends.join(of("source", "s"), "source").join(of("target", "t"), "target").select("s", "t"), "e")
    member = ids.select(F.col("n").alias("v"), F.col("n").alias("c"))
    level, count, bound = levels(dag, ids.select(F.col("n").alias("v")), cuts)
    if bound:
        # Only what a cycle leads to can lie on one.
        late = ids.select(F.col("n").alias("v")).join(level, "v", "left_anti")
        comp = cuts.table(strong_components(_among(dag, late), cuts), "comp")
        name = lambda c: comp.select(F.col("v").alias(c), F.col("comp").alias(f"{c}c"))
        dag = dag.join(name("s"), "s", "left").join(name("t"), "t", "left").select(F.coalesce("sc", "s").alias("s"), F.coalesce("tc", "t").alias("t")).where("s <> t").distinct()
        dag = cuts.table(dag, "dag")
        member = cuts.table(ids.select(F.col("n").alias("v")).join(comp, "v", "left").select("v", F.coalesce("comp", "v").alias("c")), "member")
        level, count, _ = levels(dag, member.select(F.col("c").alias("v")).distinct(), cuts, "again")
    # Edges know the level they lead to, so that what is passed on waits in that level's folder.
    dag = cuts.table(dag.join(level.toDF("s", "sl"), "s").join(level.toDF("t", "tl"), "t"), "dag-levels")
    lot = max(1, int(budget // (max(1, total) * BYTES)))
    bit, bucket = F.bitmap_bit_position(F.col("v") + 1), F.bitmap_bucket_number(F.col("v") + 1)
    own = cuts.table(member.select("c", bucket.alias("bucket"), bit.alias("bit")).join(level.toDF("c", "level"), "c"), "own")
    united = lambda rows: rows.groupBy("c", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    parts = []
    for low in range(1, -(-total // BITS) + 1, lot):
        chunk = own.where(F.col("bucket").between(low, low + lot - 1))
        passed: list[DataFrame] = []

        def known(of_level: int | None, chunk: DataFrame = chunk, passed: list[DataFrame] = passed) -> DataFrame:
            """What reaches the nodes of a level, or of all: what they are themselves, and what was passed on to them."""
            at = lambda df, c: df if of_level is None else df.where(F.col(c) == of_level)
            rows = at(chunk, "level").groupBy("c", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
            return united(reduce(DataFrame.unionByName, [at(p, "tl").select(F.col("t").alias("c"), "bucket", "bits") for p in passed], rows))

        for k in range(count - 1):
            on = known(k).join(dag.where(F.col("sl") == k).select(F.col("s").alias("c"), "t", "tl"), "c").groupBy("t", "tl", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            on.write.partitionBy("tl").parquet(f"{cuts.root}/on{low}-{k}")
            passed.append(spark.read.schema("t long, bucket long, bits binary, tl int").parquet(f"{cuts.root}/on{low}-{k}"))
        parts.append(cuts.table(known(None).groupBy("c").agg(F.sum(F.bitmap_count("bits")).alias("n")), f"n{low}"))
        cuts.drop(*(f"on{low}-{k}" for k in range(count - 1)))
    if not parts:
        return nodes.select("id", F.lit(0).cast("long").alias("blast_radius"))
    reached = reduce(DataFrame.unionByName, parts).groupBy("c").agg(F.sum("n").alias("n"))
    n = member.join(reached, "c").join(ids.select(F.col("n").alias("v"), "id"), "v").select("id", (F.col("n") - 1).alias("blast_radius"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("blast_radius", F.lit(0)).cast("long").alias("blast_radius"))
