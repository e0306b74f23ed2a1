"""Packed adjacency: neighbours by number in blocks, partitioned once, read by every pass over a graph without shuffling its edges again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.durable import Cuts, empty, shared_dir

#: Neighbours of a block, about; a node of more has several, which lie in different partitions.
BLOCK = 4096
#: Keys that are looked up by broadcast at most: those with more than a share of 1 / HOT of all rows.
HOT = 1 << 16
_BLOCKS = "s long, part int, to array<struct<t:long,w:double>>"


def numbered(ids: DataFrame, cuts: Cuts) -> DataFrame:
    """(n, id): distinct ids with numbers from 0 without gaps. A partition's first number is what the partitions before it hold, one row for each of them."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cuts.table(ids.select("id").where("id is not null").distinct().withColumn("p", F.spark_partition_id()).withColumn("k", local), "numbered")
    sizes = rows.groupBy("p").agg(F.count("*").alias("size"))
    first = sizes.select("p", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("p")) - F.col("size")).alias("first"))
    return rows.join(F.broadcast(first), "p").select((F.col("first") + F.col("k")).alias("n"), "id")


def looked_up(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """rows joined with the one row of the table for their key. sizes: (key, size), how many of the total rows a key has. Keys of very many rows are broadcast, of which there are fewer than HOT; the others are shuffled."""
    hot = F.broadcast(table.join(sizes.where(F.col("size") > max(BLOCK, total // HOT)).select(key), key, "left_semi"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table, key))


@dataclass
class Packed:
    """vertices: (n, id, out, parts), out being the weight of what leaves a node; blocks: a bucketed table of (s, part, to)."""

    spark: SparkSession
    at: str
    name: str
    vertices: DataFrame
    count: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.table(self.name)

    def spread(self, front: DataFrame) -> DataFrame:
        """front (s, parts and more) with t and w of every neighbour in place of s and parts. Only front is shuffled, a hub's row once for each of its blocks."""
        rows = front.where("parts > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.join(self.blocks, ["s", "part"]).select(*(c for c in front.columns if c not in ("s", "parts")), F.inline("to"))

    def numbers(self, ids: list[str]) -> dict[str, tuple[int, int]]:
        return {r.id: (r.n, r.parts) for r in self.vertices.where(F.col("id").isin(*ids)).collect()}


def _table(spark: SparkSession, at: str, buckets: int) -> str:
    name = f"knotwork_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({_BLOCKS}) using parquet clustered by (s, part) sorted by (s, part) into {buckets} buckets location '{at}/blocks'")
    return name


def pack(nodes: DataFrame, edges: DataFrame, ways: str = "out", at: str | None = None, buckets: int | None = None) -> Packed:
    """The edges among nodes (id) as blocks of neighbours: along them ("out"), against them ("in"), or either way ("both").

    Parallel edges are one neighbour of that weight ("both": of weight 1), edges with an end that is no node are left out, self-loops stay
    unless the ways are both. at: the folder to keep it in, to be opened again by later sessions.
    """
    spark = nodes.sparkSession
    cuts = Cuts(spark)
    at, buckets = at or f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cuts.table(numbered(nodes, cuts), "ids")
    ends = {"out": ("source", "target"), "in": ("target", "source"), "both": ("source", "target")}[ways]
    pairs = edges.select(*(F.col(e).alias(c) for e, c in zip(ends, ("a", "b"), strict=True))).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    # Many edges may share an end, on either side.
    for c in ("a", "b"):
        pairs = cuts.table(pairs, f"pairs-{c}")
        sizes = pairs.groupBy(c).agg(F.count("*").alias("size"))
        pairs = looked_up(pairs, ids.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")), c, sizes, pairs.count()).drop(c)
    pairs = pairs.select(F.col("a_n").alias("s"), F.col("b_n").alias("t"), "w")
    if ways == "both":
        both = F.array(F.struct(F.col("s").alias("s"), F.col("t").alias("t")), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))
        pairs = pairs.where("s <> t").select(F.inline(both)).distinct().withColumn("w", F.lit(1.0))
    pairs = cuts.table(pairs, "pairs")
    parts = F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")
    sizes = cuts.table(pairs.groupBy("s").agg(F.count("*").alias("size"), F.sum("w").alias("out")).select("s", "size", "out", parts), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    placed = looked_up(pairs, sizes.select("s", "parts"), "s", sizes, total).withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    rows = placed.groupBy("s", "part").agg(F.collect_list(F.struct("t", "w")).alias("to"))
    name = _table(spark, at, buckets)
    rows.select("s", "part", "to").repartition(buckets, "s", "part").write.insertInto(name)
    out = ids.join(sizes.select(F.col("s").alias("n"), "out", "parts"), "n", "left").select("n", "id", F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("parts", F.lit(0)).alias("parts"))
    out.write.parquet(f"{at}/vertices")
    spark.createDataFrame([(buckets, ways)], "buckets int, ways string").coalesce(1).write.json(f"{at}/about")
    cuts.drop("numbered", "ids", "pairs-a", "pairs-b", "pairs", "sizes")
    return opened(spark, at, name)


def opened(spark: SparkSession, at: str, name: str | None = None) -> Packed:
    """A packed adjacency from its folder."""
    name = name or _table(spark, at, spark.read.schema("buckets int, ways string").json(f"{at}/about").first().buckets)
    vertices = spark.read.schema("n long, id string, out double, parts int").parquet(f"{at}/vertices")
    return Packed(spark, at, name, vertices, vertices.count())


def near(packed: Packed, start: str, hops: int, most: int | None = None) -> DataFrame:
    """(id, hop) within the hops of start, by least hop; no further level once more than `most` nodes are found. A start that is no node is alone."""
    spark, cuts = packed.spark, Cuts(packed.spark)
    known = packed.numbers([start])
    if start not in known:
        return spark.createDataFrame([(start, 0)], "id string, hop int")
    seen = front = spark.createDataFrame([(known[start][0], known[start][1], 0)], "s long, parts int, hop int")
    count = 1
    for k in range(1, hops + 1):
        new = packed.spread(front.select("s", "parts")).select(F.col("t").alias("s")).distinct().join(seen, "s", "left_anti")
        new = new.join(packed.vertices.select(F.col("n").alias("s"), "parts"), "s")
        front = cuts.table(new.select("s", "parts", F.lit(k).alias("hop")), f"hop{k}")
        if empty(front):
            break
        seen, count = seen.unionByName(front), count + (front.count() if most else 0)
        if most and count > most:
            break
    return seen.join(packed.vertices.select(F.col("n").alias("s"), "id"), "s").select("id", "hop")


def path(packed: Packed, start: str, end: str) -> DataFrame:
    """(step, source, target) of one shortest path, of equal ones that of the least numbers from the end back; no rows if there is none or both ends are one."""
    spark, cuts = packed.spark, Cuts(packed.spark)
    kinds = "step int, source string, target string"
    known = packed.numbers([start, end])
    if start == end or len(known) < 2:
        return spark.createDataFrame([], kinds)
    goal = known[end][0]
    found = [spark.createDataFrame([(known[start][0], known[start][1], None)], "s long, parts int, prev long")]
    while not found[-1].where(F.col("s") == goal).take(1):
        seen = reduce(DataFrame.unionByName, [f.select("s") for f in found])
        step = packed.spread(found[-1].select("s", "parts", F.col("s").alias("prev"))).groupBy(F.col("t").alias("s")).agg(F.min("prev").alias("prev"))
        level = step.join(seen, "s", "left_anti").join(packed.vertices.select(F.col("n").alias("s"), "parts"), "s")
        found.append(cuts.table(level.select("s", "parts", "prev"), f"level{len(found)}"))
        if empty(found[-1]):
            return spark.createDataFrame([], kinds)
    at, rows = goal, []
    for k in range(len(found) - 1, 0, -1):  # one row a level
        prev = found[k].where(F.col("s") == at).first().prev
        rows.append((k, prev, at))
        at = prev
    steps = spark.createDataFrame(rows, "step int, a long, b long")
    name = lambda c, to: packed.vertices.select(F.col("n").alias(c), F.col("id").alias(to))
    return F.broadcast(steps).join(name("a", "source"), "a").join(name("b", "target"), "b").select("step", "source", "target")
