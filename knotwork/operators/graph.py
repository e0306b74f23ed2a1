"""Nodes (id, type, label) and edges (source, target, relation) of a typed property graph, and what is computed over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.durable import cut
from knotwork.functions.text import matches as matches
from knotwork.functions.text import slug as slug
from knotwork.operators.assemble import dangling as dangling
from knotwork.operators.metrics import blast_radius as blast_radius
from knotwork.operators.metrics import both_ways as both_ways
from knotwork.operators.metrics import bridge_score as bridge_score
from knotwork.operators.metrics import clustering as clustering
from knotwork.operators.metrics import clustering_of_classes as clustering_of_classes
from knotwork.operators.metrics import components as components
from knotwork.operators.metrics import degrees as degrees
from knotwork.operators.metrics import modularity as modularity
from knotwork.operators.metrics import pagerank as pagerank


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def upsert_nodes(candidates: DataFrame) -> DataFrame:
    """One row for each id of (id, type, label, seq): per column the value that is not blank with the least seq."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq"))).alias(c)
    return candidates.groupBy("id").agg(first("type"), first("label"))


def upsert_edges(candidates: DataFrame) -> DataFrame:
    """Distinct edges without blank ends and self-loops."""
    ends = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    return candidates.where(ends).select("source", "target", "relation").distinct()


def levels(edges: DataFrame, start: str, hops: int, reverse: bool = False) -> DataFrame:
    """(id, level): nodes within the hops along (or against) the edges from start, by their least number of hops."""
    a, b = ("target", "source") if reverse else ("source", "target")
    edges = cut(edges.select("source", "target"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, level int")
    front = seen
    for k in range(1, hops + 1):
        front = cut(edges.join(front, F.col(a) == F.col("id")).select(F.col(b).alias("id")).distinct().join(seen, "id", "left_anti").withColumn("level", F.lit(k)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


def commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the order tables; only the columns used are read."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderstatus"))
    nodes = reduce(DataFrame.unionByName, (t(k).select(node_id(k, F.col(i)).alias("id"), F.lit(k).alias("type"), F.col(n).alias("label"), F.lit(s).alias("seq")) for s, (k, i, n) in enumerate(kinds)))
    links = (("nation", "n_nationkey", "region", "n_regionkey", "in_region", "nation"), ("customer", "c_custkey", "nation", "c_nationkey", "in_nation", "customer"), ("supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", "supplier"), ("orders", "o_orderkey", "customer", "o_custkey", "placed_by", "orders"), ("orders", "l_orderkey", "part", "l_partkey", "contains", "lineitem"), ("part", "l_partkey", "supplier", "l_suppkey", "supplied_by", "lineitem"))
    # Keys are made distinct before they become names; the relations' prefixes keep them apart.
    pairs = lambda f, x, y: t(f).select(F.col(x).alias("x"), F.col(y).alias("y")).distinct() if f == "lineitem" else t(f).select(F.col(x).alias("x"), F.col(y).alias("y"))
    edges = reduce(DataFrame.unionByName, (pairs(f, x, y).select(node_id(a, F.col("x")).alias("source"), node_id(b, F.col("y")).alias("target"), F.lit(r).alias("relation")) for a, x, b, y, r, f in links))
    return upsert_nodes(nodes), edges.where("source is not null and target is not null")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges with both ends among members (id)."""
    ends = members.select("id")
    return edges.join(ends.toDF("source"), "source", "left_semi").join(ends.toDF("target"), "target", "left_semi")
