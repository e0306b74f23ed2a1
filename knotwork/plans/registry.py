"""Queries over the order tables as a graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import graph as g

ROUNDS = 5
_KINDS = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderstatus"))
_LINKS = (("nation", "n_nationkey", "region", "n_regionkey", "in_region", "nation"), ("customer", "c_custkey", "nation", "c_nationkey", "in_nation", "customer"), ("supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", "supplier"), ("orders", "o_orderkey", "customer", "o_custkey", "placed_by", "orders"), ("orders", "l_orderkey", "part", "l_partkey", "contains", "lineitem"), ("part", "l_partkey", "supplier", "l_suppkey", "supplied_by", "lineitem"))
NODES = " union all ".join(f"select '{k}:' || {i} as id, '{k}' as type, {n} as label from {k}" for k, i, n in _KINDS)
EDGES = " union ".join(f"select '{a}:' || {x} as source, '{b}:' || {y} as target, '{r}' as relation from {f}" for a, x, b, y, r, f in _LINKS)
WITH = f"with nodes as ({NODES}), edges as ({EDGES}), ends as (select source as id, 1 as o, 0 as i from edges union all select target, 0, 1 from edges), deg as (select id, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, count(*) as degree from ends group by id)"
_STEP = "p{k} as (select s.id, s.n, {low} / t.c + {d} * (coalesce(x.x, 0) + (select coalesce(sum(r), 0) from p{j} where n is null) / t.c) as r from p{j} s cross join t left join (select target, sum(p.r / p.n) as x from edges join p{j} p on p.id = source group by target) x on x.target = s.id)"
_RANKS = ", t as (select count(*)::double as c from nodes), p0 as (select n.id, o.n, 1.0::double / t.c as r from nodes n cross join t left join (select source, count(*) as n from edges group by source) o on o.source = n.id), " + ", ".join(_STEP.format(k=k, j=k - 1, low="0.15::double", d="0.85::double") for k in range(1, ROUNDS + 1))

# Every round is kept with its number and how far it moved; p starts from p0 as above. Needs nodes (id) and edges (source, target) within a recursive list.
CONVERGING = _RANKS.split(", p1 as")[0] + """, p as (select id, n, r, 0 as k, 1.0::double as l1 from p0 union all
select id, n, r, k, sum(abs(r - old)) over () as l1 from (select s.id, s.n, s.k + 1 as k, s.r as old, 0.15::double / t.c + 0.85::double * (coalesce(x.x, 0) + (select coalesce(sum(r), 0) from p where n is null) / t.c) as r
from p s cross join t left join (select target, sum(p.r / p.n) as x from edges join p on p.id = source group by target) x on x.target = s.id where s.l1 >= 1e-9 and s.k < 200)),
pr as (select id, round(r, 9) as pagerank from p where k = (select max(k) from p))"""
_CONVERGED = WITH.replace("with ", "with recursive ", 1) + CONVERGING + " select * from pr"


def node_types(spark: SparkSession, d: str) -> DataFrame:
    return g.commerce(spark, d)[0].groupBy("type").agg(F.count("*").alias("n"))


def edge_relations(spark: SparkSession, d: str) -> DataFrame:
    return g.commerce(spark, d)[1].groupBy("relation").agg(F.count("*").alias("n"))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(g.commerce(spark, d)[1])


def hubs(spark: SparkSession, d: str) -> DataFrame:
    return degree(spark, d).orderBy(F.desc("degree"), "id").limit(15).select("id", "degree")


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return g.pagerank(*g.commerce(spark, d), ROUNDS, None).select("id", F.round("pagerank", 9).alias("pagerank"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """PageRank until a round moves less than the tolerance, as in the reference."""
    return g.pagerank(*g.commerce(spark, d)).select("id", F.round("pagerank", 9).alias("pagerank"))


def impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the first region within three hops."""
    return g.levels(g.commerce(spark, d)[1], "region:0", 3, reverse=True)


def bridges(spark: SparkSession, d: str) -> DataFrame:
    return g.bridge_score(degree(spark, d).select("id", "degree"), "degree").select("id", F.round("bridge_score", 6).alias("bridge_score"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no edge mentions."""
    nodes, edges = g.commerce(spark, d)
    return nodes.join(g.degrees(edges), "id", "left_anti").select("id", "type")


def search(spark: SparkSession, d: str) -> DataFrame:
    nodes = g.commerce(spark, d)[0]
    return nodes.where(g.matches(F.concat_ws("  ", "id", "label"), "customer 00")).select("id", "label")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return g.commerce(spark, d)[0].where("type = 'part'").select("id", g.slug(F.col("label")).alias("slug"))


QUERIES = {f.__name__: f for f in (node_types, edge_relations, degree, hubs, pagerank, pagerank_converged, impact, bridges, orphans, search, slugs)}
ORACLES = {
    "node_types": f"{WITH} select type, count(*) as n from nodes group by type",
    "edge_relations": f"{WITH} select relation, count(*) as n from edges group by relation",
    "degree": f"{WITH} select * from deg",
    "hubs": f"{WITH} select id, degree from deg order by degree desc, id limit 15",
    "pagerank": f"{WITH}{_RANKS} select id, round(r, 9) as pagerank from p{ROUNDS}",
    "pagerank_converged": _CONVERGED,
    "impact": f"{WITH}, l1 as (select distinct source as id from edges where target = 'region:0'), l2 as (select distinct source as id from edges join l1 on target = id), l3 as (select distinct source as id from edges join l2 on target = id) select id, min(level)::int as level from (select 'region:0' as id, 0 as level union all select id, 1 from l1 union all select id, 2 from l2 union all select id, 3 from l3) group by id",
    "bridges": f"{WITH} select id, round(100 * percent_rank() over (order by degree), 6) as bridge_score from deg",
    "orphans": f"{WITH} select id, type from nodes where id not in (select id from deg)",
    "search": f"{WITH} select id, label from nodes where lower(id || '  ' || label) like '%customer%' and lower(id || '  ' || label) like '%00%'",
    "slugs": f"{WITH} select id, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as slug from nodes where type = 'part'",
}
