"""Queries over the links of pages, the flow of conversations and single tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.durable import cut
from knotwork.operators import graph as g

LINKS = "select distinct 'page:' || page_id as source, 'path:' || h as target from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as h from pages)"
FLOW = "select 'turn:' || conv_id || '/' || turn as source, 'turn:' || conv_id || '/' || nxt as target, role as relation from (select conv_id, turn, role, lead(turn) over (partition by conv_id order by turn) as nxt from (select distinct conv_id, turn, role from conversations)) where nxt is not null"
_ENDS = "(select source as id from e union select target from e)"
_UND = "und as (select source as a, target as b from e union select target, source from e)"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def links(spark: SparkSession, d: str) -> DataFrame:
    found = _t(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h"))
    return found.select("source", F.concat(F.lit("path:"), "h").alias("target")).distinct()


def flow(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    name = lambda t: F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit("/"), F.col(t).cast("string"))
    return turns.withColumn("nxt", nxt).where("nxt is not null").select(name("turn").alias("source"), name("nxt").alias("target"), F.col("role").alias("relation"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def shared(edges: DataFrame) -> DataFrame:
    """Pairs of pages with two common paths or more."""
    a, b = edges.toDF("source", "path"), edges.toDF("target", "path")
    return a.join(b, "path").where("source < target").groupBy("source", "target").agg(F.count("*").alias("n")).where("n >= 2").drop("n")


def alike(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, page) with the class of every page, named after its least, and (id, n) of the classes: pages of one class link to the same paths. Sets of paths are told apart by their number and 128 bits of hashes."""
    bits = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "target")).alias(k)
    kind = ["links", "x", "y"]
    sets = cut(edges.groupBy(F.col("source").alias("page")).agg(F.count("*").alias("links"), bits("x"), bits("y")))
    classes = cut(sets.groupBy(*kind).agg(F.min("page").alias("id"), F.count("*").alias("n")))
    return sets.join(classes.select(*kind, "id"), kind).select("id", "page"), classes.select("id", "n", "links")


def href_extract(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


def link_components(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return g.components(ends(e), e)


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return link_components(spark, d).groupBy("component").agg(F.count("*").alias("n"))


def clustering(spark: SparkSession, d: str) -> DataFrame:
    """Of pages that share two paths or more with another. Pages with the same links are alike to all others, so pairs are sought among classes of them."""
    e = cut(links(spark, d))
    of, classes = alike(e)
    classes = cut(classes)
    among = classes.where("n > 1 and links >= 2").select(F.col("id").alias("source"), F.col("id").alias("target"))
    pairs = cut(shared(e.join(classes.select(F.col("id").alias("source")), "source", "left_semi")).unionByName(among))
    linked = classes.join(ends(pairs), "id", "left_semi").select("id", "n")
    return of.join(g.clustering_of_classes(linked, pairs), "id").select(F.col("page").alias("id"), F.round("clustering", 9).alias("clustering"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    e = flow(spark, d)
    return g.blast_radius(ends(e), e)


def component_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return g.modularity(e, g.components(ends(e), e).select("id", "component")).select(F.round("modularity", 9).alias("modularity"))


def slice_3hop(spark: SparkSession, d: str) -> DataFrame:
    """What lies within three hops of page 0, whatever the direction."""
    return g.levels(g.both_ways(links(spark, d)).toDF("source", "target"), "page:0", 3)


def induced_slice(spark: SparkSession, d: str) -> DataFrame:
    return g.induced(links(spark, d), slice_3hop(spark, d))


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is not among those with a balance of zero or more."""
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    known = _t(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("source"))
    return orders.join(known, "source", "left_anti")


def duplicate_codes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def edge_dedup_keyed(spark: SparkSession, d: str) -> DataFrame:
    """One row for each order and line number: that of the least part, then supplier."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_suppkey")


def props_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def event_usage(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """Three largest orders of each customer, ties by key."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"), "o_totalprice").where("place <= 3").drop("o_totalprice")


def line_lead(spark: SparkSession, d: str) -> DataFrame:
    """The length of every line of documents and of the line that follows it."""
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n")).select("doc_id", "pos", "n", F.lead("n").over(w).alias("next_n"))


def part_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a size and a word in the name, dearest first."""
    rows = _t(spark, d, "part").where((F.col("p_size") >= 10) & g.matches(F.concat_ws(" ", "p_name", "p_type"), "ring"))
    return rows.select("p_partkey", "p_name", "p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")


def brand_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each brand the share of its parts that were ordered."""
    used = _t(spark, d, "lineitem").select("l_partkey").distinct().withColumn("used", F.lit(1))
    rows = _t(spark, d, "part").select("p_brand", "p_partkey").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("used").alias("n_used")).withColumn("coverage", F.round(F.col("n_used") / F.col("n"), 9))


def path_owner(spark: SparkSession, d: str) -> DataFrame:
    """For each path the longest other path that it begins with and that ends before a slash. Prefixes are made from the path, so this is an equality join."""
    paths = links(spark, d).select(F.col("target").alias("path")).distinct()
    parts = F.split("path", "/")
    cuts_ = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = paths.where(F.size(parts) > 1).select("path", F.explode(cuts_).alias("owner"))
    return rows.join(paths.toDF("owner"), "owner").groupBy("path").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation and segment, numbered from the second one on."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    k = F.row_number().over(w)
    return _t(spark, d, "customer").select("c_custkey", "c_mktsegment", k.alias("k")).select("c_custkey", F.when(F.col("k") == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("title"))


_FNS = (href_extract, link_components, component_sizes, clustering, blast_radius, component_modularity, slice_3hop, induced_slice, dangling_edges, duplicate_codes, edge_dedup_keyed, props_extract, event_usage, top_orders, line_lead, part_filter, brand_coverage, path_owner, titles)
QUERIES = {f.__name__: f for f in _FNS}
_E = f"with recursive e as ({LINKS}), {_UND}"
_CC = f"{_E}, r as (select id, id as label from {_ENDS} union select und.b, r.label from r join und on und.a = r.id), l as (select id, min(label) as label from r group by id), s as (select label, count(*) as component_size from l group by label), c as (select label, component_size, row_number() over (order by component_size desc, label) - 1 as component from s), cc as (select id, component, component_size from l join c using (label))"
_SLICE = f"{_E}, s as (select 'page:0' as id, 0 as level union select und.b, s.level + 1 from s join und on und.a = s.id where s.level < 3), sl as (select id, min(level)::int as level from s group by id)"
ORACLES = {
    "href_extract": LINKS,
    "link_components": f"{_CC} select * from cc",
    "component_sizes": f"{_CC} select component, count(*) as n from cc group by component",
    "clustering": f"with l as ({LINKS}), e as (select x.source, y.source as target from l x join l y on x.target = y.target and x.source < y.source group by all having count(*) >= 2), {_UND}, d as (select a, count(*) as d from und group by a), t as (select x.a, count(*) as t from und x join und y on x.a = y.a and x.b < y.b join und z on z.a = x.b and z.b = y.b group by x.a) select d.a as id, round(case when d > 1 then 2.0::double * coalesce(t, 0) / (d * (d - 1)) else 0 end, 9) as clustering from d left join t on t.a = d.a",
    "blast_radius": f"with recursive e as ({FLOW}), r as (select source, target from e union select r.source, e.target from r join e on e.source = r.target) select n.id, count(r.source) as blast_radius from {_ENDS} n left join r on r.target = n.id and r.source <> r.target group by n.id",
    "component_modularity": f"{_CC}, u as (select x.component as la, y.component as lb from und join cc x on x.id = und.a join cc y on y.id = und.b), b as (select la, count(*)::double as tot, (count(*) filter (where la = lb))::double as i from u group by la) select round(sum(i) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) as modularity from b",
    "slice_3hop": f"{_SLICE} select * from sl",
    "induced_slice": f"{_SLICE} select source, target from e where source in (select id from sl) and target in (select id from sl)",
    "dangling_edges": "select o_custkey as source, o_orderkey as target from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)",
    "duplicate_codes": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "edge_dedup_keyed": "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) = 1",
    "props_extract": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "event_usage": "select user_id, event_type, count(*) as n from events group by all",
    "top_orders": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as place from orders qualify place <= 3",
    "line_lead": "with l as (select doc_id, string_split(text, chr(10)) as x from documents), p as (select doc_id, unnest(range(len(x))) as pos, unnest(x) as line from l) select doc_id, pos, length(line) as n, lead(length(line)) over (partition by doc_id order by pos) as next_n from p",
    "part_filter": "select p_partkey, p_name, p_brand from part where p_size >= 10 and lower(p_name || ' ' || p_type) like '%ring%' order by p_retailprice desc, p_partkey",
    "brand_coverage": "select p_brand, count(*) as n, count(l_partkey) as n_used, round(count(l_partkey)::double / count(*), 9) as coverage from part left join (select distinct l_partkey from lineitem) on l_partkey = p_partkey group by p_brand",
    "path_owner": f"with e as ({LINKS}), p as (select distinct target as path from e) select x.path, arg_max(y.path, length(y.path)) as owner from p x join p y on starts_with(x.path, y.path || '/') group by x.path",
    "titles": "with k as (select c_custkey, c_mktsegment, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as k from customer) select c_custkey, case when k = 1 then c_mktsegment else c_mktsegment || ' (' || k || ')' end as title from k",
}
