"""Queries of the operators over the order tables, the links of pages and the flow of conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.durable import Cuts, cut
from knotwork.functions import classify as C
from knotwork.functions import text as T
from knotwork.operators import artifacts, assemble, index, layout
from knotwork.operators import graph as g
from knotwork.operators import metrics as m
from knotwork.operators import walks as W
from knotwork.operators.blocks import found
from knotwork.operators import query as Q
from knotwork.plans import links
from knotwork.plans.registry import CONVERGING, EDGES, NODES, WITH
from knotwork.sinks import notes, reports, tables
from knotwork.sources import files, markdown

#: Layers of the tables' types, and relations among them that classify.
LAYERS = {"region": 8, "nation": 8, "customer": 4, "orders": 3, "supplier": 2, "part": 1}
HIDDEN = ("in_region", "in_nation")
_LAYER = "case type when 'region' then 8 when 'nation' then 8 when 'customer' then 4 when 'orders' then 3 when 'supplier' then 2 else 1 end"
_HIDE = "relation not in ('in_region', 'in_nation')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tables' nodes with code and layer."""
    n = g.commerce(spark, d)[0]
    return n.withColumn("code", F.substring_index("id", ":", -1)).withColumn("layer", S.lookup(F.col("type"), LAYERS, -1))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return g.commerce(spark, d)[1].withColumn("context", F.lit(None).cast("string"))


def ranked_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).join(m.degrees(edges(spark, d)).select("id", "degree"), "id", "left")


def page_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = cut(links.links(spark, d)).withColumns({"relation": F.lit("links_to"), "context": F.lit(None).cast("string")})
    return links.ends(e), e


def layer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("layer").agg(F.count("*").alias("n"))


def dep_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees over the relations that do not classify."""
    return m.degrees(edges(spark, d).where(S.visible(F.col("relation"), HIDDEN))).select("id", F.col("degree").alias("dep_degree"))


def degree_rank(spark: SparkSession, d: str) -> DataFrame:
    return m.ranked(m.degrees(edges(spark, d)).select("id", "degree"), "degree", "place").select("id", "place")


def pagerank_rank(spark: SparkSession, d: str) -> DataFrame:
    n, e = page_links(spark, d)
    return m.ranked(m.pagerank(n, e).select("id", F.round("pagerank", 9).alias("pagerank")), "pagerank", "place").select("id", "pagerank", "place")


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    n, e = page_links(spark, d)
    return m.betweenness(n, e).select("id", F.round("betweenness", 9).alias("betweenness"))


def bridge_score(spark: SparkSession, d: str) -> DataFrame:
    """The percentile of betweenness, rounded before it is ranked as sums come in any order."""
    return m.bridge_score(betweenness(spark, d), "betweenness").select("id", F.round("bridge_score", 6).alias("bridge_score"))


def articulation_points(spark: SparkSession, d: str) -> DataFrame:
    n, e = page_links(spark, d)
    return m.articulation_points(n, e)


def communities(spark: SparkSession, d: str) -> DataFrame:
    n, e = page_links(spark, d)
    return m.communities(n, e)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Hops from page 0 to page 7, whatever the direction of the links."""
    path = Q.shortest_path(page_links(spark, d)[1], "page:0", "page:7")
    return path.agg(F.count("*").alias("hops"), F.min_by("source", "step").alias("first"), F.max_by("target", "step").alias("last"))


def flow_levels(spark: SparkSession, d: str) -> DataFrame:
    e = links.flow(spark, d)
    n = links.ends(e)
    return Q.flow_levels(e, e.agg(F.min("source")).first()[0], n.join(m.degrees(e).select("id", "degree"), "id"))


def impact_by_type(spark: SparkSession, d: str) -> DataFrame:
    return Q.impact(edges(spark, d), nodes(spark, d), "nation:0", 2)


def visible_slice(spark: SparkSession, d: str) -> DataFrame:
    """Around a part over what shows; no level is grown once more than 420 nodes are found."""
    return Q.slice_of(edges(spark, d), "part:1", 3, HIDDEN)[0]


def search_scored(spark: SparkSession, d: str) -> DataFrame:
    return Q.search(nodes(spark, d), "customer 00").select("id", "score")


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same hits by an index that is built of the nodes."""
    at = f"{Cuts(spark).root}/index"
    index.build(nodes(spark, d), at)
    return index.search(spark, at, "customer 00").select("id", "score")


def relation_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of nations and suppliers by relation paths over the order graph."""
    home = W.rel("in_nation")
    kinds = {
        "nation": (("customers", ~home / W.only("customer")), ("suppliers", ~home / W.only("supplier")), ("region", W.rel("in_region"))),
        "supplier": (("parts", ~W.rel("supplied_by")), ("places", home / W.Times(W.rel("in_region"), 0, 1))),
    }
    n, e = g.commerce(spark, d)
    return W.cards(cut(n), cut(e), kinds=kinds)


def resolve_entity(spark: SparkSession, d: str) -> DataFrame:
    return Q.resolve(nodes(spark, d), "small").select("id", "label", "tier")


def lab_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    return Q.lab_sort(Q.lab_filter(ranked_nodes(spark, d), "ring part", 1, "part"), "degree").select("id", "label", "degree")


def csv_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").withColumn("note", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))
    return tables.csv_lines(rows, ("p_partkey", "p_name", "note"))


def neighbours_grouped(spark: SparkSession, d: str) -> DataFrame:
    return Q.neighbour_counts(edges(spark, d), nodes(spark, d))


def measured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, betweenness, bridge_score, articulation, pagerank) as computed, rounded to 9 digits before anything is ranked."""
    parts = found(nodes, edges)
    between = m.betweenness(nodes, edges, given=parts).select("id", F.round("betweenness", 9).alias("betweenness"))
    cut_ = m.articulation_points(nodes, edges, parts).withColumn("articulation", F.lit(True))
    rows = m.bridge_score(cut(between), "betweenness").join(cut_, "id", "left").withColumn("articulation", F.coalesce("articulation", F.lit(False)))
    return cut(rows.join(m.pagerank(nodes, edges).select("id", F.round("pagerank", 9).alias("pagerank")), "id"))


def next_hop(spark: SparkSession, d: str) -> DataFrame:
    """By betweenness, cut vertices and converged PageRank of the links."""
    n, e = page_links(spark, d)
    return Q.next_hop(e, measured(n, e), ()).select("id", "next", "via", F.round("score", 9).alias("score"))


def community_pressure(spark: SparkSession, d: str) -> DataFrame:
    n, e = page_links(spark, d)
    rows = m.components(n, e).select("id", F.col("component").alias("community")).join(m.pagerank(n, e).select("id", F.round("pagerank", 9).alias("pagerank")), "id")
    rows = rows.withColumns({"label": F.col("id"), "type": F.substring_index("id", ":", 1)})
    return Q.community_pressure(rows).select("community", "n", F.round("share", 9).alias("share"), F.array_join("keys", ", ").alias("keys"), F.array_join("kinds", ", ").alias("kinds"))


def browse_groups(spark: SparkSession, d: str) -> DataFrame:
    return Q.browse(nodes(spark, d), F.when(F.col("type") != "orders", F.col("type")), "s")


def filter_domains(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    count = lambda c: n.groupBy(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return count("type").unionByName(count("layer"))


def edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.edge_histogram(edges(spark, d), "nation:0")


def legend_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.relation_counts(edges(spark, d), nodes(spark, d).where("type <> 'orders'"))


def related_nodes(spark: SparkSession, d: str) -> DataFrame:
    return Q.related(edges(spark, d), ("in_nation", "in_region"), "nation:0", True)


def top_by_type(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_per_group(ranked_nodes(spark, d), ["type"], [F.desc_nulls_last("degree"), F.col("id")], 3).select("type", "place", "id")


def theta_contains(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return Q.containing(p.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_type", "p_name").alias("text")), p.select(F.substring_index("p_name", " ", 1).alias("name")).distinct())


def _phrases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Whole texts of documents, and the words of benchmark items and pairs of them as names."""
    w = F.split("text", r"[^A-Za-z]+")
    near = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda k: F.concat_ws(" ", F.element_at(w, k.cast("int")), F.get(w, k.cast("int"))))
    names = _t(spark, d, "benchmark").select(F.explode(F.concat(w, near)).alias("name")).where("length(name) > 7")
    return _t(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), names


def names_in_texts(spark: SparkSession, d: str) -> DataFrame:
    return Q.containing(*_phrases(spark, d))


def names_by_rarest_piece(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs as where the names are too many to be sent."""
    return Q.containing(*_phrases(spark, d), most=0)


def declared_observed(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return Q.declared_observed(p.where("p_size < 3"), p.where("p_size > 48"), "p_type")


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.coverage(_t(spark, d, "nation").select("n_nationkey", "n_name"), _t(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")
    return rows.select("n_name", "n_used", "used_here")


def prioritised_resolve(spark: SparkSession, d: str) -> DataFrame:
    refs = _t(spark, d, "customer").select(F.col("c_custkey").alias("ref"), "c_nationkey")
    sup = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    part = _t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    return Q.prioritised(refs, "ref", [(sup, "ref"), (part, "ref")]).select("ref", "resolved")


def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the nearest folder that is one: every region, and nations of even number."""
    at = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    paths = _t(spark, d, "customer").join(at, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "dir", "c_name").alias("path"))
    return Q.owner(paths, at.select(F.col("r_name").alias("owner")).unionByName(at.where("n_nationkey % 2 = 0").select(F.col("dir").alias("owner"))))


def stub_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers that orders mention and that are not among those in credit."""
    seq = lambda k, c: F.struct(F.lit(k).alias("pass"), F.lit(None).cast("string").alias("file"), F.col(c).alias("n")).alias("seq")
    real = _t(spark, d, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), seq(1, "c_custkey"), F.lit(False).alias("stub"), F.col("c_name").alias("label"))
    ref = _t(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("id"), seq(0, "o_orderkey"), F.lit(True).alias("stub"), F.concat(F.lit("? "), "o_custkey").alias("label"))
    return assemble.upsert(real.unionByName(ref)).where("stub").select("id", "label")


def node_upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of an order's lines the first flag that is not A, and the first date that is there."""
    seq = F.struct(F.col("l_linenumber").alias("pass"), F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("file"), F.col("l_suppkey").alias("n"))
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), seq.alias("seq"), F.lit(False).alias("stub"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("").alias("label"), F.col("l_linestatus").alias("status"))
    return assemble.upsert(rows).select("id", "label")


def edge_dedup_context(spark: SparkSession, d: str) -> DataFrame:
    """Edges from orders to parts with the line as context: parallel edges stay, repeated ones go."""
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("orders:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("contains").alias("relation"), F.col("l_linenumber").cast("string").alias("context"), F.struct(F.col("l_suppkey").alias("n")).alias("seq"))
    return assemble.upsert_edges(rows).groupBy("source").agg(F.count("*").alias("n"))


def introduced_by(spark: SparkSession, d: str) -> DataFrame:
    """The status of the first order that mentions a part or is it."""
    l = _t(spark, d, "lineitem")  # noqa: E741
    e = l.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source"), F.col("l_linestatus").alias("source_file"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("seq")).where("l_returnflag <> 'N'")
    return assemble.introduced(e)


def step_mix(spark: SparkSession, d: str) -> DataFrame:
    return Q.step_mix(_t(spark, d, "conversations"), "conv_id", "role", ("system", "user", "assistant"))


def shape_classify(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of artifacts that are made of events, by shape."""
    key = F.element_at(F.array(*map(F.lit, ("toolCode", "workflowCode", "objectCode", "deepLinkCode", "policyCode", "nothing"))), (F.col("event_id") % 6 + 1).cast("int"))
    doc = _t(spark, d, "events").select("event_id", F.to_json(F.create_map(key, F.col("event_type"), F.lit("specification"), F.lit('{"a": 1}'))).alias("doc"))
    kind = C.artifact(F.col("doc"), C.specification(F.col("doc")))
    return doc.select("event_id", kind.alias("kind"), C.artifact_code(F.col("doc"), kind).alias("code"))


def ingest_tallies(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of files that are made of events: kinds, and reasons for passing over."""
    name = F.when(F.col("event_id") % 7 == 0, ".hidden").otherwise(F.concat(F.lit("f"), "event_id", F.lit(".json")))
    body = F.when(F.col("event_id") % 5 == 0, "text").when(F.col("event_id") % 5 == 1, "{bad").when(F.col("event_id") % 5 == 2, '{"a": 1}').otherwise(F.concat(F.lit('{"toolCode": "'), "event_id", F.lit('"}')))
    rows = _t(spark, d, "events").select(name.alias("path"), F.lit("local").alias("origin"), body.alias("content"))
    return tables.tallies(files.ingested(files.shaped(rows)))


def heading_parent(spark: SparkSession, d: str) -> DataFrame:
    """Tags of pages as levels, div 1, p 2, a 3: the nearest tag before of a lower level."""
    tag = _t(spark, d, "pages").select(F.col("page_id").alias("key"), F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-3]|p|a)[ >]"), 1)).alias("place", "tag"))
    level = T.first_match([(F.col("tag") == t, k) for k, t in enumerate(("h1", "h2", "h3", "p", "a"), 1)])
    return markdown.with_parent(tag.select("key", F.col("place").cast("long").alias("place"), level.alias("level")), "place").select("key", "place", "level", "parent")


#: Common words stand in for the markers of rules, which these texts do not have.
WORDS = (("(?:^| )the(?: |$)", "article", "the"), ("(?:^| )(?:der|die|das)(?: |$)", "article", "der"), ("(?:^| )of(?: |$)", "preposition", "of"), ("(?:^| )(?:de|del)(?: |$)", "preposition", "de"))


def rule_modality(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", C.modality(F.col("text"), WORDS).alias("m")).where("m is not null")
    return rows.select("doc_id", "m.modality", "m.marker")


def rule_dedup_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that hold a word, each once, with how often it stands there."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"))
    rows = markdown.lines_of(docs).where(F.length("raw").between(16, 400) & C.modality(F.col("raw"), WORDS).isNotNull()).withColumnRenamed("raw", "text")
    return markdown.once(rows).select("key", "line", F.col("seq").cast("long").alias("seq"), F.col("repeats").cast("long").alias("repeats"), F.size("repeated_at").cast("long").alias("again"))


def markers_by_modality(spark: SparkSession, d: str) -> DataFrame:
    return Q.markers(rule_modality(spark, d))


def text_trim(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.collapsed(F.col("text"), 120).alias("summary"))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("p"))
    return p.select("page_id", T.basename(F.col("p")).alias("base"), T.dirname(F.col("p")).alias("dir"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Capital tokens of documents, each once."""
    return _t(spark, d, "documents").select("doc_id", F.explode(T.mentions(F.col("text"), "[ .,]([A-Z]{4,})[ .,]")).alias("token"))


def significant_digits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", T.significant(F.col("o_totalprice") / 7, 4).alias("x"))


def note_path_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", notes.sanitised(F.concat_ws(": ", "p_type", "p_name")).alias("path"))
    return notes.claimed(rows, "path", ["p_partkey"]).select("p_partkey", "note_path")


def node_tags(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("type = 'part'").withColumns({"family": F.col("label"), "layerName": F.lit("Specs & vocabulary"), "articulation": F.length("label") > 9})
    return n.select("id", F.array_join(notes.tags(n), ",").alias("tags"))


def note_matter(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("type in ('nation', 'region')").withColumn("degree", F.lit(1))
    return n.select("id", notes.front_matter(n, ("title", "type", "code", "degree")).alias("matter"))


def flow_diagram(spark: SparkSession, d: str) -> DataFrame:
    """Conversations drawn as flows of turns."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    tid = F.concat(F.lit("turn:"), "conv_id", F.lit("/"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    n = turns.select(tid.alias("id"), F.lit("workflowNode").alias("type"), F.when(F.col("role") == "user", "SWITCH").otherwise("LLM").alias("nodeType"), F.col("role").alias("label"))
    held = turns.select(F.concat(F.lit("conv:"), "conv_id").alias("source"), tid.alias("target"), F.lit("contains").alias("relation"), F.lit(None).cast("string").alias("context"))
    return notes.flow_diagrams(n, held)


def payload_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("type = 'supplier'").withColumns({"promptExcerpt": F.lit("p"), "summary": F.lit(""), "resourcePath": F.col("label")})
    return tables.pruned(n).select("id", "prompt", "summary", "body")


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return tables.run_report(nodes(spark, d), edges(spark, d))


def degree_report(spark: SparkSession, d: str) -> DataFrame:
    n = ranked_nodes(spark, d).withColumns({"articulation": F.lit(False), "type": F.when(F.col("type") == "part", "tool").otherwise(F.col("type"))})
    return reports.rankings(n, (("x", "degree", 20, S.CONCRETE, False),)).select("id", F.col("value").cast("long").alias("degree"))


#: Reports over pages and paths: of all by PageRank and betweenness, of cut vertices, of pages alone.
PAGE_REPORTS = (("pagerank", "pagerank", 15, None, False), ("pages", "pagerank", 10, ("page",), False), ("betweenness", "betweenness", 15, None, False), ("articulation", "betweenness", 25, None, True))


def report_rankings(spark: SparkSession, d: str) -> DataFrame:
    """All rankings of the links in one pass over their computed metrics."""
    n, e = page_links(spark, d)
    rows = measured(n, e).withColumns({"type": F.substring_index("id", ":", 1), "label": F.col("id")})
    return reports.rankings(rows, PAGE_REPORTS).select("report", "place", "id", "value")


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """A report of parts by size as Markdown."""
    n = ranked_nodes(spark, d).withColumns({"articulation": F.lit(False), "type": F.when(F.col("type") == "part", "tool").otherwise(F.col("type"))})
    return reports.markdown(reports.rankings(n, (("x", "degree", 5, S.CONCRETE, False),)), "Report", None, (("x", "degree", 5, S.CONCRETE, False),))


def risk_card(spark: SparkSession, d: str) -> DataFrame:
    """Of turns: what reaches them, where they part a conversation, how much runs through them."""
    e = cut(links.flow(spark, d))
    n = links.ends(e)
    return Q.risk(m.blast_radius(n, e).join(measured(n, e), "id"))


def rank_grid_layout(spark: SparkSession, d: str) -> DataFrame:
    n = m.ranked(m.degrees(links.links(spark, d)).select("id", "degree"), "degree", "k")
    return layout.grid(n.select("id", (F.col("k") - 1).alias("place")), n.count()).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def radial_layout(spark: SparkSession, d: str) -> DataFrame:
    _, e = page_links(spark, d)
    hop = Q.grow(e, "page:0", 3).join(m.degrees(e).select("id", "degree"), "id")
    return layout.radial(hop).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def level_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.layered(flow_levels(spark, d)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    deg = m.spanned(m.degrees(links.links(spark, d)), "degree")
    return deg.select("id", F.round("size", 9).alias("size"), F.round(layout.hue(F.col("degree")), 6).alias("hue"))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Files of artifacts made of the tables: nations as deeplinks, suppliers as business objects, parts as tools, orders as workflows, regions as agents, customers as apps."""
    doc = lambda df, key, ext, body: df.select(F.concat(F.lit("a/"), key, F.lit(ext)).alias("path"), F.lit("upstream").alias("origin"), F.to_json(body).alias("content"))
    s = lambda **kw: F.struct(*[(v if not isinstance(v, str) else F.col(v)).alias(k) for k, v in kw.items()])
    text = lambda c: F.col(c).cast("string")
    dl = doc(_t(spark, d, "nation"), text("n_nationkey"), ".dl", s(deepLinkCode=text("n_nationkey"), name="n_name", family=text("n_regionkey")))
    bo = doc(_t(spark, d, "supplier"), text("s_suppkey"), ".bo", s(objectCode=text("s_suppkey"), name="s_name", restResourcePath=F.concat(F.lit("/s/"), text("s_nationkey")), objectProperties=s(tools=F.array(s(name=F.lit("get"), resourcePath=F.concat(F.lit("/s/"), text("s_nationkey"), F.lit("?x")), operationType=F.lit("GET"))))))
    tl = doc(_t(spark, d, "part"), text("p_partkey"), ".tool", s(toolCode=text("p_partkey"), name="p_name", type=F.lit("EMAIL"), product="p_brand", specification=s(baseObjectCode=text("p_size"))))
    agents = doc(_t(spark, d, "region"), text("r_regionkey"), ".agent", s(agentCode=text("r_regionkey"), name="r_name", type=F.when(F.col("r_regionkey") == 0, "SUPERVISOR").otherwise("WORKER"), agentToolMappings=F.array(s(tool=s(toolCode=F.concat(F.lit("T"), text("r_regionkey")), name=F.lit("x"))))))
    line = _t(spark, d, "lineitem").where("l_linenumber < 4").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    kind = F.element_at(F.array(*map(F.lit, ("TOOL", "BO_FUNCTION", "WORKFLOW"))), F.col("l_linenumber"))
    meta = s(toolCode=text("p"), businessObjectCode=text("q"), functionName=F.when(F.col("q") % 2 == 0, "get"), workflowCode=F.concat(F.lit("W"), text("q")), sourceCode=F.concat(F.lit("$context.$nodes.n"), text("q"), F.lit(". and $context.$app.$Key")))
    step = s(id=F.concat(F.lit("n"), text("l_linenumber")), type=kind, outcomes=F.create_map(F.lit("success"), F.concat(F.lit("n"), (F.col("l_linenumber") + 1).cast("string"))), metadata=meta)
    flows = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.to_json(step).alias("s")))), lambda x: x["s"]), ",").alias("steps"))
    wf = doc(flows, text("l_orderkey"), ".wf", s(workflowCode=text("l_orderkey"), name=F.concat(F.lit("order "), text("l_orderkey")), specification=F.concat(F.lit('{"dataPipeline": {"pipelineNodes": ['), "steps", F.lit("]}}"))))
    app = doc(_t(spark, d, "customer"), text("c_custkey"), ".app", s(code=text("c_custkey"), name="c_name", specification=s(applicationMetadata=s(agents=F.create_map(F.lit("slot"), s(agent=text("c_custkey"), name=F.lit("x"))), pageConfig=s(agentContainers=F.array(s(id=F.lit("main"), agents=F.array(F.lit("slot"))))), summary=s(agentCode=text("c_custkey"))))))
    every = dl
    for x in (bo, tl, agents, wf, app):
        every = every.unionByName(x)
    return files.shaped(every)


#: The columns of nodes that layers, and which edges are kept, are told by.
TOLD_BY = ("type", "label", "agentKind", "source_file", "source_location")


def _extracted(spark: SparkSession, d: str, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """Nodes, with the columns TOLD_BY, and edges of artifacts made of the tables."""
    n, e = artifacts.extract(spark, cuts.table(_artifacts(spark, d), "files"), cuts).graph()
    cuts.drop("files")
    return assemble.upsert(n, TOLD_BY), assemble.upsert_edges(e)


def artifact_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that artifacts made of the tables give, by type, layer and whether files define them. Nothing is written between, so of the edges only those are made that tell a layer."""
    return assemble.finalise(*_extracted(spark, d, Cuts(spark)))[0].groupBy("type", "layer", "stub").agg(F.count("*").alias("n"))


def artifact_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges among them by relation; nodes are written, as both ends are looked up in them."""
    cuts = Cuts(spark)
    n, e = _extracted(spark, d, cuts)
    return assemble.finalise(cuts.table(n, "nodes"), e)[1].groupBy("relation").agg(F.count("*").alias("n"))


_L = f"with recursive e as ({links.LINKS}), {links._UND}"
_N = f"with nodes as ({NODES}), edges as ({EDGES})"
_DEG = "deg as (select id, count(*) as degree from (select source as id from edges union all select target from edges) group by id)"
_RANKED = f"{_N}, {_DEG}, rn as (select n.*, {_LAYER} as layer, degree from nodes n left join deg using (id))"
_LDEG = "ld as (select id, count(*) as degree from (select source as id from e union all select target from e) group by id)"
_HOPS = "{name} as (select '{start}' as id, 0 as hop union select und.b, hop + 1 from {name} join und on und.a = {name}.id where hop < {most})"
_BFS = f"{_L}, st(s, v, k, p) using key (s, v) as (select id, id, 0, 1.0::double from {links._ENDS} union select st.s, und.b, min(st.k) + 1, sum(st.p) from st join und on und.a = st.v left join recurring.st r on r.s = st.s and r.v = und.b where r.s is null group by st.s, und.b), n as (select count(*)::double as c from {links._ENDS}), bt as (select v.v as id, sum(a.p * v.p / t.p) as x from st a join st v on v.s = a.v join st t on t.s = a.s and t.v = v.v where false group by v.v), bw as (select a.v as id, sum(a.p * b.p / t.p) as x from st a join st b on b.s = a.v join st t on t.s = a.s and t.v = b.v where t.k = a.k + b.k and a.k > 0 and b.k > 0 group by a.v), bb as (select id, round(coalesce(x, 0) / ((c - 1) * (c - 2)), 9) as betweenness from {links._ENDS} i cross join n left join bw using (id))"
_FLOWL = f"with recursive e as ({links.FLOW}), lv as (select min(source) as id, 0 as hop from e union select e.target, hop + 1 from lv join e on e.source = lv.id where hop < 29), {_LDEG}, lm as (select id, min(hop) as hop from lv group by id), fl as (select ld.id, coalesce(hop, -1)::int as level, degree from ld left join lm using (id)), fp as (select id, level, (row_number() over (partition by level order by degree desc, id) - 1)::int as place from fl)"
_MOD = "case " + " ".join(f"when regexp_matches({{0}}, '{p}') then '{k}/{w}'" for p, k, w in WORDS) + " end"
_STEPS = "st as (select l_orderkey as o, l_linenumber as k, min(l_partkey) as p, min(l_suppkey) as q from lineitem where l_linenumber < 4 group by all), ws as (select distinct o from st)"

#: Of every node betweenness, the share of others below it, whether it is a cut vertex, and its converged PageRank.
_MEASURED = f"{_BFS}, lo as (select a as v, min(b) as s from und group by a), ar(v, x) as (select v, s from lo union select ar.v, und.b from ar join und on und.a = ar.x where und.b <> ar.v), ap as (select distinct u.a as id from und u where not exists (select 1 from ar where ar.v = u.a and ar.x = u.b)), edges as (select source, target from e), nodes as (select id from bb){CONVERGING}, me as (select bb.id, percent_rank() over (order by betweenness) as bridge, (ap.id is not null)::int as articulation, pagerank from bb join pr using (id) left join ap on ap.id = bb.id)"
_NAMED = "with w as (select string_split_regex(text, '[^A-Za-z]+') as w from benchmark), n as (select distinct unnest(list_concat(w, list_transform(range(1, greatest(len(w), 2)), lambda k: concat_ws(' ', w[k], w[k + 1])))) as name from w) select doc_id as key, name from documents join (select name from n where length(name) > 7) on contains(text, name)"
ORACLES = {
    "layer_histogram": f"{_N} select {_LAYER} as layer, count(*) as n from nodes group by 1",
    "dep_degree": f"{_N} select id, count(*) as dep_degree from (select source as id from edges where {_HIDE} union all select target from edges where {_HIDE}) group by id",
    "degree_rank": f"{WITH} select id, row_number() over (order by degree desc, id) as place from deg",
    "pagerank_rank": f"with recursive edges as ({links.LINKS}), nodes as (select source as id from edges union select target from edges){CONVERGING} select id, pagerank, row_number() over (order by pagerank desc, id) as place from pr",
    "betweenness": f"{_BFS} select id, betweenness from bb",
    "bridge_score": f"{_BFS} select id, round(100 * percent_rank() over (order by betweenness), 6) as bridge_score from bb",
    "articulation_points": f"{_L}, lo as (select a as v, min(b) as s from und group by a), r(v, x) as (select v, s from lo union select r.v, und.b from r join und on und.a = r.x where und.b <> r.v) select distinct u.a as id from und u where not exists (select 1 from r where r.v = u.a and r.x = u.b)",
    "shortest_path": f"{_L}, {_HOPS.format(name='h', start='page:0', most=14)} select coalesce(min(hop), 0)::bigint as hops, case when count(*) > 0 then 'page:0' end as first, case when count(*) > 0 then 'page:7' end as last from h where id = 'page:7'",
    "flow_levels": f"{_FLOWL} select * from fp",
    "impact_by_type": f"{_N}, l1 as (select distinct source as id from edges where target = 'nation:0'), l2 as (select distinct source as id from edges join l1 on target = l1.id), h as (select id, min(hop)::int as hop from (select id, 1 as hop from l1 union all select id, 2 from l2) group by id) select type, id, hop, count(*) over (partition by type) as n from h join nodes using (id)",
    "visible_slice": f"{_N}, w as (select source as a, target as b from edges where {_HIDE} union select target, source from edges where {_HIDE}), h0 as (select 'part:1' as id, 0 as hop), h1 as (select distinct b as id, 1 as hop from w where a = 'part:1'), s1 as (select * from h0 union all select * from h1), h2 as (select distinct b as id, 2 as hop from w join h1 on a = id where b not in (select id from s1) and (select count(*) from s1) <= 420), s2 as (select * from s1 union all select * from h2), h3 as (select distinct b as id, 3 as hop from w join h2 on a = id where b not in (select id from s2) and (select count(*) from s2) <= 420) select * from s2 union all select * from h3",
    "search_scored": f"{_N}, h as (select *, lower(label) as l, lower(id || '  ' || label || '  ' || split_part(id, ':', -1)) as hay, lower(split_part(id, ':', -1)) as c from nodes) select id, (case when l = 'customer' then 100 when starts_with(l, 'customer') then 40 when contains(l, 'customer') then 18 else 0 end + case when contains(c, 'customer') then 12 else 0 end + 1 + case when l = '00' then 100 when starts_with(l, '00') then 40 when contains(l, '00') then 18 else 0 end + case when contains(c, '00') then 12 else 0 end + 1)::int as score from h where contains(hay, 'customer') and contains(hay, '00') order by score desc, id limit 60",
    "relation_cards": f"{WITH}, h as (select source, target from edges where relation = 'in_nation'), c as (select target as id, 'customers' as fact, source as other from h where starts_with(source, 'customer:') union all select target, 'suppliers', source from h where starts_with(source, 'supplier:') union all select source, 'region', target from edges where relation = 'in_region' union all select target, 'parts', source from edges where relation = 'supplied_by' union all select source, 'places', target from h where starts_with(source, 'supplier:') union select h.source, 'places', e.target from h join edges e on e.source = h.target and e.relation = 'in_region' where starts_with(h.source, 'supplier:')) select c.id, fact, other, label from c left join nodes on nodes.id = other",
    "search_indexed": f"{_N}, h as (select *, lower(label) as l, lower(id || '  ' || label || '  ' || split_part(id, ':', -1)) as hay, lower(split_part(id, ':', -1)) as c from nodes) select id, (case when l = 'customer' then 100 when starts_with(l, 'customer') then 40 when contains(l, 'customer') then 18 else 0 end + case when contains(c, 'customer') then 12 else 0 end + 1 + case when l = '00' then 100 when starts_with(l, '00') then 40 when contains(l, '00') then 18 else 0 end + case when contains(c, '00') then 12 else 0 end + 1)::int as score from h where contains(hay, 'customer') and contains(hay, '00') order by score desc, id limit 60",
    "resolve_entity": f"{_N}, h as (select id, label, case when lower(label) = 'small' then 0 when starts_with(lower(label), 'small') then 1 when contains(lower(label), 'small') then 2 end as tier from nodes) select id, label, tier::int as tier from h where tier is not null order by tier, case when tier > 0 then length(label) else 0 end, id limit 1",
    "lab_filter_sort": f"{_RANKED} select id, label, degree from rn where type = 'part' and layer = 1 and contains(lower(id || '  ' || label), 'ring') and contains(lower(id || '  ' || label), 'part') order by degree desc nulls last, id limit 1200",
    "csv_projection": "select p_partkey || ',' || p_name || ',\"' || replace(p_name || ', \"' || p_brand || '\"', '\"', '\"\"') || '\"' as line from part",
    "neighbours_grouped": f"{_N} select id, heading, count(*) as n from (select source as id, case relation when 'contains' then 'Contains' else relation end as heading from edges union all select target, case relation when 'contains' then 'Part of' else relation || ' (in)' end from edges) group by all",
    "next_hop": f"{_MEASURED}, b as (select id, articulation * 0.5::double + 100 * bridge / 100 + pagerank * 40 as score from me), w as (select source as id, target as nxt, 0 as side from e union all select target, source, 1 from e), v as (select id, nxt, min(side) as side from w group by all) select v.id, nxt as next, case when side = 0 then 'links_to →' else '← links_to' end as via, round(score, 9) as score from v join b on b.id = nxt qualify row_number() over (partition by v.id order by score desc, nxt) = 1",
    "community_pressure": f"{links._CC}, edges as (select source, target from e), nodes as (select id from cc){CONVERGING}, m as (select cc.id, component as community, pagerank as degree, split_part(cc.id, ':', 1) as type from cc join pr using (id)), top4 as (select community, count(*) as n from m group by all order by n desc, community limit 4), k as (select community, id, row_number() over (partition by community order by degree desc, id) as p from m) select top4.community, n, round(n::double / max(n) over (), 9) as share, (select string_agg(id, ', ' order by p) from k where k.community = top4.community and p <= 3) as keys, (select string_agg(type, ', ' order by type) from (select distinct type from m where m.community = top4.community)) as kinds from top4",
    "browse_groups": f"{_N}, r as (select type as name, id, label from nodes where type <> 'orders' and (contains(lower(label), 's') or contains(split_part(id, ':', -1), 's'))) select name, count(*) over (partition by name) as n, row_number() over (partition by name order by label, id)::int as place, id, label from r qualify place <= 25",
    "filter_domains": f"{_N} select 'type' as facet, type as value, count(*) as n from nodes group by all union all select 'layer', ({_LAYER})::varchar, count(*) from nodes group by all",
    "edge_histogram": f"{_N} select relation, count(*) as n from edges where source = 'nation:0' or target = 'nation:0' group by all",
    "legend_counts": f"{_N}, k as (select id from nodes where type <> 'orders') select relation, count(*) as total, count(*) filter (source in (select id from k) and target in (select id from k)) as shown from edges group by all",
    "related_nodes": f"{_N} select distinct source as id from edges where target = 'nation:0' and relation in ('in_nation', 'in_region')",
    "top_by_type": f"{_RANKED} select type, row_number() over (partition by type order by degree desc nulls last, id)::int as place, id from rn qualify place <= 3",
    "names_in_texts": _NAMED,
    "names_by_rarest_piece": _NAMED,
    "theta_contains": "with w as (select distinct split_part(p_name, ' ', 1) as name from part) select p_partkey as key, name from part join w on contains(p_type || ' ' || p_name, name)",
    "declared_observed": "with a as (select distinct p_type from part where p_size < 3), b as (select distinct p_type from part where p_size > 48) select coalesce(a.p_type, b.p_type) as p_type, a.p_type is not null as declared, b.p_type is not null as observed from a full join b on a.p_type = b.p_type",
    "coverage_ratio": "select n_name, count(s_suppkey) as n_used, count(s_suppkey) > 0 as used_here from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name",
    "prioritised_resolve": "select c_custkey as ref, coalesce(s_name, p_name) as resolved from customer left join supplier on s_suppkey = c_custkey left join part on p_partkey = c_custkey and p_size < 25",
    "longest_prefix_owner": "with a as (select n_nationkey, r_name, r_name || '/' || n_name as dir from nation join region on n_regionkey = r_regionkey) select dir || '/' || c_name as path, case when n_nationkey % 2 = 0 then dir else r_name end as owner from customer join a on c_nationkey = n_nationkey",
    "stub_nodes": "select distinct 'customer:' || o_custkey as id, '? ' || o_custkey as label from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)",
    "node_upsert_first_wins": "select l_orderkey::varchar as id, first(l_returnflag order by l_linenumber, l_partkey, l_suppkey) filter (l_returnflag <> 'A') as label from lineitem group by l_orderkey",
    "edge_dedup_context": "select 'orders:' || l_orderkey as source, count(*) as n from (select distinct l_orderkey, l_partkey, l_linenumber from lineitem) group by l_orderkey",
    "introduced_by": "with e as (select l_partkey as target, l_suppkey as source, l_linestatus as f, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) as seq from lineitem where l_returnflag <> 'N') select id, arg_min(f, row(seq, side)) as file from (select target as id, f, seq, 0 as side from e union all select source, f, seq, 1 from e) group by id",
    "step_mix": "with c as (select conv_id, role, count(*) as n, case role when 'system' then 1 when 'user' then 2 when 'assistant' then 3 else 4 end as p from conversations group by all) select conv_id, string_agg(role || ' ' || n, ', ' order by p, role) as mix from c group by conv_id",
    "shape_classify": "select event_id, case event_id % 6 when 0 then 'tool' when 1 then 'workflow' when 2 then 'businessObject' when 3 then 'deeplink' when 4 then 'policy' end as kind, case when event_id % 6 < 5 then event_type end as code from events",
    "ingest_tallies": "select case when event_id % 7 = 0 then 'skipped: not an artifact' when event_id % 5 = 0 then 'skipped: not JSON' when event_id % 5 = 1 then 'skipped: bad JSON' when event_id % 5 = 2 then 'skipped: unrecognised shape' else 'tool' end as outcome, count(*) as n from events group by 1",
    "heading_parent": "with t as (select page_id as key, regexp_extract_all(html, '<(h[1-3]|p|a)[ >]', 1) as x from pages), r as (select key, unnest(range(len(x))) as place, unnest(x) as tag from t), l as (select key, place, (case tag when 'h1' then 1 when 'h2' then 2 when 'h3' then 3 when 'p' then 4 else 5 end)::int as level from r) select key, place, level, (select max(b.place) from l b where b.key = a.key and b.place < a.place and b.level < a.level) as parent from l a",
    "rule_modality": f"with r as (select doc_id, {_MOD.format('text')} as m from documents) select doc_id, split_part(m, '/', 1) as modality, split_part(m, '/', 2) as marker from r where m is not null",
    "rule_dedup_repeats": f"with l as (select doc_id, string_split(text, chr(10)) as x from documents), p as (select doc_id::varchar as key, unnest(range(len(x))) + 1 as line, unnest(x) as t from l), r as (select key, line, lower(regexp_replace(t, '\\s+', ' ', 'g')) as s from p where length(t) between 16 and 400 and {_MOD.format('t')} is not null), c as (select key, min(line) as line, count(*) as repeats from r group by key, s) select key, line, row_number() over (partition by key order by line) as seq, repeats, repeats - 1 as again from c",
    "markers_by_modality": f"with r as (select {_MOD.format('text')} as m from documents) select split_part(m, '/', 1) as modality, count(*) as n, string_agg(distinct split_part(m, '/', 2), ', ' order by split_part(m, '/', 2)) as markers from r where m is not null group by 1",
    "text_trim": "select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120) as summary from documents",
    "text_counts": "select doc_id, len(string_split(text, chr(10))) as lines, strlen(text) as bytes from documents",
    "path_parts": "with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as p from pages) select page_id, split_part(p, '/', -1) as base, regexp_replace(regexp_replace(p, '[^/]*$', ''), '/$', '') as dir from p",
    "mentions": "select distinct doc_id, unnest(regexp_extract_all(text, '[ .,]([A-Z]{4,})[ .,]', 1)) as token from documents",
    # Exact ties go to the larger value; DuckDB's format takes the even digit.
    "significant_digits": "with v as (select o_orderkey, o_totalprice / 7 as v from orders) select o_orderkey, format('{:.3e}', case when regexp_matches(format('{:.60e}', v), '^[0-9][.][0-9]{3}50*e') then nextafter(v, 'infinity'::double) else v end)::double as x from v",
    "note_path_dedup": "with p as (select p_partkey, left(trim(replace(p_type || ': ' || p_name, ':', '-')), 110) as path from part), k as (select *, row_number() over (partition by lower(path) order by p_partkey) as k from p) select p_partkey, case when k = 1 then path else path || ' (' || k || ')' end as note_path from k",
    "node_tags": f"{_N} select id, 'type/part,family/' || label || case when length(label) > 9 then ',finding/cut-vertex' else '' end || ',layer/specs-vocabulary' as tags from nodes where type = 'part'",
    "note_matter": f"{_N} select id, '---' || chr(10) || 'title: \"' || label || '\"' || chr(10) || 'type: \"' || type || '\"' || chr(10) || 'code: \"' || split_part(id, ':', -1) || '\"' || chr(10) || 'degree: 1' || chr(10) || 'tags: [\"type/' || type || '\"]' || chr(10) || '---' as matter from nodes where type in ('nation', 'region')",
    "flow_diagram": "with t as (select distinct conv_id, turn, role from conversations), k as (select *, 'n' || (row_number() over (partition by conv_id order by lpad(turn::varchar, 6, '0')) - 1) as nm from t), r as (select conv_id, case when role = 'user' then 'route' else 'llm' end as role, string_agg(nm, ',' order by nm) as nms from k group by all), l as (select conv_id, 0 as p, lpad(turn::varchar, 6, '0') as o, '  ' || nm || case when role = 'user' then '{\"' || role || '\"}' else '[\"' || role || '\"]' end as line from k union all select conv_id, 2, role, '  classDef ' || role || ' ' || case role when 'route' then 'fill:#fce8e6,stroke:#ea4335' else 'fill:#e8f0fe,stroke:#4285f4' end || chr(10) || '  class ' || nms || ' ' || role from r) select 'conv:' || conv_id as id, '```mermaid' || chr(10) || 'flowchart TD' || chr(10) || string_agg(line, chr(10) order by p, o) || chr(10) || '```' as diagram from l group by conv_id",
    "payload_nodes": f"{_N} select id, 'p' as prompt, null::varchar as summary, 'p ' || label as body from nodes where type = 'supplier'",
    "run_report": f"{_N} select 'type' as facet, type as value, count(*) as n from nodes group by all union all select 'relation', relation, count(*) from edges group by all",
    "report_rankings": f"{_MEASURED}, w as (select me.id, me.pagerank, bb.betweenness, articulation, split_part(me.id, ':', 1) as type from me join bb using (id)), u as (" + " union all ".join(f"select * from (select '{name}' as report, row_number() over (order by {c} desc, id)::int as place, id, {c} as value from w where {'true' if t is None else f'type in {t}'.replace(',)', ')')} and {'articulation = 1' if only else 'true'}) where place <= {k}" for name, c, k, t, only in PAGE_REPORTS) + ") select * from u",
    "report_text": f"{_RANKED}, t as (select id, label, coalesce(degree, 0)::double as v, row_number() over (order by degree desc nulls last, id) as p from rn where type = 'part') select '# Report' || chr(10) || chr(10) || '## x' || chr(10) || chr(10) || '| Node | Type | degree |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || label || ' | tool | ' || v || ' |', chr(10) order by p) || chr(10) as text from t where p <= 5",
    "degree_report": f"{_RANKED} select id, degree from rn where type = 'part' order by coalesce(degree, 0) desc, id limit 20",
    "risk_card": f"{_MEASURED.replace(links.LINKS, links.FLOW)}, rr as (select source, target from e union select rr.source, e.target from rr join e on e.source = rr.target), br as (select n.id, count(rr.source) as x from {links._ENDS} n left join rr on rr.target = n.id and rr.source <> rr.target group by n.id) select id, 'If you change this' as head, case when x = 0 then 'Nothing depends on it.' when x = 1 then '1 artifact can reach it.' else x || ' artifacts can reach it.' end as body from br union all select id, 'Single point of failure', 'Without it its part of the graph falls apart.' from me where articulation = 1 union all select id, 'Connector', 'More paths run through it than through ' || round(100 * bridge)::int || '% of the nodes.' from me where articulation = 0 and 100 * bridge >= 95",
    "rank_grid_layout": f"{_L}, {_LDEG}, k as (select id, row_number() over (order by degree desc, id) - 1 as p from ld), c as (select greatest(1, ceil(sqrt(count(*) * 1.7)))::bigint as cols, count(*) as n from ld) select id, round((p % cols - (cols - 1) / 2.0) * 96, 6)::double as x, round((p // cols - (ceil(n::double / cols) - 1) / 2.0) * 62, 6)::double as y from k cross join c",
    "radial_layout": f"{_L}, {_HOPS.format(name='h', start='page:0', most=3)}, {_LDEG}, m as (select id, min(hop) as hop from h group by id), k as (select m.id, hop, (row_number() over (partition by hop order by degree desc, m.id) - 1)::double / count(*) over (partition by hop) * 2 * pi() as a, case when hop = 0 then 0 else hop::double / greatest(max(hop) over (), 1) * 330 + 70 end as r from m join ld using (id)) select id, round(cos(a) * r, 5) + 0.0::double as x, round(sin(a) * r, 5) + 0.0::double as y from k",
    "level_layout": f"{_FLOWL}, s as (select level, count(*) as n, row_number() over (order by level) - 1 as col, count(*) over () as cols from fp group by level) select id, round((col - (cols - 1) / 2.0) * 210, 6)::double as x, round((place - (n - 1) / 2.0) * 52, 6)::double as y from fp join s using (level)",
    "node_sizes": f"{_L}, {_LDEG} select id, round(3.4::double + 12 * sqrt(degree::double / max(degree) over ()), 9) as size, round((degree * 137.508::double) % 360, 6) as hue from ld",
    "artifact_nodes": f"with {_STEPS}, n(type, layer, stub, id) as (select 'deeplink', 1, false, 'd' || n_nationkey from nation union select 'family', 5, false, 'f' || n_regionkey from nation union select 'product', 5, false, p_brand from part union select 'businessObject', 1, false, 'b' || s_suppkey from supplier union select 'boFunction', 1, false, 'g' || s_suppkey from supplier union select 'restResource', 1, false, 'r' || s_nationkey from supplier union select 'tool', 1, false, 't' || p_partkey from part union select 'deeplink', 1, true, 'd' || p_size from part where p_size not in (select n_nationkey from nation) and p_size not in (select s_suppkey from supplier) union select 'agent', case when r_regionkey = 0 then 3 else 2 end, false, 'a' || r_regionkey from region union select 'tool', 1, true, 'T' || r_regionkey from region union select 'workflowNode', 0, false, 'n' || o || '/' || k from st union select 'workflow', case when o in (select o from st where k = 3) or o in (select c_custkey from customer) then 3 else 2 end, false, 'w' || o from ws union select 'workflow', case when true then 2 end, true, 'W' || q from st where k = 3 union select 'workflow', 3, true, 'w' || c_custkey from customer where c_custkey not in (select o from ws) union select 'app', 4, false, 'p' || c_custkey from customer union select 'appPanel', 4, false, 'm' || c_custkey from customer union select 'issue', -1, false, 'u' from ws union select 'issue', -1, false, 'v' from st where q > 3 or not exists (select 1 from st b where b.o = st.o and b.k = st.q) union select 'appContextKey', 8, false, 'k' from ws) select type, layer::int as layer, stub, count(*) as n from n group by all",
    "artifact_edges": f"with {_STEPS} select relation, n from (select 'in_family' as relation, count(*) as n from nation union all select 'in_product', count(*) from part union all select 'exposes_rest_resource', count(*) from supplier union all select 'contains', (select count(*) from supplier) + (select count(*) from st) + (select count(*) from customer) union all select 'calls_rest', count(*) from supplier union all select 'backed_by', count(*) from part union all select 'uses_tool', (select count(*) from region) + 2 * (select count(*) from st where k = 1) - (select count(*) - count(distinct (o, p)) from st where k = 1) union all select 'calls_bo_function', count(*) from st where k = 2 and q % 2 = 0 union all select 'belongs_to', count(distinct q) from st where k = 2 and q % 2 = 0 union all select 'uses_business_object', count(*) from st where k = 2 and q % 2 <> 0 union all select 'depends_on_data', count(distinct (o, q)) from st where k = 2 union all select 'invokes_workflow', count(*) from st where k = 3 union all select 'calls', count(distinct (o, q)) from st where k = 3 union all select 'flows_to', count(*) from st a join st b on b.o = a.o and b.k = a.k + 1 union all select 'has_issue', (select count(*) from st a where not exists (select 1 from st b where b.o = a.o and b.k = a.k + 1)) + (select count(*) from st a where not exists (select 1 from st b where b.o = a.o and b.k = a.q)) union all select 'reads_output_of', count(*) from st a join st b on b.o = a.o and b.k = a.q where a.k <> a.q union all select 'reads_app_context', count(*) from st union all select 'exposes_agent', count(*) from customer union all select 'rendered_by', count(*) from customer union all select 'summarized_by', count(*) from customer) where n > 0",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "communities"]}
