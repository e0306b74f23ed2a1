"""Questions about a graph: search, resolving a name, filtered and sorted tables, neighbours, what to look at next, paths, impact, slices, catalogues. Nodes have id, label, type and what else is asked for; edges source, target, relation, context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.durable import Cuts, empty
from knotwork.functions import text as T
from knotwork.operators.names import containing as containing

#: Results of a search, rows of a table that are shown, and nodes after which a slice grows no further level.
MOST_HITS, MOST_ROWS, MOST_SLICE = 60, 1200, 420


def search_score(query: str, label: Column, code: Column, boost: Column, rank: Column) -> Column:
    """Points of a node: per word 100 if the label is it, else 40 if it begins with it, else 18 if it holds it; 12 if the code holds it, 1 in any case; without words 8000 times the PageRank. The type's boost comes on top."""
    low, own = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(code, F.lit("")))
    words = T.tokens(query)
    if not words:
        return F.coalesce(rank, F.lit(0.0)) * 8000 + boost
    points = [F.when(low == t, 100).when(low.startswith(t), 40).when(F.contains(low, F.lit(t)), 18).otherwise(0) + F.when(F.contains(own, F.lit(t)), 12).otherwise(0) + 1 for t in words]
    return reduce(lambda a, b: a + b, points) + boost


def search(nodes: DataFrame, query: str, hay: Sequence[str] = ("id", "label", "code"), most: int = MOST_HITS) -> DataFrame:
    """The best hits whose text holds all words of the query, with their score; ties by id."""
    col = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    rank = F.col("pagerank") if "pagerank" in nodes.columns else F.lit(0.0)
    score = search_score(query, col("label"), col("code"), S.lookup(F.col("type"), S.SEARCH_RANK, 0), rank)
    return nodes.where(T.matches(T.haystack(*map(col, hay)), query)).withColumn("score", score).orderBy(F.desc("score"), "id").limit(most)


def resolve(nodes: DataFrame, text: str) -> DataFrame:
    """The one node that a text means, if any: label or code is the text, else begins with it, else the label holds it; the shortest label first among the latter two, ties by id."""
    t = text.strip().lower()
    low, own = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("code", F.lit("")))
    tier = F.when((low == t) | (own == t), 0).when(low.startswith(t) | own.startswith(t), 1).when(F.contains(low, F.lit(t)), 2)
    found = nodes.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(t != ""))
    return found.orderBy("tier", F.when(F.col("tier") > 0, F.length("label")).otherwise(0), "id").limit(1)


def prioritised(refs: DataFrame, key: str, tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """refs with `resolved`: the value that the first of the tables gives for a reference. A table is (frame of key and value, the expression of refs that is looked up in it); what none knows has null."""
    out, found = refs, []
    for k, (table, look) in enumerate(tables):
        own = table.toDF(f"_k{k}", f"_v{k}").dropDuplicates([f"_k{k}"])
        out = out.join(own, F.expr(look) == F.col(f"_k{k}"), "left")
        found.append(F.col(f"_v{k}"))
    return out.select(*refs.columns, F.coalesce(*found).alias("resolved"))


def owner(paths: DataFrame, owners: DataFrame, sep: str = "/") -> DataFrame:
    """(path, owner): the longest of owners (owner) that a path begins with and that ends before a separator. Prefixes are made from the path, so this is an equality join."""
    parts = F.split("path", sep)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), sep))
    rows = paths.where(F.size(parts) > 1).select("path", F.explode(cuts).alias("owner"))
    return rows.join(owners.select("owner").distinct(), "owner").groupBy("path").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def lab_filter(nodes: DataFrame, q: str = "", layer: int | None = None, kind: str = "", family: str = "", flag: str = "", hay: Sequence[str] = ("id", "label", "code")) -> DataFrame:
    """Rows of a layer, type and family, with a flag (articulation, issues, stub or local), whose text holds all words."""
    test = T.matches(T.haystack(*[F.col(c) for c in hay]), q)
    if layer is not None:
        test = test & (F.col("layer") == layer)
    if kind:
        test = test & (F.col("type") == kind)
    if family:
        test = test & (F.col("family") == family)
    flags = {"articulation": "articulation", "issues": "size(issues) > 0", "stub": "stub", "local": "origin = 'local'"}
    return nodes.where(test & F.expr(flags[flag]) if flag else test)


def lab_sort(rows: DataFrame, column: str, descending: bool = True, most: int = MOST_ROWS, by: str = "id") -> DataFrame:
    """Rows by a column: of numbers those that miss come last when descending and first when ascending; of texts a missing one is empty. Ties by id."""
    c = F.coalesce(column, F.lit("")) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), by).limit(most)


def neighbours(edges: DataFrame, nodes: DataFrame, ident: str | None = None) -> DataFrame:
    """(id, heading, neighbour, label, context) of a node, or of all: out-edges under what they do, in-edges under what is done to the node."""
    own = lambda c: F.lit(True) if ident is None else F.col(c) == ident
    out = edges.where(own("source")).select(F.col("source").alias("id"), S.lookup(F.col("relation"), S.OUTBOUND).alias("h"), "relation", F.col("target").alias("neighbour"), F.nullif("context", F.lit("success")).alias("context"))
    back = edges.where(own("target")).select(F.col("target").alias("id"), S.lookup(F.col("relation"), S.INBOUND).alias("h"), F.concat("relation", F.lit(" (in)")).alias("relation"), F.col("source").alias("neighbour"), F.lit(None).cast("string").alias("context"))
    rows = out.unionByName(back).join(nodes.select(F.col("id").alias("neighbour"), "label"), "neighbour", "left")
    return rows.select("id", F.coalesce("h", "relation").alias("heading"), "neighbour", "label", "context")


def neighbour_counts(edges: DataFrame, nodes: DataFrame, ident: str | None = None) -> DataFrame:
    return neighbours(edges, nodes, ident).groupBy("id", "heading").agg(F.count("*").alias("n"))


def related(edges: DataFrame, relations: Sequence[str], ident: str, inbound: bool = False) -> DataFrame:
    """(id) at the other end of a node's edges of the relations."""
    here, there = ("target", "source") if inbound else ("source", "target")
    return edges.where((F.col(here) == ident) & F.col("relation").isin(*relations)).select(F.col(there).alias("id")).distinct()


def edge_histogram(edges: DataFrame, ident: str) -> DataFrame:
    """(relation, n): edges of a node in both directions."""
    return edges.where((F.col("source") == ident) | (F.col("target") == ident)).groupBy("relation").agg(F.count("*").alias("n"))


def next_hop(edges: DataFrame, metrics: DataFrame, hidden: tuple[str, ...] = S.CLASSIFICATION) -> DataFrame:
    """(id, next, via, score): the neighbour of each node that is most worth a look, by half a point for a cut vertex, its bridge score in hundredths and 40 times its PageRank; ties to the least id. An out-edge counts before an in-edge."""
    seen = edges.where(S.visible(F.col("relation"), hidden) & F.expr("source <> target"))
    way = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("next"), F.lit(0).alias("side"), "relation"), F.struct(F.col("target").alias("id"), F.col("source").alias("next"), F.lit(1).alias("side"), "relation"))
    near = seen.select(F.inline(way)).groupBy("id", "next").agg(F.min(F.struct("side", "relation")).alias("e"))
    score = F.when(F.col("articulation"), 0.5).otherwise(0.0) + F.coalesce("bridge_score", F.lit(0.0)) / 100 + F.coalesce("pagerank", F.lit(0.0)) * 40
    rows = near.join(metrics.select(F.col("id").alias("next"), score.alias("score")), "next")
    best = rows.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "next", "e")).alias("b"))
    return best.select("id", "b.next", F.when(F.col("b.e.side") == 0, F.concat("b.e.relation", F.lit(" →"))).otherwise(F.concat(F.lit("← "), "b.e.relation")).alias("via"), (-F.col("b.s")).alias("score"))


def grow(edges: DataFrame, start: str, hops: int, ways: str = "both", most: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, hop) of what lies within the hops of start: along the edges ("out"), against them ("in") or either way. most: no further level once more nodes than that are found. within: only nodes of (id)."""
    cuts = Cuts(edges.sparkSession)
    ends = {"out": [("source", "target")], "in": [("target", "source")], "both": [("source", "target"), ("target", "source")]}[ways]
    step = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends]).where("a <> b").distinct()
    if within is not None:
        step = step.join(within.select(F.col("id").alias("b")), "b", "left_semi")
    step = cuts.table(step, "steps")
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], "id string, hop int")
    count = 1
    for k in range(1, hops + 1):
        new = step.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        front = cuts.table(new.withColumn("hop", F.lit(k)), f"hop{k}")
        if empty(front):
            break
        seen, count = seen.unionByName(front), count + (front.count() if most else 0)
        if most and count > most:
            break
    return seen


def slice_of(edges: DataFrame, focus: str, depth: int, hidden: tuple[str, ...] = S.CLASSIFICATION, most: int | None = MOST_SLICE) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) around a focus over the relations that show, and the edges among them."""
    seen = edges.where(S.visible(F.col("relation"), hidden))
    near = grow(seen, focus, depth, "both", most)
    ids = near.select("id")
    return near, seen.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").select(*edges.columns)


def impact(edges: DataFrame, nodes: DataFrame, start: str, depth: int) -> DataFrame:
    """(type, id, hop, n): what depends on a node within the depth, over all relations, by type; n is the type's size, which orders the types."""
    hit = grow(edges, start, depth, "in").where("hop > 0").join(nodes.select("id", "type"), "id", "left").withColumn("type", F.coalesce("type", F.lit("?")))
    return hit.withColumn("n", F.count("*").over(Window.partitionBy("type"))).select("type", "id", "hop", "n")


def shortest_path(edges: DataFrame, start: str, end: str, directed: bool = False) -> DataFrame:
    """(step, source, target, relation, context, arrow) of one shortest path over all relations, in order; no rows if there is none or both ends are one.

    Each level keeps, for every new node, the least (place of the node before it, out-edges first, edge) and goes on until the end is
    reached; then the path is traced back by joins.
    """
    cuts = Cuts(edges.sparkSession)
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(0).alias("side"), "relation", "context")
    step = out if directed else out.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(1).alias("side"), "relation", "context"))
    step = cuts.table(step.where("a <> b"), "steps")
    spark = edges.sparkSession
    found = [spark.createDataFrame([(start, None, None, None, None)], "id string, prev string, side int, relation string, context string")]
    while start != end:
        seen = reduce(DataFrame.unionByName, [f.select("id") for f in found])
        new = step.join(found[-1].select(F.col("id").alias("a")), "a").join(seen.withColumnRenamed("id", "b"), "b", "left_anti")
        best = new.groupBy("b").agg(F.min(F.struct("a", "side", "relation", "context")).alias("e"))
        level = cuts.table(best.select(F.col("b").alias("id"), F.col("e.a").alias("prev"), "e.side", "e.relation", "e.context"), f"level{len(found)}")
        if empty(level):
            break
        found.append(level)
        if not empty(level.where(F.col("id") == end)):
            break
    kinds = "step int, source string, target string, relation string, context string, arrow string"
    at, rows = spark.createDataFrame([(end,)], "id string"), []
    if start == end or empty(found[-1].where(F.col("id") == end)):
        return spark.createDataFrame([], kinds)
    for k in range(len(found) - 1, 0, -1):
        hop = found[k].join(at, "id")
        rows.append(hop.select(F.lit(k).alias("step"), F.col("prev").alias("source"), F.col("id").alias("target"), "relation", "context", F.when(F.col("side") == 0, "→").otherwise("←").alias("arrow")))
        at = hop.select(F.col("prev").alias("id"))
    return reduce(DataFrame.unionByName, rows).orderBy("step")


def flow_levels(edges: DataFrame, focus: str, members: DataFrame, most: int = 29) -> DataFrame:
    """(id, level, place): levels along the edges from a focus within members (id, degree); what is not reached has -1. Within a level the higher degree stands first, ties by id."""
    level = grow(edges, focus, most, "out", within=members)
    rows = members.join(level, "id", "left").select("id", F.coalesce("hop", F.lit(-1)).alias("level"), "degree")
    return rows.select("id", "level", (F.row_number().over(Window.partitionBy("level").orderBy(F.desc("degree"), "id")) - 1).alias("place"))


def relation_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(relation, total, shown): edges of each relation in the whole graph, and among members (id)."""
    ids = members.select("id")
    inner = edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    every = edges.groupBy("relation").agg(F.count("*").alias("total"))
    return every.join(inner.groupBy("relation").agg(F.count("*").alias("shown")), "relation", "left").select("relation", "total", F.coalesce("shown", F.lit(0)).alias("shown"))


def browse(nodes: DataFrame, group: Column, q: str = "", most: int = 25, order: Column | None = None) -> DataFrame:
    """(name, n, place, id, label): groups of nodes that match, each with its size and its first ones by label; order ranks the groups. Null groups are left out."""
    low = q.strip().lower()
    fields = [c for c in ("label", "code", "product", "family") if c in nodes.columns]
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in fields]) if low else F.lit(True)
    rows = nodes.where(hit).select(group.alias("name"), "id", "label").where("name is not null")
    w = Window.partitionBy("name")
    rows = rows.select("name", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("label", "id")).alias("place"), "id", "label").where(F.col("place") <= most)
    return rows if order is None else rows.orderBy(order, "name", "place")


def community_pressure(nodes: DataFrame, group: str = "community", rank: str = "pagerank", most: int = 4, keys: int = 3) -> DataFrame:
    """(group, n, share, keys, kinds) of the largest groups: members, share of the largest one's, labels of the first by rank, and up to three types."""
    sizes = nodes.groupBy(group).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("type")), 1, 3).alias("kinds")).where(F.col(group).isNotNull())
    top = sizes.orderBy(F.desc("n"), group).limit(most)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(rank), "id"))
    named = nodes.join(F.broadcast(top.select(group)), group).withColumn("_k", first).where(F.col("_k") <= keys)
    lead = named.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "label"))), lambda x: x["label"]).alias("keys"))
    most_ = F.max("n").over(Window.partitionBy(F.lit(0)))
    return top.join(lead, group).select(group, "n", (F.col("n") / most_).alias("share"), "keys", "kinds")


def top(nodes: DataFrame, column: str, most: int, where: Column | None = None) -> DataFrame:
    """The first rows by a column, missing as 0, ties by id."""
    rows = nodes if where is None else nodes.where(where)
    return rows.orderBy(F.coalesce(column, F.lit(0)).desc(), "id").limit(most)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], most: int, name: str = "place") -> DataFrame:
    """The first rows of each group, with their place."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= most)


def coverage(types: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """types with n_used, how many rows of used have their key, and whether any has."""
    count = used.groupBy(key).agg(F.count("*").alias("_n"))
    return types.join(count, key, "left").withColumn("n_used", F.coalesce("_n", F.lit(0))).withColumn("used_here", F.col("n_used") > 0).drop("_n")


def declared_observed(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, declared, observed): whether each of the two has a value."""
    d = declared.select(key).distinct().withColumn("declared", F.lit(True))
    o = observed.select(key).distinct().withColumn("observed", F.lit(True))
    out = d.join(o, key, "full")
    return out.select(key, F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("observed", F.lit(False)).alias("observed"))


def numbered(rows: DataFrame, title: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """A title with a number in brackets from the second of its kind on; by and order say what is a kind and which comes first."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return F.when(k == 1, title).otherwise(F.concat(title, F.lit(" ("), k.cast("string"), F.lit(")")))


def risk(n: DataFrame) -> DataFrame:
    """(id, head, body): what a change of a node means, in the order of urgency; n has blast_radius, articulation, bridge_score, issues and stub."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in n.columns else F.lit(default)
    blast, bridge = has("blast_radius", 0), has("bridge_score", 0.0)
    say = lambda test, head, body: F.when(test, F.struct(F.lit(head).alias("head"), body.cast("string").alias("body")))
    found = F.array_join("issues", "; ") if "issues" in n.columns else F.lit(None).cast("string")
    lines = [
        say(blast > 0, "If you change this", F.concat(blast.cast("string"), F.when(blast == 1, " artifact can").otherwise(" artifacts can"), F.lit(" reach it."))),
        say(blast <= 0, "If you change this", F.lit("Nothing depends on it.")),
        say(has("articulation", False), "Single point of failure", F.lit("Without it its part of the graph falls apart.")),
        say(~has("articulation", False) & (bridge >= 95), "Connector", F.concat(F.lit("More paths run through it than through "), F.round(bridge).cast("int").cast("string"), F.lit("% of the nodes."))),
        say(F.coalesce(found != "", F.lit(False)), "Findings", found),
        say(has("stub", False), "Not in this corpus", F.lit("Mentioned by name only.")),
    ]
    return n.select("id", F.inline(F.filter(F.array(*lines), lambda x: x.isNotNull())))


def domain_facts(edges: DataFrame, nodes: DataFrame, ident: str) -> DataFrame:
    """(fact, direction, id, label): what a node is told by, from the relations that matter for its layer: who exposes and calls it, what it holds, uses, reads and runs on."""
    asks = (
        ("exposed by", S.EXPOSES, True), ("calls", S.SUPERVISES, False), ("called by", S.SUPERVISES, True), ("parts", ("contains", "nests"), False), ("part of", ("contains", "nests"), True), ("data", S.DATA, False),
        ("used for data by", S.DATA, True), ("tools", ("uses_tool", "backed_by", "is_tool_type"), False), ("models", ("uses_model",), False), ("rules", ("states", "governs"), False), ("governed by", ("governs", "governed_by"), True),
        ("documented in", ("documents", "documents_command", "documents_artifact"), True),
    )
    parts = [related(edges, rels, ident, back).select(F.lit(fact).alias("fact"), F.lit("in" if back else "out").alias("direction"), "id") for fact, rels, back in asks]
    return reduce(DataFrame.unionByName, parts).join(nodes.select("id", "label"), "id", "left").select("fact", "direction", "id", "label")


def step_mix(members: DataFrame, group: str, kind: str, order: Sequence[str]) -> DataFrame:
    """(group, mix): counts of kinds of a group's members as texts, in a fixed order of kinds, others behind it by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(kind)), F.lit(0)), F.lit(len(order) + 1))
    rows = members.groupBy(group, kind).agg(F.count("*").alias("n"))
    item = F.struct(place.alias("p"), F.col(kind).alias("k"), "n")
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["k"], F.lit(" "), x["n"].cast("string"))), ", ").alias("mix"))


def markers(rules: DataFrame) -> DataFrame:
    """(modality, n, markers): rules of each modality and the distinct markers they are known by."""
    return rules.groupBy("modality").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("marker")), ", ").alias("markers"))
