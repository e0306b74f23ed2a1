"""From candidate rows to one graph: first values win, stubs give way, edges once, missing files and layers filled in, loose ends dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.functions.classify import corpus_role
from knotwork.functions.text import first_match

EDGE = "source string, target string, relation string, context string, source_file string, seq struct<pass:int,file:string,n:long>"


def said(c: str) -> Column:
    """Whether a column holds a value: not null and no empty text; false and 0 are values."""
    return F.col(f"`{c}`").isNotNull() & ((F.col(f"`{c}`") != "") if S.KINDS.get(c, "string") == "string" else F.lit(True))


def upsert(candidates: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row for each id of candidates (id, seq, stub, columns ...): per column the value with the least seq that says anything.

    A stub stands for what is mentioned and not defined. It gives values only where it came before the first definition, and the row is a
    stub only if no definition came at all. Null ids are left out. The first values of stubs and of definitions are found apart, in one
    pass that merges before its shuffle, so candidates are made once and no task holds the rows of an id.
    """
    columns = [c for c in candidates.columns if c not in ("id", "seq", "stub")] if columns is None else list(columns)
    first = lambda c, kind: F.min(F.when(kind & said(c), F.struct("seq", F.col(f"`{c}`").alias("v"))))
    of = [x for k, c in enumerate(columns) for x in (first(c, ~F.col("stub")).alias(f"_r{k}"), first(c, F.col("stub")).alias(f"_s{k}"))]
    by = candidates.where("id is not null").groupBy("id").agg(F.min("seq").alias("seq"), F.min(F.when(~F.col("stub"), F.col("seq"))).alias("_real"), *of)
    value = lambda k: F.when(F.col("_real").isNull() | (F.col(f"_s{k}.seq") < F.col("_real")), F.col(f"_s{k}.v")).otherwise(F.col(f"_r{k}.v"))
    return by.select("id", "seq", F.col("_real").isNull().alias("stub"), *(value(k).alias(c) for k, c in enumerate(columns)))


def upsert_edges(candidates: DataFrame, key: tuple[str, ...] = ("source", "target", "relation", "context")) -> DataFrame:
    """One row for each key, the first by seq; none with a blank end or from a node to itself. A missing context counts as an empty one."""
    ends = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    rest = [c for c in candidates.columns if c not in (*key, "seq")]
    rows = candidates.where(ends)
    if "context" in key:
        rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    out = rows.groupBy(*key).agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in rest])
    return out.select(*[F.nullif(c, F.lit("")).alias(c) if c == "context" else c for c in candidates.columns])


def introduced(edges: DataFrame) -> DataFrame:
    """(id, file): the file of the first edge that mentions a node and has one; of one edge the target comes first."""
    ends = F.array(F.struct(F.col("target").alias("id"), F.lit(0).alias("side")), F.struct(F.col("source").alias("id"), F.lit(1).alias("side")))
    rows = edges.where("source_file is not null").select("seq", "source_file", F.explode(ends).alias("e")).select("seq", "source_file", "e.*")
    return rows.groupBy("id").agg(F.min_by("source_file", F.struct("seq", "side")).alias("file"))


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with layer, layerName, corpusHalf, corpusRole, stackRole, studioSection, component, appExposed.

    A workflow is a team if something exposes it or if it calls others; an agent is one if its kind says so. All other types have fixed layers.
    """
    exposed = edges.where(F.col("relation").isin(*S.EXPOSES)).select(F.col("target").alias("id")).distinct().withColumn("_exposed", F.lit(True))
    calls = edges.where(F.col("relation").isin(*S.SUPERVISES)).select(F.col("source").alias("id")).distinct().withColumn("_calls", F.lit(True))
    rows = nodes.join(exposed, "id", "left").join(calls, "id", "left")
    wf, agent = F.col("type") == "workflow", F.col("type") == "agent"
    out, sup = F.col("_exposed").isNotNull(), F.col("_calls").isNotNull()
    chief = F.coalesce(F.upper("agentKind") == "SUPERVISOR", F.lit(False))
    layer = first_match([(agent & chief, 3), (agent, 2), (wf & (out | sup), 3), (wf, 2)], S.lookup(F.col("type"), S.TYPE_LAYER, -1))
    role = first_match([(agent & chief, "supervisor agent"), (agent, "agent"), (wf & sup, "supervisor"), (wf & out, "workflow"), (wf, "agent")])
    section = first_match([(agent & chief, "Resources · Supervisor Agents"), (agent, "Resources · Agents")], S.lookup(F.col("type"), S.SECTIONS, "Derived"))
    rows = rows.withColumn("layer", layer.cast("int"))
    return rows.withColumns(
        {
            "layerName": S.lookup(F.col("layer"), S.LAYER_NAMES), "corpusHalf": S.lookup(F.col("layer"), S.LAYER_HALF, "sample"), "corpusRole": corpus_role(F.col("stub"), F.col("source_file")),
            "stackRole": role, "studioSection": section, "component": F.col("type").isin(*S.COMPONENTS), "appExposed": wf & out,
        }
    ).drop("_exposed", "_calls")


def issues(edges: DataFrame) -> DataFrame:
    """(id, issues): what was found at a node, as texts of kind and detail, in the order found."""
    found = edges.where("relation = 'has_issue'")
    kind = F.element_at(F.split(F.regexp_replace("target", "^issue:", ""), "-"), 1)
    rows = found.select(F.col("source").alias("id"), "seq", F.concat(F.when(kind == "duplicate", "duplicate").when(kind == "unwired", "unwired").when(kind == "unresolved", "unresolved").otherwise("orphan"), F.lit(": "), "context").alias("x"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]).alias("issues"))


def finalise(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph as it is kept: nodes without a label go, layers are given (by the files that nodes have of their own), then nodes and edges without a file get one, and edges that miss an end go."""
    named = layered(nodes.where(said("label")), edges).join(issues(edges), "id", "left")
    full = named.join(introduced(edges), "id", "left")
    full = full.withColumns(
        {
            "file_type": S.lookup(F.col("type"), S.FILE_TYPES, "code"), "derived": F.col("source_file").isNull(), "source_file": F.coalesce("source_file", "file", F.lit("(derived)")),
            "source_location": F.coalesce("source_location", F.lit("L1")),
        }
    ).drop("file")
    files = full.select("id", "source_file")
    kept = edges.join(files.toDF("source", "_sf"), "source").join(files.toDF("target", "_tf"), "target")
    return full, kept.withColumn("source_file", F.coalesce("source_file", "_sf", "_tf")).select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end that is no node."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return out.where("_s is null or _t is null").select(*edges.columns)
