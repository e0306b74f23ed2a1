"""A corpus of files as one typed graph: all passes, assembled and finished."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.durable import Cuts
from knotwork.operators import artifacts, assemble, authoring


def graph(spark: SparkSession, files: DataFrame, help_texts: DataFrame | None = None, program: str = "cli", base_skill: str = "", cuts: Cuts | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of FILE rows: artifacts and what is written about them."""
    cuts = cuts or Cuts(spark)
    files = cuts.table(files, "files")
    e = artifacts.extract(spark, files, cuts)
    own, _ = e.graph()
    steps = cuts.table(own.where("type = 'workflowNode'").select(F.col("id").alias("nid"), F.col("nodeType").alias("type")).distinct(), "steps")
    authoring.extract(spark, e, files, steps, help_texts, program, base_skill)
    nodes, edges = e.graph()
    nodes = cuts.table(assemble.upsert(nodes), "nodes")
    nodes = nodes.join(e.rule_counts.withColumnsRenamed({"owner": "id", "ruleCount": "_rules"}), "id", "left").withColumn("ruleCount", F.coalesce("ruleCount", "_rules")).drop("_rules")
    nodes, tools = authoring.tool_types(nodes, e.declared)
    edges = cuts.table(assemble.upsert_edges(edges.unionByName(tools)), "edges")
    nodes = cuts.table(authoring.usage(nodes, edges), "used")
    return assemble.finalise(nodes, edges)
