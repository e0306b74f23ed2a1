"""Runs from sources to reports: python -m knotwork {graph,metrics,notes,all}.

graph reads files of artifacts and notes and stores nodes and edges; metrics computes every metric of a stored graph and reports on it;
notes writes a note for each node, maps and a home note; all does one after the other. Folders are such as driver and executors share.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import corpus
from knotwork.operators.metrics import node_metrics
from knotwork.sinks import notes, reports, tables
from knotwork.sinks.trees import add_files, write_tree
from knotwork.sources import files


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    p.add_argument("step", choices=("graph", "metrics", "notes", "all"))
    p.add_argument("--repo", action="append", default=[], help="a folder of sources; may be given more than once")
    p.add_argument("--local", action="append", default=[], help="a folder of one's own artifacts")
    p.add_argument("--out", required=True, help="the folder of the graph and of what is made of it")
    p.add_argument("--cli-help", help="a file with the help text of the command-line program")
    p.add_argument("--program", default="cli", help="the name of that program")
    p.add_argument("--base-skill", default="", help="the skill that others delegate to")
    p.add_argument("--include-classification", action="store_true", help="path metrics over relations that only classify, too")
    return p.parse_args(args)


def stored(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{out}/graph/nodes"), spark.read.parquet(f"{out}/graph/edges")


def make_graph(spark: SparkSession, a: argparse.Namespace) -> None:
    roots = [(r, "upstream", "") for r in a.repo] + [(r, "local", "local/") for r in a.local]
    if not roots:
        raise SystemExit("name a folder of sources: --repo or --local")
    found = files.scan(spark, roots)
    if not found.take(1):
        raise SystemExit(f"no files below {', '.join(r[0] for r in roots)}")
    text = None if a.cli_help is None else spark.read.option("wholetext", "true").text(a.cli_help).select(F.lit("help").alias("path"), F.col("value").alias("content"))
    nodes, edges = corpus.graph(spark, found, text, a.program, a.base_skill)
    tables.store(nodes, edges, f"{a.out}/graph")
    nodes, edges = stored(spark, a.out)
    tables.about(nodes, edges).coalesce(1).write.mode("overwrite").json(f"{a.out}/about")
    tables.run_report(nodes, edges).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{a.out}/run-report")
    files.warnings(found).write.mode("overwrite").json(f"{a.out}/warnings")


def make_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = stored(spark, a.out)
    metrics = node_metrics(nodes, edges, a.include_classification)
    metrics.write.mode("overwrite").parquet(f"{a.out}/metrics")
    measured = tables.enriched(nodes, spark.read.parquet(f"{a.out}/metrics"))
    report = reports.markdown(reports.rankings(measured), "Graph metrics")
    add_files(report.select(F.lit("metrics.md").alias("path"), F.col("text").alias("content")), f"{a.out}/reports")


def make_notes(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges = stored(spark, a.out)
    nodes = tables.enriched(nodes, spark.read.parquet(f"{a.out}/metrics"))
    write_tree(notes.notes(nodes, edges).select("path", "content").unionByName(reports.map_notes(nodes, edges)), f"{a.out}/notes", keep=(notes.SETTINGS,))


def main(args: list[str] | None = None) -> None:
    a = parsed(args)
    spark = SparkSession.builder.appName("knotwork").getOrCreate()
    for name, step in (("graph", make_graph), ("metrics", make_metrics), ("notes", make_notes)):
        if a.step in (name, "all"):
            step(spark, a)


if __name__ == "__main__":
    main()
