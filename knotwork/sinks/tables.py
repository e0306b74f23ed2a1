"""Graphs as JSON, payloads, CSV and reports of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.sinks.trees import add_files, write_tree

#: Columns of the table of nodes and of its export.
LAB = ("label", "studioSection", "layerName", "type", "family", "product", "community", "pagerank_rank", "pagerank", "bridge_score", "blast_radius", "degree", "clustering")
#: Fields of a node that a payload leaves out, and the names that long ones get.
PRUNED, RENAMED = ("seq", "file_type", "source_location", "stub"), {"promptExcerpt": "prompt", "caseExpression": "expr", "sourceCodeExcerpt": "src"}
BODY = ("promptExcerpt", "caseExpression", "sourceCodeExcerpt", "resourcePath", "destinationUrl")


def store(nodes: DataFrame, edges: DataFrame, root: str, metrics: DataFrame | None = None) -> None:
    """The graph as tables below root: nodes, edges and, where given, metrics. Each is replaced whole; nothing is changed in place."""
    for name, df in (("nodes", nodes), ("edges", edges), ("node_metrics", metrics)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def enriched(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """nodes with their metrics."""
    return nodes.join(metrics, "id", "left")


def pruned(nodes: DataFrame) -> DataFrame:
    """Nodes as a payload has them: no empty texts, shorter names, no summary that repeats a rule's body, and one body of all texts to search in."""
    own = set(nodes.columns)
    body = F.nullif(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in BODY if c in own]), F.lit("")) if own & set(BODY) else F.lit(None).cast("string")
    cols = []
    for c, t in nodes.dtypes:
        if c in PRUNED:
            continue
        x: Column = F.nullif(F.col(f"`{c}`"), F.lit("")) if t == "string" else F.col(f"`{c}`")
        if c == "summary" and "type" in own:
            x = F.when(F.col("type") != "rule", x)
        if c == "body":
            x = F.coalesce(body, x)
        cols.append(x.alias(RENAMED.get(c, c)))
    if "body" not in own:
        cols.append(body.alias("body"))
    return nodes.select(*cols)


def pruned_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "relation", F.nullif(F.nullif("context", F.lit("success")), F.lit("")).alias("context"))


def payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): a line of JSON for each node and each edge, without what is null."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("json"))
    return line(pruned(nodes), "node").unionByName(line(pruned_edges(edges), "edge"))


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of JSON lines for nodes and one for edges, written by all tasks."""
    payload(nodes, edges).write.mode("overwrite").partitionBy("part").text(path)


def csv_field(x: Column) -> Column:
    """A field of CSV, in quotes only if it holds a quote, a comma or a line break; null is empty."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line) of rows; lists are joined by semicolons."""
    kinds = dict(rows.dtypes)
    return rows.select(F.concat_ws(",", *[csv_field(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c)) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] = (*LAB, "articulation", "issues", "source_file")) -> None:
    kinds = dict(rows.dtypes)
    flat = rows.select(*[F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])
    flat.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_ingested(artifacts: DataFrame, root: str, clean: bool = True) -> None:
    """Artifacts that sources.files.ingested recognised, each as a file at its target below root, and a manifest of what went where and why the rest did not.

    Of artifacts with one target the first path counts. clean: whatever was below root goes; otherwise what is new is added to what is there.
    """
    known = artifacts.where("kind is not null").groupBy("target").agg(F.min_by(F.coalesce("content", F.lit("")), "path").alias("content"))
    files = known.select(F.col("target").alias("path"), "content")
    if clean:
        write_tree(files, f"{root}/src")
    else:
        add_files(files, f"{root}/src")
    artifacts.select("path", "kind", "code", "target", "skipped").write.mode("overwrite").json(f"{root}/manifest")


def tallies(artifacts: DataFrame) -> DataFrame:
    """(outcome, n): artifacts of each kind, and what was passed over for each reason."""
    return artifacts.groupBy(F.coalesce(F.concat(F.lit("skipped: "), "skipped"), "kind").alias("outcome")).agg(F.count("*").alias("n"))


def about(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges there are, and when this was built, in UTC."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    built = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges"))).withColumn("builtAt", built)


def run_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, value, n): nodes by type, layer, corpus role and section, edges by relation, and how many nodes are stubs; the most first within a facet."""
    facets = [(nodes, c, c) for c in ("type", "layerName", "corpusRole", "studioSection") if c in nodes.columns] + [(edges, "relation", "relation")]
    parts = [df.groupBy(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for df, c, name in facets]
    if "stub" in nodes.columns:
        parts.append(nodes.where("stub").groupBy(F.lit("stub").alias("facet"), F.col("type").alias("value")).agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("facet", F.desc("n"), "value")


def markdown_table(rows: DataFrame, columns: Sequence[tuple[str, str]], order: Sequence[Column]) -> DataFrame:
    """(text) one table of Markdown, of a bounded number of rows such as a top list; numbers below 0.01 with an exponent."""
    kinds = dict(rows.dtypes)
    cell = lambda c: T.short_number(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit("—"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for _, c in columns]), F.lit(" |"))
    rows = rows.select(F.struct(*order).alias("o"), line.alias("line"))
    head = "| " + " | ".join(h for h, _ in columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    return rows.agg(F.array_join(F.concat(F.array(F.lit(head)), F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])), "\n").alias("text"))


def bundle(page: str, styles: dict[str, str], scripts: dict[str, str]) -> str:
    """One page that needs no other file: each tag is replaced by the text it stands for, taken as it is; closing script tags within scripts are broken up."""
    for tag, body in styles.items():
        page = page.replace(tag, f"<style>\n{body}\n</style>")
    for tag, body in scripts.items():
        page = page.replace(tag, "<script>\n" + body.replace("</script>", "<\\/script>") + "\n</script>")
    return page
