"""Reports over a graph and its metrics, each a named table of bounded size, and their Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.functions import text as T
from knotwork.operators import query as Q

#: (report, order, rows, types or None, only cut vertices)
RANKED = (
    ("pagerank", "pagerank", 15, None, False), ("pagerank_concrete", "pagerank", 15, S.CONCRETE, False), ("betweenness", "betweenness", 15, None, False), ("articulation", "betweenness", 25, None, True),
    ("blast", "blast_radius", 20, S.CONCRETE, False), ("blast_objects", "blast_radius", 20, ("businessObject",), False),
)
#: The map of hubs has more rows and counts rules as concrete.
HUBS = (("hub_pagerank", "pagerank", 20, (*S.CONCRETE, "rule"), False), ("hub_betweenness", "betweenness", 20, None, False), ("hub_articulation", "betweenness", 30, None, True), ("hub_blast", "blast_radius", 20, (*S.CONCRETE, "rule"), False), ("hub_degree", "degree", 25, None, False))


def rankings(nodes: DataFrame, reports: tuple = RANKED) -> DataFrame:
    """(report, place, id, label, type, value): all ranked tables in one pass over nodes with metrics, ties by id, missing values last.

    Every node takes part in the reports that its type and role admit it to. A task keeps the best of each report before anything is
    shuffled, as many as the longest report has, so a report gathers that many rows of each task.
    """
    row = lambda name, column, types, only: F.when((F.lit(True) if types is None else F.col("type").isin(*types)) & (F.coalesce("articulation", F.lit(False)) if only else F.lit(True)), F.struct(F.lit(name).alias("report"), F.col(column).cast("double").alias("value")))
    every = F.filter(F.array(*(row(name, column, types, only) for name, column, _, types, only in reports)), lambda r: r.isNotNull())
    rows = nodes.select("id", "label", "type", F.inline(every))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc_nulls_last("value"), "id"))
    best = rows.withColumn("place", place).where(F.col("place") <= max(r[2] for r in reports))
    most = S.lookup(F.col("report"), {r[0]: r[2] for r in reports}, 0)
    return best.where(F.col("place") <= most).select("report", "place", "id", "label", "type", "value")


def markdown(rows: DataFrame, title: str, names: dict[str, str] | None = None, reports: tuple = RANKED) -> DataFrame:
    """(text): rankings as one Markdown text, a table for each report in the order of reports, with their headings."""
    column = {r[0]: r[1] for r in reports}
    cells = F.concat_ws(" | ", F.coalesce("label", "id"), F.coalesce("type", F.lit("—")), F.coalesce(T.short_number(F.col("value")), F.lit("—")))
    line = F.concat(F.lit("| "), cells, F.lit(" |"))
    tables = rows.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("## "), S.lookup(F.col("report"), names or {r[0]: r[0].replace("_", " ") for r in reports}), F.lit("\n\n| Node | Type | "), S.lookup(F.col("report"), column), F.lit(" |\n| --- | --- | --- |\n"), "lines")
    at = S.lookup(F.col("report"), {r[0]: k for k, r in enumerate(reports)}, 0)
    return tables.select(F.struct(at.alias("at"), head.alias("text")).alias("t")).agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def metrics_report(nodes: DataFrame) -> str:
    """All ranked tables as one text; each holds few rows."""
    return markdown(rankings(nodes), "Graph metrics").first()["text"]


def rule_owners(nodes: DataFrame, most: int = 30) -> DataFrame:
    """(owner, n, prohibitions, obligations, recommendations) of documents with the most rules."""
    r = nodes.where("type = 'rule'")
    count = lambda m: F.count_if(F.col("modality") == m)
    by = r.groupBy("owner").agg(F.count("*").alias("n"), count("prohibition").alias("prohibitions"), count("obligation").alias("obligations"), count("recommendation").alias("recommendations"))
    return by.orderBy(F.desc("n"), "owner").limit(most)


def prohibitions(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """Prohibitions that govern the most, with how much."""
    out = edges.where("relation = 'governs'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("governs"))
    return nodes.where("type = 'rule' and modality = 'prohibition'").join(out, "id", "left").select("id", "label", "owner", F.coalesce("governs", F.lit(0)).alias("governs")).orderBy(F.desc("governs"), "id").limit(most)


def layer_lists(nodes: DataFrame, most: int = 40) -> DataFrame:
    """(layer, place, id, label): the first nodes of each layer by PageRank; of the lowest layer only those with findings or cut vertices, 20."""
    kept = nodes.where((F.col("layer") != 0) | F.col("articulation") | (F.size("issues") > 0))
    rows = Q.top_per_group(kept, ["layer"], [F.desc_nulls_last("pagerank"), F.col("id")], most)
    return rows.where((F.col("layer") != 0) | (F.col("place") <= 20)).select("layer", "place", "id", "label")


def data_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, step, function, object) of every call of a function of a business object."""
    n = lambda c, *more: nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), *more)
    calls = edges.where("relation = 'calls_bo_function'").select(F.col("source").alias("step"), F.col("target").alias("function"))
    rows = calls.join(n("step", F.col("workflow")), "step").join(n("function", F.col("businessObject").alias("code")), "function")
    objects = nodes.where("type = 'businessObject'").select("code", F.col("label").alias("object"))
    return rows.join(objects, "code", "left").select("workflow", F.col("step_label").alias("step"), F.col("function_label").alias("function"), F.coalesce("object", "code").alias("object"))


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, id, label, detail) of all that was found."""
    rows = edges.where("relation = 'has_issue'").select(F.col("source").alias("id"), F.col("target").alias("issue"), F.col("context").alias("detail"))
    return rows.join(nodes.select("id", "label"), "id").select("issue", "id", "label", "detail")


def node_type_report(nodes: DataFrame) -> DataFrame:
    """(id, status, instanceCount, ruleCount) of types of workflow nodes: used and specified, specified only, used only, scaffolding."""
    t = nodes.where("type = 'workflowNodeType'")
    status = F.when(F.coalesce("placeholder", F.lit(False)), "scaffolding").when(F.col("specified") & F.col("usedHere"), "specified and used").when(F.col("specified"), "specified, unused").otherwise("used, no specification")
    return t.select("id", status.alias("status"), "instanceCount", "ruleCount")


def catalogue(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a type by label, as the maps list them."""
    return nodes.where(F.col("type") == kind).orderBy("label", "id")


def maps(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The maps by name: lists, counts and rankings of every part of a corpus."""
    own = {f"list_{k}": catalogue(nodes, k).select("id", "label") for k in ("app", "workflow", "businessObject", "tool", "deeplink", "skill", "promptReference", "testKind", "toolType", "family", "product")}
    commands = nodes.where("type = 'cliCommand'").groupBy("group", "verb").agg(F.count("*").alias("n"))
    taxonomy = nodes.groupBy("type", "studioSection").agg(F.count("*").alias("n"))
    stack = nodes.groupBy("layer", "layerName").agg(F.count("*").alias("n"))
    return own | {
        "commands": commands, "taxonomy": taxonomy, "stack": stack, "rule_owners": rule_owners(nodes), "markers": Q.markers(nodes.where("type = 'rule'")), "prohibitions": prohibitions(nodes, edges),
        "data_flow": data_flow(nodes, edges), "findings": findings(nodes, edges), "node_types": node_type_report(nodes),
    }


def map_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, content) of a note for each map, lists by label and tables as lines, and of the home note that leads to them. A map gathers its own lines, as a file does."""
    parts = []
    for name, df in maps(nodes, edges).items():
        line = F.concat(F.lit("- "), F.concat_ws(" · ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns)))
        parts.append(df.select(F.lit(name).alias("map"), line.alias("line")))
    ranks = rankings(nodes, HUBS).select(F.lit("hubs").alias("map"), F.concat(F.lit("- "), F.concat_ws(" · ", "report", F.lpad(F.col("place").cast("string"), 2, "0"), F.coalesce("label", "id"), T.short_number(F.col("value")))).alias("line"))
    by = reduce(DataFrame.unionByName, parts, ranks).groupBy("map").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    by = by.select("map", F.size("lines").alias("n"), F.concat(F.lit("# "), F.replace("map", F.lit("_"), F.lit(" ")), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("content"))
    notes = by.select(F.concat(F.lit("maps/"), "map", F.lit(".md")).alias("path"), "content")
    item = F.concat(F.lit("- [["), F.lit("maps/"), "map", F.lit("]] ("), F.col("n").cast("string"), F.lit(")"))
    home = by.agg(F.concat(F.lit("# Home\n\n"), F.array_join(F.array_sort(F.collect_list(item)), "\n"), F.lit("\n")).alias("content")).select(F.lit("Home.md").alias("path"), "content")
    return notes.unionByName(home)
