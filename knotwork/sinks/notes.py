"""A note for each node: its path, front matter, tags, body with links, and diagrams of flows, as rows (id, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.functions import text as T
from knotwork.operators import query as Q
from knotwork.sinks.trees import write_tree

#: Workflow nodes that only hold a flow together get no note.
STRUCTURAL = ("START", "END", "ADD")
#: Shapes of a diagram by node type: what stands around the label (fixed values).
SHAPES = {
    "START": ('(["', '"])'), "END": ('(["', '"])'), "SWITCH": ('{"', '"}'), "CONDITION": ('{"', '"}'), "CODE": ('[/"', '"/]'), "BO_FUNCTION": ('[("', '")]'), "DOCUMENT_PROCESSOR": ('[("', '")]'),
    "WORKFLOW": ('[["', '"]]'), "TOOL": ('[/"', '"\\]'), "PARALLEL": ('[["', '"]]'), "LOOP": ('[["', '"]]'), "WHILE": ('[["', '"]]'),
}
ROLES = {"LLM": "llm", "BO_FUNCTION": "data", "DOCUMENT_PROCESSOR": "data", "CODE": "code", "SWITCH": "route", "CONDITION": "route", "WORKFLOW": "sub", "TOOL": "sub"}
#: Colours by role (fixed values: the SQL of flow_diagram has them too).
STYLES = {"llm": "fill:#e8f0fe,stroke:#4285f4", "data": "fill:#e6f4ea,stroke:#34a853", "code": "fill:#fef7e0,stroke:#f9ab00", "route": "fill:#fce8e6,stroke:#ea4335", "sub": "fill:#f3e8fd,stroke:#a142f4"}
MATTER = (
    "title", "type", "code", "nodeType", "workflow", "family", "product", "status", "architecture", "pagePattern", "operationType", "toolTypeName", "verb", "group", "nodeCount", "agentCount", "aiAppsCompatible", "seeded",
    "source_file", "layerName", "corpusRole", "modality", "marker", "promptRole", "owner", "ruleCount", "specified", "instanceCount", "stackRole", "appExposed", "pagerank", "pagerank_rank", "bridge_score", "blast_radius", "community",
    "community_size", "clustering", "degree", "articulation",
)


def sanitised(name: Column) -> Column:
    """A name that may stand in a path."""
    out = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|#^\[\]]', "-"), r"\s+", " "), r"^\.+", "")), F.lit(110))
    return F.when(F.coalesce(out, F.lit("")) == "", "untitled").otherwise(out)


def claimed(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """rows with note_path: paths that are equal but for case get numbers from (2) on, in order; numbers that other rows claim of themselves are passed over."""
    low = F.lower(path)
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(low).orderBy(*order)))
    tail = r" \((\d+)\)$"
    taken = rows.select(F.lower(F.regexp_replace(path, tail, "")).alias("_l"), F.regexp_extract(path, tail, 1).alias("_t")).where("_t <> ''").groupBy("_l").agg(F.collect_set(F.col("_t").cast("int")).alias("_taken"))
    own = own.withColumn("_l", low).join(taken, "_l", "left")
    # The k-th number that is free: k plus the taken ones below it.
    free = F.filter(F.sequence(F.lit(2), F.col("_k") + F.coalesce(F.size("_taken"), F.lit(0)) + 1), lambda x: ~F.array_contains(F.coalesce("_taken", F.array().cast("array<int>")), x))
    return own.withColumn("note_path", F.when(F.col("_k") == 1, F.col(path)).otherwise(F.concat(path, F.lit(" ("), F.get(free, F.col("_k") - 2).cast("string"), F.lit(")")))).drop("_k", "_l", "_taken")


def paths(nodes: DataFrame) -> DataFrame:
    """(id, note_path) of the nodes that get a note."""
    kind = F.col("type")
    own = nodes.where(S.lookup(kind, S.FOLDERS).isNotNull() & ~F.coalesce((kind == "workflowNode") & F.col("nodeType").isin(*STRUCTURAL), F.lit(False)))
    folder, label = S.lookup(kind, S.FOLDERS), sanitised(F.col("label"))
    under = lambda c, default="unknown": F.concat(folder, F.lit("/"), sanitised(F.coalesce(c, F.lit(default))))
    stated = kind.isin("rule", "docSection")
    place = T.first_match(
        [
            (kind == "workflowNode", under("workflow")), (kind == "boFunction", under("businessObject")), (kind.isin("appPanel", "appSubPanel", "appAction"), under("app")),
            (stated, F.concat(folder, F.lit("/"), sanitised(F.regexp_replace(F.coalesce("owner", "parent", F.lit("unknown")), r"\.md$", "")))),
        ],
        folder,
    )
    short = F.regexp_replace(F.left(label, F.lit(80)), r"[\s.·-]+$", "")
    base = T.first_match(
        [
            (kind == "workflowNode", sanitised(F.col("code"))), (kind == "boFunction", sanitised(F.coalesce("code", "label"))), (kind == "restResource", sanitised(F.regexp_replace(F.regexp_replace("label", "^/", ""), "/", " · "))),
            (stated, F.when(short == "", "rule").otherwise(short)),
        ],
        label,
    )
    rows = own.select("id", F.concat(place, F.lit("/"), base).alias("path"))
    return claimed(rows, "path", ["id"]).select("id", "note_path")


def link(path: Column, label: Column) -> Column:
    """A link to a note; a plain name where there is none."""
    return F.when(path.isNull(), label).when(T.basename(path) == label, F.concat(F.lit("[["), path, F.lit("]]"))).otherwise(F.concat(F.lit("[["), path, F.lit("|"), label, F.lit("]]")))


def tags(n: DataFrame) -> Column:
    """Facets of a node as tags."""
    has = set(n.columns)
    tag = lambda prefix, c: F.when(F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)), F.concat(F.lit(f"{prefix}/"), F.col(f"`{c}`").cast("string"))) if c in has else F.lit(None).cast("string")
    flag = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    plain = lambda prefix, c, low=False: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{prefix}/"), (F.lower if low else (lambda x: x))(F.regexp_replace(F.col(f"`{c}`"), "(?i)[^a-z]+", "-")))) if c in has else F.lit(None).cast("string")
    is_type = F.col("type") == "workflowNodeType"
    own = [tag("type", "type"), tag("family", "family"), tag("product", "product"), tag("node", "nodeType"), plain("group", "group"), tag("verb", "verb"), tag("rule", "modality"), tag("prompt", "promptRole"), tag("corpus", "corpusRole")]
    if "stub" in has:
        own.append(flag(F.col("stub"), "stub/platform-seeded"))
    if {"placeholder", "specified", "usedHere"} <= has:
        own.append(F.when(is_type, F.when(F.coalesce("placeholder", F.lit(False)), "spec/builder-scaffolding").when(F.coalesce("specified", F.lit(False)), "spec/specified").otherwise("spec/undocumented")))
        own.append(flag(is_type & ~F.coalesce("usedHere", F.lit(False)), "spec/unused-in-samples"))
    if "issues" in has:
        own.append(flag(F.size("issues") > 0, "finding/has-issue"))
    if "articulation" in has:
        own.append(flag(F.col("articulation"), "finding/cut-vertex"))
    own += [plain("layer", "layerName", True), tag("tool", "toolTypeKey"), F.when(F.col("community").isNotNull(), F.concat(F.lit("community/C-"), F.col("community").cast("string"))) if "community" in has else F.lit(None).cast("string")]
    return F.filter(F.array(*own), lambda x: x.isNotNull())


def scalar(x: Column, kind: str) -> Column:
    """A value of front matter: numbers and truth values as they are, texts and lists in quotes; null if there is none."""
    quoted = lambda s: F.regexp_extract(F.to_json(F.array(s)), r"^\[(.*)\]$", 1)
    if kind.startswith("array"):
        return F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(F.transform(x, lambda s: quoted(s)), ", "), F.lit("]")))
    return F.when(F.trim(x) != "", quoted(F.trim(x))) if kind == "string" else x.cast("string")


def front_matter(n: DataFrame, fields: tuple[str, ...] = MATTER) -> Column:
    kinds = dict(n.dtypes)
    names = {"title": "label", "source_file": "source_file"}
    lines = [F.concat(F.lit(f"{f}: "), scalar(F.col(f"`{names.get(f, f)}`"), kinds[names.get(f, f)])) for f in fields if names.get(f, f) in kinds]
    return F.concat_ws("\n", F.lit("---"), *lines, F.concat(F.lit("tags: "), scalar(tags(n), "array<string>")), F.lit("---"))


def diagram_label(x: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(x, '"', "'"), r"[\n\r]+", " "), F.lit(60))


def flow_diagrams(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, diagram) of workflows: their nodes by shape, flows, data and error ways, and a colour for each role. Names within a diagram are n0, n1, ... in the order of the nodes' ids."""
    member = edges.where("relation = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("nid"))
    member = member.join(nodes.where("type = 'workflowNode'").select(F.col("id").alias("nid"), "nodeType", "label"), "nid")
    name = F.concat(F.lit("n"), (F.row_number().over(Window.partitionBy("id").orderBy("nid")) - 1).cast("string"))
    member = member.withColumn("name", name)
    around = lambda k: F.coalesce(S.lookup(F.col("nodeType"), {t: s[k] for t, s in SHAPES.items()}), F.lit('["' if k == 0 else '"]'))
    lines = member.select("id", F.lit(0).alias("part"), F.col("nid").alias("o"), F.concat(F.lit("  "), "name", around(0), diagram_label(F.col("label")), around(1)).alias("line"))
    ends = lambda c, n: member.select("id", F.col("nid").alias(c), F.col("name").alias(n))
    inner = edges.where(F.col("relation").isin("flows_to", "reads_output_of", "on_error_to")).join(ends("source", "a"), "source").join(ends("target", "b"), ["id", "target"])
    says = F.when(F.coalesce(F.col("context") != "success", F.lit(False)), F.concat(F.lit('|"'), diagram_label(F.col("context")), F.lit('"|'))).otherwise("")
    way = T.first_match([(F.col("relation") == "flows_to", F.concat("a", F.lit(" -->"), says, F.lit(" "), "b")), (F.col("relation") == "reads_output_of", F.concat("b", F.lit(" -.->|data| "), "a"))], F.concat("a", F.lit(" -.->|error| "), "b"))
    lines = lines.unionByName(inner.select("id", F.lit(1).alias("part"), F.concat_ws(">", "source", "target", "relation", "context").alias("o"), F.concat(F.lit("  "), way).alias("line")))
    role = member.withColumn("role", S.lookup(F.col("nodeType"), ROLES)).where("role is not null").groupBy("id", "role").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    style = F.concat(F.lit("  classDef "), "role", F.lit(" "), S.lookup(F.col("role"), STYLES), F.lit("\n  class "), "names", F.lit(" "), "role")
    lines = lines.unionByName(role.select("id", F.lit(2).alias("part"), F.col("role").alias("o"), style.alias("line")))
    return _drawn(lines, "TD")


def _drawn(lines: DataFrame, way: str) -> DataFrame:
    body = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("part", "o", "line"))), lambda x: x["line"])), "\n")
    return lines.groupBy("id").agg(F.concat(F.lit(f"```mermaid\nflowchart {way}\n"), body, F.lit("\n```")).alias("diagram"))


def app_diagrams(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, diagram) of apps: panels, the workflows that render them, other apps they lead to, and the data of the workflows, one hop on."""
    app = nodes.where("type = 'app'").select("id", "label")
    e = lambda rel, ctx=None: edges.where((F.col("relation") == rel) & ((F.col("context") == ctx) if ctx else F.lit(True))).select("source", "target")
    step = lambda at, rel, ctx=None: at.select("id", F.col("nid").alias("source")).join(e(rel, ctx), "source").select("id", "source", F.col("target").alias("nid"))
    root = app.select("id", F.lit(None).cast("string").alias("source"), F.col("id").alias("nid"))
    panels = step(root, "contains", "panel")
    subs = step(panels, "contains", "sub-panel")
    flows = step(panels, "rendered_by").unionByName(step(subs, "rendered_by"))
    data = step(flows, "depends_on_data")
    leads = step(root, "navigates_to")
    parts = [(root, 0, '["', '"]', " --> "), (panels, 1, '("', '")', " --> "), (subs, 2, '("', '")', " --> "), (flows, 3, '[["', '"]]', " --> "), (leads, 4, '["', '"]', " -.->|navigates| "), (data, 5, '[("', '")]', " --> ")]
    every = None
    for df, part, lo, hi, arrow in parts:
        rows = df.select("id", "source", "nid", F.lit(part).alias("part"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(arrow).alias("arrow"))
        every = rows if every is None else every.unionByName(rows)
    names = every.select("id", "nid").distinct()
    names = names.withColumn("name", F.concat(F.lit("n"), (F.row_number().over(Window.partitionBy("id").orderBy("nid")) - 1).cast("string")))
    rows = every.join(names, ["id", "nid"]).join(nodes.select(F.col("id").alias("nid"), "label"), "nid").join(names.select("id", F.col("nid").alias("source"), F.col("name").alias("from")), ["id", "source"], "left")
    shape = F.concat(F.lit("  "), "name", "lo", diagram_label(F.col("label")), "hi")
    line = F.when(F.col("from").isNull(), shape).otherwise(F.concat(shape, F.lit("\n  "), "from", "arrow", "name"))
    return _drawn(rows.select("id", "part", F.concat_ws(">", "source", "nid").alias("o"), line.alias("line")), "LR")


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, content): front matter, title, summary, findings, diagram, and the neighbours by heading with links."""
    at = paths(nodes)
    near = Q.neighbours(edges, nodes).join(at.select(F.col("id").alias("neighbour"), "note_path"), "neighbour", "left")
    item = F.concat(F.lit("- "), link(F.col("note_path"), F.coalesce("label", "neighbour")), F.when(F.col("context").isNotNull(), F.concat(F.lit(" — *"), "context", F.lit("*"))).otherwise(""))
    by = near.withColumn("item", item).groupBy("id", "heading").agg(F.array_join(F.array_sort(F.collect_set("item")), "\n").alias("items"))
    rel = by.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heading", "items"))), lambda x: F.concat(F.lit("### "), x["heading"], F.lit("\n"), x["items"])), "\n\n").alias("relations"))
    drawn = flow_diagrams(nodes, edges).unionByName(app_diagrams(nodes, edges))
    n = nodes.join(at, "id").join(rel, "id", "left").join(drawn, "id", "left")
    found = F.when(F.size("issues") > 0, F.concat(F.lit("> [!warning] Findings\n"), F.array_join(F.transform("issues", lambda i: F.concat(F.lit("> - "), i)), "\n"))) if "issues" in nodes.columns else F.lit(None).cast("string")
    stub = F.when(F.col("stub"), F.lit("> [!info] Mentioned, but not part of this corpus")) if "stub" in nodes.columns else F.lit(None).cast("string")
    cut = F.when(F.col("articulation"), F.lit("> [!danger] Structural single point of failure")) if "articulation" in nodes.columns else F.lit(None).cast("string")
    rule = F.when(F.col("type") == "rule", F.concat(F.lit("> [!"), S.lookup(F.col("modality"), {"prohibition": "danger", "obligation": "warning", "recommendation": "tip"}, "note"), F.lit("] "), "modality", F.lit("\n> "), "body")) if {"modality", "body"} <= set(nodes.columns) else F.lit(None).cast("string")
    content = F.concat_ws("\n\n", front_matter(nodes), F.concat(F.lit("# "), "label"), F.concat(F.lit("> "), F.nullif("summary", F.lit(""))), stub, found, cut, rule, F.concat(F.lit("## Flow\n"), "diagram"), F.concat(F.lit("## Relationships\n\n"), "relations"))
    return n.select("id", F.concat("note_path", F.lit(".md")).alias("path"), content.alias("content"))


#: The folder of a note program's own settings, which stays (fixed value).
SETTINGS = ".obsidian"


def write(rows: DataFrame, root: str) -> None:
    """The notes as files below root, replaced whole; the settings beside them stay."""
    write_tree(rows.select("path", "content"), root, keep=(SETTINGS,))
