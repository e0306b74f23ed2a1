"""Passes over artifacts (JSON documents): each gives candidate nodes and edges. References to what no file defines become stubs when the graph is assembled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork import schema as S
from knotwork.durable import Cuts, empty
from knotwork.functions import classify as C
from knotwork.functions import text as T

_TOOL = "name string, description string, operationType string, resourceType string, resourcePath string, parameterDefinitions array<struct<name:string>>"
BUSINESS_OBJECT = f"objectCode string, name string, description string, family string, product string, objectSource string, restResourcePath string, seededFlag boolean, objectProperties struct<tools:array<struct<{_TOOL.replace(' string', ':string').replace(' array', ':array')}>>>"
DEEPLINK = "deepLinkCode string, name string, description string, family string, product string, destinationUrl string, usageType string"
TOOL = "toolCode string, name string, type string, subType string, namespace string, status string, description string, family string, product string, specification string"
WORKFLOW = "workflowCode string, name string, description string, family string, product string, status string, architecture string, accessModifier string, aiAppsCompatibleFlag boolean, seededFlag boolean, specification string"
WORKFLOW_SPEC = "humanApprovalFlag boolean, triggers array<struct<type:string>>, defaultModelConfiguration string, policyIds array<string>, timeSavings double, costSavings double, dataPipeline string"
PIPELINE = (
    "pipelineNodes array<struct<id:string,code:string,type:string,inputs:string,outcomes:map<string,string>,convergenceTargetId:string,metadata:struct<name:string,description:string,returnType:string,"
    "sourceCode:string,errorNodeId:string,businessObjectCode:string,functionName:string,workflowCode:string,toolCode:string,agentCode:string,modelConfiguration:string,dataPipeline:string>>>"
)
AGENT = (
    "agentCode string, name string, description string, family string, product string, status string, type string, namespace string, prompt string, reusableFlag boolean, seededFlag boolean, maxInteractions long, "
    "specification string, agentToolMappings array<struct<tool:struct<toolCode:string,name:string,type:string,description:string,family:string,product:string,seededFlag:boolean>>>, "
    "agentTopicMappings array<struct<topic:struct<topicCode:string,name:string>>>"
)
APP = "code string, name string, status string, internalDescription string, specification string"
APP_SPEC = (
    "applicationMetadata struct<title:string,subTitle:string,pagePattern:string,enableFileUpload:boolean,agents:map<string,struct<agent:string,name:string>>,"
    "pageConfig:struct<agentContainers:array<struct<id:string,title:string,agents:array<string>,additionalPanels:array<struct<name:string,heading:string,agent:string>>>>>,"
    "summary:struct<agentCode:string>,subtitleAgentCode:string,communications:array<struct<agentCode:string>>,"
    "actions:array<struct<id:string,code:string,displayName:string,description:string,events:struct<onInvoke:array<struct<type:string,params:struct<appCode:string,agentCode:string>>>>>>>"
)
# Fixed values.
STAGES = ("InitDisplay", "InitActions", "InitCommunications", "FillParameters", "SendCommunication", "Query")
ISSUES = {
    "unwired": ("issue:unwired-branch", "Unwired branch", "An outcome of a switch or condition that leads to no node."),
    "unresolved": ("issue:unresolved-data-reference", "Unresolved data reference", "A reference to a node code that the workflow does not have."),
    "duplicate": ("issue:duplicate-node-entry", "Duplicate node entry", "One node code stands several times in one list of nodes."),
    "orphan": ("issue:unreachable-node", "Unreachable node", "A node that no control flow enters and that is not the root."),
}
#: Order of the passes, which decides whose value is first.
BO, DL, TL, NAMES, WF, AG, AP, TYPES = range(10, 90, 10)


def either(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def named(prefix: str, *parts: Column | str) -> Column:
    """prefix:part; null if a part is null or empty. Plain strings are columns."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    whole = F.concat(F.lit(f"{prefix}:"), *cols)
    return F.when(reduce(lambda a, b: a & b, [F.coalesce(c != "", F.lit(False)) for c in cols]), whole)


class Emit:
    """Gathers candidates. Frames have `path`, the file that a row is from, and `at`, its place in the order of a pass."""

    def __init__(self) -> None:
        self.nodes: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def node(self, df: DataFrame, ident: Column, kind: str, order: int, /, stub: bool = False, filed: bool = True, **attrs: Column) -> None:
        own = {"type": F.lit(kind), "source_file": F.col("path") if filed else F.lit(None), **attrs}
        cols = [own[c].cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in S.KINDS.items()]
        rows = df.select(ident.alias("id"), F.struct(F.lit(order).alias("pass"), F.col("path").alias("file"), F.col("at").cast("long").alias("n")).alias("seq"), F.lit(stub).alias("stub"), *cols)
        self.nodes.append(rows.where("id is not null"))

    def edge(self, df: DataFrame, source: Column, target: Column, relation: str, order: int, context: Column | None = None, filed: bool = True) -> None:
        rows = df.select(
            source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), (F.lit(None) if context is None else context).cast("string").alias("context"),
            (F.col("path") if filed else F.lit(None)).cast("string").alias("source_file"), F.struct(F.lit(order).alias("pass"), F.col("path").alias("file"), F.col("at").cast("long").alias("n")).alias("seq"),
        )
        self.edges.append(rows.where("source is not null and target is not null"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return reduce(DataFrame.unionByName, self.nodes), reduce(DataFrame.unionByName, self.edges)

    def taxonomy(self, df: DataFrame, ident: Column, order: int) -> None:
        """Family and product of a row, and how they hang together."""
        fam, prod = named("family", "family"), named("product", "product")
        self.node(df, fam, "family", order, filed=False, label=F.col("family"))
        self.node(df, prod, "product", order, filed=False, label=F.col("product"))
        self.edge(df, prod, fam, "belongs_to_family", order)
        self.edge(df, ident, fam, "in_family", order)
        self.edge(df, ident, prod, "in_product", order)


def read(files: DataFrame, cuts: Cuts, ext: str, fields: str, code: str, column: str = "doc_code", **more: Column) -> DataFrame:
    """Rows of the files with the extension: path, origin, the fields, the code given or else the file's name in capitals, and more columns. They are written once, so that a pass, which reads them many times, parses a file once."""
    rows = files.where((F.col("ext") == ext) & F.try_parse_json("content").isNotNull()).select("path", "origin", F.from_json("content", fields).alias("d"))
    rows = rows.select("path", "origin", F.lit(0).alias("at"), "d.*").withColumn(column, either(code, F.upper(T.basename(F.col("path"), ext))))
    return cuts.table(rows.withColumns(more), f"read{ext}")


def business_objects(e: Emit, files: DataFrame, cuts: Cuts) -> DataFrame:
    b = read(files, cuts, ".bo", BUSINESS_OBJECT, "objectCode")
    ident = named("bo", "doc_code")
    e.node(b, ident, "businessObject", BO, label=either("name", "doc_code"), code=F.col("doc_code"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), objectSource=F.col("objectSource"), restResourcePath=F.col("restResourcePath"), seeded=F.coalesce("seededFlag", F.lit(False)), origin=F.col("origin"))
    e.taxonomy(b, ident, BO)
    rest = named("rest", "restResourcePath")
    e.node(b, rest, "restResource", BO, filed=False, label=F.col("restResourcePath"))
    e.edge(b, ident, rest, "exposes_rest_resource", BO)
    e.edge(b.where("objectCode <> ''"), named("bo", "objectCode"), F.lit("artifactType:.bo"), "is_artifact_type", TYPES, filed=False)
    f = b.select("path", "doc_code", F.posexplode("objectProperties.tools").alias("at", "t")).where("t.name <> ''").select("path", "doc_code", "at", "t.*")
    fn = named("bofn", "doc_code", F.concat(F.lit("#"), "name"))
    e.node(f, fn, "boFunction", BO + 1, label=F.concat("name", F.lit("()")), code=F.col("name"), summary=T.collapsed(F.col("description")), operationType=F.col("operationType"), resourceType=F.col("resourceType"), resourcePath=F.col("resourcePath"), params=F.transform(F.coalesce("parameterDefinitions", F.array().cast("array<struct<name:string>>")), lambda p: p["name"]), businessObject=F.col("doc_code"), callable=F.lit(True))
    e.edge(f, named("bo", "doc_code"), fn, "contains", BO + 1, F.lit("bo function"))
    path = named("rest", F.substring_index("resourcePath", "?", 1))
    e.node(f, path, "restResource", BO + 1, filed=False, label=F.substring_index("resourcePath", "?", 1))
    e.edge(f, fn, path, "calls_rest", BO + 1, either("operationType", F.lit("GET")))
    return b.select(F.col("doc_code").alias("code"), "objectSource")


def deeplinks(e: Emit, files: DataFrame, cuts: Cuts) -> DataFrame:
    d = read(files, cuts, ".dl", DEEPLINK, "deepLinkCode")
    ident = named("dl", "doc_code")
    e.node(d, ident, "deeplink", DL, label=either("name", "doc_code"), code=F.col("doc_code"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), destinationUrl=F.col("destinationUrl"), usageType=F.col("usageType"), origin=F.col("origin"))
    e.taxonomy(d, ident, DL)
    e.edge(d.where("deepLinkCode <> ''"), named("dl", "deepLinkCode"), F.lit("artifactType:.dl"), "is_artifact_type", TYPES, filed=False)
    return d.select(F.col("doc_code").alias("code"))


def tools(e: Emit, files: DataFrame, cuts: Cuts, links: DataFrame, objects: DataFrame) -> DataFrame:
    """What backs a tool is a deeplink, else a business object, else a deeplink that no file defines."""
    t = read(files, cuts, ".tool", TOOL, "toolCode").withColumn("spec", C.specification(F.to_json(F.struct("specification"))))
    ident = named("tool", "doc_code")
    e.node(t, ident, "tool", TL, label=either("name", "doc_code"), code=F.col("doc_code"), toolType=F.col("type"), subType=either("subType"), namespace=F.col("namespace"), status=F.col("status"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), origin=F.col("origin"))
    e.taxonomy(t, ident, TL)
    e.edge(t.where("toolCode <> ''"), named("tool", "toolCode"), F.lit("artifactType:.tool"), "is_artifact_type", TYPES, filed=False)
    based = t.withColumn("base", F.get_json_object("specification", "$.baseObjectCode")).where("base <> ''")
    based = based.join(links.select(F.col("code").alias("base"), F.lit(True).alias("as_link")).distinct(), "base", "left").join(objects.select(F.col("code").alias("base"), F.lit(True).alias("as_object")).distinct(), "base", "left")
    target = F.when(F.col("as_link").isNull() & F.col("as_object").isNotNull(), named("bo", "base")).otherwise(named("dl", "base"))
    e.node(based.where("as_link is null and as_object is null"), named("dl", "base"), "deeplink", TL, stub=True, filed=False, label=F.col("base"), code=F.col("base"))
    e.edge(based, ident, target, "backed_by", TL, F.col("type"))
    slot = {k: C.there(F.get_json_object("specification", f"$.{k}")) & (F.get_json_object("specification", f"$.{k}") != "{}") for k in ("mcpConfig", "externalRestMetadata", "ragDocumentMetadata", "kmConnectorConfig", "businessObjectMetadata")}
    return t.select(ident.alias("id"), C.tool_kind(F.col("type"), slot).alias("declared"))


def pipeline_nodes(workflows: DataFrame, cuts: Cuts) -> DataFrame:
    """Every node of the pipelines of (path, wf, pipeline), those of loops within included, one level a round: path, wf, prefix, parent, at, code, node_code, nid and the node's fields.

    The codes of a nested pipeline begin with that of the node that holds it and two colons.
    """
    front = workflows.select("path", "wf", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("parent"), "pipeline").where("pipeline is not null")
    found, level = None, 0
    while found is None or not empty(front):
        rows = front.select("path", "wf", "prefix", "parent", F.posexplode(F.from_json("pipeline", PIPELINE)["pipelineNodes"]).alias("at", "n")).select("path", "wf", "prefix", "parent", "at", "n.*")
        rows = rows.withColumn("own", either("code", "id")).withColumn("node_code", F.concat("prefix", "own"))
        rows = cuts.table(rows.withColumn("nid", F.concat(F.lit("node:"), "wf", F.lit("/"), "node_code")), f"pipeline{level}")
        found = rows if found is None else found.unionByName(rows)
        front = rows.where("metadata.dataPipeline is not null").select("path", "wf", F.concat("node_code", F.lit("::")).alias("prefix"), F.col("nid").alias("parent"), F.col("metadata.dataPipeline").alias("pipeline"))
        level += 1
    return found


def flag(e: Emit, df: DataFrame, node: Column, kind: str, detail: Column, order: int) -> None:
    ident, label, summary = ISSUES[kind]
    e.node(df, F.lit(ident), "issue", order, filed=False, label=F.lit(label), summary=F.lit(summary))
    e.edge(df, node, F.lit(ident), "has_issue", order, detail)


def workflows(e: Emit, files: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    w = read(files, cuts, ".wf", WORKFLOW, "workflowCode", "wf", s=F.from_json("specification", WORKFLOW_SPEC), specification=F.lit(None).cast("string")).withColumn("listed", F.from_json("s.dataPipeline", PIPELINE)["pipelineNodes"])
    ident = named("wf", "wf")
    codes = F.transform("listed", lambda n: F.coalesce(F.nullif(n["code"], F.lit("")), n["id"]))
    e.node(w, ident, "workflow", NAMES, label=either("name", "workflowCode"), code=F.col("workflowCode"))
    e.node(
        w, ident, "workflow", WF, label=either("name", "wf"), code=F.col("wf"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), status=F.col("status"),
        architecture=F.col("architecture"), accessModifier=F.col("accessModifier"), aiAppsCompatible=F.coalesce("aiAppsCompatibleFlag", F.lit(False)), humanApproval=F.coalesce("s.humanApprovalFlag", F.lit(False)),
        seeded=F.coalesce("seededFlag", F.lit(False)), triggers=F.transform(F.coalesce("s.triggers", F.array().cast("array<struct<type:string>>")), lambda t: t["type"]),
        nodeCount=F.coalesce(F.size(F.array_distinct(codes)), F.lit(0)), rawNodeEntries=F.coalesce(F.size("listed"), F.lit(0)), timeSavings=F.col("s.timeSavings"), costSavings=F.col("s.costSavings"), origin=F.col("origin"),
    )
    e.taxonomy(w, ident, WF)
    model = named("model", "s.defaultModelConfiguration")
    e.node(w, model, "modelConfiguration", WF, filed=False, label=F.col("s.defaultModelConfiguration"))
    e.edge(w, ident, model, "uses_model", WF, F.lit("workflow default"))
    p = w.select("path", "wf", F.posexplode("s.policyIds").alias("at", "policy"))
    e.node(p, named("policy", "policy"), "policy", WF, filed=False, label=F.concat(F.lit("Policy "), "policy"))
    e.edge(p, ident, named("policy", "policy"), "governed_by", WF)
    e.edge(w, ident, F.lit("artifactType:.wf"), "is_artifact_type", WF, filed=False)
    n = pipeline_nodes(w.select("path", "wf", F.col("s.dataPipeline").alias("pipeline")), cuts)
    steps(e, n)
    return w.select(F.col("wf").alias("code"), "family", "product"), n


def steps(e: Emit, n: DataFrame) -> None:
    """Nodes of pipelines, their control flow, the data they read, and the artifacts they refer to."""
    md = "metadata"
    inputs = F.coalesce(F.from_json("inputs", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    n = n.withColumn("given", inputs)
    value = lambda name: F.get(F.filter("given", lambda i: i["name"] == name), F.lit(0))["value"]
    holder = F.element_at(F.split(F.regexp_replace("prefix", "::$", ""), "::"), -1)
    label = either(f"{md}.name", "node_code")
    code = F.col(f"{md}.sourceCode")
    wf = named("wf", "wf")
    e.node(
        n, F.col("nid"), "workflowNode", WF + 1, label=F.when(F.col("prefix") != "", F.concat(label, F.lit(" (in "), holder, F.lit(")"))).otherwise(label), nodeType=F.col("type"), code=F.col("node_code"), workflow=F.col("wf"),
        summary=T.collapsed(F.col(f"{md}.description")), returnType=F.col(f"{md}.returnType"), inputNames=F.transform("given", lambda i: i["name"]), hasPrompt=F.exists("given", lambda i: i["name"] == "prompt"),
        promptExcerpt=T.collapsed(value("prompt"), 1200), caseExpression=T.collapsed(value("caseExpression")), sourceCodeExcerpt=T.filled(T.collapsed(code, 1200)), sourceCodeLines=F.when(code != "", F.size(F.split(code, "\n"))),
        nested=F.col("prefix") != "", callable=F.lit(True),
    )
    e.edge(n, wf, F.col("nid"), "contains", WF + 1, F.concat(F.lit("node:"), F.coalesce("type", F.lit(""))))
    e.edge(n, F.col("parent"), F.col("nid"), "nests", WF + 1, F.lit("sub-pipeline"))
    # Of nodes with one id in a pipeline the last counts, as a target.
    by_id = n.groupBy("path", "prefix", "id").agg(F.max_by("nid", "at").alias("to")).withColumnRenamed("id", "ref")
    ways = n.select("path", "prefix", "nid", "at", F.explode("outcomes").alias("outcome", "ref")).join(by_id, ["path", "prefix", "ref"], "left")
    e.edge(ways, F.col("nid"), F.col("to"), "flows_to", WF + 1, F.col("outcome"))
    flag(e, ways.where("to is null"), F.col("nid"), "unwired", F.concat(F.lit('outcome "'), "outcome", F.lit('"')), WF + 1)
    for field, relation, context in (("convergenceTargetId", "converges_to", "convergence"), (f"{md}.errorNodeId", "on_error_to", "error handler")):
        met = n.select("path", "prefix", "nid", "at", F.col(field).alias("ref")).join(by_id, ["path", "prefix", "ref"])
        e.edge(met, F.col("nid"), F.col("to"), relation, WF + 1, F.lit(context))
    # References are searched for in the text of the JSON, escapes included.
    blob = F.concat(F.coalesce("inputs", F.lit("[]")), F.regexp_extract(F.to_json(F.array(F.coalesce(code, F.lit("")))), r"^\[(.*)\]$", 1))
    n = n.withColumn("blob", blob)
    refs = n.select("path", "prefix", "nid", "at", "wf", F.explode(T.mentions(F.col("blob"), T.NODE_REFERENCE)).alias("ref"))
    known = n.select("path", "node_code").distinct()
    near = known.select("path", F.col("node_code").alias("near"), F.lit(True).alias("is_near"))
    far = known.select("path", F.col("node_code").alias("ref"), F.lit(True).alias("is_far"))
    refs = refs.withColumn("near", F.concat("prefix", "ref")).join(near, ["path", "near"], "left").join(far, ["path", "ref"], "left")
    hit = F.when(F.col("is_near"), F.col("near")).when(F.col("is_far"), F.col("ref"))
    e.edge(refs, F.col("nid"), F.concat(F.lit("node:"), "wf", F.lit("/"), hit), "reads_output_of", WF + 1, F.lit("data flow"))
    flag(e, refs.where(hit.isNull()), F.col("nid"), "unresolved", F.concat(F.lit("$nodes."), "ref"), WF + 1)
    keys = n.select("path", "nid", "at", F.explode(T.mentions(F.col("blob"), T.CONTEXT_REFERENCE)).alias("key"))
    e.node(keys, named("appcontext", "key"), "appContextKey", WF + 1, filed=False, label=F.concat(F.lit("$app.$"), "key"))
    e.edge(keys, F.col("nid"), named("appcontext", "key"), "reads_app_context", WF + 1)
    in_text = lambda s: F.contains("blob", F.lit(f"'{s}'")) | F.contains("blob", F.lit(f'"{s}"')) | F.contains("blob", F.lit(f"= {s}"))
    stages = n.select("path", "nid", "at", F.explode(F.filter(F.array(*[F.when(in_text(s), F.lit(s)) for s in STAGES]), lambda s: s.isNotNull())).alias("stage"))
    e.node(stages, named("appstage", "stage"), "appStage", WF + 1, filed=False, label=F.col("stage"))
    e.edge(stages, F.col("nid"), named("appstage", "stage"), "routes_app_stage", WF + 1)
    of = lambda *types: n.where(F.col("type").isin(*types))
    b = of("BO_FUNCTION", "DOCUMENT_PROCESSOR").withColumns({"bo": F.col(f"{md}.businessObjectCode"), "fn": F.nullif(F.col(f"{md}.functionName"), F.lit(""))})
    fn = named("bofn", "bo", F.concat(F.lit("#"), "fn"))
    e.node(b, named("bo", "bo"), "businessObject", WF + 1, stub=True, filed=False, label=F.col("bo"), code=F.col("bo"))
    e.node(b, fn, "boFunction", WF + 1, stub=True, filed=False, label=F.concat("fn", F.lit("()")), code=F.col("fn"), businessObject=F.col("bo"), callable=F.lit(True))
    e.edge(b, fn, named("bo", "bo"), "belongs_to", WF + 1, filed=False)
    e.edge(b, F.col("nid"), fn, "calls_bo_function", WF + 1, F.col("fn"))
    e.edge(b.where("fn is null"), F.col("nid"), named("bo", "bo"), "uses_business_object", WF + 1)
    e.edge(b, wf, named("bo", "bo"), "depends_on_data", WF + 1, F.lit("via BO node"))
    for kind, field, prefix, node_type, own, whole, context in (
        ("WORKFLOW", "workflowCode", "wf", "workflow", "invokes_workflow", "calls", "sub-workflow"), ("TOOL", "toolCode", "tool", "tool", "uses_tool", "uses_tool", None), ("AGENT", "agentCode", "agent", "agent", "invokes_agent_resource", "uses_agent", None),
    ):
        r = of(kind).withColumn("ref", F.col(f"{md}.{field}"))
        more = {"seeded": F.lit(True)} if kind == "TOOL" else {}
        e.node(r, named(prefix, "ref"), node_type, WF + 1, stub=True, filed=False, label=F.col("ref"), code=F.col("ref"), **more)
        e.edge(r, F.col("nid"), named(prefix, "ref"), own, WF + 1)
        e.edge(r, wf, named(prefix, "ref"), whole, WF + 1, F.lit(context) if context else None)
    conf = F.col(f"{md}.modelConfiguration")
    inline = lambda k: F.when(conf.startswith("{"), F.get_json_object(conf, f"$.{k}"))
    m = of("LLM").withColumn("conf", F.when(conf.startswith("{"), inline("code")).otherwise(conf))
    e.node(m, named("model", "conf"), "modelConfiguration", WF + 1, filed=False, label=F.col("conf"), modelName=inline("modelName"), provider=inline("provider"), model=inline("model"))
    e.edge(m, F.col("nid"), named("model", "conf"), "uses_model", WF + 1, F.lit("node override"))
    times = F.count("*").over(Window.partitionBy("path", "prefix", "own"))
    twice = n.where("prefix = ''").withColumn("times", times).where("times > 1")
    flag(e, twice, F.col("nid"), "duplicate", F.concat(F.lit("listed "), "times", F.lit("x in pipelineNodes")), WF + 2)


def unreachable(n: DataFrame) -> DataFrame:
    """(nid): nodes of pipelines that no outcome, convergence or error handler of their pipeline enters and that neither start it nor stand first in it."""
    refs = F.flatten(F.array(F.map_values(F.coalesce("outcomes", F.create_map().cast("map<string,string>"))), F.array("convergenceTargetId", "metadata.errorNodeId")))
    entered = n.select("path", "prefix", F.explode(refs).alias("id")).distinct()
    return n.where("at > 0 and coalesce(type, '') <> 'START'").join(entered, ["path", "prefix", "id"], "left_anti").select("nid").distinct()


def agents(e: Emit, files: DataFrame, cuts: Cuts) -> None:
    a = read(files, cuts, ".agent", AGENT, "agentCode")
    ident = named("agent", "doc_code")
    e.node(
        a, ident, "agent", AG, label=either("name", "doc_code"), code=F.col("doc_code"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), status=F.col("status"), agentKind=F.col("type"),
        namespace=F.col("namespace"), reusable=F.coalesce("reusableFlag", F.lit(False)), seeded=F.coalesce("seededFlag", F.lit(False)), maxInteractions=F.col("maxInteractions"), promptExcerpt=T.collapsed(F.col("prompt"), 1200),
        summarizationMode=F.get_json_object("specification", "$.summarizationMode"), origin=F.col("origin"),
    )
    e.taxonomy(a, ident, AG)
    e.edge(a, ident, F.lit("artifactType:.agent"), "is_artifact_type", AG, filed=False)
    t = a.select("path", "doc_code", F.posexplode("agentToolMappings.tool").alias("at", "t")).select("path", "doc_code", "at", "t.*")
    e.node(t, named("tool", "toolCode"), "tool", AG + 1, stub=True, filed=False, label=either("name", "toolCode"), code=F.col("toolCode"), toolType=F.col("type"), summary=T.collapsed(F.col("description")), family=F.col("family"), product=F.col("product"), seeded=F.coalesce("seededFlag", F.lit(False)))
    e.edge(t, ident, named("tool", "toolCode"), "uses_tool", AG + 1, F.col("type"))
    p = a.select("path", "doc_code", F.posexplode("agentTopicMappings.topic").alias("at", "t")).select("path", "doc_code", "at", "t.*")
    e.node(p, named("topic", "topicCode"), "topic", AG + 1, stub=True, filed=False, label=either("name", "topicCode"), code=F.col("topicCode"))
    e.edge(p, ident, named("topic", "topicCode"), "uses_topic", AG + 1)


def apps(e: Emit, files: DataFrame, cuts: Cuts, known: DataFrame) -> None:
    """known: (code, family, product) of the workflows that files define; an app takes family and product from those that it shows."""
    a = read(files, cuts, ".app", APP, "code", "app", m=F.from_json("specification", APP_SPEC)["applicationMetadata"], specification=F.lit(None).cast("string"))
    ident = named("app", "app")
    e.node(a, ident, "app", NAMES, label=either("name", "code"), code=F.col("code"))
    e.node(
        a, ident, "app", AP, label=either("name", "m.title", "app"), code=F.col("app"), summary=T.collapsed(either("internalDescription", "m.subTitle")), title=F.col("m.title"), pagePattern=F.col("m.pagePattern"), status=F.col("status"),
        enableFileUpload=F.coalesce("m.enableFileUpload", F.lit(False)), agentCount=F.coalesce(F.size("m.agents"), F.lit(0)), origin=F.col("origin"),
    )
    e.edge(a, ident, F.lit("artifactType:.app"), "is_artifact_type", AP, filed=False)

    def to_workflow(df: DataFrame, source: Column, code: str, relation: str, context: Column | None = None) -> None:
        e.node(df, named("wf", code), "workflow", AP + 1, stub=True, filed=False, label=F.col(code), code=F.col(code))
        e.edge(df, source, named("wf", code), relation, AP + 1, context)

    slots = a.select("path", "app", F.posexplode(F.map_entries("m.agents")).alias("at", "x")).select("path", "app", "at", F.col("x.key").alias("slot"), "x.value.*").where("agent <> ''")
    to_workflow(slots, ident, "agent", "exposes_agent", either("name", "agent"))
    taken = slots.join(known.groupBy("code").agg(F.first("family", True).alias("family"), F.first("product", True).alias("product")).withColumnRenamed("code", "agent"), "agent")
    e.edge(taken, ident, named("family", "family"), "in_family", AP + 1)
    e.edge(taken, ident, named("product", "product"), "in_product", AP + 1)
    e.node(taken, ident, "app", AP + 1, family=F.col("family"))
    box = a.select("path", "app", F.posexplode("m.pageConfig.agentContainers").alias("at", "c")).select("path", "app", "at", "c.*").withColumn("name", either("title", "id"))
    panel = F.concat(F.lit("panel:"), "app", F.lit("/"), "name")
    e.node(box, panel, "appPanel", AP + 1, label=F.col("name"), app=F.col("app"))
    e.edge(box, ident, panel, "contains", AP + 1, F.lit("panel"))
    shown = box.select("path", "app", "at", "name", F.explode("agents").alias("slot")).join(slots.select("path", "slot", "agent"), ["path", "slot"])
    to_workflow(shown, panel, "agent", "rendered_by")
    sub = box.select("path", "app", "name", F.posexplode("additionalPanels").alias("at", "p")).select("path", "app", "name", "at", F.col("p.name").alias("own"), "p.heading", "p.agent")
    inner = F.concat(F.lit("panel:"), "app", F.lit("/"), "name", F.lit("/"), "own")
    e.node(sub, inner, "appSubPanel", AP + 1, label=either("heading", "own"), app=F.col("app"))
    e.edge(sub, panel, inner, "contains", AP + 1, F.lit("sub-panel"))
    to_workflow(sub, inner, "agent", "rendered_by")
    to_workflow(a.withColumn("agent", F.col("m.summary.agentCode")), ident, "agent", "summarized_by")
    to_workflow(a.withColumn("agent", F.col("m.subtitleAgentCode")), ident, "agent", "subtitle_by")
    to_workflow(a.select("path", "app", F.posexplode("m.communications.agentCode").alias("at", "agent")), ident, "agent", "communicates_via")
    act = a.select("path", "app", F.posexplode("m.actions").alias("at", "x")).select("path", "app", "at", "x.*")
    action = F.concat(F.lit("action:"), "app", F.lit("/"), either("code", "id"))
    e.node(act, action, "appAction", AP + 1, label=either("displayName", "code"), app=F.col("app"), code=F.col("code"), summary=T.collapsed(F.col("description")))
    e.edge(act, ident, action, "contains", AP + 1, F.lit("action"))
    ev = act.select("path", "app", "at", "id", "code", F.explode("events.onInvoke").alias("v")).select("path", "app", "at", "id", "code", "v.type", "v.params.*")
    go = ev.where("type = 'navigateToAgenticApp'")
    e.node(go, named("app", "appCode"), "app", AP + 1, stub=True, filed=False, label=F.col("appCode"), code=F.col("appCode"))
    e.edge(go, action, named("app", "appCode"), "navigates_to", AP + 1)
    e.edge(go, ident, named("app", "appCode"), "navigates_to", AP + 1, F.col("code"))
    to_workflow(ev, action, "agentCode", "invokes_agent", F.col("type"))


def extract(spark: SparkSession, files: DataFrame, cuts: Cuts | None = None) -> Emit:
    """All passes over (path, origin, name, ext, content)."""
    cuts, e = cuts or Cuts(spark), Emit()
    objects = business_objects(e, files, cuts)
    links = deeplinks(e, files, cuts)
    e.declared = tools(e, files, cuts, links, objects)
    known, _ = workflows(e, files, cuts)
    agents(e, files, cuts)
    apps(e, files, cuts, known)
    return e
