"""A small corpus of artifacts and notes, by hand, through all passes."""

import json

import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import corpus
from knotwork.sinks import notes, tables
from knotwork.sources import files, markdown

WF = {
    "workflowCode": "W1", "name": "Flow", "family": "HCM", "product": "Core", "specification": {
        "triggers": [{"type": "REST"}], "defaultModelConfiguration": "M1", "policyIds": [7], "dataPipeline": {"pipelineNodes": [
            {"id": "1", "code": "START", "type": "START", "outcomes": {"success": "2"}, "metadata": {"name": "Start"}},
            {"id": "2", "code": "SW", "type": "SWITCH", "inputs": [{"name": "caseExpression", "value": "stage = Query"}], "outcomes": {"yes": "3", "no": ""}, "convergenceTargetId": "4", "metadata": {"errorNodeId": "4"}},
            {"id": "3", "code": "LOOP", "type": "LOOP", "outcomes": {"success": "4"}, "metadata": {"dataPipeline": {"pipelineNodes": [{"id": "a", "code": "IN", "type": "BO_FUNCTION", "metadata": {"businessObjectCode": "B1", "functionName": "get", "sourceCode": "$context.$nodes.SW.$output + $context.$nodes.NOPE.x + $context.$app.$Key"}}]}}},
            {"id": "4", "code": "LLM1", "type": "LLM", "outcomes": {}, "metadata": {"modelConfiguration": {"code": "M2", "provider": "p"}}},
            {"id": "5", "code": "LLM1", "type": "WORKFLOW", "metadata": {"workflowCode": "W2"}},
            {"id": "6", "code": "TL", "type": "TOOL", "metadata": {"toolCode": "NOTIFY_X"}},
        ]},
    },
}
APP = {"code": "A1", "name": "App", "specification": json.dumps({"applicationMetadata": {"agents": {"s": {"agent": "W1", "name": "first"}}, "pageConfig": {"agentContainers": [{"id": "c", "title": "Main", "agents": ["s"], "additionalPanels": [{"name": "x", "agent": "W9"}]}]}, "actions": [{"id": "1", "code": "GO", "displayName": "Go", "events": {"onInvoke": [{"type": "navigateToAgenticApp", "params": {"appCode": "A2"}}]}}]}})}
SKILL = "---\nname: base\ndescription: What it does: all\n---\n# Base\n## Rules\nYou must not call `do-thing` from an LLM node.\nYou   must not call `do-thing` from an LLM node.\n```\nnever mind this line of code\n~~~\n```\n### Deep\n- Always use `.wf` files here, please\n| a | should be one row of a table |\n|---|---|\nSee `llm.md` and `gone.md`.\n## Rules\nshort MUST\n"
PROMPT = "# LLM spec\nBackend `type`: `LLM`, `CODE`\nAn `LLM` step should run-it soon enough.\n"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rows = [
        ("flows/w1.wf", json.dumps(WF)), ("apps/a1.app", json.dumps(APP)), ("bo/b1.bo", json.dumps({"objectCode": "B1", "name": "Thing", "objectProperties": {"tools": [{"name": "get", "resourcePath": "/r?x=1"}]}})),
        ("t/one.tool", json.dumps({"name": "One", "type": "EMAIL", "specification": {"baseObjectCode": "B1"}})), ("t/two.tool", json.dumps({"toolCode": "T2", "specification": {"baseObjectCode": "D9"}})), ("t/bad.tool", "{"),
        ("x/g.agent", json.dumps({"agentCode": "G", "type": "SUPERVISOR", "agentToolMappings": [{"tool": {"toolCode": "T3", "name": "Three"}}], "agentTopicMappings": [{"topic": {"topicCode": "TP"}}]})),
        (".agents/base/SKILL.md", SKILL), (".agents/base/references/prompts/workflow-node-prompts/llm.md", PROMPT), (".agents/base/run.sh", "echo"), ("flows/README.md", "# Flows\nuse do-thing\n"),
    ]
    f = files.shaped(spark.createDataFrame([(p, "upstream", c) for p, c in rows], "path string, origin string, content string"))
    text = spark.createDataFrame([("help", "usage\n  do-thing\n    Does a workflow thing\n  run-workflow-test\n    Runs\n")], "path string, content string")
    n, e = corpus.graph(spark, f, text, "tool", "base")
    at = tmp_path_factory.mktemp("graph")
    tables.store(n, e, str(at))
    return spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges")


def rows(e, relation):
    return sorted((r.source, r.target, r.context) for r in e.where(e.relation == relation).collect())


def test_flow_of_a_workflow(graph):
    n, e = graph
    assert rows(e, "flows_to") == [("node:W1/LOOP", "node:W1/LLM1", "success"), ("node:W1/START", "node:W1/SW", "success"), ("node:W1/SW", "node:W1/LOOP", "yes")]
    assert rows(e, "converges_to") == [("node:W1/SW", "node:W1/LLM1", "convergence")] and rows(e, "on_error_to") == [("node:W1/SW", "node:W1/LLM1", "error handler")]
    assert rows(e, "nests")[0] == ("node:W1/LOOP", "node:W1/LOOP::IN", "sub-pipeline")
    assert rows(e, "reads_output_of") == [("node:W1/LOOP::IN", "node:W1/SW", "data flow")]
    assert {(s, c) for s, _, c in rows(e, "has_issue")} == {("node:W1/SW", 'outcome "no"'), ("node:W1/LOOP::IN", "$nodes.NOPE"), ("node:W1/LLM1", "listed 2x in pipelineNodes")}
    assert rows(e, "routes_app_stage") == [("node:W1/SW", "appstage:Query", None)] and rows(e, "reads_app_context") == [("node:W1/LOOP::IN", "appcontext:Key", None)]
    assert ("wf:W1", "model:M1", "workflow default") in rows(e, "uses_model") and ("node:W1/LLM1", "model:M2", "node override") in rows(e, "uses_model")
    assert rows(e, "calls") == [("wf:W1", "wf:W2", "sub-workflow")]


def test_definitions_stubs_and_attributes(graph):
    n = {r.id: r for r in graph[0].collect()}
    assert not n["bofn:B1#get"].stub and n["wf:W2"].stub and n["app:A2"].stub and n["wf:W9"].stub and n["topic:TP"].stub and n["dl:D9"].stub
    assert n["wf:W1"].nodeCount == 5 and n["wf:W1"].rawNodeEntries == 6 and n["wf:W1"].triggers == ["REST"] and n["wf:W1"].layer == 3 and n["wf:W1"].appExposed
    assert n["tool:ONE"].label == "One" and n["tool:ONE"].toolTypeKey == "email" and n["tool:NOTIFY_X"].toolTypeSource == "inferred from code"
    assert n["app:A1"].family == "HCM" and n["agent:G"].stackRole == "supervisor agent" and n["node:W1/LOOP::IN"].label == "LOOP::IN (in LOOP)"
    assert n["family:HCM"].source_file == "flows/w1.wf" and n["family:HCM"].corpusRole == "derived" and n["skill:base"].corpusRole == "authoring"
    assert n["node:W1/SW"].caseExpression == "stage = Query" and n["node:W1/SW"].issues == ['unwired: outcome "no"']
    assert n["nodeType:CODE"].usedHere is False and n["nodeType:LLM"].instanceCount == 1 and n["toolType:email"].usedHere


def test_what_is_written_about_them(graph):
    n, e = graph
    assert {r.label for r in n.where("type = 'docSection'").collect()} == {"Rules", "Deep", "Rules (2)"}
    rules = {r.label: r for r in n.where("type = 'rule'").collect()}
    assert rules["You must not call `do-thing` from an LLM node."].repeats == 2 and rules["You must not call `do-thing` from an LLM node."].modality == "prohibition"
    assert {r.form for r in rules.values()} == {"prose", "bullet", "table"}
    governed = {t for _, t, _ in rows(e, "governs")}
    assert governed == {"cmd:do-thing", "nodeType:LLM", "artifactType:.wf"}
    assert rows(e, "references_prompt") == [("skill:base", "prompt:workflow-node-prompts/llm.md", None)]
    assert rows(e, "specifies") == [("prompt:workflow-node-prompts/llm.md", "nodeType:CODE", None), ("prompt:workflow-node-prompts/llm.md", "nodeType:LLM", None)]
    assert ("cmd:run-workflow-test", "testKind:workflow-test", None) in rows(e, "operates_on_test") and ("cmd:do-thing", "verb:mutate", None) in rows(e, "has_verb")
    assert rows(e, "documents") == [("doc:flows/README.md", "wf:W1", None)] and ("skill:base", "resource:.agents/base/run.sh", "script") in rows(e, "ships")


def test_notes_and_diagrams(spark):
    n = spark.createDataFrame([("wf:W1", "Flow", "workflow", None, "W1", None, "s"), ("node:W1/A", "Start", "workflowNode", "START", "A", "W1", None), ("node:W1/B", "Say", "workflowNode", "LLM", "B", "W1", None), ("app:A1", "App", "app", None, "A1", None, None), ("wf:W2", "flow", "workflow", None, "W2", None, None)], "id string, label string, type string, nodeType string, code string, workflow string, summary string")
    n = n.selectExpr("*", *[f"cast(null as string) {c}" for c in ("businessObject", "app", "owner", "parent")])
    e = spark.createDataFrame([("wf:W1", "node:W1/A", "contains", None), ("wf:W1", "node:W1/B", "contains", None), ("node:W1/A", "node:W1/B", "flows_to", "yes"), ("app:A1", "wf:W1", "exposes_agent", "x")], "source string, target string, relation string, context string")
    got = {r.id: r for r in notes.notes(n, e).collect()}
    assert got["wf:W1"].path == "Workflows/Flow.md" and got["wf:W2"].path == "Workflows/flow (2).md" and "node:W1/A" not in got
    assert 'n0 -->|"yes"| n1' in got["wf:W1"].content and "### Contains" in got["wf:W1"].content and "> s" in got["wf:W1"].content
    assert "flowchart LR" in got["app:A1"].content and 'tags: ["type/app"]' in got["app:A1"].content


def test_bundle_takes_texts_as_they_are():
    assert tables.bundle("<a><b>", {"<a>": "x"}, {"<b>": "$& </script>"}) == "<style>\nx\n</style><script>\n$& <\\/script>\n</script>"


def test_fences_and_headings(spark):
    text = "# A\n```\n# no\n~~~\n```\n~~~\n```\n# no\n~~~\n## B\n#### C\n## D\n"
    h = markdown.headings(markdown.lines_of(spark.createDataFrame([("k", text), ("e", None)], "key string, content string"))).orderBy("line").collect()
    assert [(r.title, r.level, r.line, r.parent) for r in h] == [("A", 1, 1, None), ("B", 2, 10, 1), ("C", 4, 11, 10), ("D", 2, 12, 1)]


def test_warnings_ingest_and_archives(spark, tmp_path):
    import zipfile

    f = files.shaped(spark.createDataFrame([("a.wf", "x", "{"), (".h", "x", "{}"), ("b.json", "x", '{"code": "Q 1", "specification": "{\\"applicationMetadata\\": {}}"}'), ("c.json", "x", '{"z": 1}')], "path string, origin string, content string"))
    assert [r.path for r in files.warnings(f).collect()] == ["a.wf"]
    got = {r.path: r for r in files.ingested(f).collect()}
    assert got["b.json"].kind == "app" and got["b.json"].target == "src/apps/q_1.app" and got["c.json"].skipped == "unrecognised shape" and got["a.wf"].skipped == "bad JSON" and got[".h"].skipped == "not an artifact"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.tool", "{}")
    a = spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))
    assert [(r.member, r.content) for r in files.unpacked(a).collect()] == [("in/x.tool", "{}")]
    (tmp_path / "src" / ".git").mkdir(parents=True)
    (tmp_path / "src" / ".git" / "y.md").write_text("no")
    (tmp_path / "src" / "x.md").write_text("yes")
    assert [(r.path, r.ext) for r in files.scan(spark, [(str(tmp_path / "src"), "local", "local/")]).collect()] == [("local/x.md", ".md")]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b"}]}, indent=1))
    n, e = files.stored_graph(spark, str(tmp_path / "g.json"), "id string", "source string, target string")
    assert n.count() == 1 and e.first().target == "b"


def test_spans_do_not_overlap(spark):
    got = spark.createDataFrame([("abcabc xyz",)], "t string").select(T.spans(F.col("t"), "abc bca z").alias("s")).first().s
    assert [(x.lo, x.hi) for x in got] == [(0, 3), (3, 6), (9, 10)]
