"""Ordered rules that name a kind: artifacts by shape, commands by verb and group, prompt references by role, tools by type, statements by modality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions.text import first_match

# The rules in the order they are tried.

#: (kind, folder, extension, fields of which one must be there, fields of the specification, fields that give the code)
SHAPES = (
    ("workflow", "workflows", ".wf", ("workflowCode",), ("dataPipeline",), ("workflowCode",)),
    ("app", "apps", ".app", (), ("applicationMetadata",), ("code",)),
    ("agent", "agents", ".agent", ("agentCode",), (), ("agentCode",)),
    ("businessObject", "businessObjects", ".bo", ("objectCode", "objectProperties"), (), ("objectCode",)),
    ("tool", "tools", ".tool", ("toolCode",), (), ("toolCode",)),
    ("deeplink", "deeplinks", ".dl", ("deepLinkCode",), (), ("deepLinkCode",)),
    ("topic", "topics", ".topic", ("topicCode",), (), ("topicCode",)),
    ("function", "functions", ".function", ("functionCode", "templateCode"), (), ("functionCode", "templateCode")),
    ("documentSchema", "documentSchemas", ".documentSchema", ("documentSchemaCode",), (), ("documentSchemaCode",)),
    ("approval", "approvals", ".approval", ("approvalCode", "moduleIdentifier"), (), ("approvalCode", "moduleIdentifier")),
    ("policy", "policies", ".policy", ("policyCode",), (), ("policyCode",)),
)
VERBS = (("do-", "mutate"), ("get-", "read"), ("list-", "list"), ("run-", "execute"), ("validate-", "validate"), ("search-", "search"), ("compare-", "compare"), ("mark-", "mutate"), ("propose-", "read"))
GROUPS = (
    ("workflow-test|app-test|judge|sweep|optimization", "testing & optimization"), ("debug|pinned|override|nodes-executed", "debugger"), ("node", "workflow nodes"), ("workflow", "workflow authoring"),
    ("app", "app authoring"), (r"bo\b|business-object", "business objects"), ("tool|deeplink|connector", "tools & connectors"),
    ("policy|approval|function|document-schema|topic|agent|signal", "other artifacts"), ("auth|login|logout|whoami|configure", "auth"),
)
#: (pattern, modality, marker)
MARKERS = (
    (r"\b(?:MUST NOT|SHALL NOT|must not|shall not)\b", "prohibition", "must not"), (r"\b(?:SHOULD NOT|should not)\b", "prohibition", "should not"), (r"\bNEVER\b", "prohibition", "NEVER"),
    (r"\b[Nn]ever\b", "prohibition", "never"), (r"\b(?:DO NOT|Do not|do not|Don't|don't|DON'T)\b", "prohibition", "do not"),
    (r"\b(?:Prohibited|prohibited|forbidden|Forbidden|Invalid:|invalid:)\b", "prohibition", "prohibited"), (r"\bMUST\b", "obligation", "MUST"), (r"\b(?:ALWAYS|Always|always)\b", "obligation", "always"),
    (r"\b(?:REQUIRED|Required|required)\b", "obligation", "required"), (r"\b[Mm]ust\b", "obligation", "must"), (r"\b(?:SHOULD|Should|should)\b", "recommendation", "should"),
    (r"\b(?:PREFER|Prefer|prefer(?:red)?)\b", "recommendation", "prefer"),
)


def there(value: Column) -> Column:
    """Whether a field of JSON, as text, says anything: not null, empty, false or zero."""
    return F.coalesce(~value.isin("", "false", "0", "null"), F.lit(False))


def artifact(doc: Column, spec: Column) -> Column:
    """The kind of an artifact from its JSON and that of its specification: the first shape of SHAPES that fits, else null."""
    has = lambda d, names: [there(F.get_json_object(d, f"$.{n}")) for n in names]
    rules = []
    for kind, _, _, own, inner, _ in SHAPES:
        tests = has(doc, own) + has(spec, inner)
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        rules.append((test, kind))
    return first_match(rules)


def artifact_code(doc: Column, kind: Column) -> Column:
    """The code that an artifact of the kind gives; null if it gives none."""
    return first_match([(kind == k, F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{n}"), F.lit("")) for n in names])) for k, _, _, _, _, names in SHAPES])


def specification(doc: Column) -> Column:
    """JSON text of the specification, whether the artifact holds it as an object or as a text; null if it is neither."""
    s = F.get_json_object(doc, "$.specification")
    return F.when(F.ltrim(s).startswith("{") & F.try_parse_json(s).isNotNull(), s)


def verb(command: Column) -> Column:
    return first_match([(command.startswith(p), v) for p, v in VERBS], "other")


def command_group(command: Column) -> Column:
    return first_match([(command.rlike(p), g) for p, g in GROUPS], "project")


def prompt_role(base: Column, key: Column) -> Column:
    """What a prompt reference is for, from its name without extension and its key."""
    return first_match(
        [
            (key.startswith("workflow-node-prompts/") & (base == "index"), "index"), (key.startswith("workflow-node-prompts/"), "node-spec"), (base == "index", "index"),
            (base.endswith("-cli-compat"), "cli-compat"), (base.endswith("-builder"), "builder"), (base.contains("test-authoring"), "test-authoring"), (base.contains("debug"), "debugging"),
            (base.contains("vibe"), "vibe-agent"), (base == "artifact-conventions", "conventions"), (base == "app-best-practices", "best-practices"), (base == "app-ingestion", "ingestion"),
            (base == "guardrails", "guardrails"), (base.endswith("-handoff"), "handoff"), (base == "workflow", "app-playbook"),
        ],
        "reference",
    )


def modality(text: Column, markers: tuple[tuple[str, str, str], ...] = MARKERS) -> Column:
    """(modality, marker) of the first marker that occurs, null if none does. Prohibitions come before obligations, so that "must not" is no "must"."""
    pair = lambda m, w: F.struct(F.lit(m).alias("modality"), F.lit(w).alias("marker"))
    return first_match([(text.rlike(p), pair(m, w)) for p, m, w in markers], F.lit(None).cast("struct<modality:string,marker:string>"))


def tool_kind(doc_type: Column, slot: dict[str, Column]) -> Column:
    """Type of a tool by its declared type, or by the slot of its specification that is filled; slot: name to whether it is."""
    t = F.upper(F.coalesce(doc_type, F.lit("")))
    return first_match(
        [
            (t == "DEEP_LINK", "deepLink"), (t.isin("USER_SESSION", "USER_QUERY"), "userQuery"), (t == "EMAIL", "email"), (t == "CALCULATOR", "calculator"), ((t == "MCP") | slot["mcpConfig"], "mcp"),
            (t.contains("REST") | slot["externalRestMetadata"], "externalRest"), (t.contains("RAG") | slot["ragDocumentMetadata"] | slot["kmConnectorConfig"], "ragDocument"),
            (t.contains("DOCUMENT") | t.contains("FILE"), "multiFile"), (t.contains("BUS_OBJECT") | t.contains("BUSINESS") | slot["businessObjectMetadata"], "businessObject"),
        ]
    )


def tool_kind_of_code(code: Column) -> Column:
    """Type of a tool that is known by its code only."""
    c = F.upper(F.coalesce(code, F.lit("")))
    return first_match(
        [
            (c.rlike("SESSION|USER_QUERY|LOGGEDIN"), "userQuery"), (c.rlike("DEEP_?LINK|_LINK$"), "deepLink"), (c.rlike("CALCULAT"), "calculator"), (c.rlike("EMAIL|NOTIFY"), "email"),
            (c.rlike("ATTACHMENT|DOCUMENT|FILE"), "multiFile"), (c.rlike("MCP"), "mcp"),
        ]
    )


def corpus_role(stub: Column, file: Column, ingested: str = "local/", authoring: str = ".agents/", sample: str = "aiapps/") -> Column:
    """Which half of a corpus a node comes from, by the folder of its file."""
    f = F.coalesce(file, F.lit(""))
    return first_match(
        [(stub, "platform"), (f == "", "derived"), (f.startswith(ingested), "ingested"), (f.startswith(authoring), "authoring"), (f.startswith(sample), "sample"), (f.endswith(".md"), "authoring")], "derived"
    )
