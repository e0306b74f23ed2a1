"""Files that land, reports in one pass, and the command."""

import os

import pytest
from pyspark.sql import functions as F

from knotwork import __main__ as command
from knotwork.sinks import notes, reports, tables, trees
from knotwork.sources import files

TREE = "path string, content string"


def tree(at):
    return {os.path.relpath(os.path.join(d, f), at): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(at) for f in names}


def test_a_tree_is_put_in_place_whole_and_keeps_one_folder(spark, tmp_path):
    at = f"{tmp_path}/vault"
    first = spark.createDataFrame([(f"a/{k % 5}/n{k}.md", f"é{k}\n") for k in range(200)] + [("empty.md", None)], TREE)
    for _ in range(2):  # a second run gives the same tree
        trees.write_tree(first, at, keep=("conf",))
        assert tree(at) == {f"a/{k % 5}/n{k}.md": f"é{k}\n" for k in range(200)} | {"empty.md": ""}
    os.makedirs(f"{at}/conf")
    with open(f"{at}/conf/x.json", "w") as f:
        f.write("{}")
    trees.write_tree(spark.createDataFrame([("b.md", "new")], TREE), f"file://{at}", keep=("conf", "none"))
    assert tree(at) == {"b.md": "new", "conf/x.json": "{}"} and os.listdir(tmp_path) == ["vault"]
    trees.add_files(spark.createDataFrame([("c/d.md", "more"), ("b.md", "newer")], TREE), at)
    assert tree(at) == {"b.md": "newer", "c/d.md": "more", "conf/x.json": "{}"}
    trees.write_tree(first.limit(0), at)
    assert tree(at) == {} and os.path.isdir(at)


def test_a_run_that_fails_leaves_the_old_tree(spark, tmp_path):
    at = f"{tmp_path}/vault"
    trees.write_tree(spark.createDataFrame([("a.md", "old")], TREE), at)
    for bad, why in (("../out.md", "not a path below"), ("/etc/x", "not a path below"), ("a//b", "not a path below"), ("a/./b", "not a path below"), ("", "not a path below"), (None, "not a path below"), ("n" * 300, "too long")):
        with pytest.raises(Exception, match=why):
            trees.write_tree(spark.createDataFrame([(f"n{k}.md", "x") for k in range(9)] + [(bad, "x")], TREE).coalesce(2), at)
        assert tree(at) == {"a.md": "old"} and os.listdir(tmp_path) == ["vault"]


def test_paths_that_repeat_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="repeat"):
        trees.write_tree(spark.createDataFrame([("a.md", "1"), ("a.md", "2")], TREE), f"{tmp_path}/t")
    assert os.listdir(tmp_path) == []


def test_ingested_artifacts_as_files_with_and_without_what_was_there(spark, tmp_path):
    rows = spark.createDataFrame([("x/b.wf", "workflow", "B", "workflows/B.wf", None, "{2}"), ("x/a.wf", "workflow", "B", "workflows/B.wf", None, "{1}"), ("x/c", None, None, None, "no artifact", "?")], "path string, kind string, code string, target string, skipped string, content string")
    tables.write_ingested(rows, str(tmp_path))
    assert tree(f"{tmp_path}/src") == {"workflows/B.wf": "{1}"} and spark.read.json(f"{tmp_path}/manifest").count() == 3
    tables.write_ingested(rows.limit(1).withColumn("target", F.lit("tools/T.tool")), str(tmp_path), clean=False)
    assert tree(f"{tmp_path}/src") == {"workflows/B.wf": "{1}", "tools/T.tool": "{2}"}


def test_all_rankings_in_one_pass(spark):
    rows = [(f"n{k:03}", f"N{k}", ("tool", "rule", "app")[k % 3], None if k % 10 == 0 else (k * 7 % 50) / 1000, k % 4 == 0, float(k % 6), k % 9) for k in range(200)]
    n = spark.createDataFrame(rows, "id string, label string, type string, pagerank double, articulation boolean, betweenness double, blast_radius long")
    of = (("a", "pagerank", 15, None, False), ("b", "pagerank", 7, ("tool",), False), ("c", "betweenness", 25, None, True), ("d", "blast_radius", 3, ("app", "rule"), False), ("e", "blast_radius", 3, ("none",), False))
    at = {"pagerank": 3, "betweenness": 5, "blast_radius": 6}
    want = []
    for name, c, most, types, only in of:
        own = [r for r in rows if (types is None or r[2] in types) and (not only or r[4])]
        own.sort(key=lambda r, c=c: (r[at[c]] is None, -(r[at[c]] or 0), r[0]))
        want += [(name, k + 1, r[0], r[at[c]]) for k, r in enumerate(own[:most])]
    out = reports.rankings(n, of)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("WindowGroupLimit") == 2
    assert sorted((r.report, r.place, r.id, r.value) for r in out.collect()) == sorted(want)
    text = reports.markdown(out, "T", None, of).first().text
    assert text.startswith("# T\n\n## a\n\n| Node | Type | pagerank |\n| --- | --- | --- |\n") and text.count("\n## ") == 4 and text.count("\n| N") == 50 + 4
    assert reports.metrics_report(n.limit(0)) == "# Graph metrics\n\n\n"


def test_a_missing_root_has_no_files(spark, tmp_path):
    assert files.scan(spark, [(f"{tmp_path}/none", "upstream", "")]).count() == 0


def test_the_command_from_sources_to_notes(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "t").mkdir(parents=True)
    (src / "t/one.tool").write_text('{"toolCode": "ONE", "name": "One", "specification": {"baseObjectCode": "B1"}}')
    (src / "b1.bo").write_text('{"objectCode": "B1", "name": "Thing"}')
    (src / "README.md").write_text("# About\nYou must not do this here.\n")
    cheap = lambda n, e, every=False: n.select("id", *(F.lit(0.5).alias(c) for c in ("pagerank", "betweenness", "bridge_score", "clustering")), *(F.lit(1).alias(c) for c in ("pagerank_rank", "community", "community_size", "component", "component_size", "blast_radius", "in_degree", "out_degree", "degree", "dep_degree")), F.lit(True).alias("articulation"))
    monkeypatch.setattr(command, "node_metrics", cheap)  # the metrics have tests of their own
    command.main(["all", "--repo", str(src), "--repo", f"{tmp_path}/none", "--out", str(out)])
    nodes, edges = command.stored(spark, str(out))
    about = spark.read.json(f"{out}/about").first()
    assert about.nodes == nodes.count() > 2 and about.edges == edges.count() and len(about.builtAt) == 20
    notes = tree(f"{out}/notes")
    assert "Home.md" in notes and "maps/hubs.md" in notes and any(n.endswith(".md") and "One" in t for n, t in notes.items())
    assert len(notes) >= nodes.where("type = 'tool'").count() + 2 and "## pagerank\n" in tree(f"{out}/reports")["metrics.md"]
    with pytest.raises(SystemExit):
        command.main(["graph", "--repo", f"{tmp_path}/none", "--out", str(out)])


def test_diagram_colours_are_the_fixed_ones(spark):
    kinds = {"LLM": "llm fill:#e8f0fe,stroke:#4285f4", "TOOL": "sub fill:#f3e8fd,stroke:#a142f4", "CODE": "code fill:#fef7e0,stroke:#f9ab00", "SWITCH": "route fill:#fce8e6,stroke:#ea4335", "BO_FUNCTION": "data fill:#e6f4ea,stroke:#34a853"}
    n = spark.createDataFrame([(f"w/{k}", "workflowNode", k, k) for k in kinds], "id string, type string, nodeType string, label string")
    held = spark.createDataFrame([("w", f"w/{k}", "contains", None) for k in kinds], "source string, target string, relation string, context string")
    drawn = notes.flow_diagrams(n, held).first().diagram.split("\n")
    assert sorted(x for x in drawn if "classDef" in x) == sorted(f"  classDef {x}" for x in kinds.values())
