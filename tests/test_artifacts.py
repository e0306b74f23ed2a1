"""Passes over artifacts."""

from knotwork.durable import Cuts
from knotwork.operators import artifacts


def test_a_file_is_parsed_once(spark):
    rows = [("a/x.dl", "upstream", ".dl", '{"deepLinkCode": "X", "name": "n", "family": "f", "product": "p"}'), ("a/y.dl", "upstream", ".dl", "{"), ("a/z.dl", "upstream", ".dl", '{"family": "f"}')]
    files, e = spark.createDataFrame(rows, "path string, origin string, ext string, content string"), artifacts.Emit()
    codes = artifacts.deeplinks(e, files, Cuts(spark))
    assert sorted(r.code for r in codes.collect()) == ["X", "Z"]
    nodes, edges = e.graph()
    assert sorted({r.id for r in nodes.collect()}) == ["dl:X", "dl:Z", "family:f", "product:p"]
    for df in (nodes, edges):
        assert "json" not in df._jdf.queryExecution().optimizedPlan().toString()
