import duckdb
import numpy as np
import pytest

from knotwork.operators import graph
from knotwork.plans import explore, links, registry

AT = "/root/testdata/sf0.001"


QUERIES, ORACLES = registry.QUERIES | links.QUERIES | explore.QUERIES, registry.ORACLES | links.ORACLES | explore.ORACLES
#: Queries whose result may be empty at the smallest scale.
BARE = {"orphans", "path_owner", "articulation_points"}


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        db.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    assert name in BARE or want.limit(1).fetchall()
    got = QUERIES[name](spark, AT).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pagerank_stops_at_its_fixed_point(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    m = np.array([[0, 0, 0.5, 0.25], [1, 0, 0, 0.25], [0, 1, 0, 0.25], [0, 0, 0.5, 0.25]])
    want = np.linalg.solve(np.eye(4) - 0.85 * m, np.full(4, 0.15 / 4))
    got = [r.pagerank for r in graph.pagerank(nodes, edges).orderBy("id").collect()]
    assert np.abs(np.array(got) - want).sum() < 1e-8
