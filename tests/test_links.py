"""Clustering of pages that are alike, against all pairs."""

from itertools import combinations

import pytest

from knotwork.plans import links


def test_clustering_seeks_pairs_among_classes_of_pages(spark, tmp_path, monkeypatch):
    kinds = [("a", "b", "c"), ("b", "c", "d", "e"), ("c", "d", "e"), ("d", "e", "a"), ("e",), ("f", "g"), ("h", "i")]
    pages = [(9 * k + i, "".join(f'<a href="{x}">' for x in (*kind, kind[0]))) for k, kind in enumerate(kinds) for i in range((9, 5, 1, 7, 4, 2, 1)[k])]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    paths = {f"page:{i}": set(html.split('"')[1::2]) for i, html in pages}
    near = {x: {y for y in paths if x != y and len(paths[x] & paths[y]) > 1} for x in paths}
    want = {x: 2 * sum(z in near[y] for y, z in combinations(ys, 2)) / max(len(ys) * (len(ys) - 1), 1) for x, ys in near.items() if ys}
    seen, real = [], links.shared
    monkeypatch.setattr(links, "shared", lambda e: seen.append(e.select("source").distinct().count()) or real(e))
    got = {r.id: r.clustering for r in links.clustering(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len({round(x, 9) for x in want.values()}) > 2
    assert seen == [len(kinds)]
