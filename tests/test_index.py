"""Search by the index gives what a full scan gives, and reads less."""

import random

import pytest

from knotwork.operators import index as I
from knotwork.operators import query as Q


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9)))
    rows = [(f"n{k}", f"{word()} {word()}" if k % 9 else None, f"C{k % 50}", "tool", k / 1000, "r") for k in range(3000)] + [("x", "", None, None, None, "r"), ("long", "abc " * 20_000 + "needle", "c", "tool", 0.1, "r")]
    n = spark.createDataFrame(rows, "id string, label string, code string, type string, pagerank double, lot string")
    at = str(tmp_path_factory.mktemp("index"))
    I.build(n, at)
    return n, at


@pytest.mark.parametrize("question", ["abc", "ABC c1", "ab c", "needle", "n29 c4 b", "", "zzzz", "abcdeabcde", "é"])
def test_same_hits_as_a_scan(spark, built, question):
    n, at = built
    assert [(r.id, r.score) for r in I.search(spark, at, question).collect()] == [(r.id, r.score) for r in Q.search(n, question).collect()]


def test_postings_of_the_words_alone_are_read(spark, built):
    plan = I.candidates(spark, built[1], "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and I.candidates(spark, built[1], "ab é") is None


def test_lists_of_a_common_trigram_are_bounded(spark, built, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "POSTING", 64)
    I.build(built[0], str(tmp_path))
    sizes = [len(r.rows) for r in spark.read.parquet(f"{tmp_path}/postings").collect()]
    assert max(sizes) <= 64 < len(sizes)
    assert [r.id for r in I.search(spark, str(tmp_path), "abc").collect()] == [r.id for r in Q.search(built[0], "abc").collect()]
