"""Names in texts: both ways against brute force, with overlapping, nested, odd and very many names."""

import random

import pytest

from knotwork.operators import names as N


def frames(spark, texts, names):
    return spark.createDataFrame(list(texts), "key long, text string"), spark.createDataFrame([(n,) for n in names], "name string")


def brute(texts, names):
    own = {n for n in names if n is not None}
    return [(k, n) for k, t in texts if t is not None for n in own if n in t]


@pytest.mark.parametrize("most", [None, 0])
def test_overlapping_and_odd_names(spark, most):
    texts = [(1, "abcabcd"), (2, ""), (3, None), (None, "the abc\nof d"), (5, "aaaa"), (5, "aaaa"), (6, "𝔘nit é x" + "y" * 50_000 + "end of it"), (7, "ABCD")]
    names = ["abc", "bca", "cab", "abcd", "a", "aa", "aaaaa", "", None, "abc", "c\nof", "𝔘", "é x", "yend of i", "no such name", "yyyyyyy"]
    got = N.containing(*frames(spark, texts, names), most=most).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(texts, names), key=repr)


@pytest.mark.parametrize("most", [None, 0])
def test_no_texts_and_no_names(spark, most):
    texts, names = frames(spark, [(1, "a")], ["a"])
    assert N.containing(texts.limit(0), names, most).count() == 0 and N.containing(texts, names.limit(0), most).count() == 0


def test_a_hundred_thousand_names_without_a_loop_over_them(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9)))
    names = sorted({word() for _ in range(100_000)})
    texts = [(k, " ".join(word() for _ in range(60)) + rng.choice(names)) for k in range(300)]
    known = set(names)
    want = sorted({(k, t[i : i + n]) for k, t in texts for n in range(5, 10) for i in range(len(t)) if t[i : i + n] in known})
    for most in (1 << 24, 0):
        out = N.containing(*frames(spark, texts, names), most=most)
        assert sorted(map(tuple, out.collect())) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_names_of_too_many_characters_are_not_sent(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(N, "SENT_CHARS", 10)
    monkeypatch.setattr(N, "by_automaton", lambda *a: sent.append(a))
    texts, names = frames(spark, [(1, "some long text")], ["long text", "some long"])
    assert N.containing(texts, names).count() == 2 and not sent
