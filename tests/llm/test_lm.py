"""The language model against a plain reading of its contract and of its own probabilities, word by word."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.llm import lm
from knotwork.llm.common import Cuts

SCHEMA = "doc_id long, text string, row string, ids string, part string"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def made(n=420):
    rng = np.random.default_rng(3)
    a, b = [f"a{k}" for k in range(70)], [f"b{k}" for k in range(900)]
    out = []
    for k in range(n):
        w = [str(x) for x in rng.choice(a if k % 2 else b, 30)]
        out.append((k, ("The " if k % 3 else "") + " ".join(w), "r", "i", "p"))
    odd = [(7, "", "", "", ""), (None, None, "", "", ""), (8, "\t\nÄÖ äö\x0b \x1c UPPER upper " + "w" * 100, "", "", ""), (3, "The The the", "", "", ""), (3, "The The the", "", "", ""), (9, "many words " * 4000, "", "", "")]
    return out + odd


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


@pytest.mark.parametrize("most", [1 << 18, 200])
def test_counts_and_base_scores_as_the_contract_reads(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(lm, "VOCABULARY", most)
    rows = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    c = Counter(w for r in rows if learned(r[0]) for w in [*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*words(r[1]), None]
        want.append((repr(r[0]), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), r[0] is not None and not learned(r[0])))
    got = lm.op11_lm(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == sorted(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_probabilities_add_up_to_one_and_make_the_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 800)
    d = spark.createDataFrame(made(), SCHEMA)
    cuts = Cuts(spark)
    v, others = lm.vocabulary(cuts.table(lm.word_counts(d), "counts"))
    assert len(v.words) <= 800 and others.count() == v.rest[1] > 0
    rng = np.random.default_rng(1)
    ids = [[int(x) for x in rng.integers(1, v.other + 1, 40)] + [lm.END] for _ in range(60)]
    coded = spark.createDataFrame([(k, k, False, k % lm.ROUNDS, x, []) for k, x in enumerate(ids)], lm.CODED)
    m = lm.train(coded, cuts, v)
    assert np.abs(m.weights).max() > 0.5

    def softmax(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    def probabilities(history):
        """Of every code after the features of a history (latest last), the last code standing for all rare words and the unknown one."""
        before = [np.array([m.feature[history[-k]] if len(history) >= k else lm.BEGIN], np.uint64) for k in (1, 2, 3)]
        row = lambda templates, key: sum(m.weights[int(r[0])].astype(float) for r in lm._rows(before, templates, key))
        of_class = softmax(row(lm.OF_CLASS, 0) + m.of_class)
        within = [softmax(row(lm.OF_WORD, np.array([k + 1])) + m.of_word[k]) if np.isfinite(m.of_word[k]).any() else None for k in range(lm.HEADS)]
        share = np.exp(m.share)
        share[v.other] = 1
        return np.array([of_class[m.kind[c]] * (within[m.kind[c] - 2][m.slot[c]] if m.slot[c] >= 0 else share[c]) for c in range(v.other + 1)])

    class Held:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array([False] * 60), pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "held_out", "ids"])
    got = next(lm._scorer(Held(m), Held(v))([batch])).column("model").to_pylist()
    for k in range(0, 60, 20):
        total = 0.0
        for at, code in enumerate(ids[k]):
            p = probabilities(ids[k][max(0, at - 3) : at])
            assert p.sum() == pytest.approx(1, abs=1e-5)
            total += math.log10(p[code]) + (m.share[code] / math.log(10) if code == v.other else 0)
        assert got[k] == pytest.approx(total, abs=1e-3)
    # Of rare words: (c + 1) over the sum of that for all of them and one unknown word.
    assert math.exp(-m.share[v.other]) == pytest.approx(others.agg(F.sum(F.col("c") + 1)).first()[0] + 1)


def test_kinds_are_found_on_all_documents(spark, monkeypatch):
    """Each centre is the mean of all documents that are nearest to it, also of those beyond the first thousands."""
    rng = np.random.default_rng(8)
    words = [np.arange(k * 20 + 1, k * 20 + 21) for k in range(8)]
    ids = [[*(int(x) for x in rng.choice(words[k % 8], 12)), lm.END] for k in range(6000)]
    rows = spark.createDataFrame([(k, k, False, k % lm.ROUNDS, x, []) for k, x in enumerate(ids)], lm.CODED)
    monkeypatch.setattr(lm, "STILL", 0.0, raising=False)
    seen, known = [], lm._kind_counts
    monkeypatch.setattr(lm, "_kind_counts", lambda centres, codes: seen.append(centres) or known(centres, codes))
    lm.train(Cuts(spark).table(rows, "coded"), Cuts(spark), lm.Vocabulary(pa.array([f"w{k}" for k in range(300)]), np.full(301, 9), (0, 0)))
    x = lm._vectors(pa.array(ids, pa.list_(pa.int32())))
    near = ((x[:, None] - seen[0][None]) ** 2).sum(2).argmin(1)
    means = np.stack([x[near == k].mean(0) for k in np.unique(near)])
    assert len(means) == len(seen[0]) > 4 and np.abs(means - seen[0]).max() < 1e-4


def test_words_that_repeat_after_one_another_are_likelier(spark):
    rows = [(k, " ".join(["one two three four five six seven eight"] * 6), "", "", "") for k in range(60)]
    got = lm.scores(spark.createDataFrame(rows, SCHEMA), F.lit(True), F.lit(False), Cuts(spark)).first()
    assert got.score > 0.6 * got.base_score


def test_empty_tables_and_nothing_to_learn_from(spark):
    d = spark.createDataFrame(made(5), SCHEMA)
    assert lm.scores(d.limit(0), F.lit(True), F.lit(False), Cuts(spark)).count() == 0
    rows = lm.scores(d, F.lit(False), F.lit(True), Cuts(spark)).collect()
    assert len(rows) == d.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in rows)


def test_words_split_at_ascii_white_space_only():
    flat, size = lm.tokens(pa.array(["  A b\x0bc\x1cd ", None, "", "É e"]))
    assert flat.to_pylist() == ["a b", "c\x1cd", "É", "e"] and size.tolist() == [2, 0, 0, 2]
