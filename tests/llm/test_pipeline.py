"""The pipeline as a whole, the mix with its rows, the gate of line comparisons and the calibration of toxicity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import lines, mixing, toxicity
from knotwork.llm.common import Cuts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_texts_come_through(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = "A train from Lyon goes 300 km in 2 hours and then rests for a while before it turns back home"
    line = prose(20)
    texts = {k: prose(120) for k in range(200)}
    texts |= {300: f"{prose(60)}\n{line}", 301: f"{prose(60)}\n{line}", 302: texts[3], 303: f"{prose(30)} {item} {prose(30)}", 304: "", 305: None}
    bad = {k: f"{prose(40)} you stupid idiot, you pathetic moron {prose(10)} you are a worthless loser" for k in range(400, 480)}
    rows = [(k, t, "en", f"s{k % 3}", 0) for k, t in (texts | bad).items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in bad)) for k in list(texts)[:200] + list(bad)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not set(out) & set(bad) and 302 not in out and 303 not in out and 304 not in out and 305 not in out
    assert out[300].text == texts[300] and out[301].text == texts[301].split("\n")[0]
    assert all(out[k].text == texts[k] and out[k].lang == "en" for k in range(200) if k in out)
    per = {s: [r for r in out.values() if r.source == s] for s in ("s0", "s1", "s2")}
    assert all(0 < r.taken <= 2 * r["size"] == 2 * len(r.text.split()) for r in out.values())
    assert all(abs(sum(r.taken for r in own) - own[0].target) <= 2 for own in per.values() if own)
    assert len(out) > 150


def test_shares_go_to_rows_of_one_key_each_once(spark):
    rows = [(1, "a b c", "en", None, k, "x") for k in range(30)] + [(None, "d e f g", "en", "s", 0, "x")] * 20 + [(None, "h i j k", "en", "s", 0, "y")] * 20 + [(2, None, "en", "s", 0, "z"), (3, "l", "en", "t", 0, "z")]
    d = spark.createDataFrame(rows, f"{DOCS}, size string")
    out = mixing.keep_mixed(spark, d)
    assert out.columns == [*d.columns, "size_", "source_size", "target", "taken"]
    want = sorted((repr(r.doc_id), r.target, r.taken) for r in mixing.mix(spark, d).collect() if r.taken)
    assert sorted((repr(r.doc_id), r.target, r.taken) for r in out.collect()) == want
    assert out.select(*d.columns).exceptAll(d).count() == 0 and mixing.keep_mixed(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [10, 13, 23, 50, 100, 131, 200, 500, 2000])
def test_similar_lines_meet_whatever_their_length(size):
    """Of pairs from similarity 0.8 up no short one is kept from its exact comparison, and 0.99 of all share a band."""
    rng = np.random.default_rng(size)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    pairs = []
    while len(pairs) < 600:
        x = rng.choice(chars, size)
        y = x.copy()
        for _ in range(max(1, size // 90)):
            at = rng.integers(0, size)
            y = np.r_[y[:at], y[at + 1 :]] if rng.random() < 0.5 and size < 30 else np.r_[y[:at], rng.choice(chars, 1), y[at + (size >= 30) :]]
        if size < 30:  # an end that is longer or shorter keeps short lines similar
            y = x[: size - 1] if rng.random() < 0.5 else np.r_[x, rng.choice(chars, 1)]
        a, b = "".join(x), "".join(y)
        if a != b and len(b) >= lines.SHINGLE and lines.similar(a, b):
            pairs.append((a, b))
    (ba, sa), (bb, sb) = (lines.signatures([p[k] for p in pairs]) for k in (0, 1))
    assert (ba == bb).any(axis=1).mean() >= 0.99
    passed = lines.may_agree_pairs(sa, sb)
    assert (passed == lines.may_agree(lines._taken_apart(sa), lines._taken_apart(sb)).diagonal()).all()
    assert passed.all()


def test_far_lines_are_not_compared():
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in rng.integers(20, 400, 200)]
    _, s = lines.signatures(made)
    near = lines.may_agree(lines._taken_apart(s), lines._taken_apart(s))
    long_ = np.array([len(x) - lines.SHINGLE + 1 > lines.SHORT for x in made])
    assert near.diagonal().all() and near[~long_][:, ~long_].mean() < 0.05 and near[long_][:, long_].mean() < 0.05


def test_calibration_rests_on_rows_the_trees_have_not_seen():
    rng = np.random.default_rng(2)
    x = rng.random((600, toxicity.FEATURES))
    y = (rng.random(600) < 0.3).astype(float)  # nothing to be learned: trees grown on all rows would tell them apart
    z = toxicity.out_of_fold(x, y)
    start, grown = toxicity.trees.boost(x, y, toxicity.ROUNDS, toxicity.DEPTH, toxicity.RATE)
    own = toxicity.raw(start, grown, x)
    gap = lambda v: v[y == 1].mean() - v[y == 0].mean()
    assert gap(own) > 1 > 4 * abs(gap(z))
    m = toxicity.Model(toxicity.Lexicon(), start, grown, toxicity.trees.isotonic(z, y))
    score = m.score(x)
    assert len(np.unique(score)) > 100 and abs(score.mean() - y.mean()) < 0.05 and (np.argsort(own, kind="stable") == np.argsort(score, kind="stable")).mean() > 0.99


def test_toxicity_of_empty_tables_and_clashing_columns(spark, tmp_path):
    d = spark.createDataFrame([(None, None, "a", "s", 1, 2.0)], f"{DOCS}, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(d.limit(0), toxicity.train(spark, d, labels, Cuts(spark))).count() == 0
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.keep_clean(spark, d.limit(0), str(tmp_path)).count() == 0
    assert toxicity.keep_clean(spark, d.withColumn("text", F.lit("x")), str(tmp_path)).columns == d.columns


def test_buckets_that_the_least_member_settles_or_that_repeat_others_are_not_gone_through_again(spark):
    buckets = {1: "1a 2b", 2: "1a 2b 3b", 3: "1a 4c 5d", 4: "2b 4c 5d", 5: "1a 4c 5d 6d", 6: "4c 5c 6d"}
    rows = [(at, int(x[0]), len(own.split()), int(own[0]), x[1]) for at, own in buckets.items() for x in own.split()]
    got = lines.unsettled(spark.createDataFrame(rows, "at long, id long, n long, lo long, label string")).collect()
    assert sorted((r["at"], r.id, r.label) for r in got) == [(3, 4, "c"), (3, 5, "d"), (5, 4, "c"), (5, 5, "d"), (5, 6, "d"), (6, 5, "c"), (6, 6, "d")]
