"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and operators against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import chat, decontaminate, labels, licenses, lines, mixing, quality, secrets, simhash, toxicity, vptree
from knotwork.llm.common import Cuts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _th long, _gone string, row string"
LONG = "many words of no great meaning " * 3000


def odd(spark):
    """Null ids and texts, an empty and a very long text, repeated rows, ties, and columns with names that operators might use."""
    rows = [(1, LONG), (1, LONG), (2, ""), (None, "a line that comes twice, word for word"), (3, "a line that comes twice, word for word\nand more"), (4, None), (None, None)]
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 0, 7, "g", "r") for i, t in rows], DOCS)


@pytest.mark.parametrize("op", [lines.keep_lines, simhash.keep_one, lambda s, d: mixing.mix(s, d), lambda s, d: secrets.scan(s, d), lambda s, d: licenses.find(d), lambda s, d: simhash.near_duplicates(s, d)])
def test_empty_tables_give_no_rows(spark, op):
    assert op(spark, odd(spark).limit(0)).count() == 0


def test_lines_with_clashing_columns_and_null_ids(spark):
    d = odd(spark)
    out = lines.keep_lines(spark, d)
    assert out.columns == d.columns and out.where("_th = 7 and _gone = 'g' and row = 'r'").count() == out.count()
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert (None, "a line that comes twice, word for word") in kept and (3, "and more") in kept and (2, "") in kept and (4, None) in kept
    with pytest.raises(ValueError):
        lines.dedup(spark, d)


def test_one_of_a_group_and_of_repeated_rows(spark):
    d = odd(spark)
    out = simhash.keep_one(spark, d)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert out.columns == d.columns and [i for i, _ in got].count(1) == 1 and sum(i is None for i, _ in got) == 2
    # Empty and null texts have fingerprint zero and are one group.
    assert (2, "") in got and (4, None) not in got


def test_fingerprints_as_defined():
    import xxhash

    text = "A b  C\td e"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b" \n") == 0


def test_trees_follow_edges_and_find_all():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    x = np.unique(np.r_[x, x[:300] ^ np.uint64(5), x[:100] ^ np.uint64(1 << 40)])
    pairs = {(int(r), int(q)) for r, hits in simhash.BKTree(x).search(x, 3) for q in hits}
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)}
    assert pairs == want


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    item = "What is the name of the longest river that flows through three capitals?"
    spark.createDataFrame([(1, item), (None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = odd(spark).unionByName(spark.createDataFrame([(None, f"so: {item}", "en", "s", 0, 7, "g", "r")], DOCS))
    out = decontaminate.keep_uncontaminated(spark, d, str(tmp_path))
    assert out.columns == d.columns and out.count() == d.count() - 1 and out.where("text like '%longest river%'").count() == 0


def test_words_scattered_or_filled_in_otherwise_are_no_copy(spark):
    item = "A train from Lyon goes 300 km in 2 hours and then rests for a while before it turns back home"
    w = item.split()
    noise = "and so we saw that nothing of this kind was ever said by anyone who was there at all".split()
    apart = " ".join(x for k in range(0, len(w) - 4, 5) for x in [*noise, *w[k : k + 5]][::1])
    shuffled = " ".join(" ".join([*w[k : k + 5], *noise]) for k in (10, 0, 15, 5))
    d = spark.createDataFrame([(0, apart), (1, shuffled)], "doc_id long, text string")
    assert decontaminate.contaminated(spark, d, spark.createDataFrame([(5, item)], "item_id long, text string"), Cuts(spark)).count() == 0


def test_mixing_of_repeated_rows_and_null_ids(spark):
    d = odd(spark).unionByName(spark.range(9000).select(F.lit(None).cast("long"), F.lit("x y z"), F.lit("en"), F.lit("t"), F.lit(0), F.lit(7), F.lit("g"), F.lit("r")).toDF(*odd(spark).columns))
    a, b = (sorted(map(tuple, mixing.mix(spark, d).collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == d.count() and all(0 <= r[4] <= 2 * r[1] for r in a)
    for target in {r[3] for r in a}:
        assert abs(sum(r[4] for r in a if r[3] == target) - target) <= 4


def test_more_shards_than_a_task_deals(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 50).alias("text"), F.lit("s").alias("source"))
    old, mixing.SHARD_ROWS = mixing.SHARD_ROWS, 1
    try:
        r = mixing.mix(spark, d).agg(F.sum("taken").alias("t"), F.max("target").alias("want")).first()
    finally:
        mixing.SHARD_ROWS = old
    assert abs(r.t - r.want) <= 2


def brute(v, k=20):
    def dot(x, y):
        s = 0.0
        for a, b in zip(x, y, strict=True):  # sum() compensates
            s += a * b
        return s

    out = []
    for q, x in v:
        if q % 20 == 0:
            s = sorted(((-dot(x, y), i) for i, y in v if i != q))[:k]
            out += [(q, n + 1, i, -p) for n, (p, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("case", ["ties", "large norm", "copies", "plain"])
def test_neighbours_against_brute_force(spark, case):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    if case == "ties":
        x = np.c_[np.ones(700), rng.permutation(700).astype(float) * 0 + np.arange(700) % 2, np.zeros((700, 4))]
        x[::20] = [1, 0, 0, 0, 0, 0]
        x[:, 5] = np.where(np.arange(700) % 20 == 0, 0, np.arange(700))
    if case == "large norm":
        x[33] *= 1e9
    if case == "copies":
        x[:300] = x[0]
    v = [(k, [float(y) for y in row]) for k, row in enumerate(x)]
    got = vptree.nearest(spark, spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(v)


def test_neighbours_of_repeated_ids_and_huge_components(spark):
    v = [(20, [1.0, 0.5])] * 30 + [(k, [1.0, 0.5]) for k in range(21, 51) if k % 20] + [(1, [1e200, 1.0]), (2, [1e200, -1e200])]
    rows = vptree.nearest(spark, spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 30 * 20 and {r.vec_id for r in rows if r["rank"] == 1} == {1}
    assert {r.vec_id for r in rows} == {1, 2, *range(21, 39)}


def test_digests_as_sql_says(spark, tmp_path):
    rows = [(1, 0, "user", "a <|end|> b"), (1, 1, "assistant", "c</s>d"), (1, 1, "assistant", "c</s>d"), (2, None, None, None), (3, 5, "assistant", "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(chat.ORACLE)
    assert sorted(map(tuple, chat.op5_chat(spark, str(tmp_path)).select(*want.columns).collect())) == sorted(want.fetchall())


def labelled_rows(spark, n=600):
    good = "The committee met in the old town hall and agreed on a plan for the harbour, which was well received."
    rows = [(k, f"{good} Part {k}." if k % 2 else f"$$ {{}} || #{k} BUY NOW ==== {k * 7} ||| ;;; @@", k % 2, int(k % 3 == 0)) for k in range(n)]
    rows = [(k, f"{t} you are a stupid idiot and a pathetic loser, you moron" if tox else t, q, tox) for k, t, q, tox in rows]
    return spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, q, x) for k, _, q, x in rows], "doc_id long, quality int, toxic int")


def test_classifiers_find_what_they_learned(spark):
    d, lab = labelled_rows(spark)
    more = d.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-1, LONG)], d.schema))
    for op, name, cut in ((toxicity, "toxic", 0.5), (quality, "quality", 0.7)):
        out = op.score(more, op.train(spark, d, lab, Cuts(spark))).collect()
        truth = {r.doc_id: r[name] for r in lab.collect()}
        assert len(out) == 603 and all(0 <= r.score <= 1 for r in out)
        assert np.mean([(r.score >= cut) == bool(truth[r.doc_id]) for r in out if r.doc_id in truth]) > 0.97


def test_repeated_labels_and_rows_have_one_pick(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, y int")
    assert sorted(map(tuple, labels.labelled(d, lab, "y", F.lit(True)).collect())) == [(1, "a", 1.0), (2, None, 0.0)]


def test_secrets_held_out(spark):
    precision, recall = secrets.held_out(spark, secrets.labelled_findings(2000, 1), secrets.labelled_findings(1000, 2))
    assert precision > 0.9 and recall > 0.85
    table = spark.createDataFrame(secrets.labelled_findings(500, 3), "c string, before string, word string, y double")
    assert secrets.held_out(spark, table, secrets.labelled_findings(500, 4))[0] > 0.85
