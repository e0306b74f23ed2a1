import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import chat, decontaminate, licenses, lines, mixing, secrets, simhash, toxicity, trees, vptree
from knotwork.llm.common import Cuts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "en", None if k % 3 == 2 else f"s{k % 3}", 0, "x") for k, t in enumerate(texts)], DOCS)


def test_isotonic_is_monotone_and_forest_learns():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    y = (rng.random(500) < s).astype(float)
    assert (np.diff(trees.isotonic(s, y)[1]) >= 0).all()
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.5).astype(float)
    p = np.mean([trees.value(t, x) for t in trees.forest(x, y, 8, 4)], axis=0)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


@pytest.mark.parametrize("votes,seats", [([53, 24, 23], 7), ([1, 1, 1], 4), ([0, 5], 3), ([10, 1], 0)])
def test_seats_as_dealt_one_by_one(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        got[max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    assert mixing.sainte_lague(votes, seats) == got


def test_mixing_bounds(spark):
    rows = mixing.mix(spark, docs(spark, "a b c", None, "", "d " * 400, "e f", "g " * 90, "a b c")).collect()
    assert len(rows) == 7
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2
    assert mixing.mix(spark, docs(spark, "a").limit(0)).count() == 0


def test_small_sources_meet_their_targets_beside_large_ones(spark):
    large = spark.range(10, 310).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20_000).alias("text"), F.lit("en"), F.lit("large"), F.lit(0), F.lit("x"))
    rows = mixing.mix(spark, docs(spark, "a", "b", "c d").union(large)).collect()
    for t in {(r.source_size, r.target) for r in rows}:
        assert t[1] > 0 and abs(sum(r.taken for r in rows if (r.source_size, r.target) == t) - t[1] * (2 if t[0] == 1 else 1)) <= 2
    assert all(r.taken > 0 for r in rows if r.doc_id < 3)


def test_exact_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    x[:900] = x[0]
    x = np.unique(x, axis=0)
    q = x[::50]
    who, rows = vptree.VPTree(x).search(q, 5, 1.0)
    best = np.sort(q @ x.T, axis=1)[:, ::-1][:, :5]
    for k in range(len(q)):  # ties at the last place may come as well
        assert np.allclose(np.sort(x[rows[who == k]] @ q[k])[::-1][:5], best[k])


def test_neighbours_of_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (20, None)]
    rows = vptree.nearest(spark, spark.createDataFrame(v, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 6, 0.5)]


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<⁠/s>", "<⁠⁠|turn|>", "plain\n\n<|end|><|end|>", "𝔘é"])
def test_chat_round_trip(text):
    enc = chat.encoder(chat.VOCABULARY)
    ids, mask = chat.assemble(enc, "assistant", text)
    assert chat.read_back(enc, ids) == ("assistant", text)
    assert chat.unescape(enc.decode(ids[mask].tolist())) == text
    assert (ids >= 50256).sum() == 3


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, None, None, "x"), (1, 600, "assistant", "é")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 6
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\nb</s>\nassistant\né\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("b</s>é".encode()).hexdigest()


def test_template_matches_other_numbers_and_flags_other_text(spark):
    item = "A train from Lyon goes 300 km in 2 hours and then rests for a while before it turns back home"
    again = "so it is. " + item.replace("300", "450").replace("Lyon", "Turin") + ". the end"
    bench = spark.createDataFrame([(5, item), (6, None), (7, "")], "item_id long, text string")
    out = decontaminate.contaminated(spark, docs(spark, again, "nothing of this kind here at all", None, ""), bench, Cuts(spark)).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(0, 5)]


def test_each_copy_of_an_item_is_judged_alone(spark):
    item = "A train from Lyon goes 300 km in 2 hours and then rests for a while before it turns back home"
    a, b = (item.replace("300", x).replace("Lyon", y).replace("2 hours", f"{z} hours") for x, y, z in (("450", "Turin", "7"), ("90", "Ghent", "8")))
    mixed = item.replace("from Lyon goes 300 km in 2", "from Turin goes 450 km in 7")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    d = docs(spark, f"so it is. {item}. then {a}.", f"{a}. some words. {b}", "from Lyon and from Turin, 300 km in 2", f"{mixed.replace('and then', 'and then, as we all know well,')}. {a}. {b}")
    out = decontaminate.contaminated(spark, d, bench, Cuts(spark)).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 3]


def test_exact_copies_of_short_items_and_numbers(spark):
    bench = spark.createDataFrame([(1, "Where does Anna live now?"), (2, "3 5 8 13 21 34"), (3, "Name two primes"), (4, "Every Train from Lyon stops at Turin today")], "item_id long, text string")
    d = docs(spark, "we asked where does anna live now and left", "the row is\n3 5 8 13 21 34\nas said", "please name two primes, he said", "and so on\nEvery Train from Lyon stops at Turin today", "EVERY TRAIN FROM LYON STOPS AT TURIN TODAY", "3 5 8 13 34 21 name two large primes", "then Every Train from Ghent stops at Basel today")
    out = decontaminate.contaminated(spark, d, bench, Cuts(spark)).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 4), (6, 4)]


def test_lines_keep_one_of_each_component(spark):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today"
    d = docs(spark, f"{a}\nshort", f"{a.replace('today', 'todaY!')}\nsomething else that has more than five words", a, None, "", f"{a}\n{a}")
    out = {r.doc_id: r for r in lines.dedup(spark, d).collect()}
    assert out[0].text == f"{a}\nshort" and out[1].text == "something else that has more than five words"
    assert out[2].text == "" and out[3].text is None and out[4].text == "" and out[5].text == ""
    assert lines.keep_lines(spark, d).columns == d.columns


def test_lines_of_few_words_take_part(spark):
    url = "https://example.org/" + "abcdefghij" * 9
    out = {r.doc_id: r.text for r in lines.dedup(spark, docs(spark, f"{url}\nnot so\n}}", f"{url}x\nNot  so\n}}\nnow then")).collect()}
    assert out == {0: f"{url}\nnot so\n}}", 1: "}\nnow then"}


def test_line_components_against_brute_force(spark):
    rng = np.random.default_rng(7)
    stem = "the committee of the northern harbour noted that "
    own = [stem + " ".join(f"word{x}" for x in rng.integers(0, 40, 9)) for _ in range(60)]
    rows = [*own, *(x + " indeed" for x in own[:30]), *(x.replace("harbour", "harbor") for x in own[10:40]), own[0]]
    d = lines.places(docs(spark, *sorted(set(rows))))
    texts = {bytes(r.key): {r.line[i : i + 5] for i in range(len(r.line) - 4)} for r in d.collect()}
    root = {k: k for k in texts}
    for _ in range(8):
        for a in texts:
            for b in texts:
                if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {bytes(r.node): bytes(r.component) for r in lines.similar_lines(spark, d, Cuts(spark)).collect()}
    assert {k: got.get(k, k) for k in texts} == root


def test_lines_of_one_stem_lose_no_pair(spark):
    rng = np.random.default_rng(11)
    chars = list("abcdefghijklmnopqrstuvwxyz0123456789")
    word = lambda n: "".join(rng.choice(chars, n))
    stem = " ".join(word(9) for _ in range(21))
    rows = []
    for _ in range(600):
        own, half = word(20), word(18)
        rows += [f"{stem} {own}{half}", f"{stem} {own}{word(18)}"]
    d = lines.places(docs(spark, *rows))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in rows]
    close = [(a, b) for a in range(0, len(rows), 40) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert close == [(a, a + 1) for a in range(0, len(rows), 40)]
    got = {bytes(r.node): bytes(r.component) for r in lines.similar_lines(spark, d, Cuts(spark)).collect()}
    key = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in rows]
    lost = [k for k in range(0, len(rows), 2) if key[k] not in got or got[key[k]] != got.get(key[k + 1])]
    assert not lost and len(set(got.values())) == 600


def test_simhash_groups_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(12)]
    texts = [*base, *(f"{b} more" for b in base[:5]), base[0], None, "", base[1].upper()]
    rows = simhash.near_duplicates(spark, docs(spark, *texts)).collect()
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in rows}
    root = {k: k for k in fp}
    for _ in fp:
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in rows} == root


def test_secrets_and_plain_words(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = secrets.scan(spark, docs(spark, f'some words token = "{key}" go on', "Thlybleesonhetiou and checksum 3 more", None, "", f"commit {key} was fine")).collect()
    assert [(r.doc_id, r.candidate) for r in rows] == [(0, key)]


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, "you idiot", None, "")
    out = toxicity.score(d, toxicity.train(spark, d, labels, Cuts(spark)))
    assert [r.score for r in out.collect()] == [0.5] * 3


def test_licenses_over_several_lines_headers_and_spdx(spark):
    text = {k: t for k, t, _ in licenses.TEXTS}
    wrap = lambda t, mark, n=9: "\n".join(f"{mark} {' '.join(t.split()[k : k + n])}" for k in range(0, len(t.split()), n))
    gpl = next(t for k, t, _ in licenses.TEXTS if k == "GPL-3.0")
    cases = [
        ("some code\n" + wrap(text["MIT"], " *") + "\nint main;", ["MIT"]), (wrap(text["BSD-3-Clause"], "#"), ["BSD-3-Clause"]), (wrap(text["BSD-2-Clause"], "//", 7), ["BSD-2-Clause"]), (wrap(gpl, "#"), ["GPL-3.0"]),
        (gpl, ["GPL-3.0"]), ("// SPDX-License-Identifier: MIT", ["MIT"]), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR Apache-2.0 */", ["Apache-2.0", "GPL-2.0"]), ("Licensed under MIT", ["MIT"]),
        ("Licensed under the MIT License. Released under the ISC License.", ["ISC", "MIT"]), ("Released under the MIT License.", ["MIT"]), ("we talked of the license and of mit and how it was\nreleased", []), (wrap(text["Zlib"], ";"), ["Zlib"]), (wrap(text["ISC"], "#") + "\n\n" + wrap(text["Apache-2.0"] if "governing" in text["Apache-2.0"] else licenses.TEXTS[7][1], "#"), ["Apache-2.0", "ISC"]),
    ]
    rows = licenses.find(docs(spark, *[c[0] for c in cases])).collect()
    got = [sorted(r.license for r in rows if r.doc_id == k) for k in range(len(cases))]
    assert got == [c[1] for c in cases]


def test_lexicon_features_count_near_second_person():
    f = toxicity.features("You are an 1diot!", toxicity.Lexicon())
    assert f[1] == 1 and f[6] > 0 and f[13] > 0
