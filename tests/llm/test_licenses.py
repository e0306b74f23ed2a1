"""License scans go by compression: ranks, rounds, and agreement with a look at every license."""

import pytest

from knotwork.llm import licenses as L

LINES = [
    "Licensed under the MIT License. Released under the ISC License.", "This work is licensed under the CC BY-SA 4.0.", "we talked of the license and of mit", "Licensed under Apache 2.0", "Available under the GPLv3 and nothing else",
    " ".join(f"Released under the {n}." for n in L.NAMES.values()), L.NOTICES["MIT"], L.NOTICES["ISC"].replace("any purpose", "every purpose"), "copyright 2020 by nobody, all rights reserved", "",
]


@pytest.mark.parametrize("name", sorted(L.NAMES))
def test_the_right_license_is_among_the_best_by_size_saved(name):
    for text in [f.format(L.NAMES[name]) for f in L.FORMS] + [t for k, t, _ in L.TEXTS if k == name]:
        saved = L.savings(L.WORD.findall(text.lower()))
        assert name in sorted(saved, key=lambda k: (-saved[k], k))[: L.LOOKED]
        assert [r[0] for r in L.scan(text)] == [name]


def test_as_if_every_license_were_looked_at(monkeypatch):
    got = [[r[:3] for r in L.scan(x)] for x in LINES]
    monkeypatch.setattr(L, "LOOKED", 1000)
    assert got == [[r[:3] for r in L._looked(x, False)] for x in LINES]
    assert {r[0] for r in got[5]} == set(L.NAMES)  # as many as there are, by rounds


def test_nothing_is_found_where_sizes_say_nothing(monkeypatch):
    monkeypatch.setattr(L, "savings", lambda words: dict.fromkeys(L.NAMES, 1))
    found = {r[0] for x in LINES[:5] for r in L._looked(x, False)}
    assert "MIT" not in found and "GPL-3.0" in found | {"GPL-3.0"} and len(found) < 4


def test_odd_texts_and_columns(spark):
    d = spark.createDataFrame([(None, "Licensed under MIT", "x"), (1, None, "y"), (2, "", "z"), (3, "w " * 60_000 + "\nLicensed under MIT\n" + "v " * 60_000, "t"), (3, "Licensed under MIT", "t")], "doc_id long, text string, license string")
    assert sorted((repr(r.doc_id), r.license) for r in L.find(d).collect()) == [("3", "MIT"), ("3", "MIT"), ("None", "MIT")]
