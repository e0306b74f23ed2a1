"""The prefix trie against a plain reading of its contract, SQL, hot and odd conversations."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from knotwork.llm import trie
from knotwork.llm.common import Cuts

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for key in nodes:
        if key:
            kids[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += kids[key] == 0
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1].encode()) if key else 0
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(k)))).encode()).hexdigest() for k, m in nodes.items()}
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in nodes.items()), key=repr)


def rows_of(kind):
    if kind == "odd":
        rows = [(None, 1, "user", "of nobody"), (3, None, None, None), (3, 2, "user", "é" * 40_000), (3, 2, "user", "a"), (3, 2, "user", "a"), (-7, 0, "user", "x"), (-5, 0, "user", "x"), (5, 1, "a", "b"), (6, 1, "a", "b"), (8, 1, "ab", ""), (9, 1, "a", "b")]
        return rows + [(c, k, "user", f"t{k % 3}") for c in range(40, 60) for k in range(c % 7)]
    if kind == "nested":  # every conversation is the start of the next, and one goes on for long
        return [(5 * c, k, "user", f"t{k}") for c in range(40) for k in range(c)] + [(1000, k, "user", f"t{k}" if k < 60 else f"{k}") for k in range(300)]
    return [(c, k, "user", ("hello" if k == 0 else f"{k * c % 11}")) for c in range(300) for k in range(1 + c % 9)]  # one first turn


@pytest.mark.parametrize("kind", ["odd", "nested", "bushy"])
def test_nodes_as_the_contract_reads_and_as_sql(spark, tmp_path, monkeypatch, kind):
    for name, value in (("BLOCK", 16), ("PACK", 8), ("BROADCAST", 8)):  # so that blocks, packs and hot parents meet here
        monkeypatch.setattr(trie, name, value)
    rows = rows_of(kind)
    spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, trie.op12_trie(spark, str(tmp_path)).select(*NAMES).collect()), key=repr)
    assert got == plain(rows)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(trie.ORACLE)
    assert want.columns == list(NAMES) and sorted(want.fetchall(), key=repr) == got


def test_empty_tables_have_no_node(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA), Cuts(spark)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", 0, "")], SCHEMA), Cuts(spark)).count() == 0


def test_paths_lead_up_by_levels(spark):
    rows = rows_of("bushy")
    cuts = Cuts(spark)
    kin = trie.family(trie.prefixes(spark.createDataFrame([(*r, 7, "n") for r in rows], SCHEMA), cuts), cuts)
    nodes = {(r.conv_id, r.depth): r for r in trie.heavy_paths(kin, cuts).collect()}
    for r in nodes.values():
        if r.depth:
            up = nodes[r.parent_conv_id, r.depth - 1]
            same = (up.path_conv, up.path_n) == (r.path_conv, r.path_n)
            assert same == r.heavy and (same or up.level > r.level)
    assert sum(not r.heavy for r in nodes.values()) == sum(r.n_children == 0 for r in nodes.values())
