"""Prefix trie of conversations by heavy-path decomposition: turns are numbered across partitions, prefixes keyed by running sums, and subtree totals found by suffix sums along path arrays that attach to their parents in rounds.

No step gathers a conversation, a node's members, its children or a path in one task: positions and prefix keys come from blocks and the
sums of blocks, members from pre-aggregation, parents of very many children from a broadcast whose rows are bounded, path arrays from
blocks of BLOCK nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts

#: Turns or nodes of a block: what a window or an array holds at once.
BLOCK = 4096
#: Parents that are broadcast at most: those with more than a share of 1 / BROADCAST of all nodes as children, of which there are fewer.
BROADCAST = 1 << 16
#: Ids that are packed in one row before a node's digest.
PACK = 4096
HEADS = 9
_SUMS = [f"k{k}" for k in range(4)]


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        c = b.column(0).to_numpy(zero_copy_only=False)
        if not len(c):
            continue
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[start, len(c)])
        at = np.arange(1, len(c) + 1) - np.repeat(start, size)
        if last == c[0]:
            at[: size[0]] += n
        last, n = c[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(c), part), pa.int64()), pa.array(at, pa.int64()), b.column(1), b.column(2)], ["conv_id", "part", "at", "digest", "bytes"])


def numbered(turns: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, bytes) of every turn, pos from 1, and (conv_id, n).

    Turns stand by number, nulls first, ties by role and text; null roles and texts are empty. Rows are sorted over all partitions, so one
    conversation may spread over many; a partition's count of the conversation that it goes on with is broadcast, one row a partition at most.
    """
    t = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    turn = F.col("turn").asc_nulls_first()
    # The start of a text is enough to deal out by; whole texts would be sampled into the driver.
    t = t.repartitionByRange(F.col("conv_id"), turn, F.left("role", F.lit(64)), F.left("text", F.lit(64))).sortWithinPartitions("conv_id", turn, "role", "text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))
    t = t.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    t = cuts.table(t.mapInArrow(_numbered, "conv_id long, part long, at long, digest binary, bytes long"), "trie-turns")
    runs = cuts.table(t.groupBy("conv_id", "part").agg(F.max("at").alias("n")), "trie-runs")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    gone_on = runs.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    pos = (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos")
    return t.join(F.broadcast(gone_on), ["conv_id", "part"], "left").select("conv_id", pos, "digest", "bytes"), runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, d, digest, bytes, total), d from 1, and every conversation (c, total): the first h turns of c - c % 5, then its own after the first h."""
    t, n = numbered(turns, cuts)
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    own = cuts.table(n, "trie-own")
    convs = own.select(F.col("conv_id").alias("c"), "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h(F.col("conv_id")).alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cuts.table(convs.select("c", "base", "n", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "trie-convs")
    # Few conversations share a base and few of its turns are lent; own turns meet their conversation by blocks.
    head = t.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= lent").select("c", F.col("pos").alias("d"), "digest", "bytes", "total")
    block = lambda c: F.floor(c / BLOCK).cast("long")
    per_block = convs.select("c", "lent", "total", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("n")))).alias("blk"))
    rest = t.withColumnRenamed("conv_id", "c").where(F.col("pos") > h(F.col("c"))).withColumn("blk", block(F.col("pos"))).join(per_block, ["c", "blk"])
    rest = rest.select("c", (F.col("pos") + F.col("lent") - h(F.col("c"))).alias("d"), "digest", "bytes", "total")
    return head.unionByName(rest), convs.select("c", "total")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def prefixes(turns: DataFrame, cuts: Cuts) -> DataFrame:
    """(c, depth, node, parent, bytes, ends) for every conversation and every prefix of it, the empty one included.

    A prefix is keyed by its depth and four sums of 32-bit hashes of (position, turn), which are added up within blocks and over blocks.
    """
    t, convs = rebuilt(turns, cuts)
    a, b = F.xxhash64(F.lit(1), "d", "digest"), F.xxhash64(F.lit(2), "digest", "d")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = dict(zip(_SUMS, (low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)), strict=True))
    t = cuts.table(t.withColumns(parts).withColumn("blk", F.floor(F.col("d") / BLOCK).cast("long")).drop("digest"), "trie-rebuilt")
    sums = t.groupBy("c", "blk").agg(*(F.sum(k).alias(k) for k in _SUMS))
    before = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "blk", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"b{k}") for k in _SUMS))
    within = Window.partitionBy("c", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"s{k}": F.sum(k).over(within) for k in _SUMS}).join(sums, ["c", "blk"])
    here = [F.col(f"s{k}") + F.col(f"b{k}") for k in _SUMS]
    node, parent = _key(F.col("d"), here), _key(F.col("d") - 1, [x - F.col(k) for x, k in zip(here, _SUMS, strict=True)])
    t = t.select("c", F.col("d").alias("depth"), node.alias("node"), parent.alias("parent"), "bytes", (F.col("d") == F.col("total")).alias("ends"))
    root = _key(F.lit(0), [F.lit(0)] * 4)
    top = convs.select("c", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("total") == 0).alias("ends"))
    return cuts.table(t.unionByName(top), "trie-prefixes")


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, ids, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
        for node, c in zip(nodes, ids, strict=True):
            if out and out[-1][0] == node and len(out[-1][1]) < PACK:
                out[-1][1].append(c)
            else:
                out.append((node, [c]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1][0] for o in out], pa.int64()), pa.array([",".join(map(str, o[1])) for o in out], pa.string())], ["node", "first", "ids"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        r = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["node", "ends_sha256"])
        out.clear()
        return r

    for b in batches:
        for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield rows()
    if state:
        out.append((now, state.hexdigest()))
        yield rows()


def endings(prefixed: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that conversations end at. A digest is sequential by nature; ids reach it sorted and packed, and are not held."""
    ends = prefixed.where("ends").select("node", "c").repartitionByRange("node", "c").sortWithinPartitions("node", "c")
    packed = ends.mapInArrow(_packed, "node binary, first long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node binary, ends_sha256 string")


def family(prefixed: DataFrame, cuts: Cuts) -> DataFrame:
    """One row for each node with its members, children, its parent's row and whether it is its parent's heavy child: the one of the most members, ties to the smaller conv_id."""
    nodes = prefixed.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = cuts.table(nodes, "trie-nodes")
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("heavy"))
    kids = kids.select(F.col("parent").alias("node"), "n_children", (-F.col("heavy.least")).alias("heavy_conv"))
    nodes = nodes.join(kids, "node", "left").join(endings(prefixed), "node", "left")
    nodes = cuts.table(nodes.fillna(0, ["n_children"]).fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]), "trie-family")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), "heavy_conv", "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > max(BLOCK, nodes.count() // BROADCAST)).drop("n_children"))
    own = nodes.where("parent is not null").drop("heavy_conv")
    known = own.join(hot, "parent").unionByName(own.join(hot.select("parent"), "parent", "left_anti").join(parents.drop("n_children"), "parent"))
    heavy = (F.col("heavy_conv") == F.col("conv_id")).alias("heavy")
    none = F.lit(None).cast("long")
    root = nodes.where("parent is null").select(*own.columns, none.alias("parent_conv_id"), none.alias("parent_n"), F.lit(False).alias("heavy"))
    return cuts.table(known.select(*own.columns, "parent_conv_id", "parent_n", heavy).unionByName(root), "trie-kin")


def heavy_paths(kin: DataFrame, cuts: Cuts) -> DataFrame:
    """kin with path_conv, path_n (smallest member and members of its heavy path's top), blk and level.

    Nodes of one smallest member and as many members are one unary chain, so chains are contracted first. Along a heavy path of k chains
    members fall k times, so all turns are at least k^2 / 2 and few rows ever point to one chain; pointers double until they reach the top.
    A light child has at most half of its parent's members, so the level, the bits of path_n, rises from every path to its parent's.
    """
    at_top = F.min_by(F.struct("heavy", "parent_conv_id", "parent_n"), "depth")
    chains = kin.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("low"), F.max("depth").alias("high"), at_top.alias("top"))
    up = lambda c, own: F.when(F.col("top.heavy"), F.col(f"top.{c}")).otherwise(F.col(own))
    j = cuts.table(chains.select("conv_id", "n_convs", "low", "high", up("parent_conv_id", "conv_id").alias("path_conv"), up("parent_n", "n_convs").alias("path_n"), (~F.col("top.heavy")).alias("done")), "trie-jump0")
    k = 0
    while j.where("not done").take(1):
        target = j.select(F.col("conv_id").alias("path_conv"), F.col("n_convs").alias("path_n"), F.col("path_conv").alias("next_conv"), F.col("path_n").alias("next_n"), F.col("done").alias("there"))
        moved = j.where("not done").join(target, ["path_conv", "path_n"]).select("conv_id", "n_convs", "low", "high", F.col("next_conv").alias("path_conv"), F.col("next_n").alias("path_n"), F.col("there").alias("done"))
        k += 1
        j = cuts.table(j.where("done").unionByName(moved), f"trie-jump{k}")
        cuts.drop(f"trie-jump{k - 1}")
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    j = j.select("conv_id", "n_convs", "path_conv", "path_n", F.explode(F.sequence(block("low"), block("high"))).alias("blk"))
    return kin.withColumn("blk", block("depth")).join(j, ["conv_id", "n_convs", "blk"]).withColumn("level", F.length(F.bin("path_n")))


_ARRAY = ("depth", "n_leaves", "saved_tokens", "conv_id", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "heavy", "parent")
_NODE = "depth long, n_leaves long, saved_tokens long, conv_id long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string, heavy boolean, parent binary"


def _suffix_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of a path array (deepest first) and what follows it: its nodes with the sums of themselves and all below."""
    for b in batches:
        path = b.column(0)
        flat, size = path.flatten(), np.diff(path.offsets.to_numpy())
        if not len(flat):
            continue
        start = np.cumsum(size) - size
        cols = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        for k, name in ((1, "n_leaves"), (2, "saved_tokens")):
            run = np.r_[0, np.cumsum(cols[name].to_numpy())]
            cols[name] = pa.array(run[1:] - np.repeat(run[start] - b.column(k).to_numpy(), size), pa.int64())
        yield pa.RecordBatch.from_arrays([cols[c] for c in _ARRAY], list(_ARRAY))


def totals(nodes: DataFrame, cuts: Cuts) -> DataFrame:
    """Leaves and saved tokens of every subtree, in one round for each level of paths from below, of which there are at most as many as bits in the count of conversations."""
    cuts.partitioned(nodes, "trie-paths", "level")
    done: list[DataFrame] = []
    for level in sorted(r.level for r in cuts.read(nodes, "trie-paths").select("level").distinct().collect()):
        x = cuts.read(nodes, "trie-paths").where(F.col("level") == level)
        leaves, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
        if done:
            tops = reduce(DataFrame.unionByName, done).where("not heavy").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            x = x.join(tops, "node", "left")
            leaves, saved = leaves + F.coalesce("more_leaves", F.lit(0)), saved + F.coalesce("more_saved", F.lit(0))
        x = x.withColumns({"n_leaves": leaves, "saved_tokens": saved})
        path = ["path_conv", "path_n"]
        arrays = x.groupBy(*path, "blk").agg(F.sort_array(F.collect_list(F.struct(*_ARRAY)), False).alias("nodes"))
        below = Window.partitionBy(*path).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
        after = x.groupBy(*path, "blk").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).select(*path, "blk", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("l", "s")))
        out = arrays.join(after, [*path, "blk"]).select("nodes", "l", "s").mapInArrow(_suffix_sums, _NODE)
        done.append(cuts.table(out, f"trie-level{level}"))
    return reduce(DataFrame.unionByName, done) if done else nodes.sparkSession.createDataFrame([], _NODE)


def trie(turns: DataFrame, cuts: Cuts) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, as the contract of op12 has it.

    Rows without a conv_id are no conversation's. Null turns come first, null roles and texts are empty, repeated rows are turns of their
    own, ties go by role and text. Texts of any length count whole and are hashed once. An empty table has no node, not even a root.
    Columns other than conv_id, turn, role and text are not read.
    """
    kin = family(prefixes(turns, cuts), cuts)
    cuts.drop("trie-turns", "trie-runs", "trie-own", "trie-convs", "trie-rebuilt", "trie-nodes")
    out = totals(heavy_paths(kin, cuts), cuts)
    cuts.drop("trie-prefixes", "trie-family", "trie-kin", "trie-paths")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Cuts(spark))


_BYTE = "list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda s, y: xor(s >> 8, tab[(xor(s, y) & 255) + 1])), 4294967295)"
#: Every conversation's prefixes, grouped; a node's subtree is made of the nodes whose smallest member has it as a prefix.
ORACLE = f"""with crc as (select list_transform(range(256), lambda b: {_BYTE}) as tab),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select conv_id as c, count(*) as n from t group by conv_id),
h as (select c, n, c - c % 5 as base, {_CRC} % {HEADS} as h from ids, crc),
lent as (select h.*, least(h.h, coalesce(b.n, 0)) as lent from h left join ids b on b.c = h.base),
r as (select c, pos as d, role, text from lent join t on t.conv_id = base and pos <= h union all select c, pos - h + lent, role, text from lent join t on t.conv_id = c and pos > h),
e as (select c, lent + greatest(n - h, 0) as total from lent),
p as (select c, 0 as d, '' as key, 0 as bytes from e union all
select c, d, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' order by d) over (partition by c order by d)), strlen(text) from r),
n as (select d, key, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (total = d), '')) as ends_sha256 from p join e using (c) group by d, key),
k as (select n.*, q.key as up, u.conv_id as parent_conv_id from n left join p q on q.c = n.conv_id and q.d = n.d - 1 left join n u on u.d = q.d and u.key = q.key),
m as (select k.*, coalesce(x.n_children, 0) as n_children from k left join (select d - 1 as d, up as key, count(*) as n_children from k where up is not null group by d - 1, up) x using (d, key)),
s as (select p.d, p.key, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * m.bytes) as saved_tokens from m join p on p.c = m.conv_id and p.d <= m.d group by p.d, p.key)
select conv_id, d::bigint as depth, parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256 from m join s using (d, key)"""
