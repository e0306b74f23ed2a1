"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked within a Hamming radius through BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts
from knotwork.llm.components import components

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Fingerprints of a shard, and in one tree at most; larger shards are dealt out as pairs of chunks.
SHARD, CHUNK = 4096, 8192
#: Fingerprints that a node keeps flat before it grows children.
LEAF = 4
#: A fingerprint is hot if more than one in so many rows have it; there are no more hot ones than that.
HOT = 1000


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes. No words: zero."""
    w = text.lower().split()
    if not w:
        return 0
    x = xxhash.xxh64_intdigest
    if len(w) <= SHINGLE:
        return x(b" ".join(w), SEED)
    h = np.fromiter((x(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(SHINGLE)), strict=False)), np.uint64, len(w) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py() or b"") for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for each row. Null texts count as empty."""
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the node's pivot. A search with many queries at once follows only the edges within the radius of each query's distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = self._grow(np.arange(len(values)))

    def _grow(self, rows: np.ndarray):
        top, todo = [], [(rows, None)]
        while todo:
            own, put = todo.pop()
            if len(own) <= LEAF:
                node = (None, own)
            else:
                d = np.bitwise_count(self.values[own[1:]] ^ self.values[own[0]])
                node = (own[0], children := {})
                todo += [(own[1:][d == c], (children, int(c))) for c in np.unique(d)]
            if put:
                put[0][put[1]] = node
            else:
                top.append(node)
        return top[0]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the tree, positions of the queries within the radius of it); every such row and query once."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (pivot, below), q = todo.pop()
            if pivot is None:
                near = np.bitwise_count(queries[q][:, None] ^ self.values[below][None, :]) <= radius
                for k in np.flatnonzero(near.any(axis=0)):
                    yield int(below[k]), q[near[:, k]]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[pivot]).astype(np.int16)
            if (hit := q[d <= radius]).size:
                yield int(pivot), hit
            for c, node in below.items():
                if (go := q[np.abs(d - c) <= radius]).size:
                    todo.append((node, go))


def spanning(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each value the least position of its component under links within the radius; keeps no list of links."""
    parent = np.arange(len(values))
    for row, hits in BKTree(values).search(values, radius):
        roots = np.append(parent[hits], row)
        while True:
            up = parent[roots]
            if (up == roots).all():
                break
            roots = up
        least = roots.min()
        if (roots != least).any():
            parent[roots] = least
            parent[hits] = least
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _links(radius: int):
    """Streams through rows sorted by (i, v, a, b); each run of equal keys is one tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def done():
            own = np.unique(np.concatenate(held)).view(np.uint64)
            if len(own) < 2:
                return None
            root = spanning(own, radius)
            child = np.flatnonzero(root != np.arange(len(own)))
            return (own[child].view(np.int64), own[root[child]].view(np.int64)) if len(child) else None

        for b in batches:
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            fp = b.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if lo == hi:
                    continue
                now = tuple(keys[lo])
                if now != key and held:
                    if x := done():
                        out.append(x)
                    held = []
                key = now
                held.append(fp[lo:hi])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
        if held and (x := done()):
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["a", "b"])

    return run


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of (i, v). Two values within the radius differ in at most `radius` of the blocks, so they share all bits of some choice of the others: no link is lost."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, own in enumerate(combinations(range(blocks), blocks - radius)):
        v = F.lit(0).cast("long")
        for k in own:
            v = F.shiftleft(v, edges[k + 1] - edges[k]).bitwiseOR(part[k])
        keys.append(F.struct(F.lit(i).alias("i"), v.alias("v")))
    return F.array(*keys)


def link_fingerprints(spark: SparkSession, fps: DataFrame, cuts: Cuts, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the distinct fingerprints that have a link, component being one value for each component.

    A shard gathers all that share any of some values of a choice of blocks, so that it holds about SHARD fingerprints; its BK-tree is grown
    where its fingerprints are and all of them are queries of it, which follow the edges within the radius. Fingerprints are never
    broadcast, as that would take all of them through the driver. Shards over CHUNK values (many that share one value) are dealt out as
    pairs of chunks, each pair a tree of bounded size, so a hot shard spreads over many tasks and nothing is cut off. More blocks
    (longer keys) are taken as the distinct fingerprints grow.
    """
    n = fps.count()
    blocks = radius + (1 if n < 1 << 24 else 2 if n < 1 << 31 else 3)
    several = F.pmod(F.xxhash64("k.i", "k.v"), F.lit(max(1, n // SHARD)))
    shards = fps.select("fp", F.explode_outer(shard_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.i", several.alias("v"))
    counts = shards.groupBy("i", "v").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b")))
    dealt = shards.join(counts, ["i", "v"]).select("i", "v", "fp", F.explode(pairs).alias("p")).select("i", "v", "p.a", "p.b", "fp")
    dealt = dealt.repartition("i", "v", "a", "b").sortWithinPartitions("i", "v", "a", "b")
    return components(spark, dealt.mapInArrow(_links(radius), "a long, b long"), cuts)


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, cuts: Cuts | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links within the radius.

    Rows with equal fingerprints link, empty and null texts (fingerprint zero) with one another. Repeated rows stay as they are. Rows
    with a null doc_id take part in no group; their component_id is null. An empty table gives no rows. Further columns of docs
    are not read.
    """
    cuts = cuts or Cuts(spark)
    every = cuts.table(fingerprints(docs), "fp")
    fps = cuts.table(every.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fps")
    linked = link_fingerprints(spark, fps, cuts, radius)
    named = fps.join(linked.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    all_fps = cuts.table(fps.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "fp-groups")
    # What very many rows share is sent to all of them; there are at most HOT such values.
    hot = all_fps.where(F.col("n") * HOT > every.count()).select("fp", F.col("component_id").alias("of_hot"))
    split = every.join(F.broadcast(hot), "fp", "left")
    cold = split.where("of_hot is null").drop("of_hot").join(all_fps.drop("n"), "fp", "left")
    joined = cold.unionByName(split.where("of_hot is not null").withColumnRenamed("of_hot", "component_id"))
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each group left, that of the smallest doc_id; of rows that repeat this doc_id the least by its columns in order. Rows with a null doc_id stay."""
    cuts = Cuts(spark)
    group = cuts.table(near_duplicates(spark, docs, cuts=cuts), "groups")
    kept = group.where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("again"))
    gone = group.where("doc_id is not null").select("doc_id").distinct().join(kept.where("not again").select("doc_id"), "doc_id", "left_anti")
    gone = cuts.table(gone, "gone")
    again = docs.join(kept.where("again").select("doc_id"), "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = again.groupBy("doc_id").agg(F.min(row).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(first)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
