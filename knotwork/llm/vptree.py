"""Approximate nearest neighbours by inner product: vantage-point trees per shard, triangle-inequality pruning relaxed by a factor."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts

#: Neighbours, vectors of a shard, bytes of a block of queries (which is what one pass sends to the executors), rows of a leaf.
K, SHARD, BLOCK_BYTES, LEAF = 20, 16384, 1 << 25, 256
#: What a node's bound is multiplied by: 1 is exact, more prunes more.
FACTOR = 1.0
EVERY = 20
#: Queries that go down a tree together.
GROUP = 512


class VPTree:
    """Directions of vectors in a tree: a node splits its rows at their median distance from a vantage point, keeps the range of distances of either half and the largest norm in it.

    Directions at a distance d or more have a cosine of 1 - d^2/2 at most, so a half's products are bounded by both norms and that. Norms
    are kept apart from directions, so that no large vector costs the digits of small ones.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        top = np.abs(x).max(axis=1, keepdims=True)
        part = np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True))
        self.unit = x / top / part
        with np.errstate(over="ignore"):
            self.norm = (top * part).ravel()
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = self.unit[rows[len(rows) // 2]]
        d = np.sqrt(((self.unit[rows] - point) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        halves = [order[: len(order) // 2], order[len(order) // 2 :]]
        return point, [(float(d[o[0]]), float(d[o[-1]]), float(self.norm[rows[o]].max()), self._grow(rows[o])) for o in halves]

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that hold each query's k rows of the largest products, and rows that may tie with the last of them. own: for each query a row that doesn't count, or -1."""
        top = np.abs(q).max(axis=1, keepdims=True)
        part = np.sqrt(((q / top) ** 2).sum(axis=1, keepdims=True))
        unit = q / top / part
        with np.errstate(over="ignore", invalid="ignore"):
            norm = (top * part).ravel()
            # What rounding can hide of a product.
            slack = 1e-12 * (len(q[0]) + 8) * norm * self.norm.max()
            slack = np.where(np.isfinite(slack), slack, np.inf)
            found = np.full((len(q), len(self.x)), -np.inf)
            best = np.full((len(q), k), -np.inf)
            least = best[:, 0].copy()
            todo = [(self.root, np.arange(len(q)), np.full(len(q), np.inf))]
            while todo:
                node, who, bound = todo.pop()
                live = ~(bound + slack[who] < least[who])
                who = who[live]
                if not len(who):
                    continue
                if isinstance(node, np.ndarray):
                    s = q[who] @ self.x[node].T
                    odd = np.isnan(s)
                    s[odd] = -np.inf
                    if own is not None:
                        s[own[who][:, None] == node[None, :]] = -np.inf
                    both = np.partition(np.c_[best[who], s], -k, axis=1)[:, -k:]
                    best[who], least[who] = both, both[:, 0]
                    # What is no number may be anything and is looked at exactly.
                    s[odd] = np.inf
                    found[np.ix_(who, node)] = s
                    continue
                point, halves = node
                d = np.sqrt(((unit[who] - point) ** 2).sum(axis=1))
                bounds, gaps = [], []
                for lo, hi, most, _ in halves:
                    gap = np.maximum(0, np.maximum(lo - d, d - hi))
                    cos = 1 - np.minimum(factor * gap, 2) ** 2 / 2
                    high = norm[who] * most * cos
                    bounds.append(np.where(cos >= 0, np.where(np.isnan(high), np.inf, high), 0.0))
                    gaps.append(gap)
                near = gaps[0] <= gaps[1]
                # The nearer half last, so that it is searched first.
                for go, order in ((~near, (0, 1)), (near, (1, 0))):
                    todo += [(halves[h][3], who[go], bounds[h][go]) for h in order]
            return np.nonzero(~(found < (least - slack)[:, None]) & (found > -np.inf))


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that equal vectors score equal; what is no number ranks as the least."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(x.shape[1]):
            out += x[:, k] * q[:, k]
    return np.where(np.isnan(out), -np.inf, out)


class Shard:
    """Rows of one shard: distinct vectors, each with its ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        kinds, which = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        self.start = np.searchsorted(which.ravel()[by], np.arange(len(kinds) + 1))
        self.ids, self.tree = ids[by], VPTree(kinds)

    def nearest(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, score) of the k nearest rows of each query but those of its own id, ties to smaller ids."""
        out: list[tuple] = []
        # Kinds whose ids all are the query's own don't count.
        single = self.ids[self.start[:-1]] == self.ids[self.start[1:] - 1]
        only = {int(i): n for n, i in enumerate(self.ids[self.start[:-1]]) if single[n]}
        plain = len(self.ids) == len(self.start) - 1
        for at in range(0, len(q), GROUP):
            part, pids = q[at : at + GROUP], qids[at : at + GROUP]
            who, rows = self.tree.search(part, k, factor, np.array([only.get(int(i), -1) for i in pids]))
            s = product(self.tree.x[rows], part[who])
            for n in range(len(part)):
                lo, hi = np.searchsorted(who, (n, n + 1))
                if plain:
                    near, mine = self.ids[self.start[rows[lo:hi]]], s[lo:hi]
                    near, mine = near[near != pids[n]], mine[near != pids[n]]
                    best = np.lexsort((near, -mine))[:k]
                    out.append((np.full(len(best), at + n), near[best], mine[best]))
                    continue
                near = np.concatenate([self._first(r, pids[n], k) for r in rows[lo:hi]] or [np.zeros(0, np.int64)])
                mine = np.repeat(s[lo:hi], [len(self._first(r, pids[n], k)) for r in rows[lo:hi]])
                best = np.lexsort((near, -mine))[:k]
                out.append((np.full(len(best), at + n), near[best], mine[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _first(self, row: int, own: int, k: int) -> np.ndarray:
        """The k smallest ids of a kind but the own one."""
        lo, hi = self.start[row], self.start[row + 1]
        a, b = lo + np.searchsorted(self.ids[lo:hi], (own, own + 1))
        return np.concatenate([self.ids[lo : min(a, lo + k)], self.ids[b : min(hi, b + k)]])[:k]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _search(asked: object, k: int, factor: float):
    """Every group of rows of one shard and length is searched with all queries of that length. What a task finds for a query is cut to its k best before it leaves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        best: dict[int, list[np.ndarray]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def close() -> None:
            if now is None or now[1] not in queries:
                return
            rows, qids, q = queries[now[1]]
            at, near, s = Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])).nearest(qids, q, k, factor)
            old = best.get(now[1], [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])
            at, near, s = np.r_[old[0], at], np.r_[old[1], near], np.r_[old[2], s]
            order = np.lexsort((near, -s, at))
            place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            order = order[place < k]
            best[now[1]] = [at[order], near[order], s[order]]

        for b in batches:
            shard, dim = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if lo == hi:
                    continue
                key = (int(shard[lo]), int(dim[lo]))
                if key != now:
                    close()
                    held, now = [], key
                held.append((b.column(2)[lo:hi].to_numpy(zero_copy_only=False), _vectors(b.column(3)[lo:hi])))
        close()
        for dim, (at, near, s) in best.items():
            rows, qids, _ = queries[dim]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(qids[at]), pa.array(near), pa.array(s)], ["asked", "query_id", "vec_id", "score"])

    return run


def nearest(spark: SparkSession, vectors: DataFrame, k: int = K, factor: float = FACTOR, cuts: Cuts | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) whose id EVERY divides, against all others: the k largest inner products, ties to smaller ids.

    Left out are null ids and vectors that are null, empty, zero or hold null or non-finite components; vectors of other lengths are no
    candidates of one another. A row with a query's id is not among its results; query rows that repeat an id are searched as rows of
    their own and give as many lists. Products that overflow to no number rank last, as minus infinity. An empty table gives no rows.

    All vectors are dealt out to shards of about SHARD rows once. Queries pass over them in blocks of at most BLOCK_BYTES, which are broadcast; a
    task keeps the k best of a query over its shards, and a window with a limit merges the tasks' lists.
    """
    cuts = cuts or Cuts(spark)
    v = F.transform("embedding", lambda e: e.cast("double"))
    fine = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    good = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    good = cuts.table(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")), "vectors")
    n, longest = good.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, -(-n * 8 * longest // (EVERY * BLOCK_BYTES)))
    shards = max(1, -(-n // SHARD))
    own = good.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "dim", "vec_id", "v").repartition("shard").sortWithinPartitions("shard", "dim")
    own = cuts.table(own, "shards")
    asked = cuts.table(good.where(F.col("vec_id") % EVERY == 0).select(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(blocks)).alias("block"), "row", "vec_id", "v", "dim"), "asked")
    found = None
    for block in range(blocks):
        t = asked.where(F.col("block") == block).toArrow().combine_chunks()
        queries = {}
        for dim in np.unique(t.column("dim").to_numpy()):
            part = t.filter(pc.equal(t.column("dim"), pa.scalar(int(dim), pa.int32()))).combine_chunks()
            queries[int(dim)] = (part.column("row").to_numpy(), part.column("vec_id").to_numpy(), _vectors(part.column("v").combine_chunks()))
        sent = spark.sparkContext.broadcast(queries)
        part = cuts.table(own.mapInArrow(_search(sent, k, factor), "asked long, query_id long, vec_id long, score double"), f"near{block}")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: Components are summed in the order of the list, in double precision, as above.
ORACLE = """with v as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null),
good as (select * from v where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
met as (select q.vec_id as query_id, x.vec_id, list_reduce(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]), lambda a, b: a + b) as score
from good q join good x on x.vec_id <> q.vec_id and len(x.v) = len(q.v) where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from met qualify rank <= 20"""
