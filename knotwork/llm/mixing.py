"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.llm.common import Cuts, word_count

#: Weights of the sources in order of code point, over and over.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all sizes, and how often a source may be taken at most.
SHARE, REPEATS = 1.5, 2
#: Rows of a shard, and shards of a source at most; beyond, shards grow.
SHARD_ROWS, SHARDS = 4096, 4096
#: Copies of one row that are given back together.
PART = 4096
#: Tokens of a block. One, so that small sources meet their targets whatever the size of all; seats are counted in closed form, so their number costs nothing.
BLOCK = 1
SEED = "knotwork"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: float = REPEATS) -> list[float]:
    """Shares of total by weight; none above repeats times its size, what is over is dealt again by weight until none is above."""
    out = [0.0] * len(sizes)
    free = [k for k in range(len(sizes)) if weights[k] > 0 and sizes[k] > 0]
    left = float(total)
    while free:
        by = left / sum(weights[k] for k in free)
        full = [k for k in free if by * weights[k] > repeats * sizes[k]]
        if not full:
            for k in free:
                out[k] = by * weights[k]
            break
        for k in full:
            out[k] = float(repeats * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes/(2s+1), ties to the earlier party; most bounds a party's seats.

    The quotients above a common threshold are counted in closed form, so that only the last few seats, one for each party at most,
    are dealt one by one: the result is that of dealing all of them, in time that doesn't depend on the seats.
    """
    v = np.maximum(np.asarray(votes, float), 0)
    cap = np.full(len(v), seats, np.int64) if most is None else np.minimum(np.asarray(most, np.int64), seats)
    cap = np.where(v > 0, cap, 0)
    if seats >= int(cap.sum()):
        return [int(x) for x in cap]
    above = lambda t: np.minimum(cap, np.ceil(np.maximum(0.0, (v / t - 1) / 2)).astype(np.int64))  # noqa: E731  quotients over t
    lo, hi = 0.0, float(v.max(initial=0)) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if above(mid).sum() > seats else (lo, mid)
    got = above(hi * (1 + 1e-9)) if seats else np.zeros(len(v), np.int64)
    heap = [(-v[k] / (2 * got[k] + 1), k) for k in range(len(v)) if got[k] < cap[k]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < cap[k]:
            heapq.heappush(heap, (-v[k] / (2 * got[k] + 1), k))
    return [int(x) for x in got]


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, cuts: Cuts | None = None, named: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs; named: with its source.

    Blocks of equal token counts go to the sources by their targets, and within a source to its shards by their tokens, both by
    Sainte-Lague. A shard's rows stand in a seeded order; its tokens are one sequence of blocks. A quota first takes the whole
    sequence as often as it holds it, then the first blocks of what the seed put first, so a row's taken words are whole passes plus its
    overlap with these blocks: at most `repeats` times its size. Rows of one id, source and size are counted before the shuffle and
    stand side by side in that order, so an id (or none) that very many rows repeat is no burden.

    Null texts have size 0 and are never taken; the null source comes last in order and is a source of its own; null ids stay null.
    Texts of any length are read whole; an empty table gives no rows; other columns are not read.
    The driver holds one line for each source. Shards are dealt in one group for each source, of SHARDS rows at most.
    """
    cuts = cuts or Cuts(spark)
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    sizes = cuts.table(sizes, "sizes")
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n")).collect()
    per.sort(key=lambda r: (r.source is None, r.source or ""))  # str orders by code point
    total = share * sum(r.source_size for r in per)
    want = targets([r.source_size for r in per], [weights[k % len(weights)] for k in range(len(per))], total, repeats)
    quota = sainte_lague(want, round(sum(want) / BLOCK), [-(-repeats * r.source_size // BLOCK) for r in per])
    lines = [(k, r.source, r.source_size, want[k], quota[k] * BLOCK, min(SHARDS, max(1, -(-r.n // SHARD_ROWS)))) for k, r in enumerate(per)]
    plan = spark.createDataFrame(lines, "source_no int, source string, source_size long, target double, blocks long, shards int")
    plan = cuts.table(plan.coalesce(1), "plan")
    at = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = sizes.withColumnRenamed("source", "own").join(plan, F.col("own").eqNullSafe(F.col("source")))
    rows = rows.select("doc_id", "source_no", "size", "copies", "source_size", "target", "blocks", at.alias("at"), F.pmod(F.xxhash64(F.lit(7), "doc_id", "size"), F.col("shards")).cast("int").alias("shard"))
    rows = cuts.table(rows, "rows")
    tokens = rows.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.first("blocks").alias("blocks"))
    deal = tokens.withColumn("repeats", F.lit(repeats)).groupBy("source_no").applyInArrow(_deal, "source_no int, shard int, tokens long, quota long")
    deal = cuts.table(deal, "quotas")
    w = Window.partitionBy("source_no", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(deal, ["source_no", "shard"]).withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(w))
    # Rows that repeat are given back by parts of PART, dealt out anew, so that no task writes all of them.
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PART))
    placed = placed.withColumn("begin", F.col("upto") - F.col("size") * F.col("copies")).drop("at", "upto").withColumn("part", F.explode_outer(parts))
    many = placed.where(F.col("copies") > PART).hint("rebalance")
    one = placed.where(F.col("copies") <= PART).unionByName(many)
    one = one.withColumn("copy", F.explode_outer(F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.col("copies")) - 1)))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0)
    rest = F.col("quota") - passes * F.col("tokens")
    lo = F.col("begin") + F.col("copy") * F.col("size")
    part = F.greatest(F.lit(0), F.least(lo + F.col("size"), rest) - lo)
    if named:
        one = one.join(F.broadcast(plan.select("source_no", "source")), "source_no")
    return one.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), *(["source"] if named else []))


def keep_mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes words of, with all their columns, whatever their names, and size, source_size, target and taken (with an underscore more where docs has such a name).

    What is taken of a text is the whole text taken // size times and then its first taken % size words. Rows that agree in id, source and
    size are interchangeable: their shares go to them in the order of their texts. Null and empty texts, and empty tables, give no rows.
    """
    names = {}
    for c in ("size", "source_size", "target", "taken"):
        names[c] = next(n for k in range(len(docs.columns) + 1) if (n := c + "_" * k) not in docs.columns)
    cuts = Cuts(spark)
    key = [F.col("doc_id").alias("doc_id"), F.col("source").alias("source")]
    shares = cuts.table(mix(spark, docs, cuts=cuts, named=True).where("taken > 0"), "shares")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key, word_count(F.col("text")).alias("size")).where("size > 0")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("doc_id", "source", "size")]
    # Most rows are alone with their key; only of those that are not is the place among their likes asked for.
    several = cuts.table(held.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).where("n > 1"), "several")
    by = Window.partitionBy("doc_id", "source", "size")
    out = []
    for how, place in (("left_anti", lambda order: F.lit(1)), ("left_semi", lambda order: F.row_number().over(by.orderBy(*order)))):
        a = held.join(several, same(held, several), how).withColumn("k", place([F.col("row")["text"]])).alias("a")
        b = shares.join(several, same(shares, several), how).withColumn("k", place([F.desc("taken")])).alias("b")
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "source", "size", "k")]
        out.append(a.join(b, on).select("a.row", *(F.col(f"b.{c}").alias(c) for c in names)))
    both = out[0].unionByName(out[1])
    return both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in names.items()))


def _deal(t: pa.Table) -> pa.Table:
    """Quotas of one source's shards."""
    rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
    got = sainte_lague([r["tokens"] for r in rows], rows[0]["blocks"], [r["repeats"] * r["tokens"] for r in rows])
    kinds = pa.schema([("source_no", pa.int32()), ("shard", pa.int32()), ("tokens", pa.int64()), ("quota", pa.int64())])
    return pa.Table.from_pylist([{**{c: r[c] for c in ("source_no", "shard", "tokens")}, "quota": g} for r, g in zip(rows, got, strict=True)], kinds)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
