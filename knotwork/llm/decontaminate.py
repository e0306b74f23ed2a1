"""Benchmark decontamination: texts become templates (numbers, names and units as typed placeholders), template windows are joined by hash, and slots must fill consistently."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts

#: Words of a window, share of an item's windows that a document must hold, and share of slots filled consistently.
WINDOW, SIMILAR, CONSISTENT = 5, 0.8, 0.8
#: Distinct benchmark hashes that are sent to the executors at most (8 bytes each); beyond, windows are joined by shuffle.
SENT = 1 << 21
#: Fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec min h hr hrs kb mb gb tb w kw hz khz mhz ghz usd eur gbp dollars euros pounds percent % meters metres miles hours minutes seconds days weeks years".split())
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/%]*(?:st|nd|rd|th|[a-z]{1,3})?$")
EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’*_-#"
NUM, NAME, UNIT = 1, 2, 3
FACTOR = np.uint64(0x9E3779B97F4A7C15)

_known: dict[str, int] = {}


def _code(word: str) -> int:
    """A hash of the bare word in the upper bits; in the lowest bits its type, whether it is capitalised and whether it ends a sentence."""
    bare = word.strip(EDGE)
    low = bare.lower()
    kind = NUM if NUMBER.match(low) else UNIT if low in UNITS else 0
    flags = kind | (bare[:1].isupper() and not bare.isupper()) << 2 | (word.rstrip("\"'»”’)")[-1:] in ".!?:") << 3
    return (xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) & ~31) | flags | (not bare) << 4


@functools.lru_cache(1)
def _coded(text: str | None) -> tuple[list[str], np.ndarray]:
    w = (text or "").split()
    if len(_known) > 300_000:
        _known.clear()
    get = _known.get
    return w, np.array([c if (c := get(x)) is not None else _known.setdefault(x, _code(x)) for x in w], np.uint64)


def template(text: str | None, lines: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes of the template's words, whether each is a slot, and the words themselves. Words of punctuation alone are left out. A name is a capitalised word that doesn't begin a sentence; with `lines`, nor a line."""
    w, codes = _coded(text)
    real = (codes & np.uint64(16)) == 0
    kind = (codes & np.uint64(3)).astype(np.int64)
    ends = (codes & np.uint64(8)) != 0
    begins = np.r_[True, ends[:-1]] if len(w) else ends
    if lines:
        first = np.cumsum([len(x.split()) for x in (text or "").split("\n")])
        begins[first[first < len(w)]] = True
    kind[(kind == 0) & ((codes & np.uint64(4)) != 0) & ~begins] = NAME
    h = np.where(kind > 0, kind.astype(np.uint64), codes & ~np.uint64(31))
    at = np.flatnonzero(real)
    return h[at], kind[at] > 0, [w[k] for k in at] if len(at) < len(w) else w


def _hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    at = np.arange(max(0, len(h) - n + 1))
    out = np.full(len(at), n + salt, np.uint64)
    for k in range(n):
        out = (out ^ h[at + k]) * FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def windows(h: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of n words with at least two that are no slots."""
    if not 0 < n <= len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fixed = np.convolve(~slot, np.ones(n, np.int64), "valid")
    at = np.flatnonzero(fixed >= 2)
    return at, _hashes(h, n)[at]


def literal(text: str | None, n: int) -> np.ndarray:
    """Hashes of all windows of n words as they are, but for case and edges; they never equal those of templates."""
    codes = _coded(text)[1]
    return _hashes(codes[(codes & np.uint64(16)) == 0] & ~np.uint64(31), n, 1 << 20)


FOUND = "id long, th long, h long, at int, slots array<string>, size int, literal boolean"


def _item(text: str | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], int, bool]]:
    """(positions, hashes, slots, words, words of a window, whether literal). The first word of an item may stand within a sentence of a document: if it is capitalised, the first window is there as a name's too."""
    h, slot, w = template(text)
    n = min(WINDOW, len(h))
    out = [(*windows(h, slot, n), slot, w, n, False)]
    if n and not slot[0] and (bare := w[0].strip(EDGE))[:1].isupper() and not bare.isupper():
        h, slot = np.r_[np.uint64(NAME), h[1:n]], np.r_[True, slot[1:n]]
        out.append((*windows(h, slot, n), slot, w, n, False))
    if n:
        x = literal(text, n)
        out.append((np.arange(len(x)), x, np.zeros(len(w), bool), w, n, True))
    return out


def _text(text: str | None, sizes: list[tuple[int, bool]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], int, bool]]:
    """As _item, for the window sizes of the items. What line breaks make another template of is there in both forms, as texts may be wrapped."""
    h, slot, w = template(text)
    out = [(*windows(h, slot, n), slot, w, n, False) for n, lit in sizes if not lit]
    if text and "\n" in text:
        h2, slot2, _ = template(text, True)
        other = np.r_[0, np.cumsum(slot2 != slot)]
        if other[-1]:
            for n, lit in sizes:
                if not lit:
                    at, x = windows(h2, slot2, n)
                    m = other[at + n] > other[at]
                    out.append((at[m], x[m], slot2, w, n, False))
    for n, lit in sizes:
        if lit:
            x = literal(text, n)
            out.append((np.arange(len(x)), x, np.zeros(len(w), bool), w, n, True))
    return out


def _windows(only: np.ndarray | None, sizes: list[tuple[int, bool]] | None):
    """Rows of FOUND for items (sizes is None) or for texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            for i, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at, hash_, slot, w, n, lit in _item(text) if sizes is None else _text(text, sizes):
                    if only is not None and len(only):
                        m = only[np.minimum(np.searchsorted(only, hash_), len(only) - 1)] == hash_
                        at, hash_ = at[m], hash_[m]
                    for p, x in zip(at.tolist(), hash_.tolist(), strict=True):
                        for c, v in zip(cols, (i, th, x, p, [w[q].strip(EDGE).lower() for q in range(p, p + n) if slot[q]], n, lit), strict=True):
                            c.append(v)
                if len(cols[0]) > 50_000:
                    yield _batch(cols)
                    cols = tuple([] for _ in range(7))
            yield _batch(cols)

    return run


def _batch(cols: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, cuts: Cuts) -> DataFrame:
    """(doc_id, th, item_id, similarity, consistency) for the texts that hold an item: in one place, or in the whole text, SIMILAR of its windows or more with slots filled consistently; or all its words in order as they are, whatever the case.

    A place is what stands at one distance (of the position in the text from that in the item), or at distances that differ by less than the
    item has windows, so that words put in between do not part it; two copies never share one. The best place is given.
    th is the text's hash, so rows that repeat an id with another text are told apart, and rows without an id are found by their texts (their
    doc_id is null). Items without an id, null texts, texts and items without words match nothing; texts of any length are read whole;
    other columns are not read; empty tables give no rows.
    """
    items = cuts.table(bench.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_windows(None, None), FOUND), "items")
    least = items.groupBy("h").agg(F.count("*").alias("n"))
    n = least.count()
    # Collected below its checked bound only.
    only = np.sort(np.array(least.select("h").toArrow().column(0).to_numpy(), np.int64)) if 0 < n <= SENT else None
    sizes = sorted((r["size"], r.literal) for r in items.select("size", "literal").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    found = texts.mapInArrow(_windows(only, sizes), FOUND).select(F.col("id").alias("doc_id"), F.col("th").alias("dth"), "h", F.col("at").alias("dat"), F.col("slots").alias("filled"))
    if not n:
        found = found.limit(0)
    of = items.select("h", F.col("id").alias("item_id"), F.col("th").alias("ith"), "at", "slots", "literal")
    n_of = of.groupBy("item_id", "ith", "literal").agg(F.countDistinct("at").alias("n"))
    met = found.join(of.join(n_of, ["item_id", "ith", "literal"]), "h")
    far, n_ = F.col("dat") - F.col("at"), F.col("n")
    place = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.floor(at).cast("long").alias("at"))
    places = F.when(F.col("literal"), F.array(place(0, far))).otherwise(F.array(place(1, F.lit(0)), place(2, far), place(3, far / n_), place(4, far / n_ + 0.5)))
    fills = F.arrays_zip("slots", "filled")
    by = met.select("doc_id", "dth", "item_id", "ith", "at", "n", "slots", "filled", F.explode(places).alias("place"))
    by = by.groupBy("doc_id", "dth", "item_id", "ith", "place", "n").agg(F.countDistinct("at").alias("held"), F.array_distinct(F.flatten(F.collect_set(fills))).alias("fills"))
    by = by.withColumn("similarity", F.col("held") / F.col("n"))
    asked = F.size(F.array_distinct(F.transform("fills", lambda x: x["slots"])))
    by = by.withColumn("consistency", F.when(F.size("fills") > 0, asked / F.size("fills")).otherwise(1.0))
    enough = F.when(F.col("place.kind") == 0, F.col("held") == F.col("n")).otherwise((F.col("similarity") >= SIMILAR) & (F.col("consistency") >= CONSISTENT))
    best = by.where(enough).groupBy("doc_id", "dth", "item_id", "ith").agg(F.max(F.struct("similarity", "consistency")).alias("best"))
    return best.select("doc_id", F.col("dth").alias("th"), "item_id", "best.similarity", "best.consistency")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contaminated(spark, docs, bench, Cuts(spark))
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("consistency").alias("consistency"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, those without an id included; columns of any names pass through."""
    out = contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Cuts(spark)).select(F.col("doc_id").alias("d"), "th").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("t", F.xxhash64("row.text"))
    clean = row.join(out, F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("t") == F.col("th")), "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
