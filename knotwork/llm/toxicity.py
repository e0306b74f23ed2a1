"""Toxicity: gradient-boosted trees over dense features (lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates) with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import trees
from knotwork.llm.common import Cuts, crc_mod
from knotwork.llm.labels import SAMPLE, labelled

#: Common insults, always part of the lexicon.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum clown worthless pathetic disgusting vermin filth imbecile fool jerk creep "
    "dummkopf abschaum versager widerlich erbärmlich trottel arschloch connard imbécile ordure abruti crétin minable dégoûtant "
    "idiota imbécil estúpido basura asqueroso patético escoria inútil".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
#: Learned entries are words and word beginnings of these lengths; documents that must hold one, its lift, and how many are kept.
BEGIN, SEEN, LIFT, ENTRIES = (4, 5, 6, 7), 4, 6.0, 4000
NEAR = 3
ROUNDS, DEPTH, RATE = 60, 3, 0.2
#: Parts that the rows of the trees are cut into for the calibration, and the share of the trees' own probability in a score.
FOLDS, ORDER = 5, 0.02
FEATURES = 14


def entries(word: str) -> Iterator[str]:
    yield word
    for n in BEGIN:
        if len(word) > n:
            yield word[:n] + "*"


@dataclass
class Lexicon:
    """Weights of learned entries. A word's weight is the largest among its entries."""

    learned: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 200_000:
                self.known.clear()
            w = self.known[word] = max((self.learned.get(e, 0.0) for e in entries(word)), default=0.0)
        return w


def features(text: str | None, lex: Lexicon) -> list[float]:
    """Rates over the whole text; empty texts are all zeros."""
    text = text or ""
    raw = WORD.findall(text)
    low = [w.lower() for w in raw]
    odd = [bool(re.search(r"[\d@$!*]", w)) and any(c.isalpha() for c in w) for w in raw] if re.search(r"[\d@$!*]", text) else [False] * len(raw)
    plain = [w.translate(LEET) if o else w for w, o in zip(low, odd, strict=True)]
    n, c = max(1, len(raw)), max(1, len(text))
    fixed = [k for k, w in enumerate(plain) if w in INSULTS]
    weights = [lex.weight(w) for w in plain]
    hits = sorted({*fixed, *(k for k, w in enumerate(weights) if w > 2)})
    you = [k for k, w in enumerate(low) if w in YOU]
    close = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        side = np.array([-(10**9), *you, 10**9])
        close = int((np.minimum(np.abs(side[at] - hits), np.abs(side[at + 1] - hits)) <= NEAR).sum())
    letters = max(1, sum(map(str.isalpha, text)))
    return [
        len(fixed) / n, float(len(fixed)), len(hits) / n, float(len(hits)), sum(weights) / n, max(weights, default=0.0), close / n, len(you) / n,
        sum(map(str.isupper, text)) / letters, sum(len(w) > 2 and w.isupper() for w in raw) / n, text.count("!") / c, text.count("?") / c,
        sum(not ch.isalnum() and not ch.isspace() for ch in text) / c, sum(odd) / n,
    ]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pos, every = Counter(), Counter()
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = {e for w in set(WORD.findall((text or "").lower())) for e in entries(w.translate(LEET) if not w.isalpha() else w)}
            every.update(own)
            if y:
                pos.update(own)
        key = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array([pos[k] for k in key], pa.int64()), pa.array([every[k] for k in key], pa.int64())], ["entry", "pos", "n"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Entries far more common in toxic documents, with their log lift; at most ENTRIES."""
    total = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    if not total.n or not total.p or total.p == total.n:
        return Lexicon()
    found = sample.select("text", "y").mapInArrow(_counts, "entry string, pos long, n long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    lift = ((F.col("pos") + 0.1) / total.p) / ((F.col("n") - F.col("pos") + 0.5) / (total.n - total.p))
    best = found.where(F.col("pos") >= SEEN).select("entry", F.log(lift).alias("w"), "pos").where(F.col("w") > float(np.log(LIFT)))
    return Lexicon({r.entry: r.w for r in best.orderBy(F.desc(F.col("w") * F.log1p("pos")), "entry").limit(ENTRIES).collect()})


def raw(start: float, grown: list, x: np.ndarray) -> np.ndarray:
    """Log odds of the trees."""
    z = np.full(len(x), start)
    for t in grown:
        z += RATE * trees.value(t, x)
    return z


@dataclass
class Model:
    lexicon: Lexicon
    start: float
    trees: list
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores. Within a step of the calibration, which is flat, a small share of the trees' own probability keeps their order."""
        if not self.trees:
            return np.full(len(x), float(self.knots[1][0]))
        z = raw(self.start, self.trees, x)
        return np.clip((1 - ORDER) * np.interp(z, *self.knots) + ORDER * trees.sigmoid(z), 0, 1)


def _features(lex: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, lex) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, cuts: Cuts, most: int = SAMPLE) -> Model:
    """Fitted on at most `most` labelled rows, none with crc32(doc_id) mod 5 = 0.

    The lexicon comes from one half of them, trees and calibration from the other, so learned entries look no better than they are. For
    the calibration each of FOLDS parts of that half is scored by trees grown on the other parts; the trees that are kept are grown on all.
    Without both labels every score is the share of label 1 (0.5 with no labels).
    """
    sample = cuts.table(labelled(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0, most), "tox-sample")
    half = crc_mod(F.concat(F.lit("half"), F.col("doc_id").cast("string")), 2)
    lex = learn_lexicon(sample.where(half == 0))
    rows = sample.where(half == 1).select("y", "text").mapInArrow(_features(lex), "y double, x array<double>").toArrow().to_pydict()
    y, x = np.array(rows["y"], float), np.array(rows["x"], float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, y))  # the fit must not hang on the order of arrival
    x, y = x[order], y[order]
    if len(set(y)) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return Model(lex, 0.0, [], (np.array([0.0]), np.array([p])))
    start, grown = trees.boost(x, y, ROUNDS, DEPTH, RATE)
    return Model(lex, start, grown, trees.isotonic(out_of_fold(x, y), y))


def out_of_fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's score by trees that have not seen it. Rows of either label are dealt out in turn; where a part's rest has one label only, as with very few rows, the trees of all have to do."""
    fold = np.empty(len(y), int)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    z = np.empty(len(y))
    for k in range(FOLDS):
        out = fold == k
        rest = ~out if len(set(y[~out])) > 1 else np.ones(len(y), bool)
        start, grown = trees.boost(x[rest], y[rest], ROUNDS, DEPTH, RATE)
        z[out] = raw(start, grown, x[out])
    return z


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns doc_id and score, one row for each row, repeated rows and null ids included; null texts count as empty, texts of any length are read whole, an empty table gives no rows, other columns are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, model.lexicon) for t in b.column(1).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(spark, docs, labels, Cuts(spark)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names; null and empty texts stay unless the labels say otherwise, texts of any length are read whole, equal texts fare alike, an empty table gives no rows."""
    model = train(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Cuts(spark))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, model.lexicon) for t in b.column(at).to_pylist()], float).reshape(-1, FEATURES)
            yield b.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(run, docs.schema).select(*names)
