"""Language model scoring: hashed maximum entropy over n-gram and skip features with a class-factored softmax, trained by gradients that Spark sums, scored in numpy batches.

Tokens are coded once against the frequent words of the corpus, whose number is bounded; all other words are one class, within which a
word's probability is its share of counts, joined by shuffle. P(word | context) = P(class | context) P(word | class, context): classes of
frequent words have a softmax of their own, those of less frequent ones the shares of their words. A decision's logits are a bias (log
shares) and one row of weights for each of its features, found by hashing the feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Cuts, crc_mod

#: Words with a code at most, and their bytes at most: the bound of what is broadcast. Other words are joined by shuffle.
VOCABULARY, LONGEST = 1 << 18, 64
#: Outcomes of a softmax; classes of frequent words, of as many words at most.
WIDTH, HEADS = 32, 16
#: Classes that are not words' own: the end of a text, and words without a code.
END, RARE = 0, 1
FIRST = 2 + HEADS
#: Kinds of documents that tell words apart (halvings of all that make them), the words they are known by, and rounds over all documents that find them at most; they end when one lessens the squared distances by a smaller share than STILL.
HALVINGS, KNOWN_BY, LLOYD, STILL = 3, 256, 20, 1e-4
#: Words that are features themselves; of others the class is.
FEATURES = 8192
BEGIN = FEATURES + WIDTH
#: Features of a decision, as places before the token: of classes (bigram, two skips, trigram) and of words within a class.
OF_CLASS, OF_WORD = ((1,), (2,), (3,), (1, 2)), ((1,), (2,))
#: Rows of weights (their logarithm), rows summed together, rounds of gradients (each over another part of the documents), step and shrinkage.
BITS, TOGETHER, ROUNDS, STEP, SHRINK = 16, 64, 4, 0.8, 4.0
#: Bytes of texts, tokens that are taken at once.
BYTES, CHUNK = 1 << 24, 1 << 15
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BYTES of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, side="right")))
        yield a, b
        a = b


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = np.r_[0, np.cumsum(full)]
    at = offsets - offsets[0]
    return (flat if full.all() else flat.filter(pa.array(full))), seen[at[1:]] - seen[at[:-1]]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, texts = [], 0

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return t.rename_columns({"n_sum": "n"}).select(["word", "n"])

    for b in batches:
        text = b.column(0)
        texts += len(text)
        for i, j in slices(text):
            vc = tokens(text.slice(i, j - i))[0].value_counts()
            held.append(pa.table({"word": vc.field(0).cast(pa.string()), "n": vc.field(1)}))
            if sum(map(len, held)) > 2_000_000:
                held = [merged()]
                if len(held[0]) > 1_000_000:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([texts], pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs; the null word is the end, once a text."""
    return docs.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


def _bin(c: Column) -> Column:
    """A number that rises with c, of a few thousand values."""
    return F.when(c < 1024, c).otherwise(F.lit(1024) + F.floor(F.log2(c / 1024) * 64)).cast("long")


@dataclass
class Vocabulary:
    """Codes: 0 is the end, then words by count, then all others. counts: of the codes but the last; rest: counts and number of other words."""

    words: pa.Array
    counts: np.ndarray
    rest: tuple[int, int]

    @property
    def other(self) -> int:
        return len(self.counts)

    @property
    def tokens(self) -> int:
        return int(self.counts.sum()) + self.rest[0]

    @property
    def types(self) -> int:
        return int((self.counts > 0).sum()) + self.rest[1]


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The most frequent words, as many as fit whole steps of _bin, and the counts of the others."""
    short = F.octet_length("word") <= LONGEST
    hist = sorted(((r.b, r.n) for r in counts.where(short).groupBy(_bin(F.col("c")).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 0
    for b, more in hist:
        if n + more > VOCABULARY:
            break
        least, n = b, n + more
    coded = F.coalesce(short & (_bin(F.col("c")) >= least), F.lit(False)) if least is not None else F.lit(False)
    words = counts.where(coded).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    others = counts.where(F.col("word").isNotNull() & ~coded)
    ends = counts.where("word is null").agg(F.sum("c")).first()[0] or 0
    rest = others.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    column = words.column("word")
    return Vocabulary(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, np.r_[ends, words.column("c").to_numpy()].astype(np.int64), (rest.c or 0, rest.n)), others


CODED = "row long, doc_id long, held_out boolean, part int, ids array<int>, rare array<struct<word:string,n:int>>"


def _coder(vocab):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        for b in batches:
            for i, j in slices(b.column(4)):
                flat, size = tokens(b.column(4).slice(i, j - i))
                code = pc.index_in(flat, v.words).fill_null(v.other - 1).to_numpy().astype(np.int32) + np.int32(1)
                doc = np.repeat(np.arange(j - i), size)
                ends = np.cumsum(size + 1) - 1
                ids = np.empty(len(code) + j - i, np.int32)
                inner = np.ones(len(ids), bool)
                inner[ends] = False
                ids[ends], ids[inner] = END, code
                odd = np.flatnonzero(code == v.other)
                words = flat.take(pa.array(odd)).dictionary_encode()
                key, n = np.unique(doc[odd] * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
                whose, which = np.divmod(key, max(1, len(words.dictionary)))
                rare = pa.StructArray.from_arrays([words.dictionary.take(pa.array(which)), pa.array(n, pa.int32())], ["word", "n"])
                bounds = lambda x: pa.array(np.r_[0, np.cumsum(x)], pa.int32())
                lists = [pa.ListArray.from_arrays(bounds(size + 1), pa.array(ids)), pa.ListArray.from_arrays(bounds(np.bincount(whose, minlength=j - i)), rare)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(4)), *lists], [c.split()[0] for c in CODED.split(", ")])

    return run


def _tallies(out: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (block, task, payload) of arrays by block."""
    task = TaskContext.get().partitionId()
    for lot in (list(out)[k : k + 64] for k in range(0, len(out), 64)):
        yield pa.RecordBatch.from_arrays([pa.array(lot, pa.int32()), pa.array([task] * len(lot), pa.int32()), pa.array([out[k].tobytes() for k in lot], pa.binary())], ["block", "task", "payload"])


TALLY = "block int, task int, payload binary"


def _summed(kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], ["block", "task", "payload"])

        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer(payload.as_buffer(), kind)
                if block == now:
                    total = total + x
                else:
                    if total is not None:
                        yield row()
                    now, total = block, x.astype(np.int64 if kind == "i4" else np.float64)
        if total is not None:
            yield row()

    return run


def gathered(tallies: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of the tallies of all tasks by block, in the order of tasks, on the driver; they are as large as one task's."""
    summed = tallies.repartition("block").sortWithinPartitions("block", "task").mapInArrow(_summed(kind), TALLY)
    return {r.block: np.frombuffer(r.payload, kind) for r in summed.collect()}


def _vectors(ids: pa.ListArray) -> np.ndarray:
    """Square roots of the shares of the most frequent words in each text."""
    size = np.diff(ids.offsets.to_numpy())
    flat, doc = ids.flatten().to_numpy(), np.repeat(np.arange(len(ids)), size)
    few = (flat > END) & (flat <= KNOWN_BY)
    x = np.bincount(doc[few] * KNOWN_BY + flat[few] - 1, minlength=len(ids) * KNOWN_BY).reshape(len(ids), KNOWN_BY)
    return np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))


def _known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _vectors(b.column(0)).astype(np.float32)], pa.binary())], ["x"])


def _read(b: pa.RecordBatch) -> np.ndarray:
    x = b.column(0)  # rows of one length after one another
    if not len(x):
        return np.zeros((0, KNOWN_BY), np.float32)
    return np.frombuffer(x.buffers()[2], np.float32).reshape(-1, KNOWN_BY)[x.offset : x.offset + len(x)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None].astype(x.dtype) - x @ (2 * centres.T).astype(x.dtype)).argmin(1)


def _members(centres: np.ndarray, products: bool):
    """Numbers and sums of the vectors that are nearest to each centre, and sums of their products, or of their squared lengths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), KNOWN_BY + 1 if products else 1, KNOWN_BY + 1 if products else KNOWN_BY + 2))
        for b in batches:
            x = _read(b)
            near = _nearest(x, centres)
            for k in np.unique(near):
                own = x[near == k]
                if products:
                    own = np.c_[np.ones(len(own), np.float32), own]
                    total[k] += own.T @ own
                else:
                    total[k, 0] += np.r_[len(own), own.sum(0, np.float64), np.vdot(own, own)]
        yield from _tallies({k * total.shape[1] + j: x for k in np.flatnonzero(total[:, 0, 0]).tolist() for j, x in enumerate(total[k])})

    return run


def _split(sums: np.ndarray) -> list[np.ndarray]:
    """Two centres on either side of a group's mean, along the direction in which it is widest."""
    mean = sums[0, 1:] / sums[0, 0]
    wide, along = np.linalg.eigh(sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean))
    off = np.sqrt(max(0.0, wide[-1])) * along[:, -1] * (-1 if along[np.abs(along[:, -1]).argmax(), -1] < 0 else 1)
    return [mean - off, mean + off]


def kinds(vectors: DataFrame) -> np.ndarray:
    """Centres of groups of all rows of vectors: k-means from groups that are split HALVINGS times. The driver holds sums only."""
    centres, before = np.zeros((1, KNOWN_BY)), np.inf
    for _ in range(HALVINGS):
        found = gathered(vectors.mapInArrow(_members(centres, True), TALLY), "f8")
        if not found:
            return centres
        centres = np.stack([c for x in np.stack([found[k] for k in sorted(found)]).reshape(-1, KNOWN_BY + 1, KNOWN_BY + 1) for c in _split(x)])
    for _ in range(LLOYD):
        found = gathered(vectors.mapInArrow(_members(centres, False), TALLY), "f8")
        sums = np.stack([found[k] for k in sorted(found)])
        centres = sums[:, 1:-1] / sums[:, :1]
        apart = sums[:, -1].sum() - (sums[:, 0] * (centres**2).sum(1)).sum()
        if apart >= before * (1 - STILL):
            break
        before = apart
    return centres


#: Codes whose counts by kind are summed together.
CODES = 1024


def _kind_counts(centres: np.ndarray, codes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-codes // CODES) * CODES * len(centres), np.int32)
        for b in batches:
            ids = b.column(0)
            near = _nearest(_vectors(ids), centres)
            np.add.at(total, ids.flatten().to_numpy().astype(np.int64) * len(centres) + np.repeat(near, np.diff(ids.offsets.to_numpy())), np.int32(1))
        yield from _tallies({k: x for k, x in enumerate(total.reshape(-1, CODES * len(centres))) if x.any()})

    return run


@dataclass
class Model:
    """kind: class of each code; slot: its outcome within a class of frequent words, or -1; share: log share of its class, where it has no softmax; biases of classes and, for each class of frequent words, of its outcomes; weights by row."""

    kind: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    of_class: np.ndarray
    of_word: np.ndarray
    feature: np.ndarray
    weights: np.ndarray


def classed(v: Vocabulary, by_kind: np.ndarray) -> Model:
    """Classes: the most frequent words by the kind of documents they are commonest in, WIDTH a class; other words by kind, kinds of the largest share cut by frequency."""
    n, top = v.other, HEADS * WIDTH
    lift = (by_kind[:n] + 0.1 * by_kind.sum(0) / max(1, by_kind.sum())) / np.maximum(by_kind.sum(0), 1)
    of = lift.argmax(1)
    kind, slot = np.full(n + 1, RARE), np.full(n + 1, -1)
    kind[END] = END
    frequent = np.arange(1, min(n, top + 1))
    frequent = frequent[np.argsort(of[frequent], kind="stable")]
    kind[frequent], slot[frequent] = 2 + np.arange(len(frequent)) // WIDTH, np.arange(len(frequent)) % WIDTH
    rest = np.arange(top + 1, n)
    mass = np.array([(v.counts[rest[of[rest] == k]] + 1).sum() for k in range(by_kind.shape[1])])
    bands = (mass > 0).astype(int)
    for _ in range(WIDTH - FIRST - int(bands.sum())):
        bands[(mass / np.maximum(bands, 1)).argmax()] += mass.sum() > 0
    at = FIRST
    for k, cuts in enumerate(bands):
        own = rest[of[rest] == k]  # by falling count
        if len(own):
            kind[own] = at + np.minimum((np.cumsum(v.counts[own] + 1) - 1) * cuts // mass[k], cuts - 1)
            at += cuts
    weight = np.r_[v.counts + 1, v.rest[0] + v.rest[1] + 1].astype(float)
    total = np.bincount(kind, weight, WIDTH)
    of_word = np.full((HEADS, WIDTH), -np.inf)
    of_word[kind[frequent] - 2, slot[frequent]] = np.log(weight[frequent] / total[kind[frequent]])
    share = np.where(slot < 0, np.log(weight / total[kind]), 0.0)
    share[n] = -np.log(weight[n])  # a rare word's own count is added by its join
    feature = np.where(np.arange(n + 1) < min(FEATURES, n), np.arange(n + 1), FEATURES + kind)
    with np.errstate(divide="ignore"):
        of_class = np.log(total / total.sum())
    return Model(kind, slot, share, of_class.astype(np.float32), of_word.astype(np.float32), feature, np.zeros((1 << BITS, WIDTH), np.float32))


def _rows(before: list[np.ndarray], templates: tuple, key: np.ndarray | int) -> list[np.ndarray]:
    """Rows of weights of each template's feature; key: 0 for classes, 1 and more for the words of a class."""
    out = []
    base = np.asarray(key, np.uint64) * _ODD[3]
    for t, places in enumerate(templates):
        h = base + np.uint64(t + 1) * _ODD[2]
        for p, odd in zip(places, _ODD, strict=False):
            h = (h ^ (before[p - 1] + np.uint64(1))) * odd
            h ^= h >> np.uint64(29)
        out.append(((h * _ODD[4]) >> np.uint64(64 - BITS)).astype(np.uint16 if BITS <= 16 else np.int64))
    return out


def _decisions(m: Model, ids: pa.ListArray) -> Iterator[tuple]:
    """For chunks of tokens: where they are, their codes, and twice (places in the chunk, rows of weights, biases, outcomes)."""
    offsets = ids.offsets.to_numpy()
    flat = ids.flatten().to_numpy()
    starts = (offsets[:-1] - offsets[0]).astype(np.int64)
    f = m.feature[flat].astype(np.uint64)
    before = []
    for back in (1, 2, 3):
        x = np.r_[np.full(min(back, len(f)), BEGIN, np.uint64), f[: max(0, len(f) - back)]]
        for k in range(back):
            at = starts + k
            x[at[at < np.r_[starts[1:], len(f)]]] = BEGIN
        before.append(x)
    kind, slot = m.kind[flat], m.slot[flat]
    for a in range(0, len(flat), CHUNK):
        b = min(len(flat), a + CHUNK)
        part = [x[a:b] for x in before]
        heads = np.flatnonzero(slot[a:b] >= 0)
        word = kind[a:b][heads] - 2
        yield a, flat[a:b], (None, _rows(part, OF_CLASS, 0), m.of_class, kind[a:b]), (heads, _rows([x[heads] for x in part], OF_WORD, word + 1), m.of_word[word], slot[a:b][heads])


def _softmax(m: Model, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits less their largest, their exponentials and the sums of these."""
    z = m.weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += m.weights.take(r, axis=0)
    z += bias
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return z, e, e.sum(1)


def _gradients(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        seen, expected = np.zeros(m.weights.size, np.float32), np.zeros(m.weights.shape, np.float32)
        for b in batches:
            for _, _, *both in _decisions(m, b.column(0)):
                for _, rows, bias, y in both:
                    if not len(y):
                        continue
                    _, p, total = _softmax(m, rows, bias)
                    p /= total[:, None]
                    for r in rows:
                        np.add.at(seen, r.astype(np.int64) * WIDTH + y, np.float32(1))
                        order = np.argsort(r, kind="stable")
                        k = r[order]
                        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                        expected[k[start]] += np.add.reduceat(p.take(order, axis=0), start, axis=0)
        both = np.stack([seen.reshape(-1, TOGETHER * WIDTH), expected.reshape(-1, TOGETHER * WIDTH)], axis=1)
        yield from _tallies({k: x for k, x in enumerate(both) if x.any()})

    return run


def train(coded: DataFrame, cuts: Cuts, v: Vocabulary) -> Model:
    """coded: rows with their part, null where they are not to be learned from. Every such row counts for the kinds, the classes and in one round of gradients."""
    spark = coded.sparkSession
    learn = coded.where("part is not null")
    codes = v.other + 1
    centres = kinds(cuts.table(learn.select("ids").mapInArrow(_known, "x binary"), "lm-known", "zstd"))
    cuts.drop("lm-known")
    by_kind = np.zeros((-(-codes // CODES) * CODES, len(centres)))
    for block, x in gathered(learn.select("ids").mapInArrow(_kind_counts(centres, codes), TALLY), "i4").items():
        by_kind[block * CODES : (block + 1) * CODES] = x.reshape(CODES, -1)
    m = classed(v, by_kind[:codes])
    for part in range(ROUNDS):
        sent = spark.sparkContext.broadcast(m)
        seen, expected = np.zeros_like(m.weights), np.zeros_like(m.weights)
        for block, x in gathered(coded.where(F.col("part") == part).select("ids").mapInArrow(_gradients(sent), TALLY), "f4").items():
            at = slice(block * TOGETHER, (block + 1) * TOGETHER)
            seen[at], expected[at] = x.reshape(2, TOGETHER, WIDTH)
        sent.unpersist()
        # The gradient over a bound of its curvature: a step is never longer than STEP.
        m.weights += np.float32(STEP) * (seen - expected) / (seen + expected + np.float32(SHRINK))
    return m


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_rare long, base double, model double"


def _scorer(model, vocab):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = model.value, vocab.value
        log_count = np.r_[np.log10(v.counts + 1), 0.0]
        for b in batches:
            ids = b.column(3)
            size = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(size) - size
            got = np.empty(int(size.sum()))
            base, rare = np.empty_like(got), np.empty(len(got), np.int64)
            for a, code, (_, rows, bias, y), (heads, rows2, bias2, y2) in _decisions(m, ids):
                at = slice(a, a + len(code))
                z, _, total = _softmax(m, rows, bias)
                got[at] = z[np.arange(len(y)), y] - np.log(total) + m.share[code]
                if len(heads):
                    z, _, total = _softmax(m, rows2, bias2)
                    got[a + heads] += z[np.arange(len(y2)), y2] - np.log(total)
                base[at], rare[at] = log_count[code], code == v.other
            sums = [np.add.reduceat(x, start) if len(b) else x for x in (rare, base, got / np.log(10))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(size), *map(pa.array, sums)], [c.split()[0] for c in SCORED.split(", ")])

    return run


def scores(docs: DataFrame, learn: Column, held_out: Column, cuts: Cuts) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from the rows where `learn` (of doc_id) is true.

    Null texts are empty and have the end as their one token; texts of any length are scored whole; repeated rows and null ids are rows of
    their own (a null id is neither learned from nor held out unless the columns say so). An empty table gives no rows; where nothing is
    learned from, no token is known. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = cuts.table(word_counts(docs.where(learn)), "lm-counts")
    v, others = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(v)
    part = F.when(learn, F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(ROUNDS)).cast("int"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), part.alias("part"), "text")
    cuts.partitioned(rows.mapInArrow(_coder(vocab), CODED), "lm-coded", "part", "zstd")
    coded = cuts.read(spark.createDataFrame([], CODED), "lm-coded")
    model = spark.sparkContext.broadcast(train(coded, cuts, v))
    out = coded.select("row", "doc_id", "held_out", "ids").mapInArrow(_scorer(model, vocab), SCORED)
    # Of words without a code: their counts, by shuffle; a text's repeats of one were summed when it was coded.
    rare = coded.select("row", F.inline("rare")).join(others, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    out = out.join(rare, "row", "left")
    more = F.coalesce("rare", F.lit(0.0))
    known = F.col("n_tokens") - F.col("n_rare") - (0 if v.counts[END] else 1) + F.coalesce("rare_known", F.lit(0))
    base = F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + more).alias("score"))


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = crc_mod(F.col("doc_id"), 7)
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), mod != 2, mod == 2, Cuts(spark))
