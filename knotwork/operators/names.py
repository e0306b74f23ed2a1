"""Many names in many texts: an automaton of all names where they are few enough to be sent, and beyond that the rarest piece of each name, joined by hash."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.durable import Cuts

#: Characters of all names that are sent to the executors at most; an automaton takes some 100 bytes for each.
SENT_CHARS = 1 << 20
#: Characters of a piece; shorter names are their own piece.
PIECE = 6
#: Tasks of a worker share the automaton that was built last.
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(token: str, names: list[str]) -> ahocorasick.Automaton:
    if token not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for k, name in enumerate(names):
            a.add_word(name, k)
        a.make_automaton()
        _built[token] = a
    return _built[token]


def _found(token: str, sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        a = _automaton(token, names)
        for b in batches:
            hits = [sorted({k for _, k in a.iter(t)}) if t else [] for t in b.column(1).to_pylist()]
            which = pa.array([k for k, h in enumerate(hits) for _ in h], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array([names[k] for h in hits for k in h], pa.string())], ["key", "name"])

    return run


def by_automaton(texts: DataFrame, names: list[str]) -> DataFrame:
    """(key, name): every text is read once, whatever the number of names, and overlapping names are all found."""
    if not names:
        return texts.select("key", F.lit(None).cast("string").alias("name")).where(F.lit(False))
    sent = texts.sparkSession.sparkContext.broadcast(names)
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(_found(uuid.uuid4().hex, sent), f"key {kind}, name string")


def pieces(text: Column, size: int) -> Column:
    """Distinct runs of so many characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def by_rarest_piece(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name) by joins only: a name is sought where its piece of the fewest texts occurs, and confirmed there.

    Pieces of texts that no name has are dropped by a join by hash before they are counted. A confirmed pair costs one row, and so does a
    text that has a name's rarest piece but not the name. Texts are dealt by row, so one of many names is split where it is skewed.
    """
    cuts = Cuts(texts.sparkSession)
    rows = cuts.table(texts.select("key", "text").where("text is not null").withColumn("row", F.monotonically_increasing_id()), "texts")
    names = cuts.table(names, "names")
    size = F.least(F.length("name"), F.lit(PIECE))
    own = cuts.table(names.select("name", F.explode(F.when(F.length("name") <= PIECE, F.array("name")).otherwise(pieces(F.col("name"), PIECE))).alias("piece")), "pieces")
    sizes = sorted(r.n for r in names.select(size.alias("n")).distinct().collect())  # PIECE of them at most
    if not sizes:
        return rows.select("key", F.lit(None).cast("string").alias("name")).where(F.lit(False))
    of_text = rows.select("row", F.explode(F.concat(*(pieces(F.col("text"), n) for n in sizes))).alias("piece"))
    met = cuts.table(of_text.join(own.select("piece").distinct(), "piece", "left_semi"), "met")
    spread = met.groupBy("piece").agg(F.count("*").alias("n"))
    # A name with a piece that no text has occurs nowhere.
    rarest = own.join(spread, "piece", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0").select("name", F.col("r.piece").alias("piece"))
    sought = met.join(rarest, "piece").select("row", "name")
    return sought.join(rows, "row").where(F.contains("text", F.col("name"))).select("key", "name")


def containing(texts: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(key, name) for every row of texts (key, text) and every distinct name (name) that occurs in it, case counted, within words too.

    Null texts and null names meet nothing; the empty name is in every text. Repeated rows of texts are rows of their own. Names are sent
    to the executors as an automaton while they have at most `most` characters in all (SENT_CHARS); beyond that both sides are joined.
    """
    cuts = Cuts(texts.sparkSession)
    names = cuts.table(names.select("name").where("name is not null").distinct(), "distinct")
    size = names.agg(F.sum(F.length("name")).alias("chars"), F.count_if(F.col("name") == "").alias("bare")).first()
    some = names.where("name <> ''")
    if (size.chars or 0) <= (SENT_CHARS if most is None else most):
        found = by_automaton(texts, sorted(r.name for r in some.collect()))
    else:
        found = by_rarest_piece(texts, some)
    return found.unionByName(texts.where("text is not null").select("key", F.lit("").alias("name"))) if size.bare else found

