"""Markdown documents as headings and statements of rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import classify as C
from knotwork.functions import text as T

#: Least and most characters of a statement, and deepest level of a heading.
LEAST, MOST, DEEPEST = 16, 400, 6


def _outside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, text) of the lines outside fenced blocks. A fence is closed by its own kind only."""
    for b in batches:
        keys, lines, texts = [], [], []
        for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fence = None
            for k, raw in enumerate((content or "").split("\n"), 1):
                bare = raw.lstrip()
                if bare[:3] in ("```", "~~~"):
                    fence = bare[:3] if fence is None else None if bare[:3] == fence else fence
                elif fence is None:
                    keys.append(key), lines.append(k), texts.append(raw)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.int64()), pa.array(texts, pa.string())], ["key", "line", "raw"])


def lines_of(docs: DataFrame) -> DataFrame:
    """(key, line, raw) of (key, content), without fenced blocks. The state of the fence is what columns cannot carry; all else is columns."""
    return docs.select("key", "content").mapInArrow(_outside, "key string, line long, raw string")


def headings(lines: DataFrame) -> DataFrame:
    """(key, line, level, title, parent): parent is the line of the nearest heading before of a lower level."""
    h = r"^(#{1,6})\s+(.+?)\s*$"
    found = lines.where(F.col("raw").rlike(h)).select("key", "line", F.length(F.regexp_extract("raw", h, 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract("raw", h, 2), "[`*_]", "")).alias("title"))
    return with_parent(found, "line")


def with_parent(found: DataFrame, order: str) -> DataFrame:
    """found (key, level, ...) with parent: the place of the nearest row before of a lower level."""
    w = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") <= k, F.col(order)), True).over(w) for k in range(1, DEEPEST)]
    return found.withColumn("parent", T.first_match([(F.col("level") == k + 1, above[k - 1]) for k in range(1, DEEPEST)], F.lit(None).cast("long")))


def statements(lines: DataFrame, markers: tuple = C.MARKERS) -> DataFrame:
    """(key, line, text, form, modality, marker, heading): lines outside headings that state a rule, in prose, bullets or table rows; heading is the line of the heading they stand under."""
    h = r"^#{1,6}\s+.+?\s*$"
    at = F.last(F.when(F.col("raw").rlike(h), F.col("line")), True).over(Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    t = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    rows = lines.withColumn("heading", at).where(~F.col("raw").rlike(h)).withColumn("t", t)
    rows = rows.where((F.col("t") != "") & ~F.col("t").startswith("<!--") & ~F.col("t").startswith("---") & ~F.col("t").rlike(r"^\|[\s:|-]+\|?$"))
    bullet = r"^(?:[-*+]|\d+[.)])\s+"
    cells = F.filter(F.transform(F.split(F.regexp_replace("t", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = rows.withColumn("form", F.when(F.col("t").startswith("|"), "table").when(F.col("t").rlike(bullet), "bullet").otherwise("prose"))
    text = F.when(F.col("form") == "table", F.array_join(cells, " · ")).when(F.col("form") == "bullet", F.trim(F.regexp_replace("t", bullet, ""))).otherwise(F.col("t"))
    rows = rows.withColumn("text", text).where(F.length("text").between(LEAST, MOST)).withColumn("m", C.modality(F.col("text"), markers))
    return rows.where("m is not null").select("key", "line", "text", "form", "m.modality", "m.marker", "heading")


def once(rules: DataFrame) -> DataFrame:
    """rules with seq, repeats and repeated_at: a statement that a document makes again, whatever its case and white space, counts once, at its first line; seq numbers what is kept."""
    same = F.lower(F.regexp_replace("text", r"\s+", " "))
    w = Window.partitionBy("key", "_same")
    rows = rules.withColumn("_same", same).withColumn("_k", F.row_number().over(w.orderBy("line")))
    rows = rows.withColumn("repeats", F.count("*").over(w)).withColumn("repeated_at", F.array_sort(F.collect_list(F.when(F.col("_k") > 1, F.col("line"))).over(w)))
    kept = rows.where("_k = 1").drop("_same", "_k")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("line")))
