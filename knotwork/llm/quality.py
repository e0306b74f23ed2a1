"""Quality classifier: a sparse rule ensemble. Tree paths over text statistics become conjunctive rules, a lasso logistic fit weighs them, and what is left compiles into one Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import trees
from knotwork.llm.common import Cuts, crc_mod, words
from knotwork.llm.labels import SAMPLE, labelled

ROUNDS, DEPTH, RATE = 24, 3, 0.3
#: Rules offered to the lasso at most, its penalty, rules kept at most by absolute weight, and the least share of rows on either side of a rule.
OFFERED, PENALTY, KEPT, SUPPORT = 160, 0.002, 48, 0.004
STATS = ("n_words", "n_chars", "word_chars", "word_kinds", "symbols", "bars", "digits", "capitals", "stops", "n_lines", "line_kinds", "ends", "commas", "joined")


def statistics(text: Column) -> dict[str, Column]:
    """Numbers over the whole text; of null and empty texts all are 0."""
    t = F.coalesce(text, F.lit(""))
    w, lines = words(t), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n, c = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    rate = lambda pattern, by: F.regexp_count(t, F.lit(pattern)) / by
    return {
        "n_words": F.size(w).cast("double"),
        "n_chars": F.length(t).cast("double"),
        "word_chars": (F.length(t) - F.size(w)) / n,
        "word_kinds": F.size(F.array_distinct(w)) / n,
        "symbols": rate(r"[#$%&*@^~<>{}\\\\=+]", c),
        "bars": rate(r"\|", c),
        "digits": rate(r"[0-9]", c),
        "capitals": rate(r"\p{Lu}", c),
        "stops": rate(r"(?i)\b(?:the|of|and|to|in|is|der|die|das|und|de|la|le|et|les|el|que|en)\b", n),
        "n_lines": F.size(lines).cast("double"),
        "line_kinds": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "ends": rate(r"[.!?]", n),
        "commas": rate(r"[,;:]", n),
        "joined": rate(r"[^\s\p{L}\p{N}]{2,}", n),
    }


@dataclass
class Rules:
    base: float
    rules: list[tuple[tuple, float]]

    def column(self, names: tuple[str, ...] = STATS) -> Column:
        """The score over columns with these names."""
        z = F.lit(self.base)
        for rule, weight in self.rules:
            own = F.lit(True)
            for j, t, above in rule:
                own = own & ((F.col(names[j]) > t) if above else (F.col(names[j]) <= t))
            z = z + F.when(own, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    if len(set(y)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Rules(float(np.log(p / (1 - p))), [])
    _, grown = trees.boost(x, y, ROUNDS, DEPTH, RATE)
    rules: list[tuple] = []
    taken = set()
    for rule in dict.fromkeys(tuple(sorted(r)) for t in grown for r in trees.paths(t)):
        on = trees.holds(rule, x)
        key = min(on.tobytes(), (~on).tobytes())
        if SUPPORT <= on.mean() <= 1 - SUPPORT and key not in taken and len(rules) < OFFERED:
            taken.add(key)
            rules.append(rule)
    if not rules:
        return fit(x, np.full(len(y), y.mean()))
    on = np.stack([trees.holds(r, x) for r in rules], axis=1).astype(float)
    _, w = trees.lasso_logistic(on, y, PENALTY)
    best = sorted(np.flatnonzero(w), key=lambda k: -abs(w[k]))[:KEPT]
    base, again = trees.lasso_logistic(on[:, best], y, PENALTY / 20)
    return Rules(base, [(rules[k], float(v)) for k, v in zip(best, again, strict=True) if v])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, cuts: Cuts, most: int = SAMPLE) -> Rules:
    """Fitted on at most `most` labelled rows, none with crc32(doc_id) mod 4 = 2. Without both labels the score is the share of label 1 (0.5 with no labels)."""
    sample = labelled(docs, labels, "quality", crc_mod(F.col("doc_id"), 4) != 2, most)
    rows = sample.select(F.col("y"), *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toPandas().to_numpy(float)
    rows = rows[np.lexsort(rows.T)]
    return fit(rows[:, 1:], rows[:, 0])


def score(docs: DataFrame, rules: Rules, *more: Column) -> DataFrame:
    """doc_id, what `more` names, and score, one row for each row of docs, repeated rows and null ids included. Null and empty texts have statistics of 0, texts of any length are read whole, an empty table gives no rows, other columns are not read."""
    stats = docs.select("doc_id", *more, *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    return stats.withColumn("score", rules.column()).drop(*STATS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    out = score(docs, train(spark, docs, labels, Cuts(spark)), held)
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
