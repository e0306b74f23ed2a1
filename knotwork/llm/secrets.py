"""Secret scans: a random forest, trained from labelled findings and compiled into Spark columns, removes false positives among candidate strings. DataFrame functions only on the main path."""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import trees
from knotwork.llm.common import words

#: Characters that a candidate has at least, labelled findings that are made, trees and their depth.
LEAST, FINDINGS, TREES, DEPTH = 16, 4000, 12, 5
CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}"
#: Words that go with secrets and with other identifiers, and pieces of ordinary words.
GOES = "token|secret|passw|pwd|api.?key|access.?key|private|auth|bearer|credential|client.?key|aws"
OTHER = "sha|commit|hash|checksum|digest|md5|uuid|guid|revision|build|etag|integrity|href|src|path|file|http"
#: Pieces that made-up ordinary words in the findings consist of.
PIECES = "tion|ing|the|and|ment|able|ver|sch|ung|keit|lich|ent|eur|que|ción|ado|ien|ter|con|pro|data|file|name|test|user|home|lib|src|bin|index|main|list|value|get|set|er|re|in|on|an|th"
FEATURES = ("length", "digits", "upper", "marks", "hex", "kinds", "changes", "covered", "slashes", "path", "goes", "other", "assigned")


#: A public vocabulary whose entries of so many small letters are the dictionary, and how many of them are taken at most, the most common first.
VOCABULARY, LETTERS, WORDS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 4, 20_000


def trie(words: list[str]) -> str:
    """A regular expression for any of the words, the longest that fits, without trying each of them."""
    first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            first.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + trie(rest) for c, rest in first.items()]
    if not parts:
        return ""
    body = "|".join(parts)
    return f"(?:{body})?" if "" in words else f"(?:{body})" if len(parts) > 1 else body


@functools.cache
def dictionary(path: str = VOCABULARY) -> str:
    """Pattern of the dictionary's words. The file is read by the driver; its lines are an entry in base 64 and its rank."""
    import base64

    found = []
    with open(path, "rb") as f:
        for line in f:
            w = base64.b64decode(line.split()[0]).strip()
            if len(w) >= LETTERS and w.isalpha() and w.islower() and len(found) < WORDS:
                found.append(w.decode())
    return trie(found)


def statistics(c: Column, before: Column, word: Column, vocabulary: str = VOCABULARY) -> dict[str, Column]:
    n = F.greatest(F.length(c), F.lit(1))
    rate = lambda p: F.regexp_count(c, F.lit(p)) / n
    near = F.concat_ws(" ", before, word)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "length": F.length(c).cast("double"), "digits": rate("[0-9]"), "upper": rate("(?<!^)[A-Z]"), "marks": rate(r"[+/_=\-]"), "hex": flag(c.rlike("^[0-9a-f]+$")),
        "kinds": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)), "changes": rate("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "covered": F.lit(1.0) - F.length(F.regexp_replace(F.lower(c), dictionary(vocabulary), "")) / n, "slashes": rate("/"), "path": flag(word.rlike(r"^\.{0,2}/|://|\.[a-z]{2,4}$")),
        "goes": flag(near.rlike(f"(?i){GOES}")), "other": flag(near.rlike(f"(?i){OTHER}")), "assigned": flag(near.rlike("[=:]")),
    }


def labelled_findings(count: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, float]]:
    """(candidate, words before, word, label) by rule: keys of usual shapes behind a name or alone, against hashes, ids, paths and long words."""
    r, out = random.Random(seed), []
    of = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    hexes, every, bits = "0123456789abcdef", string.ascii_letters + string.digits, PIECES.split("|")
    names = ["token", "secret", "api_key", "password", "auth_token", "access_key", "private_key", "client_key", "aws_secret"]
    others = ["commit", "sha", "checksum", "md5", "uuid", "revision", "build", "file", "path", "hash"]
    for k in range(count):
        good = k % 2 == 0
        if good:
            c = r.choice([lambda: of(hexes, r.choice([32, 40, 64])), lambda: of(every, r.randint(20, 64)), lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + of(every, 36), lambda: "sk-" + of(every, 40), lambda: of(every + "+/", 40)])()
            shaped = c.startswith(("AKIA", "ghp_", "sk-"))
            before = f"{r.choice(names)} {r.choice('=:')}" if not shaped or r.random() < 0.7 else r.choice(bits) + " " + r.choice(bits)
        else:
            c = r.choice([lambda: of(hexes, r.choice([32, 40, 64])), lambda: "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: "/".join("".join(r.choices(bits, k=2)) for _ in range(5)), lambda: "".join(r.choices(bits, k=r.randint(6, 12))), lambda: "".join(r.choices(bits, k=r.randint(6, 12))).capitalize(), lambda: "".join(w.capitalize() for w in r.choices(bits, k=6)), lambda: of(string.digits, r.randint(16, 24)), lambda: "_".join(r.choices(bits, k=6))])()
            wordy = not set(c) <= set(hexes + "-")
            before = f"{r.choice(names)} =" if wordy and r.random() < 0.2 else f"{r.choice(others)} {r.choice(['=', ':', ''])}" if r.random() < 0.6 else r.choice(bits) + " " + r.choice(bits)
        c = c if len(c) >= LEAST else c * 2
        out.append((c, before, f'"{c}"' if r.random() < 0.6 else c, float(good)))
    return out


def column(node: trees.Node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    j, t, low, high = node
    return F.when(F.col(FEATURES[j]) <= t, column(low)).otherwise(column(high))


def findings_table(spark: SparkSession, findings: DataFrame | list | None = None, most: int = 40_000) -> DataFrame:
    """(c, before, word, y): candidate, words before it, word that holds it, label. A table of labelled findings with these columns, of which at most `most` by hash count, or a list, or those made by rule."""
    if isinstance(findings, DataFrame):
        own = findings.select("c", "before", "word", F.col("y").cast("double").alias("y")).where("c is not null and y is not null")
        return own.orderBy(F.xxhash64("c", "before", "word"), "c", "before", "word", "y").limit(most)
    return spark.createDataFrame(findings or labelled_findings(), "c string, before string, word string, y double")


def train(spark: SparkSession, findings: DataFrame | list | None = None) -> Column:
    """The forest's score over FEATURES."""
    df = findings_table(spark, findings)
    x = df.select("y", *[v.alias(k) for k, v in statistics(F.col("c"), F.col("before"), F.col("word")).items()]).toPandas().to_numpy(float)
    x = x[np.lexsort(x.T)]
    grown = trees.forest(x[:, 1:], x[:, 0], TREES, DEPTH)
    return sum((column(t) for t in grown), F.lit(0.0)) / len(grown)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, candidate, before, word): at is the number of the word that holds the candidate."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CANDIDATE))
    w = text.select("doc_id", words(F.col("text")).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(F.get("w", i)) >= LEAST)
    own = F.transform(at, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before")))
    rows = w.select("doc_id", F.explode(own).alias("o")).where(F.col("o.word").rlike(CANDIDATE))
    return rows.select("doc_id", "o.at", F.explode(F.array_distinct(F.regexp_extract_all("o.word", F.lit(CANDIDATE), F.lit(0)))).alias("candidate"), "o.before", "o.word")


def held_out(spark: SparkSession, learn: DataFrame | list, test: DataFrame | list) -> tuple[float, float]:
    """(precision, recall) at a score of 0.5 on findings that the forest has not seen."""
    df = findings_table(spark, test)
    rows = df.select("y", *[v.alias(k) for k, v in statistics(F.col("c"), F.col("before"), F.col("word")).items()]).withColumn("score", train(spark, learn))
    hit = rows.agg(F.count_if((F.col("score") >= 0.5) & (F.col("y") == 1)).alias("both"), F.count_if(F.col("score") >= 0.5).alias("said"), F.count_if(F.col("y") == 1).alias("true")).first()
    return hit.both / max(1, hit.said), hit.both / max(1, hit.true)


def scan(spark: SparkSession, docs: DataFrame, findings: DataFrame | list | None = None) -> DataFrame:
    """(doc_id, at, candidate, score) of every candidate, of LEAST characters or more, with a score of 0.5 or more.

    Null and empty texts have no candidates; null ids stay null; rows that repeat are scanned each; texts of any length are read whole;
    equal candidates in one word count once; an empty table gives no rows; other columns are not read.
    """
    c = candidates(docs)
    rows = c.select("doc_id", "at", "candidate", *[v.alias(k) for k, v in statistics(F.col("candidate"), F.col("before"), F.col("word")).items()])
    return rows.withColumn("score", train(spark, findings)).where("score >= 0.5").select("doc_id", "at", "candidate", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
