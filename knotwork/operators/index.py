"""A stored index for search: postings of character trigrams, sorted so that a question reads only those of its words, and the rows that may hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.durable import Cuts
from knotwork.functions import text as T
from knotwork.operators import query as Q

GRAM = 3
#: Rows of a posting, about; a trigram of more rows has several.
POSTING = 4096
#: Rows whose numbers are sent to find them at most (8 bytes each); beyond, they are joined by shuffle.
SENT = 1 << 20


def grams(word: str) -> set[str]:
    return {word[k : k + GRAM] for k in range(len(word) - GRAM + 1)}


def build(nodes: DataFrame, at: str, hay: Sequence[str] = ("id", "label", "code")) -> None:
    """The index of nodes in the folder `at`: rows (all columns, and their number) in ranges of numbers, and postings (gram, lot, rows) in ranges of grams.

    Texts are looked at whole, in lower case; missing columns and null values are empty. A gram's rows stand in postings of a range of
    numbers each, so no task gathers all rows of a common one.
    """
    cuts = Cuts(nodes.sparkSession)
    rows = cuts.table(nodes.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "_row").sortWithinPartitions("_row").write.mode("overwrite").parquet(f"{at}/rows")
    text = T.haystack(*[F.col(c) if c in nodes.columns else F.lit(None).cast("string") for c in hay])
    pieces = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    # Numbers of one partition are dense, so a lot holds POSTING rows of it at most.
    said = rows.select("_row", F.explode(pieces).alias("gram"), F.floor(F.col("_row") / POSTING).alias("lot"))
    posts = said.groupBy("gram", "lot").agg(F.sort_array(F.collect_list("_row")).alias("rows"))
    posts.repartitionByRange(parts, "gram", "lot").sortWithinPartitions("gram", "lot").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{at}/postings")
    cuts.drop("rows")


def candidates(spark: SparkSession, at: str, question: str) -> DataFrame | None:
    """(_row) of the rows that have all trigrams of the question's words; None if no word is long enough to say anything."""
    wanted = sorted(set().union(*map(grams, T.tokens(question))))
    if not wanted:
        return None
    posts = spark.read.parquet(f"{at}/postings").where(F.col("gram").isin(*wanted))
    # Per lot first: its lists meet where they are short.
    lots = posts.groupBy("lot").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate("lists", F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lots.select(F.explode(both).alias("_row"))


def search(spark: SparkSession, at: str, question: str, hay: Sequence[str] = ("id", "label", "code"), most: int = Q.MOST_HITS) -> DataFrame:
    """As query.search over the nodes that the index was built of: postings give what may hold all words, which is then read, confirmed and scored."""
    rows = spark.read.parquet(f"{at}/rows")
    found = candidates(spark, at, question)
    if found is not None:
        few = found.limit(SENT + 1).collect()
        if len(few) <= SENT:
            ids = sorted(r[0] for r in few)
            # Ranges of numbers let the scan pass over row groups that hold none.
            rows = rows.where(F.col("_row").between(ids[0], ids[-1]) if ids else F.lit(False))
            rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "_row long")), "_row", "left_semi")
        else:
            rows = rows.join(found, "_row", "left_semi")
    return Q.search(rows.drop("_row"), question, hay, most)
