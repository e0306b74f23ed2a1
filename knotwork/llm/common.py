"""What the operators share: text helpers, durable cuts of lineage, seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork import durable
from knotwork.durable import empty as empty

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_mod(ident: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(n))


class Cuts(durable.Cuts):
    """As the base, with a codec for tables of long texts."""

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def partitioned(self, df: DataFrame, name: str, by: str, codec: str = "snappy") -> None:
        """Written in one folder for each value of `by`; of a column of few values."""
        df.write.mode("overwrite").option("compression", codec).partitionBy(by).parquet(f"{self.root}/{name}")

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def rest(self) -> None:
        """Lets the driver's JVM notice which finished jobs nobody refers to any more, so that their shuffle files go from the executors' disks before the next ones come."""
        self.spark._jvm.System.gc()
