"""Cuts of lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, as in tests, one of this machine is taken and noted in the session; on a cluster that is an error, as executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("knotwork.shared.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="knotwork-")
        spark.conf.set("knotwork.shared.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Cuts:
    """Tables written once to the shared folder, so that lost executors recompute nothing and loops keep short plans.

    drop() removes tables that no later plan reads; what is left when a query returns is what its result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The table and its rows, which are counted while they are written."""
        seen = Observation()
        return self.table(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get.get("n") or 0

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    return Cuts(df.sparkSession).table(df)


def empty(df: DataFrame) -> bool:
    return not df.take(1)
