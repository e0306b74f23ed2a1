"""Files under one or several roots as rows, archives unpacked, artifacts told from what is none, and stored graphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import classify as C
from knotwork.functions import text as T

#: Folders that are never looked into (fixed values).
SKIPPED = (".git", "node_modules")
FILE = "path string, origin string, name string, ext string, content string"


def scan(spark: SparkSession, roots: Sequence[tuple[str, str, str]]) -> DataFrame:
    """FILE rows of every file under the roots (folder, origin, prefix of the path); the path is relative to its root. A root that is not there has no files."""
    parts = []
    for folder, origin, prefix in roots:
        try:
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raw = spark.createDataFrame([], "path string, content binary")
        raw = raw.select("path", F.col("content").cast("string").alias("content"))
        inner = F.regexp_extract("path", "^(?:[a-z0-9+.-]+:)?/*" + _quoted(folder) + "/*(.*)$", 1)
        rows = raw.select(F.concat(F.lit(prefix), inner).alias("path"), F.lit(origin).alias("origin"), "content")
        parts.append(rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED))))
    return shaped(reduce(DataFrame.unionByName, parts))


def _quoted(folder: str) -> str:
    return r"\Q" + folder.split(":", 1)[-1].strip("/") + r"\E" if "://" not in folder else r"\Q" + folder.split("://", 1)[1].strip("/") + r"\E"


def shaped(rows: DataFrame) -> DataFrame:
    """FILE rows of (path, origin, content)."""
    return rows.select("path", "origin", T.basename(F.col("path")).alias("name"), T.extension(F.col("path")).alias("ext"), "content")


def of_kind(files: DataFrame, *exts: str) -> DataFrame:
    return files.where(F.col("ext").isin(*exts))


def counts(files: DataFrame) -> DataFrame:
    """(ext, n): files of each extension; a corpus without any is no corpus."""
    return files.groupBy("ext").agg(F.count("*").alias("n"))


def warnings(files: DataFrame) -> DataFrame:
    """(path, warning) of the artifacts whose JSON cannot be read."""
    exts = [s[2] for s in C.SHAPES[:6]]
    return of_kind(files, *exts).where(F.try_parse_json("content").isNull()).select("path", F.lit("unparsable JSON").alias("warning"))


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "member", "content", "warning"]
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([m.filename]), pa.array([z.read(m).decode("utf-8", "replace")]), pa.array([None], pa.string())], names)
            except (zipfile.BadZipFile, RuntimeError, OSError) as e:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([str(e)])], names)


def unpacked(archives: DataFrame) -> DataFrame:
    """(path, member, content, warning) of zip archives (path, content as bytes), one member at a time; a bad archive gives a warning instead."""
    return archives.select("path", "content").mapInArrow(_members, "path string, member string, content string, warning string")


def inputs(spark: SparkSession, paths: Sequence[str], defaults: Sequence[str] = ()) -> list[str]:
    """The paths that exist, the defaults where none is given."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    there = lambda p: (at := hadoop.Path(p)).getFileSystem(conf).exists(at)
    return [p for p in (paths or defaults) if there(p)]


def ingested(files: DataFrame) -> DataFrame:
    """FILE rows with kind, code, target and skipped: what an artifact is and where it goes, or why it is passed over. spec is the specification as an object, whether it was one or a text."""
    raw = F.ltrim("content")
    reason = T.first_match(
        [
            (F.col("name").startswith(".") | (F.col("name") == "app-package.json"), "not an artifact"), (F.col("content").isNull(), "unreadable"), (~raw.startswith("{"), "not JSON"),
            (F.try_parse_json("content").isNull(), "bad JSON"),
        ]
    )
    rows = files.withColumn("skipped", reason).withColumn("spec", F.when(F.col("skipped").isNull(), C.specification(F.col("content"))))
    rows = rows.withColumn("kind", F.when(F.col("skipped").isNull(), C.artifact(F.col("content"), F.col("spec"))))
    rows = rows.withColumn("skipped", F.coalesce("skipped", F.when(F.col("kind").isNull(), F.lit("unrecognised shape"))))
    code = F.coalesce(C.artifact_code(F.col("content"), F.col("kind")), F.regexp_replace("name", r"\.[^.]*$", ""))
    place = lambda n: T.first_match([(F.col("kind") == s[0], s[n]) for s in C.SHAPES])
    return rows.withColumn("code", F.when(F.col("kind").isNotNull(), code)).select(
        "path", "origin", "name", "ext", "kind", "code", F.when(F.col("kind").isNotNull(), F.concat(F.lit("src/"), place(1), F.lit("/"), T.slug(F.col("code")), place(2))).alias("target"), "skipped", "content", "spec",
    )


def stored_graph(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one JSON document with the lists `nodes` and `edges`; the two schemas say which fields are read."""
    as_fields = lambda s: ",".join(":".join(f.strip().split(" ", 1)) for f in s.split(","))
    doc = spark.read.schema(f"nodes array<struct<{as_fields(nodes)}>>, edges array<struct<{as_fields(edges)}>>").option("multiLine", "true").json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def help_commands(text: DataFrame) -> DataFrame:
    """(name, description, at) of help texts (path, content): a command stands alone on a line, two spaces from its edge; the next line describes it."""
    following = F.get(F.split("content", "\n"), F.col("at") + 1)
    rows = text.select("path", "content", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("path", "at", "line", F.trim(F.coalesce(following, F.lit(""))).alias("description"))
    name = F.regexp_extract("line", r"^ {2}([a-z][a-z0-9-]*)\s*$", 1)
    return rows.select(name.alias("name"), "description", "at", "path").where("name <> ''")


def json_field(doc: Column, path: str, kind: str = "string") -> Column:
    """A field of JSON text as a type; null where it isn't there or is none of that type."""
    return F.try_variant_get(F.try_parse_json(doc), path, kind)
