"""Reading and writing the corpus's files: pages, metadata, registries and reports, and the tables made of them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..schema import REGISTRY_ITEM, REPORT, SITTING


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text) of every file below a folder whose name fits; one file is one row and must fit in a task."""
    return as_files(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True))


def as_files(rows: DataFrame) -> DataFrame:
    """(path, text) of whole files as Spark reads them, at once or as a stream."""
    return rows.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, stem) of the transcript pages: all HTML files but the contents lists and what lies in skipped folders."""
    return as_pages(whole_files(spark, folder, "*.html"))


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the transcript pages, from a listing alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    return rows.select(decoded(F.col("path")).alias("path")).where(~F.col("path").rlike(P.SKIPPED_PATHS))


def decoded(path) -> Column:
    """A file's path as it is on disk, of the form that Spark gives, with its escapes."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def as_pages(rows: DataFrame) -> DataFrame:
    """(path, text, stem) of those HTML files (path, text) that are pages."""
    return rows.where(~F.col("path").rlike(P.SKIPPED_PATHS)).withColumn("stem", F.regexp_replace("path", r"\.html$", ""))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, meta) of the metadata files."""
    return whole_files(spark, folder, "*_metadata.txt").select(F.regexp_replace("path", r"_metadata\.txt$", "").alias("stem"), F.col("text").alias("meta"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(day, title, ord) of the contents lists: a heading moves the ordinal on by 100, an item by 1."""
    from ..operators.sections import contents_ordinal

    lists = whole_files(spark, folder, "contents.html").select(F.regexp_replace("path", "/[^/]*$", "").alias("day"), F.col("text").alias("html"))
    return contents_ordinal(lists, "day").select("day", "title", F.col("ord").cast("int").alias("ord"))


def is_damaged(text):
    """Files that aren't UTF-8, or hold the replacement characters of some that weren't; they go to quarantine."""
    return ~F.is_valid_utf8(text) | F.col(text).contains("\ufffd")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, filename, date, processed_dir, processed_date) of a JSON map of processed files; empty if it is missing or broken."""
    schema = T.MapType(T.StringType(), REGISTRY_ITEM)
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("key", T.StringType()), *REGISTRY_ITEM.fields]))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("key", "item"))
    return rows.select("key", "item.*")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of processed days with their sittings' metadata, Unknown where that lacks."""
    from ..operators.corpus import with_known

    def read(name, schema):
        rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
        return rows.withColumn("day", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))

    sittings = read("metadata.json", SITTING).select("day", "session", "meeting", F.col("date").alias("sitting"))
    return with_known(read("processing_report.json", REPORT), sittings, "day", ("date", "parliament", "session", "meeting"))


def described(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(name, type) of a table's columns."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table or view of this name, which may have a database before a dot."""
    return spark.catalog.tableExists(name)


def append_documents(docs: DataFrame, path: str) -> None:
    """Adds rows to the document table, laid out by source so that a search of one source reads only its files."""
    docs.write.mode("append").partitionBy("source").parquet(path)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of a table's older and newer form as one: columns that either lacks are null in its rows."""
    return old.unionByName(new, allowMissingColumns=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; where it names none, in a temporary one, on a local master alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    root = root or tempfile.mkdtemp(prefix="scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Queries made inside run with these settings of the session."""
    was = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Paths of what was kept for this process, which go when it ends.
KEPT: list[str] = []


def kept(rows: DataFrame) -> DataFrame:
    """Rows that several readers use, written once to the shared folder and read back; they are there until forget() or the end of the process."""
    path = scratch(rows.sparkSession, "kept")
    KEPT.append(path)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Removes what was kept, but for the first so many; nothing that still reads it may be used after."""
    while len(KEPT) > since:
        remove(spark, KEPT.pop())


@atexit.register
def _forget_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        spark = SparkSession.getActiveSession() if KEPT else None
        if spark:
            forget(spark)


def write_summary(summary: DataFrame, path: str) -> None:
    """A batch's summary as Markdown and as JSON, below one folder."""
    from ..operators.corpus import summary_lines

    summary_lines(summary).orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(f"{path}/markdown")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def quarantined(rows: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by a predicate; null counts as bad."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_csv(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


