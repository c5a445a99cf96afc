"""New files as a stream: what a scheduled job polls for, with the checkpoint as its memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..sources import files


def arrivals(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text, at) of whole files as they come; at is when they were written."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select(files.decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))


def paired(spark: SparkSession, folder: str, late: str) -> DataFrame:
    """(path, text, stem, at, meta): pages with their metadata, whichever of the two comes first, if they were written within late of each
    other; a page whose metadata hasn't come when both streams are past that time has a null meta. Until then both wait as state."""
    pages = files.as_pages(arrivals(spark, folder, "*.html")).withWatermark("at", late)
    meta = arrivals(spark, folder, "*_metadata.txt").select(F.regexp_replace("path", r"_metadata\.txt$", "").alias("meta_stem"), F.col("text").alias("meta"), F.col("at").alias("meta_at"))
    near = F.expr(f"stem = meta_stem and meta_at between at - interval {late} and at + interval {late}")
    return pages.join(meta.withWatermark("meta_at", late), near, "leftOuter").select("path", "text", "stem", "at", "meta")


def watch(spark: SparkSession, folder: str, table: str, state: str, checkpoint: str, when: str, html_sources: tuple[str, ...] = (), report=None, missed: str | None = None, late: str = "7 days", index: str | None = None) -> StreamingQuery:
    """Processes the files that have come since the last call and ends. Pages and metadata are two streams that are joined, so metadata may
    come polls later; pages whose metadata doesn't come in time go to the table missed (path, at), for retried(). A batch is one
    incremental run over its own files, so one that is repeated after a failure adds nothing twice; report, if given, gets each run's counts."""

    def run(batch: DataFrame, number: int) -> None:
        rows = files.kept(batch)  # the join's state is read once
        if rows.isEmpty():
            return
        if missed:
            rows.where("meta is null").select("path", "at").write.mode("overwrite").parquet(f"{missed.rstrip('/')}/batch={number}")
        counts = ingest.ingest(spark, folder, table, state, when, html_sources, rows.where("meta is not null").select("path", "text", "stem", "meta"), index)
        if report:
            report(counts)

    return paired(spark, folder, late).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retried(spark: SparkSession, folder: str, table: str, state: str, when: str, missed: str, html_sources: tuple[str, ...] = (), index: str | None = None) -> dict[str, int]:
    """An incremental run over the pages that a stream has missed."""
    pages = files.pages(spark, folder).join(spark.read.parquet(missed).select("path").distinct(), "path", "left_semi")
    return ingest.ingest(spark, folder, table, state, when, html_sources, pages, index)


def copied(spark: SparkSession, source: str, sink: str, checkpoint: str, transform, files_a_batch: int = 8) -> StreamingQuery:
    """A stream from a Parquet folder (or one file) through a transformation to another, exactly once by the sink's log."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_a_batch)
    if files.is_folder(spark, source):
        rows = reader.parquet(source)
    else:
        folder, _, name = source.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    return transform(rows).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
