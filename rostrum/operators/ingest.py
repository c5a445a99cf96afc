"""From files to the document table: parsing, incremental runs and their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import path_date, path_source
from ..functions.html import body_html, page_title
from ..functions.speakers import parsed, speaker_columns
from ..schema import DOCUMENT, STATE
from ..sources import files, versions
from . import index as I
from .corpus import latest, ranked_by_contents

#: Parts of the state that are folded into a whole version.
FOLD = 16


def hashed(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"file_path": F.col("path"), "file_hash": F.md5(F.col("text").cast("binary"))})


def documents(pages: DataFrame, meta: DataFrame, contents: DataFrame, html_sources: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Rows of DOCUMENT for pages that have their metadata. Keys are hashes of path and content, so a retried task makes the same.

    Contents are looked up by the title before the date is put to it. strict leaves out documents whose metadata names nobody.
    """
    return made(hashed(pages).join(meta, "stem"), contents, html_sources, strict)


def key_of(path: str, digest: str):
    return F.md5(F.concat_ws("\u0001", path, digest).cast("binary"))


def made(paired: DataFrame, contents: DataFrame, html_sources: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """documents of hashed pages that have their metadata (meta) beside them."""
    rows = paired.withColumns({"sitting_date": path_date("path"), "source": path_source("path"), "day": F.regexp_replace("path", "/[^/]*$", ""), "title": page_title("text")})
    rows = ranked_by_contents(rows, contents, ["day", "title"]).withColumn("speakers", parsed("meta"))
    if strict:
        rows = rows.where(F.size("speakers") > 0)
    first, second = speaker_columns("speakers")
    columns = {
        "doc_key": key_of("path", "file_hash"),
        "content": body_html("text", F.col("source").isin(*html_sources) if html_sources else F.lit(False)),
        "document_type": F.when(F.col("title").contains("Oral Question"), "Oral Question").otherwise("Hansard Document"),
        "speaker": first,
        "speaker2": second,
        "title": page_title("text", "sitting_date"),
        "created_at": F.lit(None).cast("timestamp"),
    }
    return rows.withColumns(columns).select(*(F.col(f.name).cast(f.dataType) for f in DOCUMENT.fields))


def counts(now: DataFrame, state: DataFrame) -> DataFrame:
    """(is_new, n): files to process and files to skip."""
    known = state.select("file_path", "file_hash", F.lit(True).alias("known"))
    return now.join(known, ["file_path", "file_hash"], "left").groupBy(F.col("known").isNull().alias("is_new")).agg(F.count(F.lit(1)).alias("n"))


def upserted(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state after a run: of each path the newest row."""
    return latest(state.unionByName(done.select(*state.columns)), "file_path", "indexed_at")


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each path that is known: its newest row. Rows with a null hash tell of files that are gone."""
    found = versions.current(spark, folder)
    rows = spark.read.schema(STATE).parquet(*found) if found else spark.createDataFrame([], STATE)
    return latest(rows, "file_path", "indexed_at")


def save_state(done: DataFrame, folder: str) -> None:
    """Adds what a run has done as a part of its own; after FOLD parts all are folded, and what the fold before has replaced goes."""
    spark, folder = done.sparkSession, folder.rstrip("/")
    done.select(*STATE.names).write.parquet(f"{folder}/{versions.name(versions.PART)}")
    found = versions.current(spark, folder)
    if len(found) > FOLD:
        load_state(spark, folder).write.parquet(f"{folder}/{versions.name(versions.WHOLE, versions.time_of(found[-1]))}")
        versions.remove_old(spark, folder)


def gone(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """(file_path, file_hash) of known files that the folder doesn't hold any more; files are listed, not read."""
    return known.where("file_hash is not null").join(files.page_paths(spark, folder), F.col("file_path") == F.col("path"), "left_anti").select("file_path", "file_hash")


def ingest(spark: SparkSession, folder: str, table: str, state: str, when: str, html_sources: tuple[str, ...] = (), pages: DataFrame | None = None, index: str | None = None, deletions: bool = False) -> dict[str, int]:
    """One incremental run over the folder's pages, or over those given (with their metadata as meta, null where it lacks, if they have
    that column): new and changed files are parsed and added, the others skipped.

    Returns how many are new, added (processed), without their metadata (failed), skipped, gone, and all pages (total); counts are
    observed in the one pass that reads the pages and writes their documents to a folder of the run, from where table, index and state
    are fed. Only what was written is known to the state, so pages without metadata are tried again in the next run. A document's key comes
    from path and content, and keys that the table has are left out, so a run that is repeated after a failure between its writes adds
    nothing twice. With index, a segment is added that hides the older forms of changed files, and with deletions those of
    files that are gone.
    """
    known = load_state(spark, state)
    own = files.pages(spark, folder) if pages is None else pages
    beside = own if "meta" in own.columns else own.join(files.metadata(spark, folder), "stem", "left")
    same = known.select(F.col("file_path").alias("known_path"), F.col("file_hash").alias("known_hash"))
    now = hashed(beside).join(same, (F.col("file_path") == F.col("known_path")) & (F.col("file_hash") == F.col("known_hash")), "left")
    is_known, has_meta, seen = F.col("known_path").isNotNull(), F.col("meta").isNotNull(), Observation()
    now = now.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(is_known).alias("skipped"), F.count_if(~is_known & ~has_meta).alias("failed"))
    rows = made(now.where(~is_known & has_meta), files.contents(spark, folder), html_sources)
    rows = files.kept(rows.withColumn("created_at", F.lit(when).cast("timestamp")))
    tally = seen.get
    lost = gone(spark, folder, known) if deletions else known.limit(0).select("file_path", "file_hash")
    new = tally["total"] - tally["skipped"]
    n_gone = lost.count() if deletions else 0
    if new > tally["failed"] or n_gone:
        fresh = rows
        if files.exists(spark, table):
            fresh = rows.join(spark.read.parquet(table).select("doc_key"), "doc_key", "left_anti").select(rows.columns)
        files.append_documents(fresh, table)
        if index:
            older = known.where("file_hash is not null").join(rows.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("file_path", "file_hash").unionByName(lost)
            hidden = older.select(key_of("file_path", "file_hash").alias("doc_key")).unionByName(rows.select("doc_key"))
            I.add_segment(rows, hidden, index, "doc_key", "content")
        at = F.lit(when).cast("timestamp").alias("indexed_at")
        done = rows.select(F.col("path").alias("file_path"), "file_hash", at).unionByName(lost.select("file_path", F.lit(None).cast("string").alias("file_hash"), at))
        save_state(done, state)
    return {"new": new, "processed": new - tally["failed"], "failed": tally["failed"], "skipped": tally["skipped"], "gone": n_gone, "total": tally["total"]}


def newest(docs: DataFrame) -> DataFrame:
    """The document table without the older rows of files that have changed."""
    return latest(docs, "path", "created_at")


def present(docs: DataFrame, state: DataFrame) -> DataFrame:
    """The document table's rows of files as the state knows them now: neither older forms nor files that are gone."""
    known = state.select(F.col("file_path").alias("path"), "file_hash")
    return docs.join(known, ["path", "file_hash"], "left_semi")
