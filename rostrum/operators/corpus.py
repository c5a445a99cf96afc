"""Joins, statistics, browsing and exports of the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import long_date
from ..functions.speakers import is_named
from ..schema import NO_SPEAKER, UNDATED, UNLISTED
from .numbering import numbered_within

CSV_FIELDS = ("title", "date", "source", "speaker", "speaker2", "document_type", "url")
URL = "/article?id="


def with_sidecar(docs: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """Documents that have their metadata beside them."""
    return docs.join(sidecar, key)


def without_sidecar(docs: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    return docs.join(sidecar, key, "left_anti")


def ranked_by_contents(docs: DataFrame, contents: DataFrame, on: list[str]) -> DataFrame:
    """docs with ord from the contents of their sitting; of equal titles the last counts, and what isn't listed comes last."""
    ranks = contents.groupBy(*on).agg(F.max("ord").alias("ord"))
    return docs.join(ranks, on, "left").withColumn("ord", F.coalesce("ord", F.lit(UNLISTED)))


def new_or_changed(now: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the state doesn't know with this content."""
    return now.join(state.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_anti")


def reconcile(store: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(side, n): keys in both, in the store alone and in the index alone."""
    both = store.select(key, F.lit(True).alias("s")).join(index.select(key, F.lit(True).alias("i")), key, "full_outer")
    return both.groupBy(F.when(F.col("i").isNull(), "store only").when(F.col("s").isNull(), "index only").otherwise("both").alias("side")).agg(F.count(F.lit(1)).alias("n"))


def with_known(rows: DataFrame, known: DataFrame, on: str, columns: tuple[str, ...], default: str = "Unknown") -> DataFrame:
    """rows with what is known of them, and a default in these columns where nothing is, whichever side they come from."""
    return rows.join(known, on, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


def new_items(items: DataFrame, registry: DataFrame, by: str) -> DataFrame:
    """Items that the registry of processed ones doesn't name; items without a name are new."""
    return items.join(registry.select(by).distinct(), by, "left_anti")


def backfilled(stored: DataFrame, derived: DataFrame, key: str, column: str) -> DataFrame:
    """stored with a derived value in column where it has none of its own: null, empty or the sentinel; names that are stored stay, and
    what the text doesn't name either keeps what it had."""
    fresh = derived.select(key, F.col(column).alias(f"{column}_derived"))
    value = F.when(is_named(column), F.col(column)).otherwise(F.coalesce(f"{column}_derived", column))
    return stored.join(fresh, key, "left").withColumn(column, value).drop(f"{column}_derived")


def latest(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when), F.desc("file_hash")))).where("k = 1").drop("k")


def stats_by_source(docs: DataFrame) -> DataFrame:
    """(source, n, speakers) and a row for all sources: partial sums over distinct (source, speaker) pairs, so one shuffle of names."""
    return docs.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("speakers"))


def speaker_autocomplete(docs: DataFrame, typed: str, source: str | None = None, most: int = 100) -> DataFrame:
    """Names that hold what was typed: at most so many of each column, as the two lists are cut before they are joined."""
    out = None
    for c in ("speaker", "speaker2"):
        rows = docs if source is None else docs.where(F.col("source") == source)
        names = rows.where(is_named(c) & F.lower(c).contains(typed.lower())).select(F.col(c).alias("name")).distinct().orderBy("name").limit(most)
        out = names if out is None else out.union(names)
    return out.distinct().orderBy("name")


def browse_by_day(docs: DataFrame, day: str, key: str, rank: str) -> DataFrame:
    """(day, documents): documents of each day in order, array<struct<rank, key>>; newest day first."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(key).alias("key"))))
    return docs.groupBy(day).agg(listed.alias("documents")).orderBy(F.col(day).desc_nulls_last())


def share(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, null of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def coverage(part: Column, whole: Column) -> Column:
    """x/y (p%)"""
    return F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), F.coalesce(share(part, whole), F.lit(0.0)).cast("string"), F.lit("%)"))


def batch_summary(files: DataFrame) -> DataFrame:
    """Totals and means over files with speakers and questions."""
    n = F.count(F.lit(1))
    asked = F.count_if(F.col("questions") > 0)
    return files.agg(n.alias("files"), F.sum("speakers").alias("speakers"), F.sum("questions").alias("questions"), F.round(F.avg("speakers"), 1).alias("mean_speakers"), F.round(F.avg("questions"), 1).alias("mean_questions"), asked.alias("with_questions"), share(asked, n).alias("share"))


def cohort_averages(files: DataFrame, modern: Column) -> DataFrame:
    """(modern, files, mean_questions, mean_speakers) of files of either format."""
    return files.groupBy(modern.alias("modern")).agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("questions"), 6).alias("mean_questions"), F.round(F.avg("speakers"), 6).alias("mean_speakers"))


def days_per_month(docs: DataFrame, day: str) -> DataFrame:
    """(year, month, days): different days of the collection in each month; undated documents make a row of nulls without days."""
    rows = docs.groupBy(F.year(day).cast("long").alias("year"), F.month(day).cast("long").alias("month"))
    return rows.agg(F.countDistinct(day).alias("days"))


def sitting_report(parts: DataFrame, sitting: str, number: str, is_question: Column) -> DataFrame:
    """(sitting, parts, questions) of each sitting: the highest part number and how many parts are questions."""
    return parts.groupBy(sitting).agg(F.max(number).cast("long").alias("parts"), F.count_if(is_question).alias("questions"))


def best_worst(files: DataFrame, measure: str, key: str) -> DataFrame:
    """The first row with the greatest and with the least measure, by key where they tie."""
    best = F.min(F.struct((-F.col(measure)).alias("v"), F.col(key).alias("k")))
    worst = F.min(F.struct(F.col(measure).alias("v"), F.col(key).alias("k")))
    return files.agg(best["k"].alias("best"), (-best["v"]).alias("most"), worst["k"].alias("worst"), worst["v"].alias("least"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(n, line): batch_summary as the lines of a Markdown report."""
    said = [("Files", "files"), ("Speakers", "speakers"), ("Questions", "questions"), ("Average speakers", "mean_speakers"), ("Average questions", "mean_questions"), ("With questions", "with_questions")]
    lines = [F.lit("# Processing summary"), F.lit(""), *(F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("0"))) for label, c in said)]
    return summary.select(F.posexplode(F.array(*lines)).alias("n", "line"))


def output_keys(parts: DataFrame, sitting: str, part: str, is_question) -> DataFrame:
    """parts with output_key: partN, or for a question partN_oral_question_M, M running within the sitting."""
    number = F.sum(is_question.cast("long")).over(Window.partitionBy(sitting).orderBy(part))  # parts of one number count together
    name = F.concat(F.lit("part"), F.col(part).cast("string"))
    return parts.withColumn("output_key", F.when(is_question, F.concat(name, F.lit("_oral_question_"), number.cast("string"))).otherwise(name))


def status_tally(rows: DataFrame, status: str) -> DataFrame:
    """(status, n, share) of each status."""
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))  # a handful of rows


def index_view(docs: DataFrame) -> DataFrame:
    """(doc_key, json): documents as the index takes them: a date for the undated, no sentinel speakers, no null fields."""
    named = lambda c: F.when(F.col(c) != NO_SPEAKER, F.col(c))
    day = F.date_format(F.coalesce("sitting_date", F.lit(UNDATED).cast("date")), "yyyy-MM-dd'T'00:00:00'Z'")
    return docs.select("doc_key", F.to_json(F.struct(F.col("doc_key").alias("id"), "title", "document_type", day.alias("date"), "source", named("speaker").alias("speaker"), named("speaker2").alias("speaker2"), "ord")).alias("json"))


def csv_lines(docs: DataFrame, origin: str = "") -> DataFrame:
    """(doc_id, line): seven fields, all quoted, quotes doubled."""
    fields = {"title": F.col("title"), "date": long_date("sitting_date"), "source": F.col("source"), "speaker": F.col("speaker"), "speaker2": F.col("speaker2"), "document_type": F.col("document_type"), "url": F.concat(F.lit(origin + URL), F.col("doc_key"))}
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(fields[f], F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in CSV_FIELDS]
    return docs.select("doc_id", F.concat_ws(",", *quoted).alias("line"))


def citations(page: DataFrame, origin: str = "") -> DataFrame:
    """(number, line) of a page's rows, in its order; a page is what a user has loaded, so one task numbers it."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("sitting_date").desc_nulls_last(), "ord", "doc_id")
    n = F.row_number().over(order)
    who = F.coalesce(F.concat(F.col("speaker"), F.lit(". ")), F.lit(""))
    line = F.concat(F.lit("["), n.cast("string"), F.lit("] "), who, F.lit("("), long_date("sitting_date"), F.lit("). "), F.col("title"), F.lit(". "), F.col("source"), F.lit(" Hansard. Retrieved from "), F.lit(origin + URL), F.col("doc_key"))
    return page.select(n.alias("number"), line.alias("line"))


def json_export(page: DataFrame, query: str, exported: str, filters: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """One JSON document of a page: query, the filters that were active, results by key and the given date of export. A page is what a
    user has loaded, so one row holds it."""
    rows = F.array_sort(F.collect_list(F.struct(key, "title", F.date_format("sitting_date", "yyyy-MM-dd").alias("date"), "source", "speaker", "document_type")))
    active = F.create_map(*(F.lit(x) for pair in (filters or {}).items() for x in pair)) if filters else F.create_map().cast("map<string,string>")
    return page.agg(F.to_json(F.struct(F.lit(query).alias("query"), active.alias("filters"), rows.alias("results"), F.lit(exported).alias("exportDate"))).alias("json"))


def batches(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """rows with batch, in groups of so many within each part, by an integer column."""
    return numbered_within(rows, [part], order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size).cast("long"))


def contents_list(parts: DataFrame, sitting: str, rank: str, title: str) -> DataFrame:
    """(sitting, html): an ordered list of a sitting's titles."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(title).alias("t")))), lambda s: F.concat(F.lit("<li>"), s["t"], F.lit("</li>")))
    return parts.groupBy(sitting).agg(F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")).alias("html"))
