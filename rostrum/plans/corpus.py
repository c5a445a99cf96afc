"""Queries on the corpus as a whole: scans, joins, statistics, exports, incremental ingestion and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.html import is_formatted
from ..functions.speakers import is_named
from ..operators import corpus as C
from ..operators import ingest as I
from ..operators import search
from ..sources import files
from ..streaming import ingest as streams
from ..streaming import usage
from .registry import query
from .views import checked_by, table, view

D = checked_by("docs_v")
PART = "CASE WHEN l_linenumber > 0 THEN l_linenumber END"


def docs_v(spark, sf_dir):
    return view(spark, sf_dir, "docs_v")


# Scans


@query("SELECT page_id, url FROM pages WHERE NOT url LIKE '%/contents.html'")
def scan_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~F.col("url").endswith("/contents.html")).select("page_id", "url")


@query(f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{P.SKIPPED_PATHS}|/fr/')")
def scan_skip_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~F.col("url").rlike(P.SKIPPED_PATHS + "|/fr/")).select("page_id", "url")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_projected(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, source, NULL::VARCHAR AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 1")
def schema_evolve(spark, sf_dir):
    """Even rows play a table of before the column came, odd ones the table of after."""
    rows = table(spark, sf_dir, "documents")
    return files.evolved(rows.where("doc_id % 2 = 0").select("doc_id", "source"), rows.where("doc_id % 2 = 1").select("doc_id", "source", "lang"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch FROM documents")
def batch_plan(spark, sf_dir):
    return C.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50)


# Joins


@query("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def join_sidecar(spark, sf_dir):
    return C.with_sidecar(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_sidecar(spark, sf_dir):
    return C.without_sidecar(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, coalesce(ord, 9999) AS ord FROM lineitem LEFT JOIN (SELECT p_partkey, max(p_size) AS ord FROM part WHERE p_partkey % 2 = 0 GROUP BY p_partkey) p ON l_partkey = p_partkey")
def join_contents_order(spark, sf_dir):
    contents = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("ord"))
    return C.ranked_by_contents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), contents, ["l_partkey"]).select("l_orderkey", "l_linenumber", "ord")


NOW_SQL = "SELECT CAST(doc_id AS VARCHAR) AS file_path, md5(text) AS file_hash FROM documents"
STATE_SQL = "SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS file_hash FROM documents WHERE doc_id % 3 <> 0"


def file_tables(spark, sf_dir):
    """Documents as files; two thirds are known to the state, a fifth of them with older content."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.md5(F.col("text").cast("binary")).alias("file_hash"))
    state = now.where("doc_id % 3 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("file_hash")))
    return now.drop("doc_id"), state.drop("doc_id")


@query(f"SELECT n.file_path, n.file_hash FROM ({NOW_SQL}) n LEFT JOIN ({STATE_SQL}) s ON n.file_path = s.file_path AND n.file_hash = s.file_hash WHERE s.file_path IS NULL")
def incremental_new_or_changed(spark, sf_dir):
    return C.new_or_changed(*file_tables(spark, sf_dir))


@query(f"SELECT s.file_path IS NULL AS is_new, count(*) AS n FROM ({NOW_SQL}) n LEFT JOIN ({STATE_SQL}) s ON n.file_path = s.file_path AND n.file_hash = s.file_hash GROUP BY 1")
def incremental_counts(spark, sf_dir):
    return I.counts(*file_tables(spark, sf_dir))


@query(f"SELECT file_path, file_hash, day FROM (SELECT coalesce(n.file_path, s.file_path) AS file_path, coalesce(n.file_hash, s.file_hash) AS file_hash, CASE WHEN n.file_path IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS day FROM ({NOW_SQL}) n FULL JOIN ({STATE_SQL}) s ON n.file_path = s.file_path) x")
def state_upsert(spark, sf_dir):
    now, state = file_tables(spark, sf_dir)
    at = lambda d: F.lit(d).cast("timestamp").alias("indexed_at")
    merged = I.upserted(state.select("file_path", "file_hash", at("2024-01-01")), now.select("file_path", "file_hash", at("2024-02-01")))
    return merged.select("file_path", "file_hash", F.col("indexed_at").cast("date").alias("day"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'Unknown') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON o_custkey = c_custkey")
def report_join(spark, sf_dir):
    """Orders as reports, customers as their sittings' metadata; a quarter of them lacks it."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return C.with_known(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", ("segment",)).select("o_orderkey", "segment")


@query("SELECT CASE WHEN i.doc_id IS NULL THEN 'store only' WHEN s.doc_id IS NULL THEN 'index only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT doc_id FROM documents) s FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -1 - doc_id FROM documents WHERE doc_id % 10 = 0) i ON s.doc_id = i.doc_id GROUP BY 1")
def reconcile(spark, sf_dir):
    """An index that lacks a seventh of the store, and holds rows that the store doesn't."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return C.reconcile(docs, docs.where("doc_id % 7 <> 0").union(docs.where("doc_id % 10 = 0").select(-1 - F.col("doc_id"))), "doc_id")


# Statistics


@query(D("SELECT source, count(*) AS n, count(DISTINCT speaker) AS speakers FROM docs_v GROUP BY ROLLUP (source)"))
def stats_by_source(spark, sf_dir):
    return C.stats_by_source(docs_v(spark, sf_dir).select("source", "speaker"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM documents")
def count_total(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))


NAMED = "{0} IS NOT NULL AND {0} <> '' AND {0} <> 'No speakers identified'"


@query(D(f"SELECT count(*) FILTER ({NAMED.format('speaker')}) AS n FROM docs_v"))
def speaker_coverage_count(spark, sf_dir):
    return docs_v(spark, sf_dir).agg(F.count_if(is_named("speaker")).alias("n"))


@query(D(f"SELECT count(DISTINCT speaker) AS n, CAST(sum(c) AS BIGINT) AS sum_of_unique FROM (SELECT source, speaker, 1 AS c FROM docs_v WHERE {NAMED.format('speaker')} GROUP BY source, speaker) x"))
def distinct_speakers(spark, sf_dir):
    """True distinct names, and the sum of each source's distinct names that reports call by the same word."""
    pairs = docs_v(spark, sf_dir).where(is_named("speaker")).select("source", "speaker").distinct()
    return pairs.agg(F.countDistinct("speaker").alias("n"), F.count(F.lit(1)).alias("sum_of_unique"))


@query("SELECT o_orderdate AS day, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_custkey, o_orderkey) AS documents FROM orders GROUP BY o_orderdate")
def browse_by_day(spark, sf_dir):
    rows = C.browse_by_day(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "o_custkey")
    return rows.select(F.col("o_orderdate").alias("day"), F.array_join(F.transform("documents", lambda d: d["key"].cast("string")), ",").alias("documents"))


FILES_SQL = "SELECT o_orderkey, o_orderpriority, count(l_linenumber) AS speakers, count(*) FILTER (l_returnflag = 'R') AS questions FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority"


def sitting_files(spark, sf_dir):
    """Orders as files: their lines are speakers, the returned ones questions. Lines are added up before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("speakers"), F.count_if(F.col("l_returnflag") == "R").alias("questions"))
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left").withColumns({c: F.coalesce(c, zero) for c in ("speakers", "questions")})


@query(f"SELECT count(*) AS files, CAST(sum(speakers) AS BIGINT) AS speakers, CAST(sum(questions) AS BIGINT) AS questions, round(avg(speakers), 1) AS mean_speakers, round(avg(questions), 1) AS mean_questions, count(*) FILTER (questions > 0) AS with_questions, round(100.0::DOUBLE * count(*) FILTER (questions > 0) / count(*), 1) AS share FROM ({FILES_SQL}) f")
def batch_summary(spark, sf_dir):
    return C.batch_summary(sitting_files(spark, sf_dir))


@query(f"SELECT starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2') AS modern, count(*) AS files, round(avg(questions), 6) AS mean_questions, round(avg(speakers), 6) AS mean_speakers FROM ({FILES_SQL}) f GROUP BY 1")
def cohort_averages(spark, sf_dir):
    return C.cohort_averages(sitting_files(spark, sf_dir), F.col("o_orderpriority").rlike("^[12]"))


@query(f"SELECT o_orderkey, CAST(questions AS VARCHAR) || '/' || CAST(speakers AS VARCHAR) || ' (' || CAST(coalesce(CASE WHEN speakers > 0 THEN round(100.0::DOUBLE * questions / speakers, 1) END, 0.0::DOUBLE) AS VARCHAR) || '%)' AS coverage FROM ({FILES_SQL}) f")
def coverage_ratio(spark, sf_dir):
    return sitting_files(spark, sf_dir).select("o_orderkey", C.coverage(F.col("questions"), F.col("speakers")).alias("coverage")).orderBy("o_orderkey")


@query(f"SELECT arg_min(o_orderkey, (-questions, o_orderkey)) AS best, max(questions) AS most, arg_min(o_orderkey, (questions, o_orderkey)) AS worst, min(questions) AS least FROM ({FILES_SQL}) f")
def best_worst(spark, sf_dir):
    return C.best_worst(sitting_files(spark, sf_dir), "questions", "o_orderkey")


@query(f"SELECT status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM (SELECT CASE WHEN {' OR '.join(f"contains(html, '{m}')" for m in P.FORMATTED)} THEN 'already' WHEN contains(html, '</body>') THEN 'success' ELSE 'error' END AS status FROM pages) x GROUP BY status")
def status_tally(spark, sf_dir):
    """Formatted pages are done already; of the others those with a whole body succeed."""
    status = F.when(is_formatted("html"), "already").when(F.col("html").contains("</body>"), "success").otherwise("error")
    return C.status_tally(table(spark, sf_dir, "pages").select(status.alias("status")), "status")


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1, 2")
def days_per_month(spark, sf_dir):
    return C.days_per_month(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS parts, count(*) FILTER (l_returnflag = 'R') AS questions FROM lineitem GROUP BY l_orderkey")
def sitting_report(spark, sf_dir):
    return C.sitting_report(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")


@query("SELECT l_orderkey, l_linenumber, 'part' || l_linenumber || CASE WHEN l_returnflag = 'R' THEN '_oral_question_' || CAST(sum(CAST(l_returnflag = 'R' AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) ELSE '' END AS output_key FROM lineitem")
def output_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return C.output_keys(rows, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").drop("l_returnflag")


@query(f"""SELECT CAST(i - 1 AS INT) AS n, l[i] AS line FROM (SELECT ['# Processing summary', '', '- Files: ' || count(*), '- Speakers: ' || CAST(sum(speakers) AS BIGINT), '- Questions: ' || CAST(sum(questions) AS BIGINT),
    '- Average speakers: ' || round(avg(speakers), 1), '- Average questions: ' || round(avg(questions), 1), '- With questions: ' || count(*) FILTER (questions > 0)] AS l FROM ({FILES_SQL}) f) x, (SELECT unnest(range(1, 9)) AS i) y""")
def summary_report(spark, sf_dir):
    return C.summary_lines(C.batch_summary(sitting_files(spark, sf_dir)))


# Exports

LONG_DATE = "coalesce(strftime(sitting_date, '%A, %B %-d, %Y'), 'Unknown date')"


def quoted(c: str) -> str:
    return f"""'"' || replace(coalesce({c}, ''), '"', '""') || '"'"""


@query(D("SELECT doc_id, concat_ws(',', " + ", ".join(quoted(c) for c in ("title", LONG_DATE, "source", "speaker", "speaker2", "document_type", "('/article?id=' || doc_key)")) + ") AS line FROM docs_v"))
def export_csv_lines(spark, sf_dir):
    return C.csv_lines(docs_v(spark, sf_dir))


@query(D(f"SELECT number, '[' || number || '] ' || coalesce(speaker || '. ', '') || '(' || {LONG_DATE} || '). ' || title || '. ' || source || ' Hansard. Retrieved from /article?id=' || doc_key AS line FROM (SELECT *, CAST(row_number() OVER (ORDER BY sitting_date DESC NULLS LAST, ord, doc_id) AS INT) AS number FROM docs_v) x WHERE number <= 20"))
def export_citations(spark, sf_dir):
    return C.citations(search.page(docs_v(spark, sf_dir)))


def json_field(name: str, c: str, quote: bool = True) -> str:
    value = f"""'"' || {c} || '"'""" if quote else f"CAST({c} AS VARCHAR)"
    return f"""CASE WHEN {c} IS NOT NULL THEN '"{name}":' || {value} END"""


@query(D("SELECT doc_key, '{' || concat_ws(',', " + ", ".join([json_field("id", "doc_key"), json_field("title", "title"), json_field("document_type", "document_type"), json_field("date", "(strftime(coalesce(sitting_date, DATE '2010-01-01'), '%Y-%m-%d') || 'T00:00:00Z')"), json_field("source", "source"), json_field("speaker", "nullif(speaker, 'No speakers identified')"), json_field("speaker2", "nullif(speaker2, 'No speakers identified')"), json_field("ord", "ord", False)]) + ") || '}' AS json FROM docs_v"))
def index_view(spark, sf_dir):
    return C.index_view(docs_v(spark, sf_dir))


EXPORTED = search.SearchRequest(document_type="Oral Question", speaker="HON. MEMBER C")
RESULT = "'{' || concat_ws(',', " + ", ".join([json_field("doc_id", "doc_id", False), json_field("title", "title"), json_field("date", "strftime(sitting_date, '%Y-%m-%d')"), json_field("source", "source"), json_field("speaker", "speaker"), json_field("document_type", "document_type")]) + ") || '}'"
PAGE = "SELECT * FROM docs_v WHERE document_type = 'Oral Question' AND (speaker = 'HON. MEMBER C' OR speaker2 = 'HON. MEMBER C') ORDER BY sitting_date DESC NULLS LAST, ord, doc_id LIMIT 20"


@query(D(f"""SELECT '{{"query":"*","filters":{{"document_type":"Oral Question","speaker":"HON. MEMBER C"}},"results":[' || coalesce(string_agg({RESULT}, ',' ORDER BY doc_id), '') || '],"exportDate":"2024-12-31"}}' AS json FROM ({PAGE}) p"""))
def export_json(spark, sf_dir):
    """A page of a filtered search, with its filters."""
    hits = search.matched(docs_v(spark, sf_dir), EXPORTED)
    return C.json_export(search.page(hits), "*", "2024-12-31", search.active_filters(EXPORTED))


@query("SELECT l_orderkey, '<ul>' || string_agg('<li>' || 'Part ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag || '</li>', '' ORDER BY l_linenumber, l_returnflag) || '</ul>' AS html FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def contents_render(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Part "), F.col("l_linenumber").cast("string"), F.lit(" "), "l_returnflag").alias("title"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.contents_list(rows.join(known, "l_orderkey"), "l_orderkey", "l_linenumber", "title")


# Usage and streams


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k <= 50")
def history_50(spark, sf_dir):
    return usage.history(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"))


@query("SELECT start, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, event_type) AS k FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) a) b WHERE k <= 3")
def trending(spark, sf_dir):
    return usage.trending(table(spark, sf_dir, "events"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, session")
def session_usage(spark, sf_dir):
    return usage.sessions(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"))


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def monthly_exports(spark, sf_dir):
    return usage.monthly(table(spark, sf_dir, "events"), "purchase")


@query("SELECT event_id, user_id, ts, event_type FROM events")
def stream_ingest(spark, sf_dir):
    """Events through a file stream into a table: what comes out is what went in."""
    sink, checkpoint = files.scratch(spark, "events"), files.scratch(spark, "stream")
    streams.copied(spark, f"{sf_dir}/events.parquet", sink, checkpoint, lambda rows: rows.select("event_id", "user_id", "ts", "event_type")).awaitTermination()
    return spark.read.parquet(sink)


def streamed(spark, sf_dir, transform):
    """What a stream over events gives by append, once its watermark has passed."""
    sink = files.scratch(spark, "usage")
    streams.copied(spark, f"{sf_dir}/events.parquet", sink, files.scratch(spark, "stream"), transform).awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def session_stream(spark, sf_dir):
    """Sessions as state of a stream; those that an event two days late could still join are open."""
    return streamed(spark, sf_dir, lambda rows: usage.session_windows(rows.select("user_id", "ts"), late="2 days")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, event_type) AS k FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) a WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY) b WHERE k <= 3")
def trending_stream(spark, sf_dir):
    """The commonest events of each day from windows that a stream has closed."""
    counts = streamed(spark, sf_dir, lambda rows: usage.counts_by_window(rows, late="2 days"))
    return usage.top_of_windows(counts).withColumn("start", F.col("start").cast("timestamp_ntz"))
