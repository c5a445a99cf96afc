"""Queries that look for documents: filters, sorting, paging, facets and full-text search."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.speakers import is_named
from ..operators import corpus as C
from ..operators import facets as B
from ..operators import index as I
from ..operators import search as S
from ..sources import files
from .registry import query
from .views import checked_by, table, view

NOW = date(2024, 12, 31)
CUSTOM = (date(2024, 2, 1), date(2024, 3, 31))
HISTORY = date(2024, 12, 6)
TERMS = ("that", "with")
D = checked_by("docs_v")
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
ROWS = ["doc_id", "title", "sitting_date", "source", "speaker", "speaker2", "document_type"]
COLS = ", ".join(ROWS)


def docs_v(spark, sf_dir):
    return view(spark, sf_dir, "docs_v")


def found(spark, sf_dir, **request):
    return S.matched(docs_v(spark, sf_dir), S.SearchRequest(now=NOW, **request)).select(*ROWS)


@query(D(f"SELECT {COLS}, strftime(sitting_date, '%Y-%m-%d') AS iso_date FROM docs_v WHERE doc_key = '42'"))
def lookup_by_id(spark, sf_dir):
    return docs_v(spark, sf_dir).where(F.col("doc_key") == "42").select(*ROWS, F.date_format("sitting_date", "yyyy-MM-dd").alias("iso_date"))


@query(D(f"SELECT {COLS} FROM docs_v WHERE source = 'src3' AND document_type = 'Oral Question'"))
def filter_source_type(spark, sf_dir):
    return found(spark, sf_dir, source="src3", document_type="Oral Question")


@query(D(f"SELECT {COLS} FROM docs_v WHERE speaker = 'HON. MEMBER C' OR speaker2 = 'HON. MEMBER C'"))
def filter_speaker_any(spark, sf_dir):
    return found(spark, sf_dir, speaker="HON. MEMBER C")


@query(D(f"SELECT {COLS} FROM docs_v WHERE document_type IN ('Oral Question', 'Written Question')"))
def filter_questions(spark, sf_dir):
    return found(spark, sf_dir, questions_only=True)


@query(
    D(
        " UNION ALL ".join(
            f"SELECT '{p}' AS period, doc_id, sitting_date FROM docs_v WHERE sitting_date BETWEEN DATE '{s}' AND DATE '2024-12-31'"
            for p, s in (("day", "2024-12-30"), ("week", "2024-12-24"), ("month", "2024-12-01"), ("year", "2023-12-31"))
        )
    )
)
def filter_date_relative(spark, sf_dir):
    """The month before December 31 is November 31, so it begins on December 1."""
    rows = docs_v(spark, sf_dir)
    parts = [S.matched(rows, S.SearchRequest(now=NOW, period=p)).select(F.lit(p).alias("period"), "doc_id", "sitting_date") for p in ("day", "week", "month", "year")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(D(f"SELECT {COLS} FROM docs_v WHERE sitting_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-31'"))
def filter_date_custom(spark, sf_dir):
    return found(spark, sf_dir, dates=CUSTOM)


@query(D(f"SELECT {COLS} FROM docs_v WHERE month(sitting_date) = 12 AND day(sitting_date) = 6 AND year(sitting_date) < 2024"))
def filter_day_in_history(spark, sf_dir):
    return S.matched(docs_v(spark, sf_dir), S.SearchRequest(now=HISTORY, day_in_history=True)).select(*ROWS)


@query(D(f"SELECT {COLS} FROM docs_v WHERE document_type IN ('Oral Question', 'Written Question') AND source = 'src4' AND sitting_date BETWEEN DATE '2023-12-31' AND DATE '2024-12-31'"))
def filter_stack(spark, sf_dir):
    return found(spark, sf_dir, questions_only=True, source="src4", period="year")


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source")


SENTINEL = "'No speakers identified'"


@query(
    D(
        f"""SELECT DISTINCT name FROM ((SELECT DISTINCT speaker AS name FROM docs_v WHERE speaker IS NOT NULL AND speaker <> '' AND speaker <> {SENTINEL} AND lower(speaker) LIKE '%member%' ORDER BY name LIMIT 100)
    UNION ALL (SELECT DISTINCT speaker2 AS name FROM docs_v WHERE speaker2 IS NOT NULL AND speaker2 <> '' AND speaker2 <> {SENTINEL} AND lower(speaker2) LIKE '%member%' ORDER BY name LIMIT 100)) ORDER BY name"""
    )
)
def speaker_autocomplete(spark, sf_dir):
    return C.speaker_autocomplete(docs_v(spark, sf_dir), "Member")


@query(D(f"SELECT DISTINCT speaker FROM docs_v WHERE speaker IS NOT NULL AND speaker <> {SENTINEL} ORDER BY speaker LIMIT 10"))
def sample_speakers(spark, sf_dir):
    return docs_v(spark, sf_dir).where(is_named("speaker")).select("speaker").distinct().orderBy("speaker").limit(10)


ORDER = "ORDER BY sitting_date DESC NULLS LAST, ord, doc_id"


@query(D(f"SELECT {COLS} FROM docs_v WHERE document_type = 'Oral Question' {ORDER}"))
def search_recent(spark, sf_dir):
    return S.ordered(S.matched(docs_v(spark, sf_dir), S.SearchRequest(document_type="Oral Question"))).select(*ROWS)


@query(D(f"SELECT {COLS} FROM docs_v {ORDER} LIMIT 20 OFFSET 40"))
def page_n(spark, sf_dir):
    return S.page(docs_v(spark, sf_dir), 40).select(*ROWS)


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def last_n(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)


# Full text


def text_check(where: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, text, {TOKENS.format('text')} AS t FROM documents) x WHERE {where}"


def text_hits(spark, sf_dir, predicate):
    return table(spark, sf_dir, "documents").where(predicate).select("doc_id")


@query(text_check("list_contains(t, 'that') AND list_contains(t, 'with')"))
def search_and(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_terms("text", TERMS))


@query(text_check("list_contains(t, 'that') OR list_contains(t, 'with')"))
def search_or(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_terms("text", TERMS, "or"))


@query(text_check("list_contains(t, 'that') AND list_contains(t, 'with')"))
def term_lookup(spark, sf_dir):
    """Terms as a user may type them, joined to postings."""
    return S.term_lookup(S.postings(table(spark, sf_dir, "documents")), ("That,", "WITH", "that"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL")
def search_all(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_terms("text", ()))


@query(text_check("contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')"))
def search_phrase(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_phrase("text", ("Of", "the")))


@query(text_check("len(list_filter(t, lambda w: starts_with(w, 'nicht'))) > 0"))
def search_prefix(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_prefix("text", "Nicht"))


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
    c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS length, CAST(len(list_filter(w, lambda x: x = 'that')) AS DOUBLE) AS tf0, CAST(len(list_filter(w, lambda x: x = 'with')) AS DOUBLE) AS tf1 FROM t),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean, CAST(count(*) FILTER (tf0 > 0) AS DOUBLE) AS df0, CAST(count(*) FILTER (tf1 > 0) AS DOUBLE) AS df1 FROM c)
    SELECT doc_id, round(ln(1 + (n - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))
      + ln(1 + (n - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)), 6) AS score FROM c, s WHERE tf0 + tf1 > 0"""
)
def search_bm25(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), TERMS)


SCORE = """round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6)"""
RANKED = f"""WITH t AS (SELECT doc_id, {TOKENS.format('content')} AS w FROM docs_v), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM t),
    p AS (SELECT doc_id, term, CAST(len(list_filter(w, lambda x: x = term)) AS DOUBLE) AS tf, CAST(len(w) AS DOUBLE) AS length FROM t, (SELECT unnest(['that', 'with']) AS term) x),
    d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p WHERE tf > 0 GROUP BY term), r AS (SELECT doc_id, {SCORE} AS score, count(*) AS k FROM p JOIN d USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


RELEVANT = D("SELECT 1")[: -len("SELECT 1")].rstrip() + ", " + RANKED.removeprefix("WITH ") + " SELECT doc_id, title, sitting_date, source, speaker, speaker2, document_type, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM docs_v JOIN r USING (doc_id) WHERE k = 2 AND document_type = 'Oral Question' ORDER BY score DESC, doc_id LIMIT 20"


@query(RELEVANT)
def search_relevance(spark, sf_dir):
    """The page of a search by relevance over an index of the same table, in order, with scores."""
    docs = docs_v(spark, sf_dir)
    return S.search(docs, S.SearchRequest(terms=("With", "that!"), document_type="Oral Question", sort="relevance"), I.index_of(docs, content="content")).page.drop("highlight")


@query(RELEVANT)
def search_top_blocks(spark, sf_dir):
    """The same page over a stored index, from the blocks whose bound reaches the twentieth score."""
    docs, at = docs_v(spark, sf_dir), files.scratch(spark, "index")
    I.rebuild(docs, at, "doc_id", "content")
    return S.search(docs, S.SearchRequest(terms=("With", "that!"), document_type="Oral Question", sort="relevance"), I.read(spark, at, "doc_id")).page.drop("highlight")


PHRASES = ("Of the", "the the", "the of the", "and nothing like it")
JOINED = "' ' || array_to_string(t, ' ') || ' '"


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, doc_id FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) x WHERE contains({JOINED}, ' {p.lower()} ')" for p in PHRASES))
def phrase_by_index(spark, sf_dir):
    """Phrases, with repeated words and over line ends, from positions alone."""
    index = I.index_of(table(spark, sf_dir, "documents"))
    return reduce(DataFrame.unionByName, (I.phrase_lookup(index, p).select(F.lit(p).alias("phrase"), "doc_id") for p in PHRASES))


PATTERNS = {"th*": "th.*", "*ing": ".*ing", "W?th": "w.th", "t*n?": "t.*n.", "*a?a*": ".*a.a.*"}


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) x WHERE len(list_filter(t, lambda w: regexp_full_match(w, '{e}'))) > 0" for p, e in PATTERNS.items()))
def pattern_by_index(spark, sf_dir):
    """Prefixes, suffixes and wildcards over the term dictionary."""
    return I.patterns_lookup(I.index_of(table(spark, sf_dir, "documents"), positions=False), tuple(PATTERNS))


@query(text_check("len(list_filter(t, lambda w: regexp_full_match(w, 't.*n.'))) > 0"))
def search_wildcard(spark, sf_dir):
    return text_hits(spark, sf_dir, S.has_wildcard("text", "t*n?"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) x GROUP BY term")
def term_dictionary(spark, sf_dir):
    return I.index_of(table(spark, sf_dir, "documents")).terms


@query(
    f"""WITH d AS (SELECT doc_id, {TOKENS.format("CASE WHEN doc_id % 5 = 0 THEN concat('That changed ', text) ELSE text END")} AS t FROM documents WHERE doc_id % 7 <> 0)
    SELECT doc_id, CAST(len(t) AS BIGINT) AS length, coalesce(contains({JOINED}, ' that changed '), false) AS changed, coalesce(list_contains(t, 'with'), false) AS has_with FROM d"""
)
def index_segments(spark, sf_dir):
    """An index in three segments: half of the documents, the others with a fifth of all changed, and one that deletes a seventh of
    all; the first two are merged before the third comes."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), files.scratch(spark, "index")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("That changed "), F.col("text"))).otherwise(F.col("text")))
    I.rebuild(docs.where("doc_id % 2 = 0"), at, "doc_id", "text")
    I.add_segment(changed.where("doc_id % 2 = 1 or doc_id % 5 = 0"), docs.where("doc_id % 5 = 0").select("doc_id"), at, "doc_id", "text")
    I.merge(spark, at, "doc_id")
    I.add_segment(docs.limit(0), docs.where("doc_id % 7 = 0").select("doc_id"), at, "doc_id", "text")
    now = I.read(spark, at, "doc_id")
    mark = lambda found, name: found.select("doc_id", F.lit(True).alias(name))
    rows = now.stats.join(mark(I.phrase_lookup(now, "that changed"), "changed"), "doc_id", "left").join(mark(I.term_lookup(now.postings, ("with",)), "has_with"), "doc_id", "left")
    return rows.select("doc_id", "length", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("has_with", F.lit(False)).alias("has_with"))


HIGHLIGHT = r"""array_to_string(list_transform(list_filter(list_transform(range(0, greatest(1, CAST(ceil(length({0}) / 250.0) AS BIGINT))), lambda k: substring({0}, k * 250 + 1, 250)),
    lambda f: regexp_matches(f, '(?i)\b(that|with)\b'))[1:3], lambda f: regexp_replace(f, '(?i)\b(that|with)\b', '<em>\1</em>', 'g')), ' … ')"""


@query(f"SELECT doc_id, {HIGHLIGHT.format('text')} AS highlight FROM documents")
def search_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.highlights(F.col("text"), TERMS), " … ").alias("highlight"))


@query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) x GROUP BY term, doc_id")
def postings(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "documents"))


# Facets and the whole search

FIELDS = ", ".join(f"('{f}', CAST({f} AS VARCHAR))" for f in S.FACETS)


def facets_sql(source: str) -> str:
    """The 100 commonest values of each facet field of a DuckDB table."""
    every = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM {source} WHERE {f} IS NOT NULL" for f in S.FACETS)
    return f"SELECT field, value, n FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (SELECT field, value, count(*) AS n FROM ({every}) a GROUP BY field, value) b) c WHERE r <= 100"


@query(D(facets_sql("(SELECT * FROM docs_v WHERE document_type = 'Oral Question') q")))
def facets_multi(spark, sf_dir):
    return S.field_facets(S.matched(docs_v(spark, sf_dir), S.SearchRequest(document_type="Oral Question")).select(*S.FACETS))


@query(D(facets_sql("(SELECT * FROM docs_v WHERE document_type = 'Oral Question' AND (speaker = 'HON. MEMBER C' OR speaker2 = 'HON. MEMBER C')) q").replace("WHERE r <= 100", "")))
def facets_bitmap(spark, sf_dir):
    """Facets under two filters, one of them on either of two columns, from bitmaps of documents."""
    filters = [[("document_type", "Oral Question")], [("speaker", "HON. MEMBER C"), ("speaker2", "HON. MEMBER C")]]
    return B.bitmap_facets(B.bitmaps(docs_v(spark, sf_dir), S.FACETS), S.FACETS, filters)


@query()
def facet_sketches(spark, sf_dir):
    """Distinct speakers of each source, estimated from sketches by source and month."""
    docs = docs_v(spark, sf_dir).withColumn("month", F.trunc("sitting_date", "MM"))
    return B.estimated(B.sketches(docs, ["source", "month"], ("speaker", "speaker2")), ("speaker", "speaker2"), ["source"])


@query(
    D(
        """SELECT v.field, v.value, count(h.value) AS n FROM
    (SELECT DISTINCT 'source' AS field, source AS value FROM docs_v UNION SELECT DISTINCT 'document_type', document_type FROM docs_v) v
    LEFT JOIN (SELECT 'source' AS field, source AS value FROM docs_v WHERE source = 'src1' UNION ALL SELECT 'document_type', document_type FROM docs_v WHERE source = 'src1') h USING (field, value)
    GROUP BY v.field, v.value"""
    )
)
def facets_zero(spark, sf_dir):
    rows = docs_v(spark, sf_dir).select("source", "document_type")
    return S.zero_facets(rows, rows.where("source = 'src1'"), ("source", "document_type"))


@query("SELECT m AS month, count(o_orderkey) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS m) x LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m")
def facet_months(spark, sf_dir):
    return S.month_facets(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate", date(1995, 1, 1), date(2001, 8, 31))


@query(D("SELECT count(DISTINCT source) AS sources, count(DISTINCT document_type) AS types, count(DISTINCT speaker) AS speakers FROM docs_v"))
def facet_cardinality(spark, sf_dir):
    return docs_v(spark, sf_dir).agg(F.countDistinct("source").alias("sources"), F.countDistinct("document_type").alias("types"), F.countDistinct("speaker").alias("speakers"))


FULL = S.SearchRequest(terms=TERMS, questions_only=True, period="year", now=NOW)


def full_sql(where: str, highlight: str) -> str:
    hits = f"(SELECT * FROM docs_v WHERE {where})"
    return D(
        f"""SELECT 'page' AS part, doc_key AS name, title, CAST(NULL AS BIGINT) AS n, {highlight} AS text FROM (SELECT * FROM {hits} h {ORDER} LIMIT 20) p
    UNION ALL SELECT 'facet', field, value, n, NULL FROM ({facets_sql(hits + ' h')}) f UNION ALL SELECT 'total', NULL, NULL, count(*), NULL FROM {hits} h"""
    )


@query(
    full_sql(
        f"document_type IN ('Oral Question', 'Written Question') AND sitting_date BETWEEN DATE '2023-12-31' AND DATE '2024-12-31' AND list_contains({TOKENS.format('content')}, 'that') AND list_contains({TOKENS.format('content')}, 'with')",
        HIGHLIGHT.format("content"),
    )
)
def search_full(spark, sf_dir):
    """The flagship: filters, all terms, page, highlights, facets and total."""
    return S.search_rows(docs_v(spark, sf_dir), FULL)


def template(spark, sf_dir, name, now, member=None):
    return S.search_rows(docs_v(spark, sf_dir), S.by_template(name, now, member))


@query(full_sql("document_type = 'Oral Question' AND sitting_date BETWEEN DATE '2024-12-01' AND DATE '2024-12-31'", "''"))
def template_recent_questions(spark, sf_dir):
    return template(spark, sf_dir, "recent_questions", NOW)


@query(full_sql(f"document_type = 'Hansard Document' AND list_contains({TOKENS.format('content')}, 'minister')", HIGHLIGHT.format("content").replace("that|with", "minister")))
def template_ministerial(spark, sf_dir):
    return template(spark, sf_dir, "ministerial", NOW)


@query(full_sql("month(sitting_date) = 12 AND day(sitting_date) = 6 AND year(sitting_date) < 2024", "''"))
def template_this_day(spark, sf_dir):
    return template(spark, sf_dir, "this_day", HISTORY)


@query(full_sql("speaker = 'HON. MEMBER C' OR speaker2 = 'HON. MEMBER C'", "''"))
def template_by_member(spark, sf_dir):
    return template(spark, sf_dir, "by_member", NOW, "HON. MEMBER C")
