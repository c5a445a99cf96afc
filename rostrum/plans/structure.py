"""Queries that structure transcripts: derived columns, classification of lines, extraction, and sectioning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, html, speakers, text
from ..functions import patterns as P
from ..operators import corpus, sections
from .registry import query
from .views import checked_by, table, view

D, L, S, V = (checked_by(n) for n in ("docs_v", "doc_lines", "speech_lines", "page_v"))
WS = r"[\s\x{00A0}]"


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def docs_v(spark, sf_dir):
    return view(spark, sf_dir, "docs_v")


def doc_lines(spark, sf_dir):
    return view(spark, sf_dir, "doc_lines")


def speech_lines(spark, sf_dir):
    return view(spark, sf_dir, "speech_lines")


def page_v(spark, sf_dir):
    return view(spark, sf_dir, "page_v")


# Derived columns


@query(D("SELECT doc_id, CASE WHEN list_position(p, 'collections') > 0 THEN coalesce(nullif(p[list_position(p, 'collections') + 1], ''), 'Unknown Source') ELSE 'Unknown Source' END AS source FROM (SELECT doc_id, string_split(path, '/') AS p FROM docs_v) x"))
def path_source(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", dates.path_source("path").alias("source"))


MONTH = "CASE {0} " + " ".join(f"WHEN '{m}' THEN {k}" for m, k in dates.MONTH_NUMBERS.items()) + " END"


def date_sql(year: str, month: str, day: str) -> str:
    return f"try_cast({year} || '-' || lpad(CAST({MONTH.format(month)} AS VARCHAR), 2, '0') || '-' || lpad({day}, 2, '0') AS DATE)"


def pick(c: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({c}, {q(pattern)}, {n}), '')"


@query(D("SELECT doc_id, " + date_sql(*(pick("path", r"/(\d{4})/([A-Za-z]+)/(\d{1,2})/", k) for k in (1, 2, 3))) + " AS d FROM docs_v"))
def path_date(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", dates.path_date("path").alias("d"))


NEW, OLD = P.FILE_DATES[0][0], P.FILE_DATES[1][0]


@query(D(f"SELECT doc_id, coalesce({date_sql(f'CAST(try_cast({pick("file_name", NEW, 3)} AS INT) + 2000 AS VARCHAR)', pick('file_name', NEW, 2), pick('file_name', NEW, 1))}, {date_sql(pick('file_name', OLD, 3), pick('file_name', OLD, 2), pick('file_name', OLD, 1))}) AS d FROM docs_v"))
def filename_date(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", dates.filename_date("file_name").alias("d"))


@query(D(f"SELECT doc_id, coalesce({date_sql(*(pick('intro_text', P.TEXT_DATE_LONG, k) for k in (3, 2, 1)))}, {date_sql(*(pick('intro_text', P.TEXT_DATE, k) for k in (3, 1, 2)))}) AS d FROM docs_v"))
def text_date(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", dates.text_date("intro_text").alias("d"))


def inner(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')")


TITLE = "nullif(" + inner("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '')"
H3 = "nullif(" + inner("regexp_extract(html, '(?is)<h3[^>]*>(.*?)</h3>', 1)") + ", '')"


@query(V(f"SELECT page_id, coalesce(CASE WHEN contains({TITLE}, 'Oral Question') THEN {TITLE} END, {H3}, {TITLE}, 'Untitled Document') AS title FROM page_v"))
def page_title(spark, sf_dir):
    return page_v(spark, sf_dir).select("page_id", html.page_title("html").alias("title"))


@query(D("SELECT doc_id, CASE WHEN contains(title, 'Oral Question') THEN 'Oral Question' ELSE 'Hansard Document' END AS document_type FROM docs_v"))
def doc_type(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", F.when(F.col("title").contains("Oral Question"), "Oral Question").otherwise("Hansard Document").alias("document_type"))


def html_text_sql(c: str) -> str:
    out = f"regexp_replace({c}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, mark in html.ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(mark)})"
    return strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")


@query(f"SELECT page_id, {html_text_sql('html')} AS content FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_text("html").alias("content"))


BODY = "coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)"


@query(V(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {strip(f'regexp_replace({BODY}, $$(?is)^(.*?)<h3[^>]*>.*?</h3>$$, $$\1$$)'.replace('$$', chr(39)).replace(chr(1), chr(92) + '1'))} ELSE {html_text_sql('html')} END AS content FROM page_v"))
def body_html(spark, sf_dir):
    return page_v(spark, sf_dir).select("page_id", html.body_html("html", F.col("page_id") % 2 == 0).alias("content"))


def clean_sql(c: str) -> str:
    tags = "a|abbr|article|b|body|div|em|footer|h[1-6]|head|header|html|i|li|meta|nav|ol|p|script|section|span|strong|style|table|td|th|title|tr|u|ul"
    out = f"regexp_replace(regexp_replace({c}, '(?i)<div[^>]*>', '<p>', 'g'), '(?i)</div>', '</p>', 'g')"
    out = f"regexp_replace({out}, '(?i)<br ?/?>', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '(?i)<({tags}) [^>]*>', '<\\1>', 'g'), '(?i)<p>\\s*</p>', '', 'g')"


@query(V(f"SELECT page_id, {clean_sql('html')} AS content FROM page_v"))
def html_clean(spark, sf_dir):
    return page_v(spark, sf_dir).select("page_id", html.html_clean("html").alias("content"))


META = """CASE WHEN contains(path, 'oral_question') THEN 'Oral Question Speakers:' WHEN contains(path, 'written_question') THEN 'Written Question Speakers:'
  WHEN regexp_extract(path, 'part(\\d+)', 1) <> '' THEN 'Part ' || regexp_extract(path, 'part(\\d+)', 1) || ' Speakers:' ELSE 'Speakers:' END || chr(10) ||
  CASE WHEN speaker IS NULL AND speaker2 IS NULL THEN 'No speakers identified' WHEN speaker IS NULL THEN 'Speaker 1: ' || speaker2 WHEN speaker2 IS NULL THEN 'Speaker 1: ' || speaker
  ELSE 'Speaker 1: ' || speaker || chr(10) || 'Speaker 2: ' || speaker2 END || chr(10)"""


def meta(spark, sf_dir):
    names = F.array_compact(F.array("speaker", "speaker2"))
    return docs_v(spark, sf_dir).select("doc_id", speakers.rendered("path", names).alias("meta"))


@query(D(f"SELECT doc_id, {META} AS meta FROM docs_v"))
def speaker_meta_text(spark, sf_dir):
    return meta(spark, sf_dir)


NAMES = "list_filter([speaker, speaker2], lambda s: s IS NOT NULL AND s <> 'No speakers identified')"


@query(D(f"SELECT doc_id, array_to_string({NAMES}, '|') AS speakers, {NAMES}[1] AS speaker, {NAMES}[2] AS speaker2 FROM docs_v"))
def speaker_parse(spark, sf_dir):
    """Metadata is written by one operator and read back by another; the check goes straight from the names."""
    rows = meta(spark, sf_dir).select("doc_id", speakers.parsed("meta").alias("names"))
    first, second = speakers.speaker_columns("names")
    return rows.select("doc_id", F.array_join("names", "|").alias("speakers"), first.alias("speaker"), second.alias("speaker2"))


@query("SELECT doc_id, md5(text) AS file_hash FROM documents")
def content_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("file_hash"))


@query(D(f"SELECT doc_id, {pick('intro_text', P.PARLIAMENT, 1)} AS parliament, {pick('intro_text', P.SESSION, 1)} AS session, {pick('intro_text', P.MEETING, 1)} AS meeting FROM docs_v"))
def sitting_meta(spark, sf_dir):
    c = "intro_text"
    return docs_v(spark, sf_dir).select("doc_id", text.group(c, P.PARLIAMENT).alias("parliament"), text.group(c, P.SESSION).alias("session"), text.group(c, P.MEETING).alias("meeting"))


@query(D("SELECT doc_id, title, coalesce(strftime(sitting_date, '%A, %B %-d, %Y'), 'Unknown date') AS day, array_to_string(list_filter([speaker, speaker2], lambda s: s IS NOT NULL), '|') AS speakers FROM docs_v"))
def article_view(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", "title", dates.long_date("sitting_date").alias("day"), F.array_join(F.array_compact(F.array("speaker", "speaker2")), "|").alias("speakers"))


@query("SELECT doc_id, substring(text, 1, 200) || '...' AS snippet FROM documents")
def snippet_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 200), F.lit("...")).alias("snippet"))


# Links

LINKS = rf"""SELECT page_id, url, pos, href, label FROM (SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(l) AS label
  FROM (SELECT page_id, url, regexp_extract_all(html, {q(html.ANCHOR)}, 1) AS h, regexp_extract_all(html, {q(html.ANCHOR)}, 2) AS l FROM page_v) a) b"""
LINK_NAME = "string_split(href, '/')[-1]"
HREF_ABS = "CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || '/' || href END"


def links(spark, sf_dir):
    rows = page_v(spark, sf_dir).select("page_id", "url", F.posexplode(html.anchors("html")).alias("pos", "a"))
    return rows.select("page_id", "url", F.col("pos").cast("long").alias("pos"), "a.href", "a.label").withColumn("name", html.file_name("href"))


@query(V(f"SELECT page_id, pos, {HREF_ABS} AS address, label FROM ({LINKS}) x WHERE lower(href) LIKE '%.pdf'"))
def anchors(spark, sf_dir):
    return links(spark, sf_dir).where(F.lower("href").endswith(".pdf")).select("page_id", "pos", html.absolute("href", "url").alias("address"), "label")


@query(V(f"SELECT page_id, pos, ({LINK_NAME} LIKE '%DAY-%' OR regexp_matches({LINK_NAME}, {q(P.LINK_NAME)}) OR regexp_matches(label, {q(P.LINK_TEXT)})) AND NOT regexp_matches(lower({LINK_NAME}), '{'|'.join(P.LINK_SKIPPED)}') AS wanted FROM ({LINKS}) x"))
def link_classify(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", "pos", "name", html.is_transcript_link("name", "label", F.lit("")).alias("wanted")).orderBy(F.desc("name"), "page_id", "pos").drop("name")


@query(V(f"SELECT page_id, pos, coalesce(CASE WHEN nullif({strip('label')}, '') <> {LINK_NAME} THEN {strip('label')} END, CASE WHEN regexp_matches({LINK_NAME}, {q(P.LINK_DATE)}) THEN concat_ws(' ', {', '.join(f'regexp_extract({LINK_NAME}, {q(P.LINK_DATE)}, {k})' for k in (1, 2, 3, 4))}) END, nullif({strip('label')}, ''), {LINK_NAME}) AS day FROM ({LINKS}) x"))
def link_date_label(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", "pos", html.link_date_label("name", "label", F.lit("")).alias("day"))


YEARS = ("2003", "2011", "2024")
YEAR = "(^|[^0-9])(" + "|".join(YEARS) + ")([^0-9]|$)"
DATED = "label || ' ' || CAST(2000 + page_id % 25 AS VARCHAR)"


@query(V(f"SELECT page_id, pos FROM ({LINKS}) x WHERE regexp_matches({HREF_ABS}, {q(YEAR)}) OR regexp_matches({LINK_NAME}, {q(YEAR)}) OR regexp_matches({DATED}, {q(YEAR)})"))
def filter_link_year(spark, sf_dir):
    """Links with one of the years in address, file name or text; each page's links bear a year of its own."""
    rows = links(spark, sf_dir).withColumn("label", F.concat("label", F.lit(" "), (2000 + F.col("page_id") % 25).cast("string")))
    return rows.where(html.names_year(html.absolute("href", "url"), "name", "label", years=YEARS)).select("page_id", "pos")


@query(V(f"SELECT address, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY page_id, pos) AS k FROM (SELECT page_id, pos, {HREF_ABS} AS address FROM ({LINKS}) x) y) z WHERE k = 1"))
def dedupe_first(spark, sf_dir):
    """The first link to each address: a minimum, with partial sums, rather than a sort of each group."""
    rows = links(spark, sf_dir).select(html.absolute("href", "url").alias("address"), F.struct("page_id", "pos").alias("at"))
    return rows.groupBy("address").agg(F.min("at").alias("at")).select("address", "at.*")


@query(V(f"SELECT page_id, pos, {LINK_NAME} AS name FROM ({LINKS}) x WHERE {LINK_NAME} NOT IN (SELECT {LINK_NAME} FROM ({LINKS}) y WHERE page_id % 3 = 0)"))
def new_items(spark, sf_dir):
    """Links of files that no page of the registry (every third one) names."""
    rows = links(spark, sf_dir)
    return corpus.new_items(rows, rows.where("page_id % 3 = 0"), "name").select("page_id", "pos", "name")


@query(f"SELECT page_id, {' OR '.join(f'contains(html, {q(m)})' for m in P.FORMATTED)} AS formatted FROM pages")
def is_formatted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.is_formatted("html").alias("formatted"))


def first_line(tag: str) -> str:
    return "nullif(" + strip(f"string_split(regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g'), chr(10))[1]") + ", '')"


@query(V(f"SELECT page_id, coalesce({first_line('h3')}, {first_line('p')}, {first_line('span')}) AS title FROM page_v"))
def question_title(spark, sf_dir):
    return page_v(spark, sf_dir).select("page_id", html.question_title("html").alias("title"))


# Lines


def flag(name: str, sql: str):
    """A DuckDB check of one boolean for each transcript line."""
    return f"SELECT {name}, pos, {sql} AS found FROM {{}}"


LINE = strip("line")


@query(S(f"SELECT conv_id, pos, regexp_matches({LINE}, {q(P.SPEAKER_LINE)}) AS plain, regexp_matches({LINE}, {q(P.SPEAKER_LINE_STRONG)}) AS strong, length({LINE}) <= 100 AND regexp_matches({LINE}, {q(P.SPEAKER_LINE_SHORT)}) AS short FROM speech_lines"))
def is_speaker_line(spark, sf_dir):
    return speech_lines(spark, sf_dir).select("conv_id", "pos", *(text.is_speaker_line("line", s).alias(s) for s in ("plain", "strong", "short")))


def dialogue_sql(n: int) -> str:
    cases = " ".join(f"WHEN regexp_matches({LINE}, {q(p)}) THEN {strip(f'regexp_extract({LINE}, {q(p)}, {n})')}" for p in P.DIALOGUE)
    return f"CASE {cases} ELSE {'NULL' if n == 1 else 'line'} END"


@query(S(f"SELECT conv_id, pos, {dialogue_sql(1)} AS speaker, {dialogue_sql(2)} AS dialogue FROM speech_lines"))
def speaker_dialogue(spark, sf_dir):
    return speech_lines(spark, sf_dir).select("conv_id", "pos", text.speaker_dialogue("line").alias("s")).select("conv_id", "pos", "s.*")


PROCEDURAL = f"regexp_matches({LINE}, {q(P.PROCEDURAL)})"
HEADING = f"(length({LINE}) < 50 AND regexp_matches({LINE}, {q(P.HEADING)}))"
CAPS = "(regexp_matches({0}, '[A-Z]') AND upper({0}) = {0})"
HEADER = f"({CAPS.format(LINE)} AND length({LINE}) > 3 AND NOT starts_with({LINE}, 'PAGE'))"


@query(L(f"SELECT doc_id, pos, {PROCEDURAL} AS found FROM doc_lines"))
def is_procedural(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "pos", text.is_procedural("line").alias("found"))


@query(L(f"SELECT doc_id, pos, {HEADING} AS found, (length(line) < 100 AND regexp_matches(upper(line), '{P.HEADING_WORDS}')) OR (length(line) < 50 AND {CAPS.format('line')}) AS listed FROM doc_lines"))
def is_section_heading(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "pos", text.is_section_heading("line").alias("found"), text.is_vocabulary_heading("line").alias("listed"))


@query(L(f"SELECT doc_id, pos, line FROM doc_lines WHERE NOT regexp_matches({LINE}, {q(P.PAGE_MARKER)})"))
def drop_page_markers(spark, sf_dir):
    return doc_lines(spark, sf_dir).where(~text.is_page_marker("line"))


@query(D(f"SELECT doc_id, CASE WHEN regexp_matches(title, {q(P.ORAL_SECTION)}) THEN 'oral' WHEN regexp_matches(title, {q(P.WRITTEN_SECTION)}) THEN 'written' END AS section, regexp_matches(title, {q(P.QUESTION_SECTION)}) AS found FROM docs_v"))
def question_section(spark, sf_dir):
    return docs_v(spark, sf_dir).select("doc_id", text.question_section("title").alias("section"), text.has_questions("title").alias("found"))


@query("SELECT c_custkey, upper(regexp_replace(c_name, '\\s+', '', 'g')) AS name FROM customer")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_name("c_name").alias("name"))


SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT doc_id, array_to_string({SPLIT.format('text')}, '|') AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    """The texts hold no abbreviation, so the check needs no joining of pieces; tests cover it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.sentences("text"), "|").alias("sentences"))


PARAGRAPHS = f"""WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS c FROM documents),
    n AS (SELECT doc_id, c, regexp_split_to_array(c, '\\s{{2,}}') AS parts, {SPLIT.format('c')} AS s FROM t),
    p AS (SELECT doc_id, CASE WHEN len(parts) = 1 AND length(c) > 500 THEN list_transform(range(0, CAST(ceil(len(s) / 3.0) AS BIGINT)), lambda k: array_to_string(s[k * 3 + 1:k * 3 + 3], ' ')) ELSE parts END AS a FROM n),
    f AS (SELECT doc_id, list_filter(list_transform(a, lambda x: {strip('x')}), lambda x: x <> '') AS a FROM p)
    SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS paragraph FROM f"""


@query(PARAGRAPHS)
def paragraph_build(spark, sf_dir):
    """The texts hold neither abbreviations nor words to the house, so the check counts sentences by threes; tests cover the rest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.regexp_replace("text", "\n", " "))).alias("pos", "paragraph"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+([.,;:!?])', '\1', 'g'), '([.,;:!?])([A-Z])', '\1 \2', 'g') AS text FROM documents")
def fix_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fix_punctuation("text").alias("text"))


BREAK = r"regexp_replace({0}, '([A-Za-z0-9])\s*<br ?/?>\s*([A-Za-z0-9])', '\1 \2', 'g')"


@query(f"SELECT page_id, {BREAK.format(BREAK.format('html'))} AS html FROM pages")
def fix_breaks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.fix_breaks("html").alias("html"))


@query(r"SELECT doc_id, pos, CASE WHEN regexp_matches(p, '(?i)^(?:HON|MR|DR|MRS|MS)\.\s+[A-Z][A-Z\s.]+:') THEN 'speaker' WHEN upper(p) = p AND length(p) > 10 THEN 'procedural' ELSE 'regular' END AS kind FROM (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS p FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}') AS a FROM documents) x) y")
def paragraph_classes(spark, sf_dir):
    """The texts have no blank lines, so each line plays a paragraph."""
    parts = F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"\n{2,}")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), text.paragraph_class("p").alias("kind"))


# Speakers


#: "at" is a word of DuckDB's own.
NTH = {"at": "nth"}


def speakers_sql(style: str, source: str = "speech_lines") -> str:
    patterns, _, noise, order = speakers.STYLES[style]
    parts = []
    for k, (pattern, title, name) in enumerate(patterns):
        listed = f"regexp_extract_all(line, {q(pattern)}, {name})"
        if title:
            bare = "t IS NULL OR t = ''" + (" OR t = 'HON.'" if style == "colon" else "")
            item = f"CASE WHEN {bare.replace('t ', 'z[1] ')} THEN z[2] ELSE z[1] || ' ' || z[2] END"
            listed = f"list_transform(list_zip(regexp_extract_all(line, {q(pattern)}, {title}), {listed}), lambda z: {item})"
        parts.append(f"SELECT conv_id, pos, {k} AS pattern, unnest(range(len(a))) AS nth, unnest(a) AS raw FROM (SELECT conv_id, pos, {listed} AS a FROM {source}) x")
    cleaned = {
        "colon": f"(SELECT *, {strip(f'regexp_replace(regexp_replace({strip("raw")}, $$:+$$, $$$$), $$[.]+$$, $$$$)').replace('$$:+$$', chr(39) + ':+$' + chr(39)).replace('$$[.]+$$', chr(39) + '[.]+$' + chr(39)).replace('$$$$', chr(39) * 2)} AS n FROM raws)",
        "dash": "(SELECT *, " + strip("regexp_replace(" + strip("raw") + ", '[.\\-:]+$', '')") + " AS n FROM raws)",
        "titled": "(SELECT *, regexp_replace(regexp_replace(" + strip("raw") + ", '[.]+$', ''), ':+$', '') AS n FROM raws)",
        "paragraph": "(SELECT *, " + strip("regexp_replace(" + strip("raw") + ", '-+$', '')") + " AS n FROM raws)",
    }[style]
    special = {"colon": "CASE WHEN n = 'SPEAKER' THEN 'MR SPEAKER' WHEN starts_with(n, 'CLERK') THEN 'CLERK' ELSE n END", "dash": "CASE WHEN contains(n, 'SPEAKER') AND NOT regexp_matches(n, 'DEPUTY|ASSISTANT') THEN 'MR SPEAKER' ELSE n END"}.get(style, "n")
    keep = "length(key) > 2 AND regexp_matches(key, '[^0-9]') AND regexp_matches(key, '[^.,!?;:-]')" if noise else "key <> ''"
    by = ", ".join(NTH.get(c, c) for c in order)
    return f"""raws AS ({' UNION ALL '.join(parts)}), named AS (SELECT conv_id, pos, pattern, nth, {special} AS name FROM {cleaned} c),
    keyed AS (SELECT *, upper(regexp_replace(name, '\\s+', '', 'g')) AS key FROM named),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY {by}, name) AS k FROM keyed WHERE {keep})"""


def listed_sql(style: str, keep_order: bool) -> str:
    order = ", ".join(NTH.get(c, c) for c in speakers.STYLES[style][3]) + ", name" if keep_order else "name"
    return "WITH " + f"speech_lines AS ({view_sql()}), " + speakers_sql(style) + f" SELECT conv_id, string_agg(name, '|' ORDER BY {order}) AS speakers FROM firsts WHERE k = 1 GROUP BY conv_id"


def view_sql() -> str:
    from .views import DUCKDB

    return DUCKDB["speech_lines"]


def speaker_list(spark, sf_dir, style, keep_order=False, lines=None):
    rows = lines if lines is not None else speech_lines(spark, sf_dir)
    return speakers.speakers(rows, "conv_id", "pos", "line", style, keep_order).select("conv_id", F.array_join("speakers", "|").alias("speakers"))


@query(listed_sql("colon", False))
def speakers_colon(spark, sf_dir):
    return speaker_list(spark, sf_dir, "colon")


@query(listed_sql("dash", False))
def speakers_dash(spark, sf_dir):
    return speaker_list(spark, sf_dir, "dash")


@query(listed_sql("titled", True))
def speakers_titled(spark, sf_dir):
    return speaker_list(spark, sf_dir, "titled", True)


#: Lines as the third parliament prints them: a title in small letters, the name, a dash.
PARAGRAPH = (r"^HON\. ([A-Z])\. MEMBER(?:\.-|:)", "Hon. {0}1member -")


@query(listed_sql("paragraph", True).replace("speech_lines AS (" + view_sql() + ")", f"lines0 AS ({view_sql()}), speech_lines AS (SELECT conv_id, pos, regexp_replace(line, {q(PARAGRAPH[0])}, {q(PARAGRAPH[1].format(chr(92)))}) AS line FROM lines0)"))
def speakers_para(spark, sf_dir):
    lines = speech_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", PARAGRAPH[0], PARAGRAPH[1].format("$")))
    return speaker_list(spark, sf_dir, "paragraph", True, lines)


STORED = "CASE conv_id % 4 WHEN 0 THEN 'HON. STORED' WHEN 1 THEN 'No speakers identified' WHEN 2 THEN '' END"


@query("WITH " + f"speech_lines AS ({view_sql()}), " + speakers_sql("dash") + f", found AS (SELECT conv_id, string_agg(name, '|' ORDER BY name) AS speakers FROM firsts WHERE k = 1 GROUP BY conv_id), stored AS (SELECT DISTINCT conv_id, {STORED} AS old FROM speech_lines) SELECT s.conv_id, CASE WHEN old = 'HON. STORED' THEN old ELSE coalesce(f.speakers, old) END AS speakers FROM stored s LEFT JOIN found f USING (conv_id)")
def speaker_backfill(spark, sf_dir):
    """Stored speakers stay where they name somebody; the sentinel, empty and null ones give way to what the text says."""
    lines = speech_lines(spark, sf_dir)
    stored = lines.select("conv_id", F.expr(STORED).alias("speakers")).distinct()
    return corpus.backfilled(stored, speaker_list(spark, sf_dir, "dash", lines=lines), "conv_id", "speakers")


# Sections


@query(L(f"SELECT doc_id, part_no, min(CASE WHEN header THEN {LINE} END) AS title, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS content FROM (SELECT *, CAST(sum(CAST(header AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS part_no FROM (SELECT *, {HEADER} AS header FROM doc_lines) a) b GROUP BY doc_id, part_no"))
def sectionize(spark, sf_dir):
    return sections.sectionize(doc_lines(spark, sf_dir), "doc_id")


BLOCKS = rf"""blocks AS (SELECT page_id, pos, regexp_extract(b, '^<(\w+)', 1) AS tag, regexp_extract(b, '^<[^>]*style="([^"]*)"', 1) AS style, {inner('b')} AS text FROM (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS b FROM (SELECT page_id, regexp_extract_all(html, {q(html.BLOCK)}) AS a FROM page_v) x) y)"""
INDENT = r"coalesce(try_cast(nullif(regexp_extract(style, 'padding-left:\s*(\d+(?:\.\d+)?)(?:pt|px)', 1), '') AS DOUBLE), 0)"
# title case as the engine has it: a letter after a space in upper case, others in lower case
INITCAP = "array_to_string(list_transform(string_split(lower(text), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
STYLED = f"(tag IN ('p', 'h2', 'h3') AND (contains(style, '{P.CENTRED}') OR tag = 'h2' OR ({INDENT} >= 110 AND tag = 'h3') OR (tag IN ('h2', 'h3') AND {INITCAP} = text AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, {q(P.TITLED_PERSON)}))))"


@query(V("SELECT 1") [: -len("SELECT 1")].rstrip() + f", {BLOCKS} SELECT page_id, pos, tag, text, {STYLED} AS heading FROM blocks")
def styled_heading(spark, sf_dir):
    rows = page_v(spark, sf_dir).select("page_id", F.posexplode(html.blocks("html")).alias("pos", "b")).select("page_id", F.col("pos").cast("long").alias("pos"), "b.*")
    return rows.select("page_id", "pos", "tag", "text", html.is_styled_heading("tag", "style", "text").alias("heading"))


@query(
    V("SELECT 1")[: -len("SELECT 1")].rstrip()
    + f""", {BLOCKS}, h AS (SELECT *, {STYLED} AS heading FROM blocks),
    f AS (SELECT *, heading AND NOT coalesce(lag(heading) OVER w AND lag(tag) OVER w = tag AND lag(style) OVER w = style, false) AS fresh FROM h WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    r AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM f)
    SELECT page_id, min(pos) AS first_pos, min(tag) AS tag, min(style) AS style, string_agg(text, ' ' ORDER BY pos) AS text FROM r WHERE heading GROUP BY page_id, run"""
)
def merge_headings(spark, sf_dir):
    return sections.merge_headings(page_v(spark, sf_dir)).withColumn("first_pos", F.col("first_pos").cast("long"))


@query(
    L(
        f"""SELECT doc_id, question_no, min(CASE WHEN opens THEN t END) AS title, count(*) AS n_lines FROM (
    SELECT *, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS question_no FROM (
    SELECT *, mode = 1 AND upper(t) <> 'QUESTIONS' AND NOT {CAPS.format('line')} AND {HEADING} AS opens FROM (
    SELECT *, {LINE} AS t, coalesce(last_value(CASE WHEN upper({LINE}) = 'QUESTIONS' THEN 1 WHEN {HEADER} THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS mode FROM doc_lines) a) b) c
    WHERE mode = 1 AND question_no > 0 AND upper(t) <> 'QUESTIONS' GROUP BY doc_id, question_no"""
    )
)
def sectionize_questions(spark, sf_dir):
    return sections.sectionize_questions(doc_lines(spark, sf_dir), "doc_id")


DATE_LINE = r"^\(Q/No\."


@query(
    L(
        rf"""SELECT doc_id, pos, line FROM (SELECT *, max(dates) OVER (PARTITION BY doc_id) AS of_all FROM (SELECT *, regexp_matches(line, '{DATE_LINE}') AS d, sum(CAST(regexp_matches(line, '{DATE_LINE}') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS dates FROM doc_lines) a) b
    WHERE (of_all >= 2 AND dates >= 2 AND NOT (d AND dates = 2)) OR (of_all = 1 AND dates >= 1) OR of_all = 0"""
    )
)
def trim_preamble(spark, sf_dir):
    """Reference lines play the dates that head a sitting."""
    return sections.trim_preamble(doc_lines(spark, sf_dir), "doc_id", F.col("line").rlike(DATE_LINE))


@query(
    S(
        f"""SELECT conv_id, block, min(CASE WHEN opens THEN speaker END) AS speaker, count(*) FILTER (t <> '') AS n_lines, string_agg(t, chr(10) ORDER BY pos) AS speech FROM (
    SELECT *, CASE WHEN opens THEN dialogue ELSE {LINE} END AS t, CAST(sum(CAST(opens OR closes AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS block FROM (
    SELECT *, coalesce(speaker IS NOT NULL, false) AS opens, heading OR (speaker IS NULL AND {PROCEDURAL}) AS closes FROM (
    SELECT *, {HEADING} AS heading, CASE WHEN NOT {HEADING} THEN {dialogue_sql(1)} END AS speaker, CASE WHEN NOT {HEADING} THEN {dialogue_sql(2)} END AS dialogue FROM speech_lines) a) b) c
    WHERE NOT closes AND block > 0 GROUP BY conv_id, block HAVING min(CASE WHEN opens THEN speaker END) IS NOT NULL AND count(*) FILTER (t <> '') > 0"""
    )
)
def speech_blocks(spark, sf_dir):
    return sections.speech_blocks(speech_lines(spark, sf_dir), "conv_id")


@query(
    S(
        f"""SELECT conv_id, question_no, min(pos) AS first_pos, count(*) AS n_lines FROM (SELECT *, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS question_no FROM (
    SELECT *, regexp_matches({LINE}, {q(P.QUESTION_SPEAKER)}) AND regexp_matches(string_agg(line, ' ') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), {q(P.ASKING.replace('question', 'the'))}) AS opens FROM speech_lines) a) b
    WHERE question_no > 0 GROUP BY conv_id, question_no"""
    )
)
def question_boundaries(spark, sf_dir):
    """The invented prose asks nothing, so the commonest word plays "question"."""
    return sections.question_boundaries(speech_lines(spark, sf_dir), "conv_id", asking=P.ASKING.replace("question", "the"))


@query(L("SELECT doc_id, number, CASE WHEN max(CAST(contains(lower(line), 'oral') AS INT)) = 1 THEN 'oral' ELSE 'written' END AS kind, count(*) AS n_lines FROM (SELECT *, CAST(sum(CAST(line = 'Question put.' AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS number FROM (SELECT doc_id, pos, line FROM doc_lines) a) b GROUP BY doc_id, number"))
def split_questions(spark, sf_dir):
    """Procedural lines are numbered first, so that they open questions."""
    lines = doc_lines(spark, sf_dir).withColumn("line", F.when(F.col("line") == "Question put.", "Question No. 1").otherwise(F.col("line")))
    return sections.split_questions(lines, "doc_id")


ITEM = f"regexp_extract({LINE}, {q(P.QUESTION_ITEM)}, 2)"
ITEM_TITLE = "regexp_replace(regexp_replace(" + strip(ITEM) + ", '\\s+', ' ', 'g'), '[ –—-]+$', '')"


@query(
    L(
        f"""SELECT doc_id, min(CASE WHEN is_item THEN pos END) AS pos, min(CASE WHEN is_item THEN section END) AS section, min(CASE WHEN is_item THEN regexp_extract({LINE}, {q(P.QUESTION_ITEM)}, 1) END) AS number, min(CASE WHEN is_item THEN {ITEM_TITLE} END) AS title,
    max_by(reference, pos) FILTER (reference IS NOT NULL) AS reference FROM (
    SELECT *, CASE WHEN section IS NOT NULL AND NOT is_item THEN nullif(regexp_extract({LINE}, {q(P.QUESTION_REFERENCE)}, 1), '') END AS reference, sum(CAST(is_item AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM (
    SELECT *, coalesce(section IS NOT NULL AND opener IS NULL AND regexp_matches({LINE}, {q(P.QUESTION_ITEM)}) AND length({ITEM_TITLE}) > 5, false) AS is_item FROM (
    SELECT *, last_value(opener IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM (
    SELECT *, CASE WHEN regexp_matches({LINE}, '(?i)^Oral Questions?$') THEN 'oral' WHEN regexp_matches({LINE}, '(?i)^Written Questions?$') THEN 'written' END AS opener FROM doc_lines) a) b) c) d
    WHERE item > 0 GROUP BY doc_id, item"""
    )
)
def question_items(spark, sf_dir):
    return sections.question_items(doc_lines(spark, sf_dir), "doc_id")


@query(D("SELECT doc_id, source, document_type, row_number() OVER (PARTITION BY source, document_type ORDER BY doc_id) AS number FROM docs_v"))
def number_by_type(spark, sf_dir):
    rows = docs_v(spark, sf_dir).select("doc_id", "source", "document_type")
    return sections.number_by_type(rows, "source", "document_type", "doc_id").withColumn("number", F.col("number").cast("long"))


@query(V("SELECT 1")[: -len("SELECT 1")].rstrip() + f", {BLOCKS} SELECT page_id, text AS title, max(ord) AS ord FROM (SELECT page_id, text, CAST(sum(CASE WHEN tag = 'h2' THEN 100 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS ord FROM blocks WHERE tag IN ('h2', 'li')) x GROUP BY page_id, text")
def contents_ordinal(spark, sf_dir):
    return sections.contents_ordinal(page_v(spark, sf_dir))
