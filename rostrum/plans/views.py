"""Stand-in views over the given tables, as Spark reads them and as DuckDB does.

They give documents a sitting date, type, speakers, path and file name by arithmetic on doc_id, and turn conversations, texts and
pages into transcript lines and pages with headings. Every query takes the Spark form, every check the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {}
DUCKDB = {}

SPARK["docs_v"] = r"""
SELECT b.*,
 CASE WHEN sitting_date IS NULL THEN concat('/app/collections/', source, '/undated/part', ord, '.html')
      ELSE concat('/app/collections/', source, '/', year(sitting_date), '/', date_format(sitting_date, CASE WHEN doc_id % 2 = 0 THEN 'MMMM' ELSE 'MMM' END), '/', day(sitting_date), '/part', ord, '.html') END AS path,
 CASE WHEN sitting_date IS NULL THEN 'undated.html'
      WHEN doc_id % 2 = 0 THEN concat(date_format(sitting_date, 'EEEE-d-MMMM-yyyy'), '.html')
      ELSE concat('DAY-', ord, '-', date_format(sitting_date, 'EEE-d-MMM-yy'), '.html') END AS file_name,
 concat(CAST(20 + doc_id % 20 AS STRING), 'th Parliament ', CAST(4 + doc_id % 5 AS STRING), 'th Session Fifth Meeting. ', coalesce(date_format(sitting_date, 'MMMM d, yyyy'), ''), ' ', content) AS intro_text
FROM (SELECT doc_id, CAST(doc_id AS STRING) AS doc_key, text AS content, source, lang,
  concat(CASE doc_id % 3 WHEN 0 THEN 'Oral Question ' WHEN 1 THEN 'Written Question ' ELSE 'Statement ' END, CAST(doc_id AS STRING)) AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE date_add(DATE'2023-01-01', CAST((doc_id * 37) % 731 AS INT)) END AS sitting_date,
  CASE doc_id % 3 WHEN 0 THEN 'Oral Question' WHEN 1 THEN 'Written Question' ELSE 'Hansard Document' END AS document_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'No speakers identified' ELSE concat('HON. MEMBER ', chr(CAST(65 + (doc_id * 7) % 26 AS INT))) END AS speaker,
  CASE WHEN doc_id % 4 = 0 THEN concat('HON. MEMBER ', chr(CAST(65 + (doc_id * 13) % 26 AS INT))) ELSE NULL END AS speaker2,
  CAST(doc_id % 17 AS INT) AS ord FROM documents) b
"""

DUCKDB["docs_v"] = r"""
SELECT b.*,
 CASE WHEN sitting_date IS NULL THEN concat('/app/collections/', source, '/undated/part', ord, '.html')
      ELSE concat('/app/collections/', source, '/', year(sitting_date), '/', CASE WHEN doc_id % 2 = 0 THEN strftime(sitting_date, '%B') ELSE strftime(sitting_date, '%b') END, '/', day(sitting_date), '/part', ord, '.html') END AS path,
 CASE WHEN sitting_date IS NULL THEN 'undated.html'
      WHEN doc_id % 2 = 0 THEN concat(strftime(sitting_date, '%A-%-d-%B-%Y'), '.html')
      ELSE concat('DAY-', ord, '-', strftime(sitting_date, '%a-%-d-%b-%y'), '.html') END AS file_name,
 concat(CAST(20 + doc_id % 20 AS VARCHAR), 'th Parliament ', CAST(4 + doc_id % 5 AS VARCHAR), 'th Session Fifth Meeting. ', coalesce(strftime(sitting_date, '%B %-d, %Y'), ''), ' ', content) AS intro_text
FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS doc_key, text AS content, source, lang,
  concat(CASE doc_id % 3 WHEN 0 THEN 'Oral Question ' WHEN 1 THEN 'Written Question ' ELSE 'Statement ' END, CAST(doc_id AS VARCHAR)) AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(DATE '2023-01-01' + CAST((doc_id * 37) % 731 AS INT) AS DATE) END AS sitting_date,
  CASE doc_id % 3 WHEN 0 THEN 'Oral Question' WHEN 1 THEN 'Written Question' ELSE 'Hansard Document' END AS document_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'No speakers identified' ELSE concat('HON. MEMBER ', chr(CAST(65 + (doc_id * 7) % 26 AS INT))) END AS speaker,
  CASE WHEN doc_id % 4 = 0 THEN concat('HON. MEMBER ', chr(CAST(65 + (doc_id * 13) % 26 AS INT))) ELSE NULL END AS speaker2,
  CAST(doc_id % 17 AS INT) AS ord FROM documents) b
"""

SPARK["speech_lines"] = r"""
SELECT conv_id, turn AS pos,
 CASE role WHEN 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'ORAL QUESTIONS' ELSE 'ADJOURNMENT' END
  WHEN 'assistant' THEN concat(CASE WHEN conv_id % 3 = 0 THEN 'HON. SPEAKER.- ' ELSE 'MR SPEAKER: ' END, text)
  ELSE CASE WHEN turn % 3 = 2 THEN text
       ELSE concat('HON. ', chr(CAST(65 + conv_id % 26 AS INT)), CASE WHEN conv_id % 3 = 0 THEN '. MEMBER.- ' ELSE '. MEMBER: ' END, text) END END AS line
FROM conversations
"""

DUCKDB["speech_lines"] = r"""
SELECT conv_id, turn AS pos,
 CASE role WHEN 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'ORAL QUESTIONS' ELSE 'ADJOURNMENT' END
  WHEN 'assistant' THEN concat(CASE WHEN conv_id % 3 = 0 THEN 'HON. SPEAKER.- ' ELSE 'MR SPEAKER: ' END, text)
  ELSE CASE WHEN turn % 3 = 2 THEN text
       ELSE concat('HON. ', chr(CAST(65 + conv_id % 26 AS INT)), CASE WHEN conv_id % 3 = 0 THEN '. MEMBER.- ' ELSE '. MEMBER: ' END, text) END END AS line
FROM conversations
"""

SPARK["doc_lines"] = r"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos,
 CASE (doc_id + pos) % 9 WHEN 0 THEN 'MINISTERIAL STATEMENT' WHEN 1 THEN 'QUESTIONS' WHEN 2 THEN 'Oral Questions'
  WHEN 3 THEN concat('(', CAST(pos AS STRING), ') ', raw, ' - ') WHEN 4 THEN concat('(Q/No. ', CAST(pos AS STRING), '/2024)')
  WHEN 5 THEN 'Question put.' WHEN 6 THEN concat('Page ', CAST(pos AS STRING)) ELSE raw END AS line
FROM (SELECT doc_id, posexplode(split(text, r'\n')) AS (pos, raw) FROM documents) d
"""

DUCKDB["doc_lines"] = r"""
SELECT doc_id, pos,
 CASE (doc_id + pos) % 9 WHEN 0 THEN 'MINISTERIAL STATEMENT' WHEN 1 THEN 'QUESTIONS' WHEN 2 THEN 'Oral Questions'
  WHEN 3 THEN concat('(', CAST(pos AS VARCHAR), ') ', raw, ' - ') WHEN 4 THEN concat('(Q/No. ', CAST(pos AS VARCHAR), '/2024)')
  WHEN 5 THEN 'Question put.' WHEN 6 THEN concat('Page ', CAST(pos AS VARCHAR)) ELSE raw END AS line
FROM (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw
      FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) d
"""

SPARK["page_v"] = r"""
SELECT page_id, url,
 CASE WHEN page_id % 2 = 0 THEN regexp_replace(h, r'(<a href="[^"]*)"', '$1.pdf"') ELSE h END AS html
FROM (SELECT page_id, url, replace(replace(html,
   '<h1>', CASE page_id % 3 WHEN 0 THEN '<h3 style="padding-left: 120pt">' WHEN 1 THEN '<h2>' ELSE '<h3>' END),
   '</h1>', CASE page_id % 3 WHEN 1 THEN '</h2>' ELSE '</h3>' END) AS h FROM pages) p
"""

DUCKDB["page_v"] = r"""
SELECT page_id, url,
 CASE WHEN page_id % 2 = 0 THEN regexp_replace(h, '(<a href="[^"]*)"', '\1.pdf"', 'g') ELSE h END AS html
FROM (SELECT page_id, url, replace(replace(html,
   '<h1>', CASE page_id % 3 WHEN 0 THEN '<h3 style="padding-left: 120pt">' WHEN 1 THEN '<h2>' ELSE '<h3>' END),
   '</h1>', CASE page_id % 3 WHEN 1 THEN '</h2>' ELSE '</h3>' END) AS h FROM pages) p
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The table that each view reads.
BASE = {"docs_v": "documents", "doc_lines": "documents", "speech_lines": "conversations", "page_v": "pages"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view, with no temporary name left behind: the table is passed in as an argument of the statement."""
    return spark.sql(SPARK[name].replace(f"FROM {BASE[name]}", "FROM {base}"), base=table(spark, sf_dir, BASE[name]))


def checked_by(*names: str):
    """A function from a DuckDB query to the same with these views before it."""
    return lambda sql: "WITH " + ", ".join(f"{n} AS ({DUCKDB[n]})" for n in names) + " " + sql.strip()
