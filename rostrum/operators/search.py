"""Search: a request's filters, ranking, highlights, facets and page, over a table of documents.

Predicates on fields go to the scan; texts never pass a shuffle but for the rows of the page. With an index (postings and lengths, as
written by operators.index) no text but those of the page is read to find by terms, phrases and patterns, or to rank.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import range_start
from ..functions.text import tokens
from ..sources.files import kept
from .index import K1, B, Index, Pattern, doc_stats, pattern_lookup, phrase_lookup, postings, ranked, term_lookup, words_of

__all__ = ["Index", "SearchRequest", "doc_stats", "postings", "search", "term_lookup", "words_of"]
FRAGMENT, FRAGMENTS = 250, 3
PAGE_ROWS = 20
FACETS = ("source", "document_type", "speaker", "speaker2")


@dataclass(frozen=True)
class SearchRequest:
    """What a user asks for. now is always given: no search depends on the clock."""

    terms: tuple[str, ...] = ()
    mode: str = "and"  # or: any term
    phrase: str = ""
    prefix: str = ""
    wildcard: str = ""  # a term with * and ?
    source: str | None = None
    document_type: str | None = None
    speaker: str | None = None
    questions_only: bool = False
    period: str | None = None  # day, week, month, year
    dates: tuple[date, date] | None = None
    day_in_history: bool = False
    now: date | None = None
    sort: str = "date"  # or relevance
    offset: int = 0
    rows: int = PAGE_ROWS
    facets: tuple[str, ...] = FACETS


TEMPLATES = {
    "recent_questions": SearchRequest(document_type="Oral Question", period="month"),
    "ministerial": SearchRequest(terms=("minister",), document_type="Hansard Document"),
    "this_day": SearchRequest(day_in_history=True),
    "by_member": SearchRequest(),
}


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def terms_of(r: SearchRequest) -> tuple[str, ...]:
    """The request's different terms."""
    return tuple(dict.fromkeys(words_of(r.terms)))


def has_terms(content, terms: tuple[str, ...], mode: str = "and") -> Column:
    """Documents with all (or any) of these terms, however written; of no terms, documents with content."""
    terms = sorted(set(words_of(terms)))
    if not terms:
        return F.col(content).isNotNull()
    wanted = F.array(*map(F.lit, terms))
    found = F.array_distinct(tokens(content))
    return F.arrays_overlap(found, wanted) if mode == "or" else F.size(F.array_intersect(found, wanted)) == len(terms)


def has_phrase(content, words: tuple[str, ...]) -> Column:
    """Consecutive tokens, told by the text of all tokens with a separator on both sides of each; of no words, as has_terms."""
    words = words_of(words)
    if not words:
        return F.col(content).isNotNull()
    return F.concat(F.lit(" "), F.array_join(tokens(content), " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def has_prefix(content, prefix: str) -> Column:
    """Documents with a token that begins so; of an empty prefix, those with any token."""
    return F.exists(tokens(content), lambda t: t.startswith(prefix.lower()))


def has_wildcard(content, typed: str) -> Column:
    """Documents with a token that fits a pattern of * and ?."""
    pattern = Pattern.of(typed)
    return F.exists(tokens(content), pattern.fits)


def filters(r: SearchRequest) -> list[Column]:
    """The request's predicates on fields; all hold."""
    out = []
    if r.source:
        out.append(F.col("source") == r.source)
    if r.document_type:
        out.append(F.col("document_type") == r.document_type)
    if r.speaker:
        out.append((F.col("speaker") == r.speaker) | F.coalesce(F.col("speaker2") == r.speaker, F.lit(False)))
    if r.questions_only:
        out.append(F.col("document_type").isin("Oral Question", "Written Question"))
    if r.period:
        out.append(F.col("sitting_date").between(range_start(r.now, r.period), F.lit(r.now)))
    if r.dates:
        out.append(F.col("sitting_date").between(*map(F.lit, r.dates)))
    if r.day_in_history:
        d = F.col("sitting_date")
        out.append((F.month(d) == r.now.month) & (F.dayofmonth(d) == r.now.day) & (F.year(d) < r.now.year))
    return out


def by_template(name: str, now: date, member: str | None = None) -> SearchRequest:
    """A saved template as a request of this day; by_member takes the member's name."""
    if name == "by_member" and not member:
        raise ValueError("by_member needs a member")
    return replace(TEMPLATES[name], now=now, **({"speaker": member} if member else {}))


def active_filters(r: SearchRequest) -> dict[str, str]:
    """The request's filters as an export names them."""
    out = {c: getattr(r, c) for c in ("source", "document_type", "speaker", "period") if getattr(r, c)}
    out |= {"questions_only": "true"} if r.questions_only else {}
    out |= {"from": str(r.dates[0]), "to": str(r.dates[1])} if r.dates else {}
    return out | ({"day_in_history": f"{r.now:%m-%d}"} if r.day_in_history else {})


def reads_texts(r: SearchRequest, index: Index | None) -> bool:
    """Whether finding the request's documents takes a pass over texts."""
    return index is None and bool(terms_of(r) or r.phrase or r.prefix or r.wildcard)


def matched(docs: DataFrame, r: SearchRequest, index: Index | None = None) -> DataFrame:
    """The documents that meet the request. With an index its key's column tells them, and no text is read."""
    out, terms = docs.where(all_of(filters(r))), terms_of(r)
    if index is None:
        out = out.where(has_terms("content", terms, r.mode))
        out = out.where(has_phrase("content", (r.phrase,))) if r.phrase else out
        out = out.where(has_prefix("content", r.prefix)) if r.prefix else out
        return out.where(has_wildcard("content", r.wildcard)) if r.wildcard else out
    phrase = words_of((r.phrase,))
    patterns = ([f"{r.prefix}*"] if r.prefix else []) + ([r.wildcard] if r.wildcard else [])
    if not (terms or phrase or patterns):
        return out.where("content is not null")
    if terms:
        out = out.join(term_lookup(index.postings, terms, r.mode, index.key), index.key, "left_semi")
    if phrase:
        out = out.join(phrase_lookup(index, r.phrase), index.key, "left_semi")
    for typed in patterns:
        out = out.join(pattern_lookup(index, typed), index.key, "left_semi")
    return out


def highlights(content, terms: tuple[str, ...], size: int = FRAGMENT, most: int = FRAGMENTS) -> Column:
    """The first windows of a text that hold a term, terms marked: windows of fixed size, so a long text is one pass. None of no terms."""
    terms = words_of(terms)
    if not terms:
        return F.array().cast("array<string>")
    pattern = r"(?i)\b(" + "|".join(terms) + r")\b"  # letters and digits alone, so nothing to escape
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(content) / size).cast("int") - 1))
    windows = F.transform(starts, lambda k: F.substring(content, k * size + 1, F.lit(size)))
    return F.transform(F.slice(F.filter(windows, lambda w: w.rlike(pattern)), 1, most), lambda w: F.regexp_replace(w, pattern, "<em>$1</em>"))


def ordered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.orderBy(F.col("sitting_date").desc_nulls_last(), "ord", F.col(key))


def page(docs: DataFrame, offset: int = 0, rows: int = PAGE_ROWS, key: str = "doc_id") -> DataFrame:
    """Rows of one page, newest first; a top-k, not a full sort."""
    return ordered(docs, key).offset(offset).limit(rows)


def page_after(docs: DataFrame, last_date: date, last_ord: int, last_id, rows: int = PAGE_ROWS, key: str = "doc_id") -> DataFrame:
    """The page after a given row: deep pages cost what the first one does."""
    d = F.col("sitting_date")
    after = (d < F.lit(last_date)) | d.isNull() | ((d == F.lit(last_date)) & ((F.col("ord") > last_ord) | ((F.col("ord") == last_ord) & (F.col(key) > last_id))))
    return ordered(docs.where(after), key).limit(rows)


def bm25(docs: DataFrame, terms: tuple[str, ...], key: str = "doc_id", content: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents with any of the terms.

    Term counts are taken where each text lies, once: they are kept, as sums and scores both need them. Statistics cover all documents.
    """
    terms = tuple(dict.fromkeys(words_of(terms)))
    if not terms:
        raise ValueError("ranking needs a term")
    found = tokens(content)

    def times(word: str) -> Column:
        return F.size(F.filter(found, lambda t: t == F.lit(word))).cast("double")

    counted = docs.select(key, F.size(found).cast("double").alias("length"), *(times(w).alias(f"tf{k}") for k, w in enumerate(terms)))
    counted = kept(counted)
    totals = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(terms))))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    any_term = reduce(lambda a, b: a | b, (F.col(f"tf{k}") > 0 for k in range(len(terms))))
    return counted.where(any_term).join(F.broadcast(totals)).select(key, F.round(score, 6).alias("score"))


def bm25_by_index(index: Index, terms: tuple[str, ...], k1: float = K1, b: float = B) -> DataFrame:
    """bm25 from postings and lengths: what is read of the postings is the terms' own rows."""
    key = index.key
    terms = tuple(dict.fromkeys(words_of(terms)))
    if not terms:
        raise ValueError("ranking needs a term")
    totals = index.stats.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"))
    found = index.postings.where(F.col("term").isin(*terms))
    df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # a row for each term
    rows = found.join(F.broadcast(df), "term").join(index.stats, key).join(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def field_facets(docs: DataFrame, fields: tuple[str, ...] = FACETS, most: int = 100) -> DataFrame:
    """(field, value, n): the commonest values of several fields in one pass, ties by value."""
    pairs = docs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select("p.*").where("value is not null")
    counts = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def zero_facets(corpus: DataFrame, hits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Facets that keep the corpus's values without a hit."""
    pairs = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("p")).select("p.*").where("value is not null")
    counts = pairs(hits).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return pairs(corpus).distinct().join(counts, ["field", "value"], "left").select("field", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def month_facets(dates: DataFrame, day: str, first: date, last: date) -> DataFrame:
    """(month, n) of every month from first to last's, empty ones included; the last one counts in full."""
    spark = dates.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first), "MM"), F.trunc(F.lit(last), "MM"), F.expr("interval 1 month"))).alias("month"))
    counts = dates.where(F.col(day) >= F.lit(first)).groupBy(F.trunc(day, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@dataclass(frozen=True)
class SearchResult:
    """page, facets and total of a search; counted has the last two in one pass, the total as the empty field."""

    page: DataFrame
    counted: DataFrame

    @property
    def facets(self) -> DataFrame:
        return self.counted.where("field <> ''")

    @property
    def total(self) -> DataFrame:
        return self.counted.where("field = ''").select("n")


def counted(hits: DataFrame, fields: tuple[str, ...] = FACETS, most: int = 100) -> DataFrame:
    """field_facets of the hits, and their number as a row without field and value, 0 where there are none."""
    none = F.lit(None).cast("string")
    marks = F.array(F.struct(F.lit("").alias("field"), none.alias("value")), *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    pairs = hits.select(F.explode(marks).alias("p")).select("p.*").where("value is not null or field = ''").withColumn("one", F.lit(1).cast("long"))
    zero = hits.sparkSession.range(1).select(F.lit("").alias("field"), none.alias("value"), F.lit(0).cast("long").alias("one"))
    counts = pairs.unionByName(zero).groupBy("field", "value").agg(F.sum("one").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


SHOWN = ("title", "sitting_date", "source", "speaker", "speaker2", "document_type")


def search(docs: DataFrame, r: SearchRequest, index: Index | None = None, key: str | None = None) -> SearchResult:
    """A page of the documents that meet the request, newest first, or best first where it asks for relevance and has terms; and
    facets and total of them all.

    key names the column that tells documents apart: the index's own, or doc_id. The page has rank, from 1 over all pages, and score,
    null where rows aren't ranked by it. Where texts have to be read to find documents, that is done once: what page and facets need of
    the hits is kept.
    """
    key = key or (index.key if index else "doc_id")
    if index and index.key != key:
        raise ValueError(f"the index tells documents by {index.key}, not by {key}")
    if r.sort not in ("date", "relevance"):
        raise ValueError(f"no sort by {r.sort}")
    hits, terms = matched(docs, r, index), terms_of(r)
    hits = hits.select(*dict.fromkeys((key, "sitting_date", "ord", *r.facets)))
    hits = kept(hits) if reads_texts(r, index) else hits
    if r.sort == "relevance" and terms:
        if index and index.blocks is not None:
            scores = ranked(index, terms, r.offset + r.rows, hits).scores
        else:
            scores = bm25_by_index(index, terms) if index else bm25(docs, terms, key, "content")
        best, order = hits.select(key).join(scores, key), (F.desc("score"), F.col(key))
    else:
        best, order = hits.select(key, "sitting_date", "ord", F.lit(None).cast("double").alias("score")), (F.col("sitting_date").desc_nulls_last(), F.col("ord"), F.col(key))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    top = best.orderBy(*order).limit(r.offset + r.rows).withColumn("rank", rank).where(F.col("rank") > r.offset)  # a page, or those up to it
    marked = F.array_join(highlights(F.col("content"), terms), " … ") if terms else F.lit("")
    shown = docs.join(F.broadcast(top.select(key, "score", "rank")), key).select(key, *SHOWN, marked.alias("highlight"), "score", "rank")
    return SearchResult(shown.orderBy("rank"), counted(hits.select(*r.facets), r.facets))


def search_rows(docs: DataFrame, r: SearchRequest, index: Index | None = None, key: str | None = None) -> DataFrame:
    """A search's page, facets and total as one table: part, name, value, n, text."""
    key = key or (index.key if index else "doc_id")
    s = search(docs, r, index, key)
    none = F.lit(None).cast("string")
    rows = s.page.select(F.lit("page").alias("part"), F.col(key).cast("string").alias("name"), "title", F.lit(None).cast("long").alias("n"), F.col("highlight").alias("text"))
    part = F.when(F.col("field") == "", "total").otherwise("facet").alias("part")
    counts = s.counted.select(part, F.nullif("field", F.lit("")).alias("name"), F.col("value").alias("title"), "n", none.alias("text"))
    return rows.unionByName(counts)
