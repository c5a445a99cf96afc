"""The inverted index: postings with positions, a dictionary of terms, lookups by term, phrase and pattern, and its upkeep in segments.

On disk an index is a folder of versions. Each segment holds the postings of its documents in order of terms, with their documents'
length and block (documents of like length), the documents, the dictionary in order of terms and of terms read backwards, and the keys of
older documents that it hides. What is live is an anti-join of postings with the keys that later segments hide; a merge folds segments
into one.

A whole version also holds the mean length, with which postings give impacts: what a term adds to a document's score but for its rarity;
and the greatest impact of each term in each block: the best of a search are found in blocks whose bound reaches the score of the last
of them, without the others.

Postings are put in order by way of ranges: they are written once to a folder for each range, compressed by columns, and each range is
sorted by a task. A shuffle of the same rows takes three times the disk.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, tokens
from ..sources import versions
from ..sources.files import remove, settings

#: What is written last; a segment without it isn't read.
MARK = "documents/_SUCCESS"
K1, B = 1.2, 0.75
#: Documents in a block, a power of two, and blocks that are scored first to learn what score the best have.
BLOCK_BITS, FIRST_BLOCKS = 6, 32
LAST = chr(0x10FFFF)
POSTING = ("term", "tf", "positions")
#: Postings in a range, ranges at least and at most, and what is looked at to cut them evenly: documents, or one posting in so many.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2_000_000, 4, 256
LOOKED_AT, LOOKED_AT_ROWS = 200, 100_000
#: Keys up to which a counted list of hidden documents is broadcast.
BROADCAST_KEYS = 1_000_000
#: For writes: shuffle files go when a write ends, and the ranges of a union stay tasks of their own.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.unionOutputPartitioning": "false"}


def words_of(texts) -> tuple[str, ...]:
    """What a user typed as the tokens that texts are cut into: letters and digits, in lower case."""
    return tuple(w for t in texts for w in re.findall(r"[^\W_]+", t.lower()))


def postings(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(term, key, tf): the inverted index."""
    return docs.select(key, F.explode(tokens(content)).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def placed(docs: DataFrame, key: str, content: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, tf, positions, length, more columns of docs) of each row by itself: its tokens are sorted with their places within the
    row and cut where the term changes, so nothing is shuffled."""
    at = F.transform(tokens(content), lambda t, k: F.struct(t.alias("term"), k.alias("at")))
    rows = docs.select(key, *more, F.sort_array(at).alias("all")).where(F.size("all") > 0)
    # slices of the whole, as a mere field would be taken out anew for each element below
    rows = rows.select(key, *more, *(F.slice(F.col("all")[c], 1, (1 << 31) - 1).alias(f"{c}s") for c in ("term", "at")))
    begins_at = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda k: (k == 0) | (F.get("terms", k) != F.get("terms", k - 1)))
    rows = rows.select(key, *more, "terms", "ats", begins_at.alias("starts"))

    def run(a, k):
        return F.struct(F.get("terms", a).alias("term"), F.slice("ats", a + 1, F.coalesce(F.get("starts", k + 1), F.size("terms")) - a).alias("positions"))

    rows = rows.select(key, *more, F.size("ats").alias("length"), F.explode(F.transform("starts", run)).alias("run"))
    return rows.select("run.term", key, F.size("run.positions").cast("long").alias("tf"), "run.positions", "length", *more)


def one_row_each(docs: DataFrame, key: str) -> bool:
    """Whether no key has several rows; only keys are read."""
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def positional(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(term, key, tf, positions): postings with the places of each term among the document's tokens, from 0, ascending. Rows of one key
    are one document, whose places stand together; only then are postings shuffled."""
    rows = placed(docs, key, content).drop("length")
    if one_row_each(docs, key):
        return rows
    rows = rows.groupBy("term", key).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return rows.select("term", key, F.size("positions").cast("long").alias("tf"), "positions")


def doc_stats(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, length) of all documents; null texts have no length, and don't count in means."""
    return docs.select(key, F.size(tokens(content)).cast("long").alias("length"))


def dictionary(rows: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Index:
    """postings (term, key, tf, and positions for phrases), stats (key, length), terms (term, df), backwards (reversed, df), and of a whole
    version impacts (term, block, key, impact) and blocks (term, block, n, most)."""

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None
    backwards: DataFrame | None = None
    key: str = "doc_id"
    impacts: DataFrame | None = None
    blocks: DataFrame | None = None


def index_of(docs: DataFrame, key: str = "doc_id", content: str = "text", positions: bool = True) -> Index:
    """An index that isn't stored: each use works it out anew. Without positions (and tf) it is for terms and patterns, of documents with a
    row each."""
    rows = positional(docs, key, content) if positions else docs.select(F.explode(F.array_distinct(tokens(content))).alias("term"), key)
    terms = dictionary(rows)
    return Index(rows, doc_stats(docs, key, content), terms, terms.select(F.reverse("term").alias("reversed"), "df"), key)


# Lookups


def term_lookup(rows: DataFrame, terms: tuple[str, ...], mode: str = "and", key: str = "doc_id") -> DataFrame:
    """(key) of documents with all (or any) of the terms, from postings alone."""
    terms = sorted(set(words_of(terms)))
    found = rows.where(F.col("term").isin(terms))
    if mode == "or" or len(terms) < 2:
        return found.select(key).distinct()
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select(key)


def phrase_lookup(index: Index, phrase: str) -> DataFrame:
    """(key) of documents with the phrase's words one after the other: each word's positions, moved back by the word's place in the
    phrase, have a place in common. Only postings of these words are read; a document's row holds their positions."""
    words = words_of((phrase,))
    if not words:
        raise ValueError("a phrase needs a word")
    different = list(dict.fromkeys(words))
    rows = index.postings.where(F.col("term").isin(different))
    if len(different) == 1 and len(words) == 1:
        return rows.select(index.key).distinct()
    at = {w: f"p{k}" for k, w in enumerate(different)}
    each = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in at.items()]
    found = rows.groupBy(index.key).agg(*each).where(reduce(Column.__and__, (F.col(c).isNotNull() for c in at.values())))
    moved = [F.transform(at[w], moved_back(k)) for k, w in enumerate(words)]
    return found.where(F.size(reduce(F.array_intersect, moved)) > 0).select(index.key)


def moved_back(k: int):
    return lambda x: x - k


@dataclass(frozen=True)
class Pattern:
    """A term with * (any characters) and ? (one): its literal head and tail, and an expression for all of it."""

    head: str
    tail: str
    whole: str

    @staticmethod
    def of(typed: str) -> Pattern:
        """Case doesn't count; characters that no term holds make a pattern that nothing fits."""
        typed = typed.lower()
        parts = re.split(r"[*?]", typed)
        whole = "".join({"*": r"[\p{L}\p{N}]*", "?": r"[\p{L}\p{N}]"}.get(c, c if c.isalnum() else r"\x{" + f"{ord(c):x}" + "}") for c in typed)
        return Pattern(parts[0], parts[-1] if len(parts) > 1 else "", f"^{whole}$")

    def fits(self, term) -> Column:
        return F.col(term).rlike(self.whole) if isinstance(term, str) else term.rlike(self.whole)


def begins(column: str, head: str) -> Column:
    """A range of a sorted column, so that a scan skips what lies outside of it."""
    return (F.col(column) >= head) & (F.col(column) < head + LAST)


def terms_like(index: Index, typed: str) -> DataFrame:
    """(term) of the dictionary's terms that fit the pattern: a range of terms where it has a head, else of terms read backwards where
    it has a tail, else all of them."""
    p = Pattern.of(typed)
    if p.head or not p.tail:
        rows = index.terms.where(begins("term", p.head)) if p.head else index.terms
        return rows.where(p.fits("term")).select("term").distinct()
    return index.backwards.where(begins("reversed", p.tail[::-1])).select(F.reverse("reversed").alias("term")).where(p.fits("term")).distinct()


def pattern_lookup(index: Index, typed: str) -> DataFrame:
    """(key) of documents with a term that fits the pattern."""
    head = Pattern.of(typed).head
    rows = index.postings.where(begins("term", head)) if head else index.postings
    return rows.join(terms_like(index, typed), "term", "left_semi").select(index.key).distinct()


def patterns_lookup(index: Index, typed: tuple[str, ...]) -> DataFrame:
    """(pattern, key) of documents with a term that fits, for several patterns in one pass over the dictionary and one over postings."""
    at = {f"p{k}": p for k, p in enumerate(dict.fromkeys(typed))}
    terms = index.terms.select("term", *(Pattern.of(p).fits("term").alias(c) for c, p in at.items())).where(reduce(Column.__or__, map(F.col, at)))
    found = index.postings.select("term", index.key).join(terms, "term").groupBy(index.key).agg(*(F.bool_or(c).alias(c) for c in at))
    return found.select(F.explode(F.array_compact(F.array(*(F.when(F.col(c), F.lit(p)) for c, p in at.items())))).alias("pattern"), index.key)


# Ranking


def rarity(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def impact(tf, length, mean: float, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a document's score, but for its rarity."""
    return col(tf) * (k1 + 1) / (col(tf) + k1 * (1 - b + b * col(length) / mean))


@dataclass(frozen=True)
class Ranked:
    """scores (key, score) of the documents in the blocks that were needed; needed and all blocks with one of the terms."""

    scores: DataFrame
    needed: DataFrame
    bounds: DataFrame


def ranked(index: Index, terms: tuple[str, ...], most: int, hits: DataFrame | None = None) -> Ranked:
    """Scores of documents among which are the best so many of those with any of the terms (and among hits, if given).

    A block's bound is the sum over terms of rarity and greatest impact. The blocks with the highest bounds are scored first, as many as
    rows are wanted and FIRST_BLOCKS at least (of one term each holds a document that reaches its bound); then all whose bound reaches
    the score of the last of the best there. The driver gets a row for each term, those blocks, and the best.
    """
    terms = tuple(dict.fromkeys(words_of(terms)))
    if not terms:
        raise ValueError("ranking needs a term")
    n = index.stats.count()
    own = index.blocks.where(F.col("term").isin(*terms))
    weights = {r["term"]: rarity(n, r["df"]) for r in own.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = F.lit(0.0)
    for term, w in weights.items():
        weight = F.when(F.col("term") == term, F.lit(w)).otherwise(weight)
    bounds = own.groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"))
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(FIRST_BLOCKS, most)).collect()]

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("term").isin(*terms))
        rows = rows if hits is None else rows.join(hits.select(index.key), index.key, "left_semi")
        return rows.groupBy(index.key).agg(F.round(F.sum(weight * F.col("impact")), 6).alias("score"))

    best = scored(index.impacts.where(F.col("block").isin(first))).orderBy(F.desc("score"), index.key).limit(most).collect()
    least = best[-1]["score"] if len(best) == most else 0.0
    needed = bounds.where((F.col("bound") >= least - 1e-6) | F.col("block").isin(first)).select("block")
    return Ranked(scored(index.impacts.join(needed, "block", "left_semi")), needed, bounds)


# Segments


def save(rows: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """rows as Parquet, and read back."""
    spark = rows.sparkSession
    with settings(spark, FREED):
        rows.write.option("compression", "zstd").mode(mode).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def save_in_order(rows: DataFrame, path: str, *order: str) -> DataFrame:
    return save(rows.repartitionByRange(*order).sortWithinPartitions(*order), path)


def write_numbers(stats: DataFrame, at: str, key: str) -> DataFrame:
    """(key, length, block) of a version: documents are numbered by length, so that blocks differ in what they can reach. Lengths are
    written before they are sorted, as a range sort reads its rows twice, and numbers too: the ranges aren't the same each time."""
    ranges = save(stats.select(key, "length"), f"{at}/lengths").repartitionByRange("length", key).sortWithinPartitions("length", key)
    return save(ranges.select(key, "length", block_of(F.monotonically_increasing_id())), f"{at}/numbers")


def block_of(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS).alias("block")


def numbered(rows: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """Postings with length and block; rows of one key have the length of all."""
    return rows.join(numbers.groupBy(key).agg(F.sum("length").alias("length"), F.min("block").alias("block")), key, "left")


def in_blocks(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, content, block) of documents with a row each: blocks of those of like length, as far as a task holds such, so no text is
    shuffled."""
    return docs.select(key, content).sortWithinPartitions(F.length(content)).select(key, content, block_of(F.monotonically_increasing_id()))


def cuts(looked_at: DataFrame, share: float) -> list[tuple[str, int]]:
    """(term, block) where ranges begin, of postings of which such a share is looked at; a common term may be several ranges. Only how
    even the ranges are depends on what is looked at."""
    n = looked_at.count()
    some = looked_at if n <= LOOKED_AT_ROWS else looked_at.sample(LOOKED_AT_ROWS / n, 5)
    found = sorted((r["term"], r["block"] or 0) for r in some.collect())
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(n / share / RANGE_ROWS)))
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def with_range(rows: DataFrame, begins: list[tuple[str, int]]) -> DataFrame:
    """rows with part, the number of ranges that begin at or before (term, block), by halving."""
    known = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(b).cast("long").alias("block")) for t, b in begins))
    own, rows = F.struct("term", F.coalesce("block", F.lit(0).cast("long")).alias("block")), rows.withColumn("part", F.lit(0))
    for bit in reversed(range(len(begins).bit_length())):
        reached = F.coalesce(F.get(known, F.col("part") + ((1 << bit) - 1)) <= own, F.lit(False))
        rows = rows.withColumn("part", F.col("part") + F.when(reached, 1 << bit).otherwise(0))
    return rows


def write_version(rows: DataFrame, stats: DataFrame, hidden: DataFrame | None, at: str, key: str, begins: list[tuple[str, int]]) -> None:
    """One version: postings, the dictionary both ways, for a segment the hidden keys, for a whole one the mean length and blocks, and the
    documents with the mark at last. rows are postings with length and block; stats are the documents: (key, length, block), or (key, none), where
    none is the length of one without postings and the others' are taken from those."""
    spark, order = rows.sparkSession, ["term", "block", key]
    rows = rows.select("term", key, "tf", "positions", F.col("block").cast("long"), F.col("length").cast("long"))
    dealt = with_range(rows, begins)
    with settings(spark, FREED | {"spark.sql.maxConcurrentOutputFileWriters": str(len(begins) + 1)}):  # no sort by range
        dealt.write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/unsorted")
    unsorted = spark.read.schema(dealt.schema).parquet(f"{at}/unsorted")

    def each(make) -> DataFrame:
        """What make gives of each range, which is one task's."""
        return reduce(DataFrame.unionAll, (make(unsorted.where(F.col("part") == k).drop("part").coalesce(1)) for k in range(len(begins) + 1)))

    postings = save(each(lambda df: df.sortWithinPartitions(*order)), f"{at}/postings")
    if "block" not in stats.columns:
        held = unsorted.groupBy(F.col(key).alias("held_key")).agg(F.first("length").alias("length"), F.first("block").alias("block"))
        stats = stats.join(held, F.col(key).eqNullSafe(F.col("held_key")), "left").select(key, F.coalesce("length", "none").alias("length"), "block")
    documents = save(stats.select(key, F.col("length").cast("long"), F.col("block").cast("long")), f"{at}/found")
    if hidden is None:
        mean = documents.agg(F.avg("length")).first()[0] or 1.0
        save(spark.range(1).select(F.lit(mean).alias("mean")), f"{at}/mean")
        most = F.max(impact(F.col("tf").cast("double"), "length", mean))
        save(each(lambda df: df.where("block is not null").groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), most.alias("most")).sortWithinPartitions("term", "block")), f"{at}/blocks")
    remove(spark, f"{at}/unsorted")
    terms = save_in_order(dictionary(postings.select("term")), f"{at}/terms", "term")
    save_in_order(terms.select(F.reverse("term").alias("reversed"), "df"), f"{at}/backwards", "reversed")
    if hidden is not None:
        save(hidden.select(key).distinct(), f"{at}/hidden")
    save(documents, f"{at}/documents")
    remove(spark, f"{at}/found")


def write_documents(docs: DataFrame, hidden: DataFrame | None, at: str, key: str, content: str) -> None:
    """A version of these documents' texts."""
    n = max(1, docs.count())
    apart = max(1, n // LOOKED_AT)
    some = lambda df: df.where(F.pmod(F.xxhash64(key), F.lit(apart)) == 0)
    if one_row_each(docs, key):
        docs = docs.select(key, content)
        found = in_blocks(docs, key, content)
        begins = cuts(placed(some(found), key, content, ("block",)).select("term", "block"), 1 / apart)
        none = F.when(F.col(content).isNotNull(), 0).alias("none")
        write_version(placed(found, key, content, ("block",)), docs.select(key, none), hidden, at, key, begins)
        return
    numbers = write_numbers(doc_stats(docs, key, content), at, key)
    rows = numbered(positional(docs, key, content), numbers, key)
    begins = cuts(numbered(positional(some(docs), key, content), numbers, key).select("term", "block"), 1 / apart)
    write_version(rows, numbers, hidden, at, key, begins)


def rebuild(docs: DataFrame, path: str, key: str = "doc_key", content: str = "content") -> None:
    """Writes the index anew, as a whole version beside the old ones: readers keep theirs."""
    write_documents(docs, None, f"{path.rstrip('/')}/{versions.name(versions.WHOLE)}", key, content)


def add_segment(docs: DataFrame, hidden: DataFrame, path: str, key: str = "doc_key", content: str = "content") -> None:
    """Adds a segment of these documents, which hides the older documents whose keys are in hidden (changed or deleted ones). Older
    segments are neither read nor written."""
    write_documents(docs, hidden, f"{path.rstrip('/')}/{versions.name(versions.PART)}", key, content)


def all_of(spark: SparkSession, found: list[str], name: str, *columns: str) -> DataFrame:
    """A table of these versions, with segment, the place of the version among them."""
    parts = (spark.read.parquet(f"{p}/{name}").select(*(columns or "*")).withColumn("segment", F.lit(k)) for k, p in enumerate(found))
    return reduce(DataFrame.unionByName, parts)


def hidden_in(spark: SparkSession, found: list[str], key: str) -> DataFrame:
    """(hidden_key, by): keys that segments hide, and the last one that does."""
    later = [(k, p) for k, p in enumerate(found) if not versions.is_whole(p)]
    parts = (spark.read.parquet(f"{p}/hidden").select(F.col(key).alias("hidden_key"), F.lit(k).alias("by")) for k, p in later)
    return reduce(DataFrame.unionByName, parts).groupBy("hidden_key").agg(F.max("by").alias("by"))


def live(rows: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    return rows.join(hidden, (F.col(key) == F.col("hidden_key")) & (F.col("segment") < F.col("by")), "left_anti")


def read(spark: SparkSession, path: str, key: str = "doc_key") -> Index:
    """The index as it is now: what no later segment hides."""
    found = versions.current(spark, path, MARK)
    if not found:
        raise FileNotFoundError(f"no whole index in {path}")
    postings, stats = all_of(spark, found, "postings", *POSTING, key), all_of(spark, found, "documents", key, "length")
    terms, backwards = all_of(spark, found, "terms").drop("segment"), all_of(spark, found, "backwards").drop("segment")
    if len(found) == 1:
        blocks = {}
        if versions.is_whole(found[0]):
            rows = spark.read.parquet(f"{found[0]}/postings").where("block is not null").join(F.broadcast(spark.read.parquet(f"{found[0]}/mean")))
            reached = impact(F.col("tf").cast("double"), "length", F.col("mean"))
            blocks = {"impacts": rows.select("term", "block", key, reached.alias("impact")), "blocks": spark.read.parquet(f"{found[0]}/blocks")}
        return Index(postings.drop("segment"), stats.drop("segment"), terms, backwards, key, **blocks)
    hidden = hidden_in(spark, found, key)
    return Index(live(postings, hidden, key).drop("segment"), live(stats, hidden, key).drop("segment"), terms, backwards, key)


def merge(spark: SparkSession, path: str, key: str = "doc_key") -> int:
    """Folds the segments into one whole version without what is hidden, and removes what was replaced before the last merge. Segments
    that come meanwhile stay as they are. Returns how many were folded; nothing is done with fewer than two.

    Postings keep their blocks, those of each segment behind the last one's, unless blocks have become less than half full: then all
    documents are numbered anew, and postings joined with their numbers."""
    found = versions.current(spark, path, MARK)
    if len(found) < 2:
        return 0
    at = f"{path.rstrip('/')}/{versions.name(versions.WHOLE, versions.time_of(found[-1]))}"
    hidden = save(hidden_in(spark, found, key), f"{at}/hiding")
    hidden = F.broadcast(hidden) if hidden.count() <= BROADCAST_KEYS else hidden
    rows = live(all_of(spark, found, "postings", *POSTING, key, "length", "block"), hidden, key)
    documents = live(all_of(spark, found, "documents", key, "length", "block"), hidden, key)
    ends = {r["segment"]: r["n"] for r in all_of(spark, found, "documents", "block").groupBy("segment").agg((F.coalesce(F.max("block"), F.lit(-1)) + 1).alias("n")).collect()}
    starts = F.lit(0).cast("long")
    for k in range(1, len(found)):
        starts = F.when(F.col("segment") == k, sum(ends.get(x, 0) for x in range(k))).otherwise(starts)
    rows, documents = (df.withColumn("block", F.col("block") + starts).drop("segment") for df in (rows, documents))
    full = documents.where("block is not null").groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    if full is not None and full < (1 << BLOCK_BITS) / 2:
        documents = write_numbers(documents, at, key)
        rows = numbered(rows.drop("length", "block"), documents, key)
    n = rows.count()
    apart = max(1, n // LOOKED_AT_ROWS)
    begins = cuts(rows.where(F.pmod(F.xxhash64("term", key), F.lit(apart)) == 0).select("term", "block"), 1 / apart)
    write_version(rows, documents, None, at, key, begins)
    remove(spark, f"{at}/hiding")
    versions.remove_old(spark, path, MARK)
    return len(found)
