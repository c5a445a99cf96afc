"""Facets from what is kept beside the rows: bitmaps of documents for each value, and sketches of distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** 14 registers: a standard error of 0.8 %.
SKETCH_BITS = 14
ALL = ""


def bitmaps(docs: DataFrame, fields: tuple[str, ...], number: str = "doc_id") -> DataFrame:
    """(field, value, bucket, bits): for each value of each field the documents that have it, as bitmaps of 32,768 document numbers each;
    the field ALL has all documents. number is an integer column, from 0 and best without large gaps, as a bucket without a document takes no row.
    """
    none = F.lit(None).cast("string")
    marks = F.array(F.struct(F.lit(ALL).alias("field"), none.alias("value")), *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    rows = docs.select(F.col(number).cast("long").alias("number"), F.explode(marks).alias("m")).select("number", "m.*").where(F.col("value").isNotNull() | (F.col("field") == ALL))
    # buckets of the function begin at 1 and bits at 0
    return rows.groupBy("field", "value", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def hit_bitmaps(index: DataFrame, filters: list[list[tuple[str, str]]]) -> DataFrame:
    """(bucket, hits) of documents that meet all filters, each a list of (field, value) of which one has to hold. Without filters all."""
    if not filters:
        return index.where(F.col("field") == ALL).select("bucket", F.col("bits").alias("hits"))
    fits = lambda choice: reduce(Column.__or__, ((F.col("field") == f) & (F.col("value") == v) for f, v in choice))
    which = F.explode(F.filter(F.array(*(F.when(fits(c), F.lit(k)) for k, c in enumerate(filters))), lambda x: x.isNotNull())).alias("filter")
    each = index.where(reduce(Column.__or__, map(fits, filters))).select("bucket", "bits", which).groupBy("filter", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = each.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("hits"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == len(filters)).select("bucket", "hits")


def bitmap_facets(index: DataFrame, fields: tuple[str, ...], filters: list[list[tuple[str, str]]], zero: bool = False) -> DataFrame:
    """(field, value, n) of documents that meet the filters, from bitmaps alone: their rows aren't read. With zero, values without a hit stay."""
    hits = hit_bitmaps(index, filters)
    rows = index.where(F.col("field").isin(*fields)).join(hits, "bucket", "left" if zero else "inner")
    # each bitmap and the hits of its bucket meet in one group; where there are none an empty bitmap counts
    two = rows.select("field", "value", "bucket", F.explode(F.array("bits", F.coalesce("hits", F.unhex(F.lit("00"))))).alias("bits"))
    counts = two.groupBy("field", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy("field", "value").agg(F.sum("n").alias("n"))
    return counts if zero else counts.where("n > 0")


def bitmap_total(index: DataFrame, filters: list[list[tuple[str, str]]]) -> DataFrame:
    return hit_bitmaps(index, filters).agg(F.coalesce(F.sum(F.bitmap_count("hits")), F.lit(0)).cast("long").alias("n"))


def sketches(docs: DataFrame, by: list[str], values: tuple[str, ...]) -> DataFrame:
    """by and a sketch of each column of values: what is distinct in a group, in a few kilobytes, so new days' sketches are added to
    those of old ones without reading the old rows. Nulls aren't values."""
    return docs.groupBy(*by).agg(*(F.hll_sketch_agg(v, SKETCH_BITS).alias(v) for v in values))


def estimated(rows: DataFrame, values: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Numbers of distinct values from sketches, over all rows or by some of their columns."""
    return rows.groupBy(*(by or [])).agg(*(F.hll_sketch_estimate(F.hll_union_agg(v)).alias(v) for v in values))
