"""Mixing sources to target weights: tokens are added up per source, each source gets a repetition rate, and each document is
emitted floor(rate) times plus one more time where a hash-seeded draw falls below the rate's fraction.

Tokens are words here. Sources by code point, null last, weigh WEIGHTS in turn, and share SHARE of all words; no target
passes CAP times its source's words, and what is cut off goes to the others by weight until none is above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
#: With at most so many sources (some 100 bytes each) their targets are broadcast; beyond it a sort-merge join splits hot sources.
BROADCAST_SOURCES = 50_000


def words_in(text="text"):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def numbered(df: DataFrame, *by) -> DataFrame:
    """df with n, 0-based in this order, without bringing all rows to one task: a range sort, then each partition's offset.

    df must be free of ties in the order. The offsets are a table of one row for each partition.
    """
    sorted_ = cut(df.orderBy(*by).withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sorted_.join(F.broadcast(offsets.select("part", "before")), "part").withColumn("n", F.col("before") + F.col("k")).drop("part", "k", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rate from (source, source_size), one row for each source.

    A round adds up the sources at their cap and the weight of the rest; the level (words for each unit of weight) only rises,
    so at most as many rounds run as there are different caps. Two sums reach the driver in each.
    """
    at = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    table = cut(numbered(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", at.alias("weight"), (F.col("source_size") * cap).alias("most")))
    goal = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, seen = -1.0, None
    while True:
        full = F.col("most") <= F.col("weight") * level
        now = table.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if now == seen or not now[1]:
            break
        seen, level = now, (goal - now[0]) / now[1]
    target = F.least(F.col("most"), F.col("weight") * F.lit(level)) if seen else F.lit(0.0)
    return table.select("source", "source_size", target.cast("double").alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(seed: str, *columns):
    """A number in [0, 1) that depends on the seed and these columns alone: 32 bits of an md5."""
    key = F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def rated(docs: DataFrame, key: str = "doc_id", seed: str = SEED) -> tuple[DataFrame, str]:
    """docs with one struct column more: size, source_size, target, rate, copies; and that column's name.

    The table of targets has one row for each source; nothing groups by source but partial sums, so a hot one is no matter.
    """
    name = unused(docs)
    sized = docs.withColumn(name, words_in("text"))
    table = targets(sized.groupBy("source").agg(F.sum(name).alias("source_size")))
    sides = table.select(F.col("source").alias(f"{name}_source"), F.struct("source_size", "target", "rate").alias(f"{name}_of"))
    sides = F.broadcast(sides) if table.count() <= BROADCAST_SOURCES else sides.hint("merge")
    joined = sized.join(sides, F.col("source").eqNullSafe(F.col(f"{name}_source")))
    of = F.col(f"{name}_of")
    mark = F.struct(F.col(name).alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), of["rate"].alias("rate"))
    out = joined.withColumn(name, mark)
    rate = F.col(f"{name}.rate")
    copies = F.floor(rate) + (draw(seed, key) < rate - F.floor(rate)).cast("long")
    return out.withColumn(name, F.col(name).withField("copies", copies.cast("long"))).select(*docs.columns, name), name


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs.

    Null texts have size 0, a null source is a source of its own, repeated rows (equal doc_id) draw alike, sources without a
    word have target 0, sources of equal size are told apart by name, long texts are counted whole, and an empty table gives no rows.
    """
    out, name = rated(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", f"{name}.size", f"{name}.source_size", f"{name}.target", (F.col(f"{name}.size") * F.col(f"{name}.copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as its copies say, with its columns as they are. Rows of size 0 (null and empty texts)
    follow their source's rate too; repeated rows draw alike; an empty table gives no rows."""
    out, name = rated(docs)
    return out.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(f"{name}.copies").cast("int")))).select(docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM per
), filled AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS before, (SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER w, 0) AS rest, (SELECT 1.5::DOUBLE * sum(source_size) FROM ranked) AS goal
  FROM ranked WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((goal - before) / rest) AS l FROM filled -- it rises while the caps below it are taken out, then falls
), goals AS (
  SELECT source, source_size, least(most, weight * coalesce(l, 0)) AS target FROM ranked, level
), rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""
