"""What users do, from a log of events: history, trends, sessions and exports; as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(events: DataFrame, most: int = 50) -> DataFrame:
    """Each user's last events."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("k", k).where(F.col("k") <= most).drop("k")


def in_time(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark on ts, which takes times with a zone alone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts_by_window(events: DataFrame, length: str = "1 day", late: str | None = None, what: str = "event_type") -> DataFrame:
    """(start, what, n) in tumbling windows; with late, for streams: events later than that are dropped and windows closed."""
    rows = in_time(events, late) if late else events
    return rows.groupBy(F.window("ts", length).alias("w"), what).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), what, "n")


def trending(events: DataFrame, length: str = "1 day", most: int = 3, what: str = "event_type") -> DataFrame:
    """The commonest of each window, ties by name."""
    return top_of_windows(counts_by_window(events, length, what=what), most, what)


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(order) > gap_minutes * 60_000_000).cast("int"), F.lit(1))
    marked = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).drop("session")


def session_windows(events: DataFrame, gap_minutes: int = 30, late: str | None = None) -> DataFrame:
    """sessions as windows that the engine keeps as state: with late, for streams, a session is given once no event that late can
    join it, and later events are dropped."""
    rows = in_time(events, late) if late else events
    session = F.session_window("ts", f"{gap_minutes} minutes").alias("session")  # a gap of exactly that doesn't end it
    return rows.groupBy("user_id", session).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session.start").alias("start"), "n")


def dropped(query) -> int:
    """What a stream has dropped as it came after the watermark, over the progress that it remembers; rows of one batch that make one
    session or window count once, as they are added up before."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def written(rows: DataFrame, sink: str, checkpoint: str):
    """A stream into a table, for rows that are final when they come (append)."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def top_of_windows(counts: DataFrame, most: int = 3, what: str = "event_type") -> DataFrame:
    """The commonest of each window of counts_by_window, ties by name."""
    k = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), what))
    return counts.withColumn("k", k).where(F.col("k") <= most).drop("k")


def monthly(events: DataFrame, kind: str) -> DataFrame:
    """(month, n) of events of a kind."""
    return events.where(F.col("event_type") == kind).groupBy(F.trunc(F.col("ts").cast("date"), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
