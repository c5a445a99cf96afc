"""The corpus's tables: one row for each document of a sitting, its metadata files, and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import types as T

#: What transcripts and their writers put where a part has no speaker.
NO_SPEAKER = "No speakers identified"
#: Rank of a document that its sitting's contents don't list.
UNLISTED = 9999
#: Date of undated documents in the index view.
UNDATED = "2010-01-01"

DOCUMENT = T.StructType(
    [
        T.StructField("doc_key", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("sitting_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("speaker2", T.StringType()),
        T.StructField("speakers", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
STATE = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("indexed_at", T.TimestampType())])
REGISTRY_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "filename", "date", "processed_dir", "processed_date")])
REPORT = T.StructType([T.StructField("directory", T.StringType()), T.StructField("total_parts", T.LongType()), T.StructField("questions_extracted", T.LongType()), T.StructField("date", T.StringType()), T.StructField("parliament", T.StringType())])
SITTING = T.StructType([T.StructField(n, T.StringType()) for n in ("date", "parliament", "session", "meeting", "day_of_week", "sitting_type")])

# English month names, full and short.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_NUMBERS = {m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"Sept": 9}
