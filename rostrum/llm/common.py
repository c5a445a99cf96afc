"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space as every contract here takes it: U+0020 and U+0009 to U+000D, what bytes.split() splits on.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that a Python step holds at once (a longer document alone makes a slice).
SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it names none, on a local
    master alone (tests)."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not here:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        here = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(here)
    return here


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries made inside free their shuffle files when they end, instead of whenever the driver collects garbage: what they
    wrote is read from the shared folder from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for small rows that loops or several readers use."""
    checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # df itself was made outside


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back, for wide rows that several readers use."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str = "found") -> str:
    """A name that no column of df has or begins with, in any case of letters."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def slices(texts: pa.Array):
    """An Arrow array of texts cut into slices of at most SLICE_BYTES (or one text), so that memory doesn't follow batch size."""
    n = len(texts)
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + SLICE_BYTES, side="right")))
        yield texts.slice(at, end - at)
        at = end


def memory_returned() -> None:
    """Gives what earlier tasks of this worker have freed back to the machine, for tasks that need much: workers outlive their tasks, and
    an executor's memory is shared by all of its cores."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def bounded_batches() -> None:
    """Lowers the session's limit on the bytes of an Arrow batch (64 MB by itself) to BATCH_BYTES: a batch stands several times in
    an executor's memory, inside the JVM and out of it, for each of its cores."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark and int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_column(make, schema: str | T.StructType):
    """A function from a text (or binary) column to a struct column.

    make() runs once in each task and gives a function from a list of values, nulls included, to the struct's columns.
    Rows stay where they are: no shuffle, and memory is bounded by SLICE_BYTES and the longest text.
    """
    bounded_batches()
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for texts in batches:
            parts = [
                pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(apply(part.to_pylist()), fields, strict=True)], fields=fields)
                for part in slices(texts)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct(fields))

    return F.arrow_udf(run, returnType=kind)


def edge_summary(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps: each is one aggregate with map-side combine and one join, and each round
    is checkpointed. A hub's neighbours are never gathered into one row. Null ends and loops are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = edge_summary(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
        was, seen = seen, edge_summary(now)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
