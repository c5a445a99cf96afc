"""Packing by first-fit decreasing in randomised groups of documents, with a tournament tree of bin capacities.

A document's ids (with the closing id) are cut at multiples of the sequence length; full pieces are sequences of their own, and
what remains of each document is packed whole: within a group, largest first, each into the first sequence that has room. The
tree keeps the most room of any sequence below each node, so the first that fits is found in as many steps as the tree is deep.
Groups are drawn by hash and hold about GROUP_ROWS documents whatever the input's size; each is packed alone, in one task.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_returned, stored, text_column
from .tokens import WordTokens

LENGTH = 2048
CLOSING = 1
GROUP_ROWS = 8192
PIECES = "array<struct<start: long, length: long, crc: long, ids: binary>>"


def pieces(text="text", length: int = LENGTH, closing: int = CLOSING, path: str | None = None, keep_ids: bool = False):
    """A struct column with doc_tokens and pieces (PIECES; ids only if they are to be kept). A null text has the closing id alone."""

    def make():
        memory_returned()
        words = WordTokens(path)
        end = struct.pack("<I", closing)

        def cut(entries):
            data = b"".join([*entries, end])
            parts = [data[at : at + 4 * length] for at in range(0, len(data), 4 * length)]
            return len(data) // 4, [(k * length, len(p) // 4, zlib.crc32(p), p if keep_ids else None) for k, p in enumerate(parts)]

        return lambda texts: list(zip(*map(cut, words.of(texts)), strict=True))

    return text_column(make, f"doc_tokens long, pieces {PIECES}")(text)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size (none above the capacity), the number of its bin and the place in it where it begins."""
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, places = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], places[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, places


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if they are kept).

    Null and empty texts are one piece of the closing id; repeated rows are packed apart; an empty table gives no rows; other
    columns are left out. A text of more tokens than a sequence is cut into several pieces; pieces of one length are packed in
    the order of their rows. Sequence ids are unique over all groups, not gapless.
    """
    cut = stored(docs.select("doc_id", pieces(docs["text"], length, path=path, keep_ids=keep_ids).alias("p")).select("doc_id", "p.doc_tokens", "p.pieces"))
    groups = max(1, -(-cut.count() // GROUP_ROWS))
    # Rows of the written table are numbered, so equal rows too go to different groups, and to the same ones in a retried task.
    rows = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("row", F.lit("packing")), F.lit(groups)))
    flat = rows.select("doc_id", "doc_tokens", "row", "group", F.inline("pieces"))
    flat = flat if keep_ids else flat.drop("ids")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], kind="stable", ignore_index=True)
        bins, places = first_fit_decreasing(group["length"].to_numpy(), length)
        out = group.rename(columns={"crc": "ids_crc32"}).assign(sequence_id=group["group"].to_numpy() * (1 << 32) + bins, offset=places)
        return out[names]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return flat.groupBy("group").applyInPandas(pack, schema)
