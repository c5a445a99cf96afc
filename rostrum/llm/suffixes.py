"""Exact substring dedup: suffixes are sorted to a depth of LENGTH bytes by bucket-pointer refinement.

A suffix's first bucket is its q-gram, and its bucket pointer that bucket's number. A bucket is refined by sorting its suffixes on
the pointers at a later offset, and the numbers of the new buckets become its suffixes' pointers, so that the next step reads at
its offset what the one before has refined: pointers of 32 bytes give pointers of 64, and these of 100. Suffixes alone in
their bucket are done. What remains together after the last step is compared byte by byte; all but the earliest of such a
class are repeats.

To let machines sort apart from each other, suffixes are grouped by content. Of the q-grams in a window of LENGTH bytes the
one with the least hash is the window's anchor, so equal windows have equal anchors at equal places. Only anchors whose q-gram
occurs twice are sorted; each brings the stretch of text whose windows it anchors. Where stretches are cut from texts, of equal
ones only the earliest goes on with its bytes; the others are repeats as a whole. An anchor that occurs over HOT times brings
its stretch in CUTS parts, each named by all the bytes that its windows share, so that its group is many. The sort runs in
groups of anchors, some CHUNK_BYTES at a time.

Equal texts are one node: all rows but that of the least doc_id are repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_column

LENGTH = 100
Q = 32
#: Positions of a piece of text that is searched for anchors at once; a power of two that the low bits of a key can number.
PIECE = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
CHUNK_BYTES = 2 << 20
#: Occurrences up to which an anchor's stretches (some 200 bytes each) are named by the anchor alone; beyond it, they come in parts.
HOT = 20_000
CUTS = 4
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def identifiers(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The bucket identifier of the q-gram (q a power of two) at each place: from those of its halves, by doubling."""
    h, base = data.astype(np.uint64) * MIX[1] + MIX[0], int(MIX[0])
    h ^= h >> np.uint64(29)
    size = 1
    while size < q:
        if len(h) <= size:
            return h[:0]
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of the windows in data, in order: its q-gram's identifier, its place, the first and the last window that it anchors."""
    n, wide = len(data) - length + 1, length - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    ids = identifiers(data, q)
    least = (ids & ~PLACE) | np.arange(len(ids), dtype=np.uint64)  # of equal ones the first
    size = 1
    while size < wide:
        step = min(size, wide - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least[:n] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return ids[at[first]], at[first], first, np.append(first[1:], n) - 1


def pieces(data: bytes, length: int = LENGTH):
    """(place, bytes) of a text's pieces: each has the windows that start in its PIECE places."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(1, len(raw) - length + 1), PIECE):
        yield at, raw[at : at + PIECE + length - 1]


def text_anchors(text="text"):
    """An array column of the identifiers of a text's anchors, in order."""

    def make():
        def of(text):
            found = [anchors(part)[0] for _, part in pieces((text or "").encode("utf-8", "surrogatepass"))]
            return np.concatenate(found).view(np.int64)

        def apply(texts):
            found = [of(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))]

        return apply

    return text_column(make, "ids array<long>")(text)["ids"]


STRETCHES = "array<struct<anchor: long, start: long, end: long, bytes: binary>>"


def parts_of(raw: bytes, anchor: int, place: int, first: int, last: int, hot: bool) -> Iterator[tuple[int, int, int]]:
    """(name, start, end) of the stretch of windows first to last around an anchor's place; of a hot one, of its parts, cut at equal
    distances from the anchor whatever windows there are."""
    if not hot:
        yield anchor, first, last + LENGTH
        return
    width = -(-(LENGTH - Q + 1) // CUTS)
    for k in range(CUTS):
        low, high = place - min((k + 1) * width - 1, LENGTH - Q), place - k * width
        a, b = max(first, low), min(last, high)
        if a <= b:  # the anchor and what lies around it in every window of this part, whether here or not
            yield xxhash.xxh64_intdigest(raw[high : low + LENGTH], k) - (1 << 63), a, b + LENGTH


def stretches(text, chosen, node, id):
    """An array column: for each chosen anchor its name, and place and bytes of its stretch, or of its parts.

    chosen has the anchors' numbers in the order of text_anchors, doubled, plus one for a hot anchor. Of equal stretches in
    a slice of rows the earliest alone has bytes; the others, repeats as a whole, have a name that spreads them.
    """
    fields = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())]))

    def of(text, which, doc, earliest):
        wanted, before, found = np.unique(np.array(which or [], dtype=np.int64)), 0, []
        wanted, hot = wanted >> 1, wanted & 1 == 1
        for at, data in pieces((text or "").encode("utf-8", "surrogatepass")) if len(wanted) else ():
            ids, places, first, last = anchors(data)
            among = (wanted >= before) & (wanted < before + len(ids))
            here = wanted[among] - before
            before += len(ids)
            raw = data.tobytes()
            for row in zip(*(x[here].tolist() for x in (ids.view(np.int64), places, first, last)), hot[among].tolist(), strict=True):
                for name, a, b in parts_of(raw, *row):
                    item = [name, at + a, at + b, raw[a:b]]
                    key, mine = (name, item[3]), (doc, item[1])
                    other = earliest.get(key)
                    if other and other[0] == mine:  # a document given twice
                        continue
                    found.append(item)
                    if other is None or mine < other[0]:
                        earliest[key] = (mine, item)
                        item, mine = (other[1], other[0]) if other else (None, None)
                    if item:
                        item[0], item[3] = xxhash.xxh64_intdigest(repr(mine)) - (1 << 63), None
        return found

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *columns in batches:
            at, parts = 0, []
            for part in slices(texts):
                numbers, nodes, ids = (c.slice(at, len(part)).to_pylist() for c in columns)
                at += len(part)
                earliest: dict = {}
                rows = [of(text, which, doc, earliest) for text, which, doc in zip(part.to_pylist(), numbers, zip(ids, nodes, strict=True), strict=True)]
                parts.append(pa.array([[dict(zip(("anchor", "start", "end", "bytes"), x, strict=True)) for x in found] for found in rows], fields))
            yield pa.concat_arrays(parts) if parts else pa.array([], fields)

    return F.arrow_udf(run, returnType=STRETCHES)(text, chosen, node, id)


def refined(pointers: np.ndarray, active: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """One step: the suffixes at the active places, those together in a bucket, are sorted on their own pointer and that at
    offset. Gives all pointers anew, and the places that are still not alone in their bucket."""
    own, later = pointers[active], pointers[active + offset]
    order = np.lexsort((later, own))
    ranked, after = own[order], later[order]
    number = np.cumsum(np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (after[1:] != after[:-1])])) - 1 if len(order) else order
    now = pointers.copy()
    now[active[order]] = number + pointers.max(initial=0) + 1  # numbers that no other suffix has
    together = np.bincount(number, minlength=1)[number] > 1
    return now, np.sort(active[order[together]])


def same_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at places a equal those at b, byte by byte."""
    span = np.arange(length)
    out = [(data[a[k : k + 8192, None] + span] == data[b[k : k + 8192, None] + span]).all(axis=1) for k in range(0, len(a), 8192)]
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def repeats(stretches: list[bytes], length: int = LENGTH, q: int = Q) -> list[tuple[int, int, int]]:
    """(stretch, first, end) of the runs of bytes covered by windows that an earlier stretch, or an earlier place in it, holds too.

    Stretches come in the order that says which is earlier; no place is in two. q is a power of two and over a quarter of length.
    """
    sizes = np.array([len(s) for s in stretches], dtype=np.int64)
    data = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    room = np.repeat(begin + sizes, sizes) - np.arange(len(data))  # bytes from each place to its stretch's end
    ids = identifiers(data, q)
    pointers = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    pointers = np.concatenate([pointers, np.full(len(data) - len(pointers), -1)])
    known = q
    places = np.flatnonzero(room >= q)
    active = places[np.bincount(pointers[places], minlength=1)[pointers[places]] > 1]
    while known < length:
        offset = min(known, length - known)
        here = active[room[active] >= known + offset]
        pointers, active = refined(pointers, here, offset)
        known += offset
    if not len(active):
        return []
    order = np.argsort(pointers[active], kind="stable")  # places are in order, so the first of a bucket is the earliest
    ranked, members = pointers[active][order], active[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    head = members[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    later, head, bucket = members[~fresh], head[~fresh], ranked[~fresh]
    same = same_windows(data, later, head, length)
    found = later[same]
    if not same.all():  # two q-grams with one identifier: such buckets are told apart by their bytes
        seen, raw = set(), data.tobytes()
        for p in np.sort(members[np.isin(ranked, bucket[~same])]).tolist():
            window = raw[p : p + length]
            if window in seen:
                found = np.append(found, p)
            seen.add(window)
        found = np.unique(found)
    found = np.sort(found)
    if not len(found):
        return []
    owner = np.searchsorted(begin, found, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(owner) > 0)]))
    ends = np.append(cut[1:], len(found)) - 1
    return [(int(o), int(a - begin[o]), int(b - begin[o]) + length) for o, a, b in zip(owner[cut], found[cut], found[ends], strict=True)]


def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows (anchor, id, node, start, bytes, end) sorted by the first four: rows (node, id, start, end) of
    repeats. A row without bytes is one."""
    held: list[tuple] = []
    size, last = 0, None

    def result(found: list[tuple[tuple, int, int]]) -> pa.RecordBatch:
        columns = [[r[2] for r, _, _ in found], [r[1] for r, _, _ in found], [r[3] + a for r, a, _ in found], [r[3] + b for r, _, b in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "id", "start", "end"])

    def flush() -> pa.RecordBatch:
        rows = sorted(held, key=lambda r: r[1:4])
        rows = [r for k, r in enumerate(rows) if not k or r[1:4] != rows[k - 1][1:4]]  # a document given twice is one
        return result([(rows[o], a, b) for o, a, b in repeats([r[4] for r in rows])])

    for batch in batches:
        later = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[4] is None:
                later.append((row, 0, row[5] - row[3]))
                continue
            if row[0] != last and size >= CHUNK_BYTES:
                yield flush()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[4]), row[0]
        if later:
            yield result(later)
    if held:
        yield flush()


def kept(text, is_first, runs):
    """A struct column: n_bytes, n_removed, n_spans and the remaining bytes, for a text, whether its node's first document is
    here, and the repeats in it (array<struct<start, end>>, any order, may overlap)."""
    schema = "n_bytes long, n_removed long, n_spans long, remaining binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def of(text, first, runs):
        data = (text or "").encode("utf-8", "surrogatepass")
        if not first:
            return (len(data), 0, 0, data) if len(data) < LENGTH else (len(data), len(data), 1, b"")
        spans, out, at, removed, end = 0, [], 0, 0, -1
        for a, b in sorted((r["start"], r["end"]) for r in runs or ()):
            if a > end:
                out.append(data[at:a])
                spans, removed, end, at = spans + 1, removed + b - a, b, b
            elif b > end:
                removed, end, at = removed + b - end, b, b
        return len(data), removed, spans, b"".join([*out, data[at:]])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, firsts, runs in batches:
            at, parts = 0, []
            for part in slices(texts):
                n = len(part)
                rows = [of(*x) for x in zip(part.to_pylist(), firsts.slice(at, n).to_pylist(), runs.slice(at, n).to_pylist(), strict=True)]
                at += n
                parts.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["n_bytes", "n_removed", "n_spans", "remaining"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(["n_bytes", "n_removed", "n_spans", "remaining"], kinds, strict=True))))

    return F.arrow_udf(run, returnType=schema)(text, is_first, runs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and kept's columns for every row of docs: each text without the bytes of LENGTH-byte strings that start earlier too.

    A text's first document is the row of its hash and least doc_id. Texts are joined by these two three times, over one shuffle
    of docs (so the same columns each time) that the plan reuses, and copies of one text are spread by their ids. Null texts are empty. A document given twice
    (equal doc_id and text) is one, and both rows get the same values; of different texts under one doc_id the one with the
    lesser hash is earlier; a null doc_id is earlier than any. Long texts are searched in overlapping pieces. Other columns are left out; an
    empty table gives no rows.
    """
    on = ["node", "id"]
    text, none = F.coalesce("text", F.lit("")), F.lit(-(1 << 63))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("node"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"))
    firsts = rows.groupBy("node").agg(F.min("id").alias("id"))
    own = rows.join(firsts, on)
    found = own.select(*on, F.posexplode(text_anchors(F.col("text"))).alias("number", "anchor"))
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).cast("int").alias("hot"))
    twice = cut(twice)  # read anew, so that a hot anchor's rows can be split in the join
    chosen = found.join(twice, "anchor").groupBy(on).agg(F.collect_list(F.col("number") * 2 + F.col("hot")).alias("chosen"))
    source = rows.join(chosen, on)
    parts = source.select(*on, F.explode_outer(stretches(F.col("text"), F.col("chosen"), F.col("node"), F.col("id"))).alias("s")).select("s.anchor", "id", "node", "s.start", "s.bytes", "s.end").where("anchor is not null")
    order = ["anchor", "id", "node", "start"]
    repeated = parts.repartition("anchor").sortWithinPartitions(*order).mapInArrow(sort_groups, "node long, id long, start long, end long")
    runs = repeated.groupBy(on).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    table = firsts.join(runs, on, "left").withColumn("first", F.lit(True))
    doc_id = F.nullif("id", none).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    marked = rows.join(table, on, "left").select(doc_id, kept(F.col("text"), F.col("first"), F.col("runs")).alias("k"))
    return marked.select("doc_id", "k.*")


def substring_report(docs: DataFrame) -> DataFrame:
    """without_repeats with the remaining bytes as a digest."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("remaining", 256).alias("kept_sha256"))


def removed_runs(data: list[bytes], length: int = LENGTH) -> list[str]:
    """What substring_report must give for documents in order, by brute force: (n_removed, n_spans, digest) of each. For tests."""
    seen: set[bytes] = set()
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - length + 1):
            window = d[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out
