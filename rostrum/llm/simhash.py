"""SimHash near-dedup by segment popcounts.

A document's fingerprint has the bits that are set in over half of its shingles' hashes. Two fingerprints link when few bits
differ. To find the links without comparing all pairs, a fingerprint is embedded as the vector of bit counts of its segments:
the Manhattan distance of two such vectors never exceeds the number of differing bits. On that grid a range join at distance 2
is an equality join: each fingerprint is put into its own cell and the cells one step away, and two vectors at distance 2 or
less meet in a cell midway. Candidates are then verified on the bits themselves.

Exact copies share a fingerprint and are one node from the start. A cell's number, least and greatest fingerprint are summed
up before the shuffle, so no cell is ever gathered. A cell of two gives one candidate pair. The fingerprints of fuller cells
go through the same join on the finest grid, segments of one bit: there a cell is a bit string, its members are within one bit
of it, so at most 65 and all linked with one another; each is tied to the least of them.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, stored, text_column, unused

WORDS = 3
DISTANCE = 2
SEED = 42
SEGMENT_BITS = 4
BITS = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the text's word shingles in order, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(found) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # what a byte can count
        part = np.ascontiguousarray(hashes[at : at + 255], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * total > len(hashes)].sum())


def fingerprint(text="text", words: int = WORDS):
    """A long column (the bits as a signed number); null and wordless texts get zero."""

    def make():
        return lambda texts: [[x - (1 << 64) if x >> 63 else x for x in (majority(shingle_hashes(t, words)) for t in texts)]]

    return text_column(make, "bits long")(text)["bits"]


def vector(bits, width: int):
    """The popcounts of a fingerprint's segments, lowest bits first."""
    return [F.bit_count(F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))).cast("int") for at in range(0, BITS, width)]


def cells(fingerprints: DataFrame, width: int) -> DataFrame:
    """(cell, bits): every fingerprint in its own cell and in those one step away in one segment."""
    if width == 1:
        own = F.col("bits")
        near = [own.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(BITS)]
        return fingerprints.select("bits", F.explode(F.array(own, *near)).alias("cell"))
    counts = F.col("counts")
    own = F.aggregate(counts, F.lit(0).cast("long"), lambda key, c: key * (width + 1) + c)
    places = [F.lit(wrapped((width + 1) ** (BITS // width - 1 - k))) for k in range(BITS // width)]
    near = [F.when(counts[k] + step >= 0, F.when(counts[k] + step <= width, own + step * p)) for k, p in enumerate(places) for step in (1, -1)]
    at = fingerprints.withColumn("counts", F.array(*vector(F.col("bits"), width)))
    return at.select("bits", F.explode(F.array_compact(F.array(own, *near))).alias("cell"))


def wrapped(x: int) -> int:
    """x as a signed 64-bit number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def links(fingerprints: DataFrame, width: int = SEGMENT_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in 1 or 2 bits; enough of them to join all that are linked."""
    grid = cells(fingerprints, width).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b")).where("n > 1")
    grid = cut(grid)
    pairs = grid.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    full = grid.where("n > 2").select("cell")
    if full.isEmpty():
        return pairs.distinct()
    dense = cells(fingerprints, width).join(full, "cell", "left_semi").select("bits").distinct()
    balls = cells(dense, 1).groupBy("cell").agg(F.collect_set("bits").alias("all")).where(F.size("all") > 1)  # of 65 at most
    tied = balls.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, bits and component_id (the least doc_id linked to it, through others too) for every row of docs.

    Null and wordless texts share fingerprint zero and are linked like others. Repeated rows are one node. A null doc_id is
    the least of none but of rows that are linked to no other. Texts of any length are read whole. Other columns are left out; an empty
    table gives no rows.
    """
    marked = cut(docs.select("doc_id", fingerprint(docs["text"], words).alias("bits")))
    nodes = cut(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("bits")))
    linked = cut(found.join(nodes.withColumnRenamed("bits", "node"), "node"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = linked.join(roots, "root").select(F.col("node").alias("bits"), "component_id")
    table = nodes.join(of_node, "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(table, "bits").select("doc_id", "bits", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """near_duplicates with the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity: the pipeline's form. Links at 2 of 64 bits find copies with a change or two in a long text; copies
# of 0.8 similarity differ in some ten bits, where neither the grid nor any other index on 64 bits is selective. So the
# fingerprint is made LEAST_BANDS times as many bits long as a band has, or more. What the grid links by the first 64 bits and texts that
# agree on a whole band are candidates, the distance of those 64 bits rules out chance in bands, and the shingle sets decide. Bands widen with the table so that
# chance groups stay small, and as wider bands agree less often, their number grows with them: recall is the same at every size.

LEAST_BANDS = 64
#: The chance that texts at the similarity agree on a whole band: 64 bands of 20 bits have it at similarity 0.8.
RECALL = 0.91
LEAST_BAND_BITS, MOST_BAND_BITS = 20, 32
#: Of 64 bits, so many differ at most in candidates: at similarity 0.8 the mean is 9.7 with a deviation of 2.9, by chance 32 with 4.
CANDIDATE_DISTANCE = 18
#: Longs of the fingerprint that tell apart what a full band's classes hold, and by how many deviations of the distance more than the
#: mean at the similarity a pair may differ in them: of pairs at the similarity, 1 in 160 differs by more.
WIDE, DEVIATIONS = LEAST_BANDS * LEAST_BAND_BITS // 64, 2.5
#: Nodes or rows (16 bytes each) up to which a counted list is broadcast to spare a shuffle of texts; longer ones are joined by a shuffle.
BROADCAST_ROWS = 400_000


def wide_bits(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """64 * blocks majority bits: block k takes the hashes mixed anew with its own multiplier; block 0 takes them as they are."""
    total = np.zeros(64 * blocks, dtype=np.int64)
    odd = np.array([1, *(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(1, blocks))], dtype=np.uint64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] * odd
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        x[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(29)
        total += np.unpackbits(np.ascontiguousarray(x, dtype="<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * total > len(hashes)


def agreement(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of like size agree at a Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_count(bits: int, similarity: float) -> int:
    """How many bands of so many bits it takes for RECALL at the similarity."""
    whole = min(agreement(similarity) ** bits, 0.99)
    return max(LEAST_BANDS, math.ceil(math.log(1 - RECALL) / math.log1p(-whole)))


def band_bits(rows: int) -> int:
    """The width of a band for so many rows."""
    return min(MOST_BAND_BITS, max(LEAST_BAND_BITS, (max(2, rows) - 1).bit_length() + 2))


def bands(text="text", words: int = 5, bits: int = LEAST_BAND_BITS, count: int = LEAST_BANDS):
    """A struct column of the set of a text's shingles, repeats left out: wide, the first 64 * WIDE bits as longs, bands, count
    keys of so many bits each with the band's number, and size, the number of different shingles."""

    def make():
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        number = np.arange(count, dtype=np.int64) << MOST_BAND_BITS

        def of(text):
            hashes = np.unique(shingle_hashes(text, words))  # sets decide, so sets are what bands tell apart
            found = wide_bits(hashes, -(-count * bits // 64))
            wide = np.packbits(found[: 64 * WIDE], bitorder="little").view(np.int64)
            return wide.tolist(), (found[: count * bits].reshape(count, bits) @ powers + number).tolist(), len(hashes)

        return lambda texts: list(zip(*map(of, texts), strict=True))

    return text_column(make, "wide array<long>, bands array<long>, size int")(text)


def shingle_set(text="text", words: int = 5):
    """An array column of the text's different shingle hashes, 32 bits of each, ascending."""

    def make():
        return lambda texts: [[np.unique((shingle_hashes(t, words) >> np.uint64(32)).astype(np.uint32).view(np.int32)).tolist() for t in texts]]

    return text_column(make, "all array<int>")(text)["all"]


def alike(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose shingle sets are that similar by Jaccard."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # else all texts would be shuffled to find some
    sets = docs.join(wanted, "node", "left_semi").select("node", shingle_set(docs["text"], words).alias("all")).groupBy("node").agg(F.first("all").alias("all"))
    sets = stored(sets)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("all").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("all").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where((shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)) | ((F.size("of_a") == 0) & (F.size("of_b") == 0))).select("a", "b")


def divided(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of rest (band, node, ...) in bands that hold more than one class of linked nodes (node, root), with root, the class,
    and most, the band's largest class."""
    here = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = here.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = classes.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "most")
    return stored(here.join(largest, "band"))


def across(here: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes in a band of divided() that bits and sizes allow to be similar.

    Nodes outside a band's largest class meet those of all classes but their own: what a large class holds isn't paired with
    itself. The distance of wide fingerprints is judged within the join, so that few pairs leave it.
    """
    names = ["node", "wide", "root", "size"]
    met = here.select("band", *names).join(here.where("root <> most").select("band", *(F.col(c).alias(f"few_{c}") for c in names)), "band")
    differ = sum((F.bit_count(F.expr(f"wide[{k}] ^ few_wide[{k}]")) for k in range(1, WIDE)), F.bit_count(F.expr("wide[0] ^ few_wide[0]")))
    near = (F.least("size", "few_size") >= similarity * F.greatest("size", "few_size")) & (differ <= widest_distance(similarity))
    return met.where((F.col("root") != F.col("few_root")) & near).select(F.least("node", "few_node").alias("a"), F.greatest("node", "few_node").alias("b")).distinct()


def widest_distance(similarity: float) -> int:
    """Of 64 * WIDE bits, so many differ at most in candidates."""
    n, p = 64 * WIDE, 1 - agreement(similarity)
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def joined_classes(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only the classes that these touch are looked at again."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = cut(components(between)).withColumnRenamed("root", "top")
    known = roots.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(tops.join(roots, "node", "left_anti").select("node", F.col("top").alias("root")))


def grid_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, bits) that the popcount grid links: the least nodes of two linked fingerprints, and each node of a
    fingerprint with the least one."""
    least = cut(marks.groupBy("bits").agg(F.min("node").alias("least")))
    end = lambda c: least.select(F.col("bits").alias(c), F.col("least").alias(f"node_{c}"))
    across = cut(links(least.select("bits"))).join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    within = marks.join(least, "bits").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return cut(across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) for the nodes (hashes) of texts that are linked: their shingle sets are that similar by Jaccard, they share a
    band and are near by their bits. root names the class of all that are linked, through others too.

    docs has node and text. First, texts that the popcount grid links (2 of the first 64 bits) are candidates. Then, in each band's group, ordered by node, a text is compared with the first, or, where that one
    only met it by chance, with the one before it: as the order is the same everywhere, large groups share few first texts, and
    copies become one class. Last, in groups of three and more, all pairs between different classes are compared.
    """
    bits = band_bits(docs.count())
    marks = docs.select("node", bands(docs["text"], words, bits, band_count(bits, similarity)).alias("m")).groupBy("node").agg(F.first("m").alias("m"))  # of copies one goes on
    marks = stored(marks.select("node", F.expr("m.wide[0]").alias("bits"), "m.*"))
    by_grid = grid_pairs(marks.select("node", "bits"))
    members = marks.select("node", "bits", F.explode("bands").alias("band"))
    order = Window.partitionBy("band").orderBy("node")
    here = F.struct("node", "bits")
    near = members.select("band", here.alias("b"), F.first(here).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lag(here).over(order).alias("last"), F.row_number().over(order).alias("k"))
    chance = F.bit_count(F.expr("first.bits ^ b.bits")) > CANDIDATE_DISTANCE
    near = near.select("band", "k", "b", F.when(chance, F.col("last")).otherwise(F.col("first")).alias("a"))
    near = near.select("band", "k", "a.node", F.col("b.node").alias("other"), ((F.col("a.node") != F.col("b.node")) & (F.bit_count(F.expr("a.bits ^ b.bits")) <= CANDIDATE_DISTANCE)).alias("met"))
    near = stored(near.where("met or k = 3"))
    pairs = near.where("met").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = cut(pairs.unionByName(by_grid).distinct())
    roots = cut(components(alike(docs, pairs, words, similarity)))
    full = cut(near.where("k = 3").select("band"))
    if full.isEmpty():
        return roots
    full = F.broadcast(full) if full.count() <= BROADCAST_ROWS else full
    rest = marks.select("node", "wide", "size", F.explode("bands").alias("band")).join(full, "band", "left_semi")
    rest = divided(rest, roots)
    more = cut(across(rest, similarity).join(pairs, ["a", "b"], "left_anti"))
    return joined_classes(roots, alike(docs, more, words, similarity))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of texts linked at the similarity (through others too), the row of the least doc_id stays.

    Equal texts are one node, named by their 64-bit hash; null texts are one too. Of repeated rows one stays. A null doc_id
    counts as the least. Texts of any length are read whole; an empty table gives no rows. All columns stay as they are.
    """
    node, key = unused(docs, "node"), unused(docs, "key")
    on = [node, key]
    rows = docs.withColumns({node: F.xxhash64("text"), key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))})
    texts = rows.select(F.col(node).alias("node"), "text")
    counted = cut(rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")))
    nodes = counted.groupBy(F.col(node).alias("node")).agg(F.min(key).alias("least"))
    roots = similar_classes(texts, words, similarity)
    classes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = classes.groupBy("root").agg(F.min(F.struct("least", "node")).alias("k")).select(F.col("k.node").alias(node), F.col("k.least").alias(key))
    keep = cut(counted.join(keep, on, "left_semi"))
    gone = cut(counted.join(keep, on, "left_anti").select(on))
    few = gone.count() <= BROADCAST_ROWS  # then texts stay where they are
    left = rows.join(F.broadcast(gone), on, "left_anti") if few else rows.join(keep.select(on), on, "left_semi")
    again = keep.where("n > 1").select(on)
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(on))
    return once.select(docs.columns)
