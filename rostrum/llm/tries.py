"""Trie of conversation prefixes, built by van Emde Boas recursion.

A conversation is a sequence of elements: the root, then its turns. Blocks of 2b elements are cut at half depth. The upper b
elements are named by their last one (the cut), sequences of one name are merged, and upper tries and lower forests go through the
same step at b, all in one shuffle, down to blocks of LEAF elements, which are tries that a row holds. A cut after q elements is named by
the digest of the name at the block's root and the elements between, so a name says the whole prefix. A lower block keeps the
names above it up to its own cut. Totals are grafted in the opposite order: the sums of a lower forest go to its cut, and from
there to the b names above, once for each cut, at b = LEAF, 2 LEAF and so on; a path of d nodes takes part in log d steps.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint_dir, shuffles_freed, stored

#: Elements of a block that isn't cut further.
LEAF = 8
#: Members that are listed in one row at most; a node's list is such rows in order.
LISTED_BITS = 10
ROOT = hashlib.md5(b"root").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, items array<struct<code, chars>>): each conversation's turns in order, stored.

    A code is the digest of role and text, null ones empty. Order is by turn, null first; ties go by role, then by code. Rows
    without conv_id belong to no conversation. A conversation's codes (32 bytes a turn) stand in one row, its texts don't.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    item = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"), role.alias("role"), code.alias("code"), F.length(text).cast("long").alias("chars"))
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    listed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), item.alias("item")).groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return stored(listed.select("conv_id", F.transform("items", lambda x: F.struct(x["code"].alias("code"), x["chars"].alias("chars"))).alias("items")))


def with_shared_openings(lists: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """lists with the first h items of each conversation replaced by the first h of its group's first one (conv_id a multiple of
    group; none if that is absent), h = crc32(conv_id) % (most + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = lists.select("conv_id", "items", (F.col("conv_id") - F.col("conv_id") % group).alias("of"))
    heads = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("of"), F.slice("items", 1, most).alias("head"))
    kept = F.slice("items", h + 1, F.greatest(F.size("items") - h, F.lit(0)))
    opening = F.coalesce(F.slice("head", F.lit(1), h), F.slice("items", 1, 0))
    return own.join(heads, "of", "left").select("conv_id", F.concat(opening, kept).alias("items"))


def cuts_named(b: int):
    """A function from a name and its place to the name of the cut there, where blocks of 2b elements are cut; else to what it was."""

    def name(was, i):
        above = F.when(i >= b, F.hex(F.get("names", i - b))).otherwise(F.lit(""))
        of = F.unhex(F.md5(F.concat(above, F.lit("/"), F.array_join(F.slice("codes", i - b + 2, F.lit(b)), "")).cast("binary")))
        return F.when((i + 1) % (2 * b) == b, of).otherwise(was)

    return name


def named(lists: DataFrame, most: int) -> DataFrame:
    """(conv_id, names, chars) of sequences of at most so many elements, the root first."""
    out = lists.select("conv_id", F.concat(F.array(F.lit(ROOT)), F.col("items.code")).alias("codes"), F.concat(F.array(F.lit(0).cast("long")), F.col("items.chars")).alias("chars"))
    out = out.withColumn("names", F.transform("codes", lambda _: F.lit(None).cast("binary")))
    b = 1 << most.bit_length()
    while b:
        out = out.withColumn("names", F.transform("names", cuts_named(b)))
        b >>= 1
    return out.select("conv_id", "names", "chars")


def classes(sequences: DataFrame) -> DataFrame:
    """Equal sequences as one row: names, chars, n, conv_id (the smallest) and ends, the digest of their ids in ascending order.

    Members are listed in rows of at most 2 ** LISTED_BITS; the rows of a class are digested in order as they stream by.
    """
    key = F.element_at("names", -1)
    ids = F.array_sort(F.collect_list("conv_id"))
    parts = sequences.groupBy(key.alias("key"), F.shiftright("conv_id", LISTED_BITS).alias("part")).agg(F.first("names").alias("names"), F.first("chars").alias("chars"), ids.alias("ids"))
    parts = parts.select("key", "part", "names", "chars", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("conv_id"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    bounded_batches()

    def digested(batches):
        last = row = sha = None
        n = least = 0

        def made(rows, ns, leasts, ends):
            return pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in ("names", "chars")), pa.array(ns, pa.int64()), pa.array(leasts, pa.int64()), pa.array(ends, pa.string())], names=["names", "chars", "n", "conv_id", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, listed, sizes, firsts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "ids", "n", "conv_id"))
            whole = pa.Table.from_batches(([row] if row is not None else []) + [batch])
            shift = int(row is not None)
            at, ns, leasts, ends = [], [], [], []
            for i, k in enumerate(keys):
                if k != last:
                    if last is not None:
                        at.append(i - 1 + shift), ns.append(n), leasts.append(least), ends.append(sha.hexdigest())
                    last, sha, n, least = k, hashlib.sha256(), 0, firsts[i]
                else:
                    sha.update(b",")
                sha.update(listed[i].encode())
                n += sizes[i]
            row = batch.slice(batch.num_rows - 1, 1)
            if at:
                yield from (made(r, ns, leasts, ends) for r in whole.take(pa.array(at)).combine_chunks().to_batches())
        if row is not None:
            yield made(row, [n], [least], [sha.hexdigest()])

    dealt = parts.repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(digested, "names array<binary>, chars array<long>, n long, conv_id long, ends string")


def by_height(rows: DataFrame) -> DataFrame:
    """rows stored by the height of the smallest block that holds them, so that a step of the recursion reads its own alone."""
    spark = rows.sparkSession
    height = F.greatest(F.lit(LEAF), F.expr("shiftleft(1, length(bin(size(names) - 1)))"))
    out = rows.withColumn("height", height.cast("int"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    with shuffles_freed(spark):
        out.write.option("compression", "zstd").partitionBy("height").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def blocks(found: DataFrame, most: int) -> DataFrame:
    """Blocks of at most LEAF elements: above, names, chars, start, n, conv_id, ends, more (nodes follow the last), merged at each cut."""
    none = F.array().cast("array<binary>")

    def fresh(height):
        return found.where(F.col("height") == height).select(none.alias("above"), "names", "chars", F.lit(0).cast("long").alias("start"), "n", "conv_id", "ends", F.lit(False).alias("more"))

    height, out = 1 << max(LEAF.bit_length() - 1, (most - 1).bit_length()), None
    while height > LEAF:
        out = fresh(height) if out is None else out.unionByName(fresh(height))
        b = height // 2
        longer = F.size("names") > b
        upper = F.struct("above", F.slice("names", 1, b).alias("names"), F.slice("chars", 1, b).alias("chars"), "start", "n", "conv_id", F.when(~longer, F.col("ends")).alias("ends"), (F.col("more") | longer).alias("more"))
        rest = F.greatest(F.size("names") - b, F.lit(0))
        lower = F.struct(F.slice("names", 1, b).alias("above"), F.slice("names", F.lit(b + 1), rest).alias("names"), F.slice("chars", F.lit(b + 1), rest).alias("chars"), (F.col("start") + b).alias("start"), "n", "conv_id", "ends", "more")
        cut = out.select(F.explode(F.when(longer, F.array(upper, lower)).otherwise(F.array(upper))).alias("x")).select("x.*")
        same = [F.first(c).alias(c) for c in ("above", "names", "chars", "start")]
        out = cut.groupBy(F.element_at("names", -1).alias("name")).agg(*same, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.max("more").alias("more")).drop("name")
        height = b
    return fresh(LEAF) if out is None else out.unionByName(fresh(LEAF))


def nodes(rows: DataFrame) -> DataFrame:
    """One row for each node, with its parent's name, above (for the top of a block, the names up to the cut over it) and leaves, saved
    and children: sums over its subtree within its block."""
    last = F.size("names") - 1
    each = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            F.get("names", i).alias("name"), F.get("chars", i).alias("chars"), (F.col("start") + i).alias("depth"), F.when(i == last, F.col("ends")).alias("ends"), ((i < last) | F.col("more")).alias("more"),
            F.slice("names", F.lit(1), i).alias("path"), F.when(i == 0, F.col("above")).alias("above"),
        ),
    )
    one = rows.select("n", "conv_id", F.explode(each).alias("x")).select("n", "conv_id", "x.*")
    same = [F.first(c).alias(c) for c in ("chars", "depth", "path", "above")]
    one = one.groupBy("name").agg(*same, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.max("more").alias("more"))
    parent = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.try_element_at("above", F.lit(-1)))
    zero, leaf, saved = F.lit(0).cast("long"), (~F.col("more")).cast("long"), (F.col("n") - 1) * F.col("chars")
    about = F.struct("depth", parent.alias("parent"), "above", "n", "conv_id", "ends")
    nothing = F.lit(None).cast("struct<depth:bigint,parent:binary,above:array<binary>,n:bigint,conv_id:bigint,ends:string>")
    part = lambda name, leaves, saved, children, about: F.struct(name.alias("name"), leaves.alias("leaves"), saved.alias("saved"), children.alias("children"), about.alias("about"))
    to = F.concat(
        F.array(part(F.col("name"), leaf, saved, zero, about)),
        F.transform("path", lambda a: part(a, leaf, saved, zero, nothing)),
        F.when(parent.isNotNull(), F.array(part(parent, zero, zero, zero + 1, nothing))).otherwise(F.array().cast("array<struct<name:binary,leaves:bigint,saved:bigint,children:bigint,about:struct<depth:bigint,parent:binary,above:array<binary>,n:bigint,conv_id:bigint,ends:string>>>")),
    )
    sums = one.select(F.explode(to).alias("x")).select("x.*").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("leaves", "saved", "children")), F.first("about", ignorenulls=True).alias("about"))
    return sums.select("name", "leaves", "saved", "children", "about.*")


def grafted(found: DataFrame, most: int) -> DataFrame:
    """(name, more_leaves, more_saved): what subtrees hold below the blocks of their tops."""
    tops = found.where((F.col("depth") > 0) & (F.col("depth") % LEAF == 0))
    zero = F.lit(0).cast("long")
    out = tops.select("name", "depth", "above", "leaves", "saved", zero.alias("more_leaves"), zero.alias("more_saved"))
    b = LEAF
    while b < most:
        rises = F.col("depth") % (2 * b) == b
        own = F.struct(F.lit(False).alias("rising"), "name", "depth", F.when(~rises, F.col("above")).alias("above"), "leaves", "saved", "more_leaves", "more_saved")
        up = F.struct(F.lit(True).alias("rising"), F.element_at("above", -1).alias("name"), F.lit(None).cast("long").alias("depth"), F.col("above"), zero.alias("leaves"), zero.alias("saved"), (F.col("leaves") + F.col("more_leaves")).alias("more_leaves"), (F.col("saved") + F.col("more_saved")).alias("more_saved"))
        sums = [F.sum(c).alias(c) for c in ("leaves", "saved", "more_leaves", "more_saved")]
        same = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "above")]
        # a forest's total at its cut, then along the names above
        totals = out.select(F.explode(F.when(F.coalesce(rises, F.lit(False)), F.array(own, up)).otherwise(F.array(own))).alias("x")).select("x.*").groupBy("rising", "name").agg(*same, *sums)
        names = F.when(F.col("rising"), F.col("above")).otherwise(F.array("name"))
        dealt = totals.select(F.explode(names).alias("name"), "depth", F.when(~F.col("rising"), F.col("above")).alias("above"), "leaves", "saved", "more_leaves", "more_saved")
        out = dealt.groupBy("name").agg(*same, *sums)
        b *= 2
    return out.select("name", "more_leaves", "more_saved").where("more_leaves > 0 or more_saved > 0")


def prefix_trie(sequences: DataFrame, longest: int) -> DataFrame:
    """NODES of the trie of sequences (conv_id, items array<struct<code, chars>>) of at most so many items: one row for each different
    prefix, the empty one (depth 0) among them.

    conv_id is a node's smallest member, parent_conv_id that of its parent (null for the root), saved_tokens the sum over the subtree of
    (n_convs - 1) x chars, ends_sha256 the digest of members that end here. Equal sequences are merged first, so a sequence that
    most conversations share is one row; no sequences give no rows.
    """
    most = longest + 1
    found = by_height(classes(named(sequences, most)))
    found = stored(nodes(blocks(found, most)))
    parents = found.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = found.join(grafted(found, most), "name", "left").join(parents, "parent", "left")
    zero = F.lit(0)
    return rows.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def longest_list(lists: DataFrame) -> int:
    return lists.agg(F.max(F.size("items"))).first()[0] or 0


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """NODES of the conversations themselves: rows of conv_id, turn, role, text; other columns are left out.

    Null role or text is empty; a null turn comes first; ties go by role, then by the text's digest, and repeated rows count as turns
    of their own; rows without conv_id are left out; an empty table gives no rows; texts may be of any length.
    """
    lists = turn_lists(conversations)
    return prefix_trie(lists, longest_list(lists))


def shared_opening_trie(conversations: DataFrame) -> DataFrame:
    """conversation_trie of conversations whose openings are those of their hundred's first one; see with_shared_openings."""
    lists = turn_lists(conversations)
    return prefix_trie(with_shared_openings(lists), max(5, longest_list(lists)))


ORACLE = r"""
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)) x
), ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c, steps
), turns AS (
  SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS code, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), code) AS k FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT i.conv_id, k, code, chars FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 WHERE k <= h
  UNION ALL SELECT i.conv_id, k, code, chars FROM ids i JOIN turns t USING (conv_id) WHERE k > h
), placed AS (
  SELECT conv_id, row_number() OVER w AS d, md5(string_agg(code, '') OVER w) AS name, chars FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), parts AS (
  SELECT conv_id, d, name, chars FROM placed UNION ALL SELECT conv_id, 0, 'root', 0 FROM ids
), ended AS (
  SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(name, d) AS name FROM parts GROUP BY conv_id) x GROUP BY name
), found AS (
  SELECT name, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM parts GROUP BY name
), parented AS (
  SELECT f.*, p.name AS parent FROM found f LEFT JOIN parts p ON p.conv_id = f.conv_id AND p.d = f.d - 1
), families AS (
  SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parented p LEFT JOIN (SELECT parent, count(*) AS n_children FROM parented GROUP BY parent) c ON c.parent = p.name
), totals AS (
  SELECT a.name, CAST(sum(CAST(f.n_children = 0 AS INT)) AS BIGINT) AS n_leaves, CAST(sum((f.n - 1) * f.chars) AS BIGINT) AS saved_tokens FROM families f JOIN parts a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.name
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM families f JOIN totals USING (name) LEFT JOIN found p ON p.name = f.parent LEFT JOIN ended e ON e.name = f.name
"""
