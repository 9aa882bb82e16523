"""Exact duplicates through an extendible-hash index kept as files in the shared folder.

1. Directory: distinct 64-bit keys of the normalised texts are counted by their leading
   bits. Starting from one bucket the directory doubles while a bucket holds more than
   ``capacity`` keys; only overfull buckets split. A bucket is a range of keys, and
   neighbouring buckets with about the same number of rows together have one owner.
2. Insert: every row looks up its cell in the directory and goes to the owner of its
   bucket. The owner sorts the rows of a key and compares the bytes of each text with
   those of the one before it: equal texts are one link of the key's chain, and texts
   that differ on the same key are further links.
3. Pages: one entry a link, with its first document and its number of copies.
4. Probe: each row finds its entry by bucket, key and link.

A key with more than ``PIECE_ROWS`` rows is cut into pieces, each a task's own; the texts
at the heads of the pieces' links, a few for each piece, are then compared in the same way,
so no group of copies ever meets in one task. The directory has 2^20 cells at most, since the
capacity grows with the keys beyond that, and there are at most rows / ``PIECE_ROWS`` such keys:
both can be broadcast.

Edge cases: a null text counts as empty; rows repeating both id and text count in
``group_size`` and all but one are dropped; a null id sorts after all others, so such
a row stays only in a group without any id (``keep_id`` is null there); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.llm.common import finish, materialize, scratch_mark, text_or_empty

#: Keys that a bucket holds before it splits, and cells that the directory has at most.
CAPACITY, MOST_CELLS = 4_096, 1 << 20
#: Rows of one key that meet in a task, and rows that an owner is given (about; a bucket is never split but for its large keys).
PIECE_ROWS, OWNER_ROWS = 50_000, 20_000
#: Runs of white space that are not yet one plain space.
RUNS = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*"


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, RUNS, " ")


def hash_key(text: Column, key_bits: int) -> Column:
    """The leading ``key_bits`` bits of the text's 64-bit hash; the directory uses them from the left."""
    whole = F.xxhash64(text)
    return whole if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(whole, 64 - key_bits), 64 - key_bits)


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(cell, bucket, depth) for every cell in use: a leaf is the shortest prefix whose bucket is not overfull.

    A bucket still overfull at ``max_depth`` (many keys alike in all their leading bits)
    keeps longer chains instead of splitting on.
    """
    cells = keys.groupBy(prefix(F.col("key"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    depths = cells.select(
        "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {max_depth} - depth)"))
    fits = (
        depths.groupBy("depth", "prefix")
        .agg(F.sum("n").alias("held"))
        .where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    )
    leaf = depths.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    first = F.expr(f"shiftleft(shiftrightunsigned(cell, {max_depth} - depth), {max_depth} - depth)")
    return leaf.select("cell", first.alias("bucket"), "depth")


def with_owners(directory: DataFrame, keys: DataFrame, max_depth: int, owner_rows: int) -> tuple[DataFrame, int]:
    """The directory with the owner of each bucket, neighbours together up to about ``owner_rows`` rows, and how many there are."""
    rows = keys.groupBy(prefix(F.col("key"), max_depth).alias("cell")).agg(F.sum("n").alias("rows"))
    held = directory.join(rows, "cell").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over buckets: MOST_CELLS rows at most
    owners = held.select("bucket", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / owner_rows).cast("int").alias("owner"))
    found = materialize(directory.join(owners, "bucket"), "dedup-directory")
    return found, (found.agg(F.max("owner")).first()[0] or 0) + 1


def links_of(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """Walk the chain of each key: ``new`` where a text differs from the one before it, ``link`` its number in the chain."""
    chain = Window.partitionBy(*by).orderBy(text)
    new = ~F.col(text).eqNullSafe(F.lag(text).over(chain))
    return rows.withColumn("new", new).withColumn(
        "link", F.sum(F.col("new").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )


def build_index(
    docs: DataFrame,
    doc_id: str,
    text: str,
    capacity: int = CAPACITY,
    key_bits: int = 64,
    piece_rows: int = PIECE_ROWS,
    owner_rows: int = OWNER_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(pages, rows): an entry for each link of each chain, and for each input row the bucket, key and link it is in."""
    norm = collapse_blanks(text_or_empty(text))
    keyed = docs.select(F.col(doc_id).alias("id"), norm.alias("norm")).withColumn("key", hash_key(F.col("norm"), key_bits))
    keys = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    distinct = keys.count()
    capacity = max(capacity, -(-16 * distinct // MOST_CELLS))
    max_depth = min(key_bits, 20, max(0, math.ceil(math.log2(max(1, distinct) / capacity)) + 3))
    directory, owners = with_owners(grow_directory(keys, capacity, max_depth), keys, max_depth, owner_rows)
    large = materialize(
        keys.where(F.col("n") > piece_rows).select("key", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces")), "dedup-large"
    )
    any_large = bool(large.take(1))

    routed = keyed.withColumn("cell", prefix(F.col("key"), max_depth)).join(F.broadcast(directory.select("cell", "bucket", "owner")), "cell")
    pieces = F.lit(1)
    if any_large:
        routed, pieces = routed.join(F.broadcast(large), "key", "left"), F.coalesce("pieces", F.lit(1))
    piece = F.pmod(F.monotonically_increasing_id(), pieces).cast("int")
    routed = routed.select("id", "norm", "key", "bucket", piece.alias("piece"), F.pmod(F.col("owner") + piece, F.lit(owners)).alias("owner"), (pieces > 1).alias("large"))
    walked = links_of(routed.repartitionById(owners, F.col("owner")), ["owner", "bucket", "key", "piece"], "norm")
    rows = materialize(
        walked.select(
            "id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("norm", 256)).alias("digest"),
            "bucket", "key", "piece", "link", "large", F.when(F.col("large") & F.col("new"), F.col("norm")).alias("head_text"),
        ),
        "dedup-rows",
    )
    if any_large:  # the same walk over the heads of the pieces, at most rows / piece_rows of them for each different text
        heads = rows.where(F.col("head_text").isNotNull()).withColumnRenamed("link", "piece_link")
        whole = links_of(heads, ["bucket", "key"], "head_text").select("bucket", "key", "piece", "piece_link", F.col("link").alias("whole"))
        same = ["bucket", "key", "piece", "piece_link"]
        rows = rows.drop("head_text").withColumnRenamed("link", "piece_link")
        joined = rows.where("large").join(whole, same).withColumn("link", F.col("whole")).drop("whole", "piece_link")
        rows = materialize(joined.unionByName(rows.where(~F.col("large")).withColumnRenamed("piece_link", "link")), "dedup-joined")
    pages = rows.groupBy("bucket", "key", "link").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("large").alias("large")
    )
    return materialize(pages, "dedup-pages"), rows


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    key_bits: int = 64,
    piece_rows: int = PIECE_ROWS,
    owner_rows: int = OWNER_ROWS,
) -> DataFrame:
    """One row per input row: the row that stays for it, the size of its group, and whether it is that row."""
    mark = scratch_mark()
    pages, rows = build_index(docs, doc_id, text, capacity, key_bits, piece_rows, owner_rows)
    found = rows.where(~F.col("large")).join(pages.where(~F.col("large")).drop("large"), ["bucket", "key", "link"])
    # Entries of large keys hold over piece_rows rows together, so they are few, and their rows need not move.
    of_large = rows.where("large").join(F.broadcast(pages.where("large").drop("large")), ["bucket", "key", "link"])
    return finish(
        found.unionByName(of_large).select(
            F.col("id").alias(doc_id),
            F.col("first.id").alias("keep_id"),
            F.col("copies").alias("group_size"),
            (F.col("row") == F.col("first.row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        ),
        "dedup",
        mark,
    )
