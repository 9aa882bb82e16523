"""SimHash near duplicates, found by Golay-code keys.

Fingerprints of 64 bits are cut into segments of 22, 21 and 21 bits. If two differ
in at most 4 bits, some pair of segments holds at most 2 of them: one or none in
each, or both in one with the other equal. For each pair of segments a fingerprint
therefore gets

* keys of codeword indices near each of the two segments, to meet the nearest
  codewords of another (at most one flip in each), and
* keys of the indices near one segment with the other's exact bits, to meet the
  same of another (two flips in that one).

Keys meet in a shuffle; every meeting is verified on the whole fingerprint. In a
key's group only a spanning forest of the links is kept: a large group is searched
breadth-first against the fingerprints not yet reached, and each task drops links
inside what it has already connected; a group of more than ``GROUP_ROWS`` rows is cut
into blocks, and each pair of blocks is a task's own. Components of the links between
fingerprints follow by star contraction, and the smallest id of each comes last. Equal
fingerprints are one from the start, so copies cost nothing.

``near_copies`` links by the similarity of texts: two fingerprints of shingles of two words, which a
few changed words move by a few bits, propose most links, an exact similarity join all others
(``overlap``), and shingles of the texts decide.

Edge cases: a null, empty or wordless text has fingerprint 0 and links as any
other; texts shorter than a shingle are one shingle; equal ids each get their row; a
null id links as any other and is never a component's smallest, unless all its ids are
null (``component_id`` is null there); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm import overlap
from dateloom.llm.common import ascii_lower, bound_batches, finish, materialize, scratch_mark, text_or_empty
from dateloom.llm.components import components
from dateloom.llm.exact_dedup import collapse_blanks
from dateloom.llm.golay import nearby, nearest

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Near copies: words of a shingle and number of the fingerprints that propose links.
COPY_SHINGLE, COPY_TABLES = 2, 2
#: Rounds that link each text to the nearest one of another component, before all pairs left between components are put to the test.
NEAREST_ROUNDS = 2
#: Fixed odd multiplier for scattering hashes anew.
SCATTER = np.uint64(0xD6E8FEB86659FD93)
#: (shift, width) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Groups up to this size are compared position by position, larger ones breadth-first.
SMALL_GROUP = 24
#: Rows of a key that one task compares, and fingerprints whose keys one task makes.
GROUP_ROWS, PRINTS_A_TASK = 500_000, 20_000
#: Texts that one task fingerprints.
TEXTS_A_TASK = 4_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Roles in a group, in the low bits of a key: A meets A and B, and so does no other.
NEAREST, NEAR = 0, 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(values: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the values."""
    octets = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(values) < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 values."""
    return majority(shingle_hashes(text, shingle))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit fingerprint as a (signed) long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([text_fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return of(text)


def fingerprints(text: Column, shingle: int, tables: int) -> Column:
    """An array of fingerprints that err independently: the first is ``fingerprint``, the others are of the same hashes scattered anew."""

    def both(text: str | None) -> Iterator[int]:
        values = shingle_hashes(text, shingle)
        for _ in range(tables):
            yield majority(values)
            values = values * SCATTER
            values ^= values >> np.uint64(29)

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([list(both(t.as_py())) for t in texts], dtype=np.uint64).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, tables, dtype=np.int32)), pa.array(found))

    return of(text)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (int64, key * 2 + role) and the fingerprint of each."""
    whole = prints.view(np.uint64)
    cut = [((whole >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int32) for s, w in SEGMENTS]
    best = [nearest(c) for c in cut]
    near = [nearby(c, w) for c, (_, w) in zip(cut, SEGMENTS, strict=True)]
    keys, owners = [], []

    def add(tag: int, left: np.ndarray, right: np.ndarray, role: int, own: np.ndarray) -> None:
        key = (np.int64(tag) << 36) | (left.astype(np.int64) << 22) | right.astype(np.int64)
        keys.append(key << 1 | role)
        owners.append(own)

    at = np.arange(len(prints))
    for p, (i, j) in enumerate(PAIRS):
        add(3 * p, best[i], best[j], NEAREST, at)
        both = near[i][1][:, :, None] & near[j][1][:, None, :]
        own, x, y = np.nonzero(both)
        add(3 * p, near[i][0][own, x], near[j][0][own, y], NEAR, own)
        own, x = np.nonzero(near[i][1])
        add(3 * p + 1, near[i][0][own, x], cut[j][own], NEAREST, own)
        own, x = np.nonzero(near[j][1])
        add(3 * p + 2, near[j][0][own, x], cut[i][own], NEAREST, own)
    return np.concatenate(keys), prints[np.concatenate(owners)]


class Linker:
    """Verified links within key groups, without those inside what this task has already connected.

    Links are taken at the least level (most differing bits) first, and one is left out
    only if links of its own level or below connect its ends already: so whatever a caller
    finds wrong with a long link, the shorter ones still connect all that they can.
    """

    def __init__(self, distance: int) -> None:
        self.levels = [*range(min(DISTANCE, distance), distance, 2), distance]
        self.parents: list[dict[int, int]] = [{} for _ in self.levels]

    def root(self, parent: dict[int, int], x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def fresh(self, a: np.ndarray, b: np.ndarray, level: int) -> Iterator[tuple[int, int]]:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            for parent in self.parents[level:]:
                p, q = self.root(parent, x), self.root(parent, y)
                if p == q:  # and so at all further levels
                    break
                parent[p] = q
                if parent is self.parents[level]:
                    yield x, y

    def bits(self, a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
        return np.bitwise_count((a ^ b).view(np.uint64))

    def large(self, prints: np.ndarray, searching: np.ndarray) -> Iterator[tuple[int, int]]:
        """A spanning forest of one group at each level; rows that search meet all others, the rest meet only them."""
        prints, first = np.unique(prints[np.argsort(~searching, kind="stable")], return_index=True)
        search = first < searching.sum()
        for level, most in enumerate(self.levels):
            left, other = prints[search], prints[~search]
            while len(left):
                stack = [(left[0], True)]
                left = left[1:]
                while stack:
                    one, searches = stack.pop()
                    hit = self.bits(left, one) <= most
                    reached, left = left[hit], left[~hit]
                    yield from self.fresh(np.full(len(reached), one), reached, level)
                    stack += [(x, True) for x in reached]
                    if searches and len(other):
                        hit = self.bits(other, one) <= most
                        reached, other = other[hit], other[~hit]
                        yield from self.fresh(np.full(len(reached), one), reached, level)
                        stack += [(x, False) for x in reached]

    def sorted_rows(self, keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of whole groups, given rows sorted by key and role."""
        group = keys >> 1
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([edge, [len(group)]]))
        for start, n in zip(edge[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
            yield from self.large(prints[start : start + n], keys[start : start + n] & 1 == NEAREST)
        end = np.repeat(edge + size, size)
        at = np.flatnonzero((keys & 1 == NEAREST) & np.repeat((size > 1) & (size <= SMALL_GROUP), size))
        found: list[list[np.ndarray]] = [[] for _ in self.levels]
        for step in range(1, SMALL_GROUP):
            at = at[at + step < end[at]]
            if not len(at):
                break
            bits, least = self.bits(prints[at], prints[at + step]), -1
            for level, most in enumerate(self.levels):
                hit = at[(bits <= most) & (bits > least)]
                found[level].append(np.stack([prints[hit], prints[hit + step]]))
                least = most
        for level, pairs in enumerate(found):
            if pairs:
                yield from self.fresh(*np.concatenate(pairs, axis=1), level)


LINKS = "a long, b long, key long, print long, block int"


def link_rows(rows: Iterator[pa.RecordBatch], distance: int, group_rows: int = GROUP_ROWS) -> Iterator[pa.RecordBatch]:
    """Links from a partition of (key, print) rows sorted by key; a group may span batches.

    Of a group with more than ``group_rows`` rows nothing is compared here: its rows come
    out again (key, print, block), in blocks of ``group_rows``.
    """
    linker = Linker(distance)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    group, block, size = None, 0, 0

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        found = list(linker.sorted_rows(keys, prints))
        a, b = zip(*found, strict=True) if found else ((), ())
        return table(pa.array(a, pa.int64()), pa.array(b, pa.int64()), None, None, None)

    def table(*columns: pa.Array | None) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        types = [pa.int64()] * 4 + [pa.int32()]
        filled = [pa.nulls(n, t) if c is None else c for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(filled, ["a", "b", "key", "print", "block"])

    def blocks(last: bool) -> Iterator[pa.RecordBatch]:
        """Let out whole blocks of the group held, and what is left of it if it is the ``last`` call."""
        nonlocal held, block, size
        if not held:
            return
        keys, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        while len(keys) >= group_rows or (last and len(keys)):
            n = min(group_rows, len(keys))
            yield table(None, None, pa.array(keys[:n]), pa.array(prints[:n]), pa.array(np.full(n, block, np.int32)))
            keys, prints, block = keys[n:], prints[n:], block + 1
        held, size = ([(keys, prints)] if len(keys) else []), len(keys)

    for more in rows:
        keys, prints = more.column(0).to_numpy(), more.column(1).to_numpy()
        while len(keys):
            if group is None:
                group = keys[0] >> 1
            own = int(np.searchsorted(keys >> 1, group, side="right"))
            if own:
                held.append((keys[:own], prints[:own]))
                size += own
                keys, prints = keys[own:], prints[own:]
                if size > group_rows:
                    yield from blocks(last=False)
            if len(keys):  # the group held is complete
                if block:
                    yield from blocks(last=True)
                elif held:
                    yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, block, size, group = [], 0, 0, None
                edges = np.flatnonzero(np.diff(keys >> 1)) + 1
                whole = int(edges[-1]) if len(edges) else 0
                cut = np.concatenate([[0], edges])
                if whole and np.diff(cut).max() <= group_rows:  # all groups but the last one, at once
                    yield links(keys[:whole], prints[:whole])
                    keys, prints = keys[whole:], prints[whole:]
    if block:
        yield from blocks(last=True)
    elif held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def key_rows(prints: DataFrame) -> DataFrame:
    """(key, print) rows of all keys, made in as many tasks as there are ``PRINTS_A_TASK`` fingerprints."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_numpy()
            for lo in range(0, len(column), 2_000):
                key, own = golay_keys(column[lo : lo + 2_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "print"])

    tasks = -(-prints.count() // PRINTS_A_TASK) or 1
    # As many tasks compare them: each leaves out what it has connected, so more tasks than the rows need would only repeat links.
    return prints.select("print").repartition(tasks).mapInArrow(keys, "key long, print long").repartition(tasks, F.shiftright("key", 1))


def near_links(prints: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``print``) at 4 bits or less, directly or in steps.

    With a larger ``distance`` also those further apart that share a key, which is likely up to about 8 bits.
    Groups of more than ``group_rows`` rows go on in blocks, each pair of blocks in a task of its own.
    """
    if distance < DISTANCE:
        raise ValueError("the segments are laid out for 4 differing bits and more")
    found = materialize(
        key_rows(prints).sortWithinPartitions("key").mapInArrow(lambda rows: link_rows(rows, distance, group_rows), LINKS), "key-links"
    )
    links = found.where(F.col("a").isNotNull()).select("a", "b")
    large = found.where(F.col("key").isNotNull()).select("key", "print", "block")
    if not large.take(1):
        return links
    blocks = large.groupBy(F.shiftright("key", 1).alias("group")).agg((F.max("block") + 1).alias("blocks"))
    large = large.withColumn("group", F.shiftright("key", 1)).join(F.broadcast(blocks), "group")  # rows / group_rows groups at most
    other = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select(
        # A pair of blocks is a group by itself: its number stands in the place of the key.
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "key", "print"
    )
    paired = pairs.select(
        F.bitwise_not(F.lit(1).cast("long")).bitwiseAND(F.col("pair")).bitwiseOR(F.col("key").bitwiseAND(F.lit(1))).alias("key"), "print"
    )
    more = (
        paired.repartition(F.shiftright("key", 1))
        .sortWithinPartitions("key")
        .mapInArrow(lambda rows: link_rows(rows, distance, 2**62), LINKS)
        .select("a", "b")
    )
    return links.unionByName(materialize(more, "block-links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint (16 hex digits) and the smallest id that links reach from it."""
    bound_batches(docs.sparkSession)
    mark = scratch_mark()
    marked = materialize(
        docs.select(F.col(doc_id).alias("id"), fingerprint(F.col(text)).alias("print")), "fingerprints"
    )
    prints = materialize(marked.groupBy("print").agg(F.min("id").alias("head")), "distinct-prints")
    roots = components(near_links(prints), "a", "b").select(F.col("node").alias("print"), "root")
    rooted = materialize(prints.join(roots, "print", "left").select("print", "head", F.coalesce("root", "print").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    labels = materialize(rooted.join(least, "root").select("print", "component_id"), "labels")
    return finish(
        marked.join(labels, "print").select(
            F.col("id").alias(doc_id),
            F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
            "component_id",
        ),
        "near-duplicates",
        mark,
    )


def same_words(text: Column) -> Column:
    """A 64-bit hash of the words in lower case: equal for texts that differ in white space and case alone."""
    return F.xxhash64(F.trim(collapse_blanks(ascii_lower(text))))


def similarity(a: Column, b: Column, shingle: int) -> Column:
    """Jaccard similarity of the sets of word shingles of two texts; 1 if neither has a word."""

    def shingles(text: str | None) -> set[tuple[bytes, ...]]:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}

    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(left, right, strict=True):
            one, two = shingles(x.as_py()), shingles(y.as_py())
            found.append(len(one & two) / len(one | two))
        return pa.array(found, pa.float64())

    return of(a, b)


def near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, distance: int = 12
) -> DataFrame:
    """(id, same, keep_id, keep_same) of all documents: the document that stays for each, and ``same_words`` of both.

    Links are all pairs of texts whose sets of ``shingle`` words have a Jaccard similarity of
    ``least`` or more. A pair of that similarity shares a shingle of its prefixes (``overlap``), so
    texts without such a shingle have no link and go no further. Of the others, those of which one
    of ``COPY_TABLES`` fingerprints, of shingles of two words, shares a key and differs in
    ``distance`` bits at most, or is the same, are linked first, each to the nearest; then every text is
    linked to its nearest one of another component, ``NEAREST_ROUNDS`` times; at last all pairs
    left between components are. Every link is verified on the texts. The smallest id of what links
    connect stays (null ids last, then by ``same``).
    """
    bound_batches(docs.sparkSession)
    mark = scratch_mark()
    whole = text_or_empty(text)
    marked = materialize(docs.select(F.col(doc_id).alias("id"), same_words(whole).alias("same")), "copy-ids")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("head")
    nodes = materialize(marked.groupBy("same").agg(first), "copy-nodes")
    shared = materialize(overlap.shared_prefixes(docs, same_words(whole), whole, shingle, least), "copy-prefixes")
    ends = materialize(shared.select(F.col("node").alias("same")).distinct(), "copy-ends")
    dealt = docs.select(same_words(whole).alias("same"), whole.alias("whole")).repartition(-(-marked.count() // TEXTS_A_TASK) or 1, "same")
    texts = dealt.join(ends.hint("merge"), "same", "left_semi")
    texts = texts.groupBy("same").agg(F.min("whole").alias("whole"))
    prints = fingerprints(F.col("whole"), COPY_SHINGLE, COPY_TABLES).alias("prints")
    texts = materialize(texts.select("same", "whole", prints, overlap.sketch_of(F.col("whole"), shingle).alias("of")), "copy-texts")
    own = lambda name: texts.select(F.col("same").alias(f"{name}_node"), F.col("whole").alias(name))
    verified = None

    def verify(pairs: DataFrame) -> None:
        nonlocal verified
        good = pairs.join(own("a"), "a_node").join(own("b"), "b_node").where(similarity(F.col("a"), F.col("b"), shingle) >= least)
        good = materialize(good.select("a_node", "b_node"), "copy-links")
        verified = good if verified is None else verified.unionByName(good)

    verify(materialize(print_links(texts, distance), "copy-candidates"))
    known = texts.select(F.col("same").alias("node"), "of.size", "of.sketch")
    for turn in range(NEAREST_ROUNDS + 1):
        roots = components(verified, "a_node", "b_node")
        known = materialize(known.select("node", "size", "sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "copy-sketches")
        rows = shared.join(known, "node")
        pairs = materialize(overlap.proposals(rows, least, nearest=turn < NEAREST_ROUNDS), "copy-candidates")
        if not pairs.take(1):
            break
        verify(pairs)
        # A text without a pair now has none after more links.
        open_ = pairs.select(F.col("a_node").alias("node")).union(pairs.select("b_node")).distinct()
        known = known.join(open_, "node", "left_semi")
    roots = components(verified, "a_node", "b_node")
    rooted = nodes.join(roots.withColumnRenamed("node", "same"), "same", "left").select("same", "head", F.coalesce("root", "same").alias("root"))
    rooted = materialize(rooted, "copy-roots")
    kept = rooted.groupBy("root").agg(F.min("head").alias("kept"))
    labels = rooted.join(kept, "root").select("same", F.col("kept.id").alias("keep_id"), F.col("kept.same").alias("keep_same"))
    return finish(marked.join(labels, "same").select("id", "same", "keep_id", "keep_same"), "copies", mark)


def print_links(texts: DataFrame, distance: int) -> DataFrame:
    """Proposed links (a_node, b_node) of ``same`` values: each fingerprint's to the nearest smaller one found, and all of a fingerprint's to the smallest."""
    proposed = None
    for table in range(COPY_TABLES):
        own = texts.select("same", F.col("prints")[table].alias("print"))
        reps = materialize(own.groupBy("print").agg(F.min("same").alias("rep")), "copy-reps")
        side = lambda name: reps.select(F.col("print").alias(name), F.col("rep").alias(f"{name}_node"))  # noqa: E731, B023
        links = near_links(reps, distance).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # Each task of the key comparison keeps a forest of its own: one link a fingerprint is left of them all before any is joined.
        links = links.groupBy("a").agg(F.min_by("b", F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "b")).alias("b"))
        between = links.join(side("a"), "a").join(side("b"), "b").select("a_node", "b_node")
        within = own.join(reps, "print").where(F.col("same") != F.col("rep")).select(F.col("same").alias("a_node"), F.col("rep").alias("b_node"))
        found = between.unionByName(within)
        proposed = found if proposed is None else proposed.unionByName(found)
    return proposed.select(F.greatest("a_node", "b_node").alias("a_node"), F.least("a_node", "b_node").alias("b_node")).distinct()
