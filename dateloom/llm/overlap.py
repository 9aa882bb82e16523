"""Every pair of texts whose sets of word shingles can have a given Jaccard similarity.

Sets of that similarity t share one of the first n - ceil(t n) + 1 of their n shingles, in any
order of all shingles (prefix filter); here the order is rarest first, so that a common
passage meets in no group unless it fills a text. ``common_shingles`` counts for that order
alone: a shingle that it misses, or that its bound leaves out, stands further in front, which
costs time and loses nothing. Within a group a pair is proposed unless its sizes or its
sketches rule it out: bit i of a sketch is the parity of the shingles that hash to i, so two
sketches differ in at most as many bits as the sets in elements.

Shingles are told apart by a hash of 64 bits. A text shorter than a shingle is one shingle, and
so is one without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
SKETCH_BITS = 1024
#: Shingles held to count repeats among them, and how many of the most frequent order the rest.
BLOCK, MOST_COMMON = 4_000_000, 200_000
#: Rows of a large group that are compared with all others at once.
ROWS_AT_ONCE = 256


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    digest = xxhash.xxh3_64_intdigest
    marks = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(words) - shingle + 1)
    value = np.full(n, min(len(words), shingle), np.uint64)
    for k in range(min(shingle, len(words))):
        value = (value * STEP) ^ (marks[k : k + n] * MIX)
        value ^= value >> np.uint64(32)
    value *= MIX
    value ^= value >> np.uint64(29)
    return np.unique(value)


def common_shingles(docs: DataFrame, text: Column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles in many texts, sorted by hash: a lower bound, from repeats within blocks of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeats() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["mark", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py(), shingle))
                size += len(held[-1])
                if size >= BLOCK:
                    yield repeats()
                    held, size = [], 0
        if held:
            yield repeats()

    counts = docs.select(text.alias("text")).mapInArrow(count, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    found = counts.where("n >= 8").orderBy(F.desc("n"), "mark").limit(MOST_COMMON).toArrow()
    marks, n = (found.column(c).to_numpy() for c in ("mark", "n"))
    marks = marks.view(np.uint64)
    order = np.argsort(marks)
    return marks[order], n[order]


def prefix(values: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The rarest of the shingles, one of which any set of similarity ``least`` shares."""
    n = len(values) - int(np.ceil(least * len(values) - 1e-9)) + 1
    marks, counts = common
    if len(marks):
        at = np.minimum(np.searchsorted(marks, values), len(marks) - 1)
        values = values[np.argsort(np.where(marks[at] == values, counts[at], 0), kind="stable")]
    return values[:n]


def shared_prefixes(docs: DataFrame, node: Column, text: Column, shingle: int, least: float) -> DataFrame:
    """(mark, node): the prefix shingles that stand in more than one node, which is a long that tells texts apart."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, shingle))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(shingle_set(t.as_py(), shingle), common.value, least) for t in batch.column(1)]
            if found:
                own = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(own)], ["mark", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by both columns: different ones whose neighbour has the same mark; the last one waits for the next batch."""
        last, met = None, False

        def out(mark: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(mark), pa.array(node)], ["mark", "node"])

        for batch in batches:
            mark, node = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                mark, node = np.concatenate([last[0], mark]), np.concatenate([last[1], node])
            new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (node[1:] != node[:-1])])
            mark, node = mark[new], node[new]
            if not len(mark):
                continue
            same = mark[1:] == mark[:-1]
            keep = np.concatenate([[met], same]) | np.concatenate([same, [False]])
            yield out(mark[:-1][keep[:-1]], node[:-1][keep[:-1]])
            met = bool(same[-1]) if len(same) else met
            last = mark[-1:], node[-1:]
        if last is not None and met:
            yield out(*last)

    rows = docs.select(node.alias("node"), text.alias("text")).mapInArrow(marks, "mark long, node long")
    return rows.repartition("mark").sortWithinPartitions("mark", "node").mapInArrow(shared, "mark long, node long")


def sketch_of(text: Column, shingle: int) -> Column:
    """struct(size, sketch) of a text's shingles."""

    @F.arrow_udf("struct<size:int,sketch:binary>")
    def of(texts: pa.Array) -> pa.Array:
        sizes, sketches = [], []
        for t in texts:
            values = shingle_set(t.as_py(), shingle)
            odd = np.bincount((values & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
            sizes.append(len(values))
            sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], ["size", "sketch"])

    return of(text)


def possible(size: np.ndarray, sketch: np.ndarray, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) with i in lo..hi that sizes and sketches allow, and how far apart each is in 2^-20 of both sizes."""
    a, b = size[lo:hi, None], size[None, :]
    i, j = np.nonzero(np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9)
    apart = np.empty(len(i), np.int64)
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        apart[part] = np.bitwise_count(sketch[lo + i[part]] ^ sketch[j[part]]).sum(axis=1, dtype=np.int64)
    both = size[lo + i] + size[j]
    fits = apart <= both * ((1 - least) / (1 + least)) + 1e-9
    return lo + i[fits], j[fits], (apart[fits] << 20) // both[fits]


def proposals(rows: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs (a_node, b_node) of the groups of rows (mark, node, root, size, sketch) whose roots differ and that can have the similarity ``least``.

    All of them, or with ``nearest`` the one nearest to each node.
    """

    def of_group(node: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> Iterator[tuple]:
        for lo in range(0, len(node), ROWS_AT_ONCE):
            i, j, apart = possible(size, sketch, lo, min(lo + ROWS_AT_ONCE, len(node)), least)
            other = (root[i] != root[j]) & (nearest | (node[i] > node[j]))
            yield from zip(node[i[other]].tolist(), node[j[other]].tolist(), apart[other].tolist(), strict=True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()

        def found(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            node, root, size = (table.column(c).to_numpy() for c in ("node", "root", "size"))
            if (root == root[0]).all():
                return
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            for a, b, apart in of_group(node, root, size.astype(np.int64), sketch):
                if not nearest:
                    seen.add((a, b))
                elif a not in best or (apart, b) < best[a]:
                    best[a] = apart, b

        def out() -> pa.RecordBatch:
            listed = [(a, b, n) for a, (n, b) in best.items()] if nearest else [(a, b, 0) for a, b in seen]
            a, b, n = zip(*listed, strict=True) if listed else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a_node", "b_node", "apart"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            mark = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(mark)) + 1, [len(mark)]]).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if held and held[0].column(0)[0].as_py() != mark[lo]:
                        found(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
            if len(best) + len(seen) > 1_000_000:
                yield out()
                best.clear()
                seen.clear()
        if held:
            found(held)
        yield out()

    made = rows.select("mark", "node", "root", "size", "sketch").repartition("mark").sortWithinPartitions("mark")
    made = made.mapInArrow(pairs, "a_node long, b_node long, apart long")
    if nearest:
        made = made.groupBy("a_node").agg(F.min_by("b_node", F.struct("apart", "b_node")).alias("b_node"))
    return made.select(F.greatest("a_node", "b_node").alias("a_node"), F.least("a_node", "b_node").alias("b_node")).distinct()
