"""Length buckets with the least padding, and batches of a fixed token budget inside each bucket.

The lengths of all rows make one histogram; dynamic programming over it picks
the bucket boundaries with the least total padding. Rows of a bucket are numbered
without gaps in a shuffled order that depends on the id alone, and cut into
batches of as many rows as the budget holds at the bucket's length.

Histogram bins are multiples of ``pad_to``; beyond 4,096 of those the bin width
doubles with each doubling of the length, which bounds the histogram by 4,096 bins
and 2,048 for each further doubling, whatever the input.

Edge cases: a null text is a row of the end token alone; a row longer than the
budget makes a batch of its own; rows that repeat each get a slot; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import finish, gapless_rank, materialize, scratch_mark, text_or_empty

PAD_TO, BUCKETS, BUDGET = 8, 12, 65_536
FINE_BINS = 4_096
ROWS_PER_CELL = 50_000


def word_length(text: str = "text") -> Column:
    """Words between white space, and one end token."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def padded(length: Column, pad_to: int = PAD_TO) -> Column:
    """The upper edge of the length's histogram bin."""
    fine = F.lit(pad_to * FINE_BINS)
    octaves = F.greatest(F.lit(0), F.ceil(F.log2(length / fine)))
    width = (F.lit(pad_to) * F.pow(F.lit(2.0), octaves)).cast("long")
    return (F.ceil(length / width) * width).cast("long")


def best_boundaries(sizes: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """The upper edges of at most ``buckets`` buckets that minimise padded tokens; the earliest cut wins ties.

    cost(i, j) = sizes[j] * (rows in i..j) satisfies the quadrangle inequality, so
    the best cut moves right with j and each layer is solved by halving.
    """
    n = len(sizes)
    if not n:
        return []
    size = np.asarray(sizes, dtype=object if max(sizes) * sum(counts) >= 2**62 else np.int64)
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=size.dtype))])
    cost = size * total[1:]
    cuts = []
    for k in range(1, min(buckets, n)):
        better, cut = cost.copy(), np.zeros(n, dtype=np.int64)
        todo = [(k, n - 1, k - 1, n - 2)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            upto = min(right, mid - 1)
            tried = cost[left : upto + 1] + size[mid] * (total[mid + 1] - total[left + 1 : upto + 2])
            at = int(np.argmin(tried))
            better[mid], cut[mid] = tried[at], left + at
            todo += [(lo, mid - 1, left, left + at), (mid + 1, hi, left + at, right)]
        cost = better
        cuts.append(cut)
    edges, j = [n - 1], n - 1
    for cut in reversed(cuts):
        j = int(cut[j])
        edges.append(j)
    return [int(sizes[e]) for e in reversed(edges)]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    pad_to: int = PAD_TO,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per input row: its bucket, the bucket's length, its batch, its place in the batch and its padding."""
    mark = scratch_mark()
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("id"), (word_length() if length is None else length).alias("n_tokens"), F.md5(name).alias("order")
        ),
        "pack-rows",
    )
    histogram = sorted(
        (r["bin"], r["n"]) for r in rows.groupBy(padded(F.col("n_tokens"), pad_to).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    edges = best_boundaries([b for b, _ in histogram], [n for _, n in histogram], buckets) or [pad_to]
    bucket = sum(((F.col("n_tokens") > e).cast("int") for e in edges[:-1]), F.lit(0))
    ranked = gapless_rank(rows.withColumn("bucket", bucket), ["bucket"], ["order", "id", "n_tokens"], "slot", rows_per_cell)
    ends = F.array(*(F.lit(e).cast("long") for e in edges))
    ranked = ranked.withColumn("bucket_len", F.element_at(ends, F.col("bucket") + 1))
    held = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    return finish(
        ranked.select(
            F.col("id").alias(doc_id),
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("slot") / held).cast("long").alias("batch"),
            (F.col("slot") % held).cast("long").alias("place"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        ),
        "packed",
        mark,
    )
