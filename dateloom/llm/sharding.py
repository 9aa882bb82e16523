"""Rendezvous sharding: every record goes to the shard with the highest weighted score of its own key.

The score of (key, shard) depends on nothing else, so a shard added to the list
only ever takes records into itself, and one removed only gives its own away.
All of it is column arithmetic on one pass over the texts; the numbering shuffles light rows.

Edge cases: a null key counts as the empty key; a null text has no bytes and the
checksum of the empty text; rows with the same key share a shard and each still
gets a slot of its own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import finish, gapless_rank, materialize, scratch_mark

#: Rows that one task of the numbering sorts.
ROWS_PER_CELL = 50_000


def unit_hash(key: Column) -> Column:
    """A double strictly between 0 and 1 from the first 52 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(2.0**52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: the largest of weight / -ln(hash), the smaller number winning ties."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive and finite")
    scores = [
        F.struct(
            (F.lit(float(w)) / -F.log(unit_hash(F.concat(key, F.lit(f":{i}"))))).alias("score"),
            F.lit(-i).alias("minus"),
        )
        for i, w in enumerate(weights)
    ]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["minus"]).cast("int")


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Give every row a shard, a slot in it and, if asked, its shard after growth.

    Slots follow the key's MD5 (a shuffled order that does not depend on the
    file layout), then the key, checksum and size.
    """
    mark = scratch_mark()
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        (rendezvous(name, grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(name).alias("order"),
    )
    ranked = gapless_rank(materialize(rows, "shard-rows"), ["shard"], ["order", "key", "text_crc32", "size"], "slot", rows_per_cell)
    return finish(
        ranked.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"),
        "shards",
        mark,
    )
