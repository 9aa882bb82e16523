"""Connected components of a table of links, without gathering them anywhere.

Alternating star contraction: each node points at the smallest node it can see,
first among its larger neighbours, then among its smaller ones, until every
component is a star around its smallest node. Rounds are written to the shared
folder, so lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import materialize


#: Links of one node beyond which it is dealt to several tasks.
LARGE_NODE = 1_000_000


def _star(links: DataFrame, large: list[int], large_node: int) -> DataFrame:
    """(node, near) lists a node's neighbours; link each, and the node, to the smallest of them all.

    ``large`` are the nodes with more than ``large_node`` links, at most links / large_node
    of them: their smallest neighbours go to all tasks, and their links stay where they are.
    """
    def least_of(some: DataFrame) -> DataFrame:
        return some.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))

    if not large:
        return links.join(least_of(links), "node")
    many = F.array_contains(F.split(F.lit(" ".join(map(str, large))), " "), F.col("node").cast("string"))
    some, rest = links.where(many), links.where(~many)
    return some.join(F.broadcast(least_of(some)), "node").unionByName(rest.join(least_of(rest), "node"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("near").alias("node"), F.col("node").alias("near")))


def large_star(links: DataFrame, large: list[int], large_node: int) -> DataFrame:
    seen = _star(both_ways(links), large, large_node)
    return seen.where(F.col("near") > F.col("node")).select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """After a large star a node's smaller neighbours are few: one for each star it was in."""
    down = links.select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near"))
    seen = _star(down, [], 0)
    moved = seen.where(F.col("near") != F.col("least")).select(F.col("near").alias("node"), F.col("least").alias("near"))
    own = seen.select("node", F.col("least").alias("near"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame, a: str, b: str, large_node: int = LARGE_NODE) -> DataFrame:
    """(node, root) for every node with a link, the root being the smallest node of its component, itself included."""
    now = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("near")).distinct(),
        "links",
    )
    state = None
    while True:
        found = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "near"))).first())
        if found == state or not found[0]:
            break
        state, large = found, []
        if state[0] > large_node:
            degrees = both_ways(now).groupBy("node").count().where(F.col("count") > large_node)
            large = sorted(r["node"] for r in degrees.collect())
        now = materialize(small_star(large_star(now, large, large_node)), "stars")
    roots = now.select(F.col("near").alias("node"), F.col("near").alias("root")).distinct()
    return now.select("node", F.col("near").alias("root")).unionByName(roots)
