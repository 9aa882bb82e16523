"""What the corpus operators share: gapless numbering, and small columns; scratch tables are those of ``dateloom.scratch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dateloom.scratch import delete_path, finish, freed_shuffles, materialize, release, scratch_mark, scratch_path, shared_root  # noqa: F401

#: ASCII white space as a character class, for Java's and Python's regular expressions.
BLANK = r"[\x20\x09-\x0D]"

def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Keep the batches of text that go to Python at ``most`` bytes or less, however long the texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(name, str(most))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is written and evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, so that every engine agrees on the result."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], out: str, rows_per_cell: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps in the order of the columns ``order``, ties in any order.

    The first of ``order`` is a hexadecimal hash. Its leading digits cut a group into
    cells of about ``rows_per_cell`` rows that one task can sort; cell bases come from
    prefix sums over the cell counts. Rows repeating one hash more often than that are a
    cell for each value of the other columns and each partition they stand in, so no
    group ever meets in one task, however many rows it has and however many repeat. ``df`` must
    be a written table, whose partitions stay the same from job to job.
    """
    first = order[0]
    rows = df.count()
    cells = cells_for(rows, rows_per_cell)
    anchors = [F.lit(""), F.lit(0)]
    if rows > rows_per_cell:
        often = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_cell).select(first)
        found = sorted(r[0] for r in often.collect())  # at most rows / rows_per_cell values
        if found:
            often = F.split(F.lit(" ".join(found)), " ")  # one constant
            before = F.array_max(F.filter(often, lambda v: v <= F.col(first)))
            own = F.when(F.array_contains(often, F.col(first)), F.spark_partition_id() + 1)
            anchors = [F.coalesce(before, F.lit("")), F.when(before.isNull(), 0).otherwise(F.coalesce(own, F.lit(2**31 - 1)))]
    value = F.conv(F.substring(first, 1, 8), 16, 10).cast("long")
    cut = df.withColumns({"_cell": F.floor(value * cells / F.lit(2**32)), "_after": anchors[0], "_part": anchors[1]})
    # A repeated hash is also cut by the other columns, which come before the partition in the order.
    repeated = (F.col("_part") > 0) & (F.col("_part") < 2**31 - 1)
    cut = cut.withColumns({f"_by{i}": F.when(repeated, F.col(c)) for i, c in enumerate(order[1:])})
    key = ["_cell", "_after", "_late", *(f"_by{i}" for i in range(len(order) - 1)), "_part"]
    cut = cut.withColumn("_late", F.col("_part") == 2**31 - 1)
    bases = cut.groupBy(*groups, *key).agg(F.count(F.lit(1)).alias("_n"))
    before_all = Window.partitionBy(*groups).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(*groups, *key, F.coalesce(F.sum("_n").over(before_all), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*groups, *key).orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(within).cast("long"))
    names = [*groups, *key]
    bases = bases.select(*(F.col(c).alias(f"_b_{c}") for c in names), "_base")
    same = [ranked[c].eqNullSafe(bases[f"_b_{c}"]) for c in names]
    return ranked.join(bases, same).withColumn(out, F.col("_base") + F.col("_rank") - 1).drop("_base", "_rank", *key, *(f"_b_{c}" for c in names))


def cells_for(rows: int, rows_per_cell: int) -> int:
    """How many pieces keep about ``rows_per_cell`` rows each."""
    return max(1, -(-rows // rows_per_cell))
