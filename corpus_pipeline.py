"""From raw documents to packed batches: language, exact copies, near copies, benchmark passages, packing.

Each stage works on all that its predecessor kept and is written as Parquet before
the next one reads it, so no stage repeats the work of another.

Rows are told apart by ``doc_id``; rows repeating both id and text count as copies of
each other, and one of them stays. Null ids and texts, empty tables and extra
columns are allowed at every stage; texts without a letter leave at the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm import decontamination, exact_dedup, language_id, packing, simhash
from dateloom.llm.common import fresh, materialize, release, scratch_mark, scratch_path, text_or_empty
from dateloom.shipping import ship


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays ambiguous."""
    ship(spark)
    out = fresh(docs, "predicted")
    found = language_id.predict(docs, language_id.train(docs), out=out)
    return found.where(~F.col(out)["ambiguous"]).drop(out)


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``, nulls being equal."""
    names = {k: fresh(docs, f"_{k}") for k in keys}
    keyed = docs.withColumns({names[k]: c for k, c in keys.items()})
    gone = gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys))
    same = [keyed[names[k]].eqNullSafe(gone[f"gone_{k}"]) for k in keys]
    # One way at every size: the rows are dealt by key, and the few that go are hashed where they meet.
    return keyed.join(gone.hint("shuffle_hash"), same, "left_anti").drop(*names.values())


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    ship(spark)
    found = exact_dedup.exact_duplicates(docs)
    digest = F.unhex(F.sha2(exact_dedup.collapse_blanks(text_or_empty("text")), 256))
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = found.where(~same_id).select("doc_id", F.unhex("text_sha256").alias("digest"))
    kept = without(docs, materialize(copies.distinct(), "pipeline-dropped"), {"doc_id": F.col("doc_id"), "digest": digest})
    return one_of_each(kept, found.where(same_id & ~F.col("kept")), digest)


def one_of_each(docs: DataFrame, repeated: DataFrame, mark: Column) -> DataFrame:
    """One row of each id and ``mark``, if there are any rows in ``repeated``."""
    if not repeated.take(1):
        return docs
    name = fresh(docs, "_mark")
    return docs.withColumn(name, mark).dropDuplicates(["doc_id", name]).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four in five of their five-word shingles, directly or in steps, the one with the smallest id stays."""
    ship(spark)
    found = simhash.near_copies(docs)
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("same") == F.col("keep_same"))
    same = simhash.same_words(text_or_empty("text"))
    gone = materialize(found.where(~stays).select(F.col("id").alias("doc_id"), "same").distinct(), "pipeline-dropped")
    kept = without(docs, gone, {"doc_id": F.col("doc_id"), "same": same})
    return one_of_each(kept, found.where(stays).groupBy("id", "same").count().where("count > 1"), same)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    ship(spark)
    out = fresh(docs, "found")
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.where(~F.col(out)["contaminated"]).drop(out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: SQL has no XXH64, so it cannot say the near-duplicate stage; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths, mark = [], scratch_mark()
    for name, stage in STAGES:
        paths.append(scratch_path(spark, f"stage-{name}"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(paths[-1])
        release(spark, mark, keep=paths[-1:])
        docs = spark.read.schema(out.schema).parquet(paths[-1])
    return docs
