"""Small document tables with every awkward case."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm", "en", "s"),
    (2, "the  quick brown\tfox jumps over the lazy dog and runs away from the farm", "en", "s"),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the farm", "en", "s"),
    (4, None, "en", None),
    (5, "", None, "s"),
    (6, " \n\t ", "de", "s"),
    (7, "word " * 30_000, "en", "s"),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "de", "s"),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "de", "s"),
    (9, "12345 67890", "en", "s"),
    (10, "a\x0bb\x0cc\rd 日本語 🙂 é", "", "s"),
    (None, "no id at all", "en", "s"),
]


def documents(spark, rows=None, **more):
    rows = PLAIN if rows is None else rows
    made = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    df = spark.createDataFrame(made, SCHEMA)
    for name, value in more.items():
        df = df.withColumn(name, value)
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Extra columns named like those that operators make inside."""
    from pyspark.sql import functions as F

    names = ["id", "key", "norm", "digest", "head", "cell", "bucket", "shard", "slot", "found", "predicted", "print", "size", "batch", "_order", "_cell", "rank", "word", "chunk", "_e", "folded", "kept_id"]
    return documents(spark).withColumns({n: F.lit("x") for n in names})
