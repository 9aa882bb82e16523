"""Dates of a text column, and the numbered candidates of document pages.

The reader runs on Arrow batches; a plain pattern that every date contains is
tested before, inside the scan's stage, so texts without a year never reach Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.functions.loose import loose_parse, parse_one
from dateloom.functions.reading import ORDERS, PREFILTER, fields_in, fold, mend, print_key, read_dates
from dateloom.operators.grouping import Rows, map_groups
from dateloom.operators.layout import line_boxes, span_box

HIT = (
    "raw_text string, normalized string, label string, confidence double, context string, start int, end int, "
    "candidates array<string>, precision string, review_reasons array<string>"
)


def struct_of(fields: str) -> str:
    """A column list as a struct type."""
    return "struct<" + ",".join(":".join(f.split(" ", 1)) for f in fields.split(", ")) + ">"


_STRINGS = pa.list_(pa.string())
_HIT = pa.struct(
    [("raw_text", pa.string()), ("normalized", pa.string()), ("label", pa.string()), ("confidence", pa.float64())]
    + [("context", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("candidates", _STRINGS)]
    + [("precision", pa.string()), ("review_reasons", _STRINGS)]
)
#: Fixed value: characters of context on either side of a candidate.
CONTEXT = 200


def hits_of(text: Column, order: str = "auto", repair: bool = True, standalone: bool = False) -> Column:
    """array<hit> of a text column."""
    if order not in ORDERS:
        raise ValueError(f"unknown date order: {order}")

    @F.arrow_udf(f"array<{struct_of(HIT)}>")
    def read(texts: pa.Array) -> pa.Array:
        found = [[h._asdict() for h in read_dates(t, repair, order, standalone)] if t else [] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(_HIT))

    # Else the filter that Spark infers for an explode is pushed below the reader, and every text is read twice.
    return read.asNondeterministic()(text)


def _of_text(function, kind: str, arrow: pa.DataType):
    def column(text: Column) -> Column:
        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else function(t) for t in texts.to_pylist()], arrow)

        return run(text)

    return column


folded = _of_text(fold, "string", pa.string())
mended = _of_text(mend, "string", pa.string())
printed_key = _of_text(print_key, "string", pa.string())
fields_named = _of_text(fields_in, "array<string>", _STRINGS)
_READING = pa.struct([("normalized", pa.string()), ("candidates", _STRINGS), ("precision", pa.string())])
_LOOSE = pa.struct([("value", pa.string()), ("precision", pa.string())])
one_date = _of_text(
    lambda t: (r := parse_one(t)) and r._asdict(), "struct<normalized:string,candidates:array<string>,precision:string>", _READING
)
loose_date = _of_text(
    lambda t: (r := loose_parse(t)) and {"value": r[0], "precision": r[1]}, "struct<value:string,precision:string>", _LOOSE
)


def extract(df: DataFrame, text: str = "text", order: str = "auto", repair: bool = True, standalone: bool = False) -> DataFrame:
    """One row per printed date: the columns of ``df``, the date's fields, and its number ``i`` in the text (from 1)."""
    likely = df.where(F.col(text).rlike(PREFILTER))
    found = likely.withColumn("_hits", hits_of(F.col(text), order, repair, standalone))
    rows = found.select(*df.columns, F.posexplode("_hits").alias("_at", "_hit"))
    return rows.select(*df.columns, (F.col("_at") + 1).alias("i"), "_hit.*")


def candidates(pages: DataFrame, order: str = "auto") -> DataFrame:
    """Numbered candidates of pages (document_id, n, text, optional words), with boxes and wide context."""
    words = F.col("words") if "words" in pages.columns else F.lit(None)
    rows = extract(pages, "text", order)
    left = F.greatest(F.lit(0), F.col("start") - CONTEXT)
    placed = rows.select(
        "document_id",
        F.concat(F.lit("p"), F.col("n"), F.lit("-c"), F.col("i")).alias("id"),
        F.col("n").alias("page"),
        "raw_text", "normalized", "candidates", "precision",
        F.col("start").alias("char_start"),
        F.col("end").alias("char_end"),
        F.substr("text", left + 1, F.col("end") + CONTEXT - left).alias("context"),
        F.col("label").alias("rule_label"),
        F.lit("rules").alias("source"),
        *(
            [span_box(words, F.col("start"), F.col("end")).alias("bbox"), line_boxes(words, F.col("text"), F.col("start"), F.col("end")).alias("line_boxes")]
            if "words" in pages.columns
            else []
        ),
    )
    return placed


def transcription_candidates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Dates of the pages' transcriptions that their text does not yield.

    A transcription date is one of the text if it prints alike and their readings
    meet; each text date absorbs one, in order. ``found`` are the pages' candidates.
    """
    heard = extract(pages.where(F.col("transcription").isNotNull()).select("document_id", F.col("n").alias("page"), "transcription"), "transcription")
    left = F.greatest(F.lit(0), F.col("start") - CONTEXT)
    heard = heard.select(
        "document_id", "page", F.lit("t").alias("side"), F.col("i").alias("at"), "raw_text", "normalized", "candidates", "precision", "start", "end", "label",
        F.substr("transcription", left + 1, F.col("end") + CONTEXT - left).alias("context"),
    )
    known = found.select(
        "document_id", "page", F.lit("c").alias("side"), F.regexp_extract("id", "c([0-9]+)$", 1).cast("int").alias("at"),
        "raw_text", "normalized", "candidates", "precision", F.col("char_start").alias("start"), F.col("char_end").alias("end"),
        F.col("rule_label").alias("label"), "context",
    )

    def leftover(rows: Rows) -> Rows:
        values = lambda r: {*r["candidates"], *filter(None, [r["normalized"]])}
        open_ones = [(print_key(r["raw_text"]), values(r)) for r in rows if r["side"] == "c"]
        kept: Rows = []
        for r in (r for r in rows if r["side"] == "t"):
            key, own = print_key(r["raw_text"]), values(r)
            match = next((i for i, (k, v) in enumerate(open_ones) if k == key and v & own), None)
            if match is not None:
                del open_ones[match]
                continue
            placed = {"id": f"p{r['page']}-t{len(kept) + 1}", "char_start": r["start"], "char_end": r["end"], "rule_label": r["label"], "source": "ai_only"}
            kept.append({k: r[k] for k in ("document_id", "page", "raw_text", "normalized", "candidates", "precision", "context")} | placed)
        return kept

    return map_groups(
        known.unionByName(heard), ["document_id", "page"], ["side", "at"], leftover,
        "document_id long, id string, page int, raw_text string, normalized string, candidates array<string>, precision string, "
        "char_start int, char_end int, context string, rule_label string, source string",
    )


def register_sql(spark: SparkSession) -> None:
    """``SELECT * FROM pages, LATERAL extract_dates(text)`` in SQL."""

    class ExtractDates:
        def eval(self, text: str):
            for h in read_dates(text) if text else []:
                yield tuple(h)

    spark.udtf.register("extract_dates", F.udtf(ExtractDates, returnType=HIT))
