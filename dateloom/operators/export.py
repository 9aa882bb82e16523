"""Exports of a run: one CSV row per date, or one JSON document; and the guard on what flags refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.functions.columns import csv_cell
from dateloom.operators.ledger import flags_by_date, review_fold

# The CSV columns in order, and the mark that makes spreadsheets read UTF-8.
COLUMNS = (
    "document run_id date_id page raw_text status current_type current_family current_value date_type normalized candidates "
    "precision qualifier resolved_value evidence source confidence flags carried_from_run last_action last_reviewer "
    "last_reason last_reviewed_at context"
).split()
BYTE_ORDER_MARK = "﻿"


def export_rows(dates: DataFrame, events: DataFrame, flags: DataFrame, documents: DataFrame) -> DataFrame:
    """The cells of the CSV export, in reading order: every column text, lists joined, formulas defused."""
    rules = flags_by_date(flags).withColumnRenamed("date_id", "id")
    names = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document"))
    rows = review_fold(dates, events).join(rules, "id", "left").join(names, "document_id", "left")
    given = {
        "date_id": F.col("id"),
        "candidates": F.array_join("candidates", " | "),
        "flags": F.array_join("rules", " | "),
        "last_reviewed_at": F.date_format("last_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    }
    ordered = rows.orderBy("run_id", "page", "char_start", "id")
    return ordered.select(*(csv_cell(given.get(c, F.col(c))).alias(c) for c in COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    """Write export rows as CSV files; readers add ``BYTE_ORDER_MARK`` when they serve one as a download."""
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_json(dates: DataFrame, events: DataFrame, flags: DataFrame, documents: DataFrame, runs: DataFrame, exported_at: str) -> DataFrame:
    """One JSON text per run: document, run, dates with their histories, flags."""
    past = events.groupBy(F.col("date_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("event_id"), "action", "new_type", "new_value", "reviewer", "reason"))).alias("history")
    )
    folded = review_fold(dates, events).join(past, "id", "left").withColumn("history", F.coalesce("history", F.array()))
    body = F.struct("page", "char_start", "id", *(c for c in folded.columns if c not in ("page", "char_start", "id", "run_id")))
    listed = folded.groupBy("run_id").agg(F.array_sort(F.collect_list(body)).alias("dates"))
    noted = flags.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", "rule", "severity", "message", "date_ids"))).alias("flags"))
    run = runs.select(F.col("id").alias("run_id"), "document_id", F.struct(*runs.columns).alias("run"))
    document = documents.select(F.col("id").alias("document_id"), F.struct(*documents.columns).alias("document"))
    joined = run.join(document, "document_id").join(listed, "run_id", "left").join(noted, "run_id", "left")
    whole = F.struct(F.lit(exported_at).alias("exported_at"), "document", "run", F.coalesce("dates", F.array()).alias("dates"), F.coalesce("flags", F.array()).alias("flags"))
    return joined.select("run_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def unknown_flag_dates(flags: DataFrame, dates: DataFrame) -> DataFrame:
    """(flag id, date id) of flags that refer to dates there are not; a write is refused if there is any."""
    each = flags.select(F.col("id").alias("flag_id"), F.explode("date_ids").alias("date_id"))
    return each.join(dates.select(F.col("id").alias("date_id")), "date_id", "left_anti").select("flag_id", "date_id")


def save_results(spark_tables: dict[str, DataFrame], path: str) -> None:
    """Append a run's tables (each with ``run_id``) under ``path``, refusing flags that refer to unknown dates."""
    if {"flags", "dates"} <= spark_tables.keys() and unknown_flag_dates(spark_tables["flags"], spark_tables["dates"]).take(1):
        raise ValueError("a flag refers to a date that is not in the run")
    for name, table in spark_tables.items():
        table.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")
