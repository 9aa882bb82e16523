"""Synthetic documents with known dates: printed formats and damages as columns over any date column, without chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.functions.vocabulary import ROMAN

# The printed formats and the damages of a scan that text can show.
FORMATS = (
    "iso dmy_slash mdy_slash dmy_dot dmy_dash spaced_dot spaced_dot_right spaced_slash d_mon_y d_month_y month_d_y d_mon_dot_y "
    "d_mon_y_dash d_mon_y_dot compact roman_dot roman_dash roman_space month_year_slash mon_year month_year"
).split()
PATTERNS = {
    "iso": "yyyy-MM-dd", "dmy_slash": "dd/MM/yyyy", "mdy_slash": "MM/dd/yyyy", "dmy_dot": "dd.MM.yyyy", "dmy_dash": "dd-MM-yyyy",
    "spaced_dot": "dd . MM . yyyy", "spaced_dot_right": "dd. MM. yyyy", "spaced_slash": "dd / MM / yyyy", "d_mon_y": "d MMM yyyy",
    "d_month_y": "d MMMM yyyy", "month_d_y": "MMMM d, yyyy", "d_mon_dot_y": "d MMM. yyyy", "d_mon_y_dash": "d-MMM-yyyy",
    "d_mon_y_dot": "d.MMM.yyyy", "compact": "ddMMMyyyy", "month_year_slash": "MM/yyyy", "mon_year": "MMM yyyy", "month_year": "MMMM yyyy",
}
KINDS = ["coa", "cpp", "sop", "label"]
DAMAGES = ["clean", "digits", "spaces"]
ROMAN_SEPARATORS = {"roman_dot": ".", "roman_dash": "-", "roman_space": " "}


def printed(day: Column, style: Column) -> Column:
    """The date as text in the named format."""
    out = F.lit(None).cast("string")
    for name, pattern in PATTERNS.items():
        text = F.date_format(day, pattern)
        out = F.when(style == name, F.upper(text) if name == "compact" else text).otherwise(out)
    roman = F.element_at(F.array(*map(F.lit, ROMAN)), F.month(day))
    for name, sep in ROMAN_SEPARATORS.items():
        out = F.when(style == name, F.concat_ws(sep, F.dayofmonth(day).cast("string"), roman, F.year(day).cast("string"))).otherwise(out)
    return out


def damaged(text: Column, damage: Column) -> Column:
    """``digits``: every 0 is read as O; ``spaces``: a space around points and slashes."""
    return F.when(damage == "digits", F.translate(text, "0", "O")).when(damage == "spaces", F.regexp_replace(text, " ?([./]) ?", " $1 ")).otherwise(text)


def gold_of(day: Column, style: Column) -> Column:
    """struct(normalized, candidates, precision, read): what a reader must find; ``read`` false for forms left unread on purpose."""
    iso, swapped = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-dd-MM")
    numeric = style.rlike("^(dmy|mdy|spaced)_")
    month = style.isin("month_year_slash", "mon_year", "month_year")
    two = numeric & (F.dayofmonth(day) <= 12) & (F.dayofmonth(day) != F.month(day))
    return F.struct(
        F.when(month, F.substring(iso, 1, 7)).when(~two, iso).alias("normalized"),
        F.when(month, F.array(F.substring(iso, 1, 7))).when(two, F.array_sort(F.array(iso, swapped))).otherwise(F.array(iso)).alias("candidates"),
        F.when(month, "month").otherwise("day").alias("precision"),
        ~((style == "roman_space") & F.month(day).isin(1, 5, 10)).alias("read"),
    )


def document_lines(orders: DataFrame) -> DataFrame:
    """One labelled line for each order in the format of its key: (o_orderkey, day, style, text)."""
    style = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("o_orderkey") % len(FORMATS) + 1).cast("int"))
    rows = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), style.alias("style"))
    return rows.withColumn("text", F.concat(F.lit("Batch record\nExpiry date: "), printed(F.col("day"), F.col("style")), F.lit(" end of line")))
