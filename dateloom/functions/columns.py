"""Date logic as Spark columns: order votes, effective values, display forms and safe cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A full numeric date in either order, nothing else in the text.
NUMERIC = r"^\s*([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([12][0-9]{3})\s*$"


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The ISO date, null if the calendar has none."""
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(iso.try_cast("date").isNotNull(), iso)


def interpret(raw: Column, order: Column | str) -> Column:
    """A full numeric date under one order (``dmy`` or ``mdy``); null if it is none or the order is neither."""
    order = F.lit(order) if isinstance(order, str) else order
    a, b, year = (F.regexp_extract(raw, NUMERIC, i) for i in (1, 2, 3))
    value = F.when(order == "dmy", day_of(year, b, a)).when(order == "mdy", day_of(year, a, b))
    return F.when(raw.rlike(NUMERIC), value)


def order_vote(raw: Column) -> Column:
    """``dmy`` or ``mdy`` where exactly that order gives a calendar date, else null."""
    dmy, mdy = interpret(raw, "dmy"), interpret(raw, "mdy")
    return F.when(dmy.isNotNull() & mdy.isNull(), "dmy").when(mdy.isNotNull() & dmy.isNull(), "mdy")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def value_of(normalized: Column, resolved: Column) -> Column:
    """The printed value, else the resolved one; empty text counts as none."""
    return F.coalesce(blank_to_null(normalized), blank_to_null(resolved))


def effective_value(normalized: Column, resolved: Column, precision: Column) -> Column:
    """The date to compare: a month stands for its last day."""
    value = value_of(normalized, resolved)
    month = F.last_day(F.concat(F.substring(value, 1, 7), F.lit("-01")).try_cast("date"))
    return F.when(precision == "month", month).otherwise(value.try_cast("date"))


def shown_value(normalized: Column, resolved: Column, precision: Column, effective: Column) -> Column:
    value = value_of(normalized, resolved)
    month = F.concat(value, F.lit(" (month precision, compared as "), F.date_format(effective, "yyyy-MM-dd"), F.lit(")"))
    return F.when(precision == "month", month).otherwise(value)


def type_name(date_type: Column) -> Column:
    return F.translate(F.regexp_replace(date_type, "_date$", ""), "_", " ")


def first_upper(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def csv_cell(value: Column) -> Column:
    """Text that no spreadsheet runs as a formula; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_name(filename: Column, run_id: Column, extension: str) -> Column:
    """A safe file name for an export of one run."""
    base = F.element_at(F.split(filename, "/"), -1)
    stem = F.when(base.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.coalesce(blank_to_null(safe), F.lit("document")), F.lit("-run-"), run_id.cast("string"), F.lit(f".{extension}"))


def display_name(filename: Column) -> Column:
    """The base name without control characters, at most 200 characters."""
    base = F.element_at(F.split(F.translate(filename, "\\", "/"), "/"), -1)
    return F.substring(F.regexp_replace(base, r"[\x00-\x1F\x7F]", ""), 1, 200)


def month_label(value: Column) -> Column:
    """``2027-03`` as ``Mar 2027``; other values as they are."""
    first = F.concat(value, F.lit("-01")).try_cast("date")
    return F.when(value.rlike("^[0-9]{4}-[0-9]{2}$") & first.isNotNull(), F.date_format(first, "MMM yyyy")).otherwise(value)


def snippet(context: Column, raw: Column, reach: int = 48) -> Column:
    """struct(before, match, after): the words around a date, cut at word edges, with an ellipsis where cut."""
    text = F.trim(F.regexp_replace(context, r"\s+", " "))
    needle = F.trim(F.regexp_replace(raw, r"\s+", " "))
    at = F.when(F.length(needle) > 0, F.instr(text, needle)).otherwise(0) - 1
    size, until = F.length(text), at + F.length(needle)
    rough = F.greatest(F.lit(0), at - reach)
    space = F.position(F.lit(" "), text, rough + 1)
    start = F.when((rough > 0) & (space > 0), space).otherwise(rough)
    far = F.least(size, until + reach)
    head = F.substr(text, F.lit(1), far + 1)
    last = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    end = F.when(far < size, F.greatest(last, until)).otherwise(far)
    before = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, F.greatest(at - start, F.lit(0))))
    after = F.concat(F.substr(text, until + 1, F.greatest(end - until, F.lit(0))), F.when(end < size, "…").otherwise(""))
    found = F.struct(before.alias("before"), needle.alias("match"), after.alias("after"))
    missing = F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after"))
    return F.when(at >= 0, found).otherwise(missing)
