"""Documents, runs and the append-only review ledger, as tables and views over them.

Ids grow with time, so the largest id is the latest; nothing is ever updated, and
current state is a fold of the events of a date in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dateloom.functions.columns import blank_to_null, value_of
from dateloom.functions.vocabulary import FAMILY_OF, TYPES

#: Rows that one task numbers, and stretches at most.
ROWS_A_CELL, MOST_CELLS = 50_000, 1_000
# Run states, review actions with the state they lead to, and admission errors in the order they are tested.
RUN_STATES = ["queued", "reading", "classifying", "validating", "done", "failed"]
STATUS_OF = {"accept": "accepted", "correct": "corrected", "reject": "rejected", "reopen": "needs_review"}
ADMISSION = (
    "unknown_action", "reviewer_missing", "reason_missing", "correction_empty", "change_without_correction", "type_unknown",
    "value_malformed", "date_not_found", "run_frozen", "day_on_month_date",
)


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def upsert_documents(seen: DataFrame) -> DataFrame:
    """One row per content hash of (seq, filename, sha256, pages): the first name and id, the most pages."""
    return seen.groupBy("sha256").agg(
        F.min("seq").alias("id"), F.min_by("filename", "seq").alias("filename"), F.max("pages").alias("pages"), F.count(F.lit(1)).alias("uploads")
    )


def merge_documents(table: DataFrame, seen: DataFrame) -> DataFrame:
    """The documents after a batch of uploads: known hashes keep id and name."""
    known = table.select(F.col("id").alias("seq"), "filename", "sha256", "pages")
    return upsert_documents(known.unionByName(seen.select("seq", "filename", "sha256", "pages"))).drop("uploads")


def latest_run(runs: DataFrame, done_only: bool = False) -> DataFrame:
    """The latest run of each document, or the latest that is done."""
    chosen = runs.where(F.col("status") == "done") if done_only else runs
    other = [c for c in runs.columns if c not in ("document_id", "id")]
    best = chosen.groupBy("document_id").agg(F.max("id").alias("id"), F.max_by(F.struct(*other), "id").alias("_r"))
    return best.select("document_id", "id", *(F.col(f"_r.{c}").alias(c) for c in other))


def numbered(ids: DataFrame, key: str, out: str) -> DataFrame:
    """Rows numbered from 1 in the order of a distinct integer key: sorted by stretches of it with about as many rows each, with bases from their counts."""
    cells = min(MOST_CELLS, ids.count() // ROWS_A_CELL + 1)
    steps = [i / cells for i in range(1, cells)]
    edges = (ids.agg(F.percentile_approx(key, steps, 10 * MOST_CELLS)).first()[0] if steps else None) or []
    cell = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col(key))) if edges else F.lit(0)
    cut = ids.withColumn("_cell", cell)
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("_cell").count().select("_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(key))
    return cut.withColumn("_place", place).join(bases, "_cell").withColumn(out, F.col("_base") + F.col("_place")).drop("_cell", "_base", "_place")


def create_runs(documents: DataFrame, runs: DataFrame, pipeline_version: str) -> DataFrame:
    """A new queued run for each row of ``documents``, numbered after the last run in the order of document ids."""
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(documents.select("id").distinct(), "id", "_n")
    return new.select(
        (F.lit(last) + F.col("_n")).cast("long").alias("id"), F.col("id").alias("document_id"),
        F.lit(pipeline_version).alias("pipeline_version"), F.lit("queued").alias("status"),
    )


def run_states(changes: DataFrame) -> DataFrame:
    """Current state of each run from its (seq, run_id, document_id, status, at) changes; unknown states are refused."""
    known = changes.where(F.col("status").isin(RUN_STATES))
    last = known.groupBy("run_id", "document_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("at", "seq").alias("_at"), F.min("at").alias("started_at")
    )
    return last.select(
        "run_id", "document_id", "status", "started_at", F.when(F.col("status").isin("done", "failed"), F.col("_at")).alias("finished_at")
    )


def document_states(states: DataFrame) -> DataFrame:
    """A document's state is that of its latest run."""
    return states.groupBy("document_id").agg(F.max("run_id").alias("run_id"), F.max_by("status", "run_id").alias("status"))


def fail_unfinished(runs: DataFrame) -> DataFrame:
    """At start-up, runs that were cut off count as failed; ``was_cut`` marks them."""
    cut = ~F.col("status").isin("done", "failed")
    return runs.withColumns({"was_cut": cut, "status": F.when(cut, "failed").otherwise(F.col("status"))})


def submission(documents: DataFrame, runs: DataFrame, reprocess: bool = False) -> DataFrame:
    """For each document: reuse its latest run, or start a new one carrying from its latest done run.

    A running run is always reused; a done one only if this is no reprocessing.
    """
    latest = latest_run(runs).select("document_id", F.col("id").alias("latest_run"), F.col("status").alias("latest_status"))
    done = latest_run(runs, done_only=True).select("document_id", F.col("id").alias("carry_from"))
    joined = documents.select(F.col("id").alias("document_id")).join(latest, "document_id", "left").join(done, "document_id", "left")
    running = ~F.col("latest_status").isin("done", "failed")
    reuse = F.coalesce(running if reprocess else running | (F.col("latest_status") == "done"), F.lit(False))
    return joined.select(
        "document_id", F.when(reuse, "reuse").otherwise("new_run").alias("decision"),
        F.when(reuse, F.col("latest_run")).alias("run_id"), F.when(~reuse, F.col("carry_from")).alias("carry_from"),
    )


def last_event(events: DataFrame) -> DataFrame:
    """What the events of each date add up to: last action and its fields, and the corrections in force."""
    last = lambda c: F.max_by(c, "id")
    latest_set = lambda c: F.max_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), F.col("id")))
    return events.groupBy("date_id").agg(
        last("action").alias("last_action"), last("reviewer").alias("last_reviewer"), last("reason").alias("last_reason"),
        last("at").alias("last_at"), last("carried_from_run").alias("carried_from_run"),
        blank_to_null(latest_set("new_type")).alias("set_type"), blank_to_null(latest_set("new_value")).alias("set_value"),
        F.count(F.lit(1)).alias("n_events"),
    )


def review_fold(dates: DataFrame, events: DataFrame) -> DataFrame:
    """Dates with their review state: status, current type, family and value, and the run a decision came from."""
    joined = dates.join(last_event(events).withColumnRenamed("date_id", "id"), "id", "left")
    current = F.coalesce("set_type", "date_type")
    return joined.withColumns(
        {
            "status": F.coalesce(mapped(STATUS_OF, F.col("last_action")), F.lit("needs_review")),
            "current_type": current,
            "current_family": mapped(FAMILY_OF, current),
            "current_value": F.coalesce(F.col("set_value"), value_of(F.col("normalized"), F.col("resolved_value"))),
        }
    ).drop("set_type", "set_value")


def reading_order(dates: DataFrame) -> DataFrame:
    return dates.orderBy("run_id", "page", "char_start", "id")


def needs_review(dates: DataFrame, events: DataFrame) -> DataFrame:
    """Dates whose last event is missing or a reopening."""
    last = events.groupBy(F.col("date_id").alias("id")).agg(F.max_by("action", "id").alias("_last"))
    return dates.join(last, "id", "left").where(F.coalesce("_last", F.lit("reopen")) == "reopen").drop("_last")


def history(events: DataFrame) -> DataFrame:
    """Every event of every date with its number, oldest first."""
    return events.withColumn("turn", F.row_number().over(Window.partitionBy("date_id").orderBy("id")))


def list_documents(documents: DataFrame, runs: DataFrame, dates: DataFrame, flags: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the state of their latest run and its counts, newest first; those without a run stay."""
    latest = latest_run(runs).select("document_id", F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    joined = (
        documents.join(latest, documents["id"] == latest["document_id"], "left").drop("document_id")
        .join(count(dates, "n_dates"), "run_id", "left")
        .join(count(flags, "n_flags"), "run_id", "left")
        .join(count(needs_review(dates, events), "n_needs_review"), "run_id", "left")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_dates", "n_flags", "n_needs_review")}
    return joined.withColumns(zero).orderBy(F.col("created_at").desc(), F.col("id").desc())


def document_detail(documents: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their latest run and the sizes of its pages in order."""
    latest = latest_run(runs).select("document_id", F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    sizes = pages.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("n", "width", "height"))).alias("page_sizes"))
    return documents.join(latest, documents["id"] == latest["document_id"], "left").drop("document_id").join(sizes, "run_id", "left")


def admit(requests: DataFrame, dates: DataFrame, runs: DataFrame) -> DataFrame:
    """Review requests (date_id, action, reviewer, reason, new_type, new_value) with the first error, or null if admitted."""
    latest = runs.groupBy("document_id").agg(F.max("id").alias("_latest"))
    known = dates.select(F.col("id").alias("date_id"), "document_id", "run_id", "precision").join(latest, "document_id", "left")
    joined = requests.join(known, "date_id", "left")
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    day = F.when(F.length("new_value") == 10, F.col("new_value")).otherwise(F.concat("new_value", F.lit("-01")))
    well_formed = F.col("new_value").rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$") & day.try_cast("date").isNotNull()
    changes = F.col("new_type").isNotNull() | F.col("new_value").isNotNull()
    tests = [
        ~F.coalesce(F.col("action"), F.lit("")).isin(*STATUS_OF),
        ~given("reviewer"),
        ~given("reason"),
        (F.col("action") == "correct") & ~changes,
        (F.col("action") != "correct") & changes,
        F.col("new_type").isNotNull() & ~F.col("new_type").isin(TYPES),
        F.col("new_value").isNotNull() & ~well_formed,
        F.col("run_id").isNull(),
        F.col("run_id") != F.col("_latest"),
        F.col("new_value").isNotNull() & (F.col("precision") == "month") & (F.length("new_value") != 7),
    ]
    error = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, ADMISSION, strict=True))):
        error = F.when(test, name).otherwise(error)
    return joined.select(*requests.columns, error.alias("error"))


def carry_over(old_dates: DataFrame, new_dates: DataFrame, events: DataFrame, old_run: int) -> DataFrame:
    """Events that copy the decisions on an old run's dates to the equal dates of a new one.

    Dates are equal by page, text and printed value (null equals null), repeats pair
    in reading order before anything is skipped. Nothing goes to a date that has an
    event; a reopening carries the correction in force, reopened, or nothing; a
    decision on an unread date never goes to a date with a reading.
    """
    keys = ["page", "raw_text", "normalized"]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("page", "char_start", "id"))
    old = review_fold(old_dates, events).withColumn("turn", turn)
    new = new_dates.withColumn("turn", turn)
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (*keys, "turn")]
    reviewed = events.select(F.col("date_id").alias("reviewed_id")).distinct()
    pairs = (
        n.join(o, same)
        .where(F.col("o.last_action").isNotNull())
        .select(
            F.col("n.id").alias("date_id"), F.col("n.page").alias("page"), F.col("n.char_start").alias("char_start"),
            F.col("o.last_action").alias("last_action"), F.col("o.last_reviewer").alias("reviewer"),
            F.col("o.current_type").alias("old_type"), F.col("n.date_type").alias("type"),
            F.col("o.current_value").alias("old_value"), value_of(F.col("n.normalized"), F.col("n.resolved_value")).alias("value"),
        )
        .join(reviewed, F.col("date_id") == F.col("reviewed_id"), "left_anti")
    )
    new_type = F.when(~F.col("old_type").eqNullSafe(F.col("type")), F.col("old_type"))
    new_value = F.when(~F.col("old_value").eqNullSafe(F.col("value")), F.col("old_value"))
    event = lambda action, *change: F.struct(F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), *change)
    changed = (new_type.alias("new_type"), new_value.alias("new_value"))
    same_ = (F.lit(None).cast("string").alias("new_type"), F.lit(None).cast("string").alias("new_value"))
    unread = F.col("old_value").isNull() & F.col("value").isNotNull()
    nothing = F.filter(F.array(event("none", *same_)), lambda _: F.lit(False))
    copies = (
        F.when(
            F.col("last_action") == "reopen",
            F.when(new_type.isNull() & new_value.isNull(), nothing).otherwise(F.array(event("correct", *changed), event("reopen", *same_))),
        )
        .when(unread, nothing)
        .otherwise(F.array(event(F.col("last_action"), *changed)))
    )
    rows = pairs.select("date_id", "page", "char_start", "reviewer", F.posexplode(copies).alias("step", "e"))
    return rows.select(
        "date_id", "page", "char_start", "step", "e.action", "e.new_type", "e.new_value", "reviewer",
        F.lit(f"carried over from run {old_run}").alias("reason"), F.lit(old_run).cast("long").alias("carried_from_run"),
    )


def flags_by_date(flags: DataFrame) -> DataFrame:
    """The rules of the flags on each date, in the order of the flags."""
    each = flags.select(F.col("id").alias("flag_id"), "rule", F.explode("date_ids").alias("date_id"))
    in_order = F.array_sort(F.collect_list(F.struct("flag_id", "rule")))
    return each.groupBy("date_id").agg(F.transform(in_order, lambda s: s["rule"]).alias("rules"))


def by_family(dates: DataFrame) -> DataFrame:
    """Dates of folded runs with the place of their family and the family's size, in taxonomy order."""
    place = {f: str(i) for i, f in enumerate(dict.fromkeys(FAMILY_OF.values()))}
    size = F.count(F.lit(1)).over(Window.partitionBy("run_id", "current_family"))
    return dates.withColumns({"family_ord": mapped(place, F.col("current_family")).cast("int"), "family_size": size}).orderBy(
        "run_id", "family_ord", "page", "char_start", "id"
    )


def top_flags(flags: DataFrame, shown: int = 5, most: int = 6) -> DataFrame:
    """Flags by severity then id; the first ``shown`` of a run that has more than ``most``."""
    weight = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(weight, "id"))
    total = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return flags.withColumns({"place": place, "total": total}).where((F.col("total") <= most) | (F.col("place") <= shown))


def review_counts(dates: DataFrame) -> DataFrame:
    """Of each folded run: dates, those to review, carried, and ambiguous without a value."""
    return dates.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("status") == "needs_review").alias("n_needs_review"),
        F.count_if(F.col("carried_from_run").isNotNull()).alias("n_carried"),
        F.count_if(F.col("current_value").isNull() & (F.size("candidates") > 1)).alias("n_ambiguous"),
    )


def dates_per_page(dates: DataFrame) -> DataFrame:
    return dates.groupBy("run_id", "page").agg(F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("bbox").isNotNull()).alias("n_boxed"))
