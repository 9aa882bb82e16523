"""DataFrame operators on small fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dateloom.functions import columns as fc
from dateloom.functions.matching import best_window, find_quote
from dateloom.operators import checks, export, extraction, ledger, order, scoring, verification
from dateloom.plans.batch import process_json, process_pages
from dateloom.plans.queries import QUERIES


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_votes_and_readings(spark):
    texts = ["31/10/2026", "10/31/2026", "29/02/2024", "09/10/2026", "10/10/2026", "31/02/2026", "12/2028", "2026-10-31", "31 / 10 / 2026", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, raw string")
    found = [r.v for r in df.select("i", fc.order_vote(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert found == ["dmy", "mdy", "dmy", None, None, None, None, None, None, None]


def test_order_inference_and_leave_one_out(spark):
    data = [("a", 1, "31/10/2026"), ("a", 2, "09/10/2026"), ("b", 1, "31/10/2026"), ("b", 2, "10/31/2026"), ("c", 1, "09/10/2026"), ("d", 1, "30/10/2026"), ("d", 2, "31/10/2026")]
    df = spark.createDataFrame(data, "doc string, id int, raw string")
    found = {r.doc: (r.status, r.order, r.dmy_evidence) for r in order.infer_order(df, "doc", "id", "raw", ["id"]).collect()}
    assert found == {"a": ("unanimous", "dmy", [1]), "b": ("conflict", None, [1]), "c": ("no_evidence", None, []), "d": ("unanimous", "dmy", [1, 2])}
    assert tuple(order.leave_one_out(df, "doc", "raw").first()) == (2, 2, 1, 5)


DATE = "document_id long, id long, page int, char_start int, raw_text string, normalized string, candidates array<string>, precision string, date_type string, qualifier string, resolved_value string"


def dates(spark, *items):
    made = []
    for i, (kind, value, more) in enumerate(items, 1):
        base = {"page": 1, "char_start": i * 10, "raw_text": value or "x", "normalized": value, "candidates": [value or "2026-01-02", "2026-02-01"], "precision": "day", "qualifier": None, "resolved_value": None}
        base |= more
        made.append((1, i, base["page"], base["char_start"], base["raw_text"], base["normalized"], base["candidates"], base["precision"], kind, base["qualifier"], base["resolved_value"]))
    return spark.createDataFrame(made, DATE)


def test_month_precision_compares_as_last_day(spark):
    df = dates(spark, ("manufacture_date", "2027-03-15", {}), ("expiry_date", "2027-03", {"precision": "month"}))
    assert checks.check_dates(df, "2027-12-01").where("rule LIKE 'expiry%'").count() == 0


def test_single_pair_is_an_error_and_cross_lot_pair_a_warning(spark):
    one = dates(spark, ("manufacture_date", "2026-05-01", {}), ("expiry_date", "2026-05-01", {}))
    assert rows(checks.check_dates(one, "2027-01-01"), "rule", "severity") == [("expiry_before_manufacture", "error")]
    two = dates(
        spark, ("manufacture_date", "2024-01-01", {}), ("expiry_date", "2025-01-01", {}),
        ("manufacture_date", "2026-01-01", {}), ("expiry_date", "2028-01-01", {}),
    )
    assert rows(checks.check_dates(two, "2027-01-01"), "severity", "date_ids") == [("warning", [3, 2])]


def test_future_month_counts_from_its_first_day(spark):
    df = dates(spark, ("signature_date", "2026-11", {"precision": "month"}), ("audit_date", "2026-12", {"precision": "month"}))
    assert rows(checks.check_dates(df, "2026-11-11"), "date_ids") == [([2],)]


def test_other_flags(spark):
    df = dates(
        spark, ("certificate_valid_until", "2020-01-01", {}), ("notarization_date", "2026-02-01", {}), ("apostille_date", "2026-01-01", {}),
        ("signature_date", "2026-01-01", {"qualifier": "Approved by"}), ("effective_date", "2026-01-05", {}), ("other_date", None, {}),
    )
    found = rows(checks.check_dates(df, "2026-11-11"), "rule", "date_ids")
    assert found == [
        ("ambiguous_unresolved", [6]), ("certificate_expired", [1]), ("legalization_chain_order", [2, 3]), ("signature_before_effective", [4, 5]),
    ]


EVENT = "id long, date_id long, action string, new_type string, new_value string, reviewer string, reason string, at timestamp, carried_from_run long"


def events(spark, *items):
    return spark.createDataFrame([(i, d, a, t, v, "r", "why", None, None) for i, (d, a, t, v) in enumerate(items, 1)], EVENT)


def test_fold_keeps_corrections(spark):
    ev = events(spark, (1, "correct", "audit_date", None), (1, "correct", None, "2026-01-01"), (1, "accept", None, None), (2, "accept", None, None), (2, "reopen", None, None))
    df = dates(spark, ("issue_date", "2025-01-01", {}), ("issue_date", None, {}), ("issue_date", "", {"resolved_value": "2024-01-01"}))
    found = rows(ledger.review_fold(df, ev), "id", "status", "current_type", "current_family", "current_value")
    assert found == [(1, "accepted", "audit_date", "audit", "2026-01-01"), (2, "needs_review", "issue_date", "document", None), (3, "needs_review", "issue_date", "document", "2024-01-01")]


def test_carry_over_is_exact_positional_and_idempotent(spark):
    old = dates(spark, ("issue_date", "2025-01-01", {}), ("issue_date", None, {"raw_text": "x"}), ("issue_date", None, {"raw_text": "x"}), ("issue_date", "2025-02-02", {}))
    new = old.withColumn("id", F.col("id") + 10)
    ev = events(spark, (1, "accept", None, None), (3, "reject", None, None), (4, "correct", "audit_date", None), (4, "reopen", None, None))
    copied = ledger.carry_over(old, new, ev, 1)
    assert rows(copied, "date_id", "step", "action", "new_type") == [(11, 0, "accept", None), (13, 0, "reject", None), (14, 0, "correct", "audit_date"), (14, 1, "reopen", None)]
    again = ev.unionByName(copied.select(F.lit(100).alias("id") + F.col("step"), "date_id", "action", "new_type", "new_value", "reviewer", "reason", F.lit(None).cast("timestamp").alias("at"), "carried_from_run").toDF(*ev.columns))
    assert ledger.carry_over(old, new, again, 1).count() == 0


def test_unread_decision_never_lands_on_a_reading(spark):
    old = dates(spark, ("issue_date", None, {"raw_text": "x"}))
    new = dates(spark, ("issue_date", None, {"raw_text": "x", "resolved_value": "2026-01-02"})).withColumn("id", F.lit(11).cast("long"))
    assert ledger.carry_over(old, new, events(spark, (1, "accept", None, None)), 1).count() == 0


def test_quotes_are_found_by_likeness_but_numbers_hold(spark):
    text = "Valid from 01/01/2020 to then"
    assert find_quote("01/01/2030", text.lower(), text) is None
    assert find_quote("01/01/2020", text.lower(), text) == (11, 21)
    assert find_quote("12.III.2026", "ref=12.iii.2026/riga", "Ref=12.III.2026/Riga") == (4, 15)
    assert best_window("abc", "xxabcxx") == (2, 5) and best_window("abc", "zzz") is None


def test_verification_reasons():
    text = "Expiry 03/04/2031 and 12.II.2026"
    cand = {"id": "p1-c1", "raw_text": "03/04/2031", "normalized": None, "candidates": ["2031-03-04", "2031-04-03"], "precision": "day", "char_start": 7, "char_end": 17, "context": "", "rule_label": "expiry", "source": "rules"}
    missed = {"seq": 1, "verbatim_text": "12.III.2026", "date_type": "issue_date", "qualifier": None, "confidence": 2.0, "rationale": "r"}
    found, log = verification.verify_page(1, text, [cand], [], [missed, missed | {"verbatim_text": "12.II.2026"}])
    assert [(d["id"], d["confidence"]) for d in found] == [("p1-c1", 0.5), ("p1-a1", 1.0)]
    assert [x["reason"] for x in log] == ["printed text reads as a different date"]


def test_matching_pairs_one_to_one():
    gold = [{"page": 1, "at": i, "raw_text": "1/2/2026", "date_type": t, "normalized": "2026-01-02", "candidates": None} for i, t in enumerate(["a", "b"])]
    pred = [{"page": 1, "at": i, "raw_text": "1/2/2026", "date_type": t, "normalized": "2026-01-02", "candidates": ["2026-01-02"], "resolved_value": None, "evidence": None} for i, t in enumerate(["b", "a", "a"])]
    out = scoring.match_document(pred, gold, {1: "1/2/2026"})
    assert sorted(o["kind"] for o in out) == ["extra", "match", "match"]
    assert [o["hallucinated"] for o in out if o["kind"] == "extra"] == [False]


def test_pages_to_dates_and_flags(spark):
    text = "Expiry: 09/10/2026\nReceived: 31/12/2025"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "document_id long, n int, text string")
    found, flags, _ = process_pages(pages, "2026-11-11")
    assert rows(found, "raw_text", "normalized", "resolved_value", "date_type") == [("09/10/2026", None, "2026-10-09", "expiry_date"), ("31/12/2025", "2025-12-31", None, "receipt_date")]
    assert flags.count() == 0


def test_transcription_dates_are_kept_where_the_page_prints_them(spark):
    """The text layer's "13,II.2031" is no date by rule; the transcription's is, and is placed on it. One that is not printed is dropped."""
    box = {"x0": 5, "y0": 0, "x1": 9, "y1": 4}
    word = {"text": "13,II.2031", "bbox": box, "char_start": 4, "char_end": 14, "confidence": None}
    page = {"n": 1, "width": 9, "height": 9, "text": "Exp 13,II.2031", "text_source": "pdf", "words": [word], "transcription": "Exp 13.II.2031 Mfg 2030-05-06"}
    df = spark.createDataFrame([(1, json.dumps([page]))], "document_id long, layouts_json string")
    found = json.loads(process_json(df, "2026-11-11").first()["result"])["dates"]
    assert [(d["raw_text"], d["normalized"], d["source"], d["bbox"]["x0"]) for d in found] == [("13,II.2031", "2031-02-13", "ai_only", 5.0)]
    assert found[0]["date_type"] == "expiry_date" and found[0]["confidence"] == 0.5


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "document_id long, n int, text string")
    found, flags, _ = process_pages(pages, "2026-11-11")
    assert found.count() == 0 and flags.count() == 0


def test_export_has_all_columns_and_defused_cells(spark):
    df = dates(spark, ("issue_date", "2025-01-01", {})).withColumns(
        {"run_id": F.lit(1), "evidence": F.lit("=1+1"), "source": F.lit("rules"), "confidence": F.lit(0.5), "context": F.lit("c")}
    )
    flags = spark.createDataFrame([(1, 1, "late", "error", "m", [1])], "id long, run_id int, rule string, severity string, message string, date_ids array<long>")
    docs = spark.createDataFrame([(1, "a.pdf")], "id long, filename string")
    row = export.export_rows(df, events(spark, (1, "accept", None, None)), flags, docs).first()
    assert list(row.asDict()) == export.COLUMNS and row.evidence == "'=1+1" and row.flags == "late" and row.status == "accepted"


def test_unknown_flag_reference_refuses_the_write(spark, tmp_path):
    df = dates(spark, ("issue_date", "2025-01-01", {})).withColumn("run_id", F.lit(1))
    flags = spark.createDataFrame([(1, 1, [9])], "id long, run_id int, date_ids array<long>")
    try:
        export.save_results({"dates": df, "flags": flags}, str(tmp_path))
    except ValueError:
        return
    raise AssertionError("written")


def test_snippet_cuts_at_words(spark):
    df = spark.createDataFrame([("a " * 60 + "2026-01-01" + " b" * 60, "2026-01-01"), ("none", "zz")], "c string, r string")
    one, two = (r.s for r in df.select(fc.snippet(F.col("c"), F.col("r")).alias("s")).collect())
    assert one.match == "2026-01-01" and one.before.startswith("…a") and one.after.endswith("b…") and two.match == ""


def test_stream_reads_landed_pages_once(spark, tmp_path):
    from dateloom.streaming.stream import ingest_pages

    land, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "document_id long, n int, text string"
    for i, value in enumerate(["2026-01-01", "2026-01-02"]):
        spark.createDataFrame([(i, 1, f"Expiry {value}")], schema).write.mode("append").parquet(land)
        ingest_pages(spark, land, schema, out, str(tmp_path / "cp"), "2026-11-11").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/dates"), "document_id", "normalized") == [(0, "2026-01-01"), (1, "2026-01-02")]


def test_table_function(spark):
    extraction.register_sql(spark)
    found = spark.sql("SELECT normalized FROM extract_dates('Expiry 5 May 2026')").collect()
    assert [r[0] for r in found] == ["2026-05-05"]


def test_layout_json_is_read(spark):
    from dateloom.sources.ingest import pages_from_json

    page = {"n": 1, "width": 9, "height": 9, "text": "a", "text_source": "pdf", "words": [{"text": "a", "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "char_start": 0, "char_end": 1, "confidence": None}], "transcription": None}
    df = spark.createDataFrame([(1, json.dumps([page]))], "document_id long, layouts_json string")
    assert pages_from_json(df).select("words.x1").first()[0] == [1.0]


def test_render_adapter_reports_pages_and_failures(spark):
    from dateloom.sources.render import render_pages

    def adapter(content):
        if content == b"locked":
            raise ValueError("password")
        yield {"n": 1, "width": 2, "height": 3, "image": content, "text": "t"}

    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"locked"))], "sha256 string, content binary")
    assert rows(render_pages(files, adapter), "sha256", "n", "failure") == [("a", 1, None), ("b", None, "password")]


def test_new_runs_are_numbered_after_the_last(spark):
    docs = spark.createDataFrame([(5,), (70_000,), (70_001,)], "id long")
    runs = spark.createDataFrame([(9, 5, "done")], "id long, document_id long, status string")
    assert rows(ledger.create_runs(docs, runs, "v"), "id", "document_id") == [(10, 5), (11, 70_000), (12, 70_001)]


def test_rows_are_numbered_over_many_stretches(spark, monkeypatch):
    """Keys far apart, and more rows than stretches."""
    monkeypatch.setattr(ledger, "ROWS_A_CELL", 7)
    keys = [i * i * 1_000 for i in range(100)]
    found = ledger.numbered(spark.createDataFrame([(k,) for k in keys], "id long"), "id", "nr").collect()
    assert sorted((r.id, r.nr) for r in found) == [(k, i) for i, k in enumerate(keys, 1)]


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    """labels and pages meet by a shuffle, however small their files look, and the rules read written dates."""
    spark.range(40).selectExpr("id AS o_orderkey", "date_add(DATE'2020-01-01', cast(id AS int)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("l_judge", "s_process_json"):
        found = QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
        assert "layouts_json" not in plan
        assert found.count() >= 40
