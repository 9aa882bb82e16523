"""Scores of predicted dates against gold: one-to-one matching, precision and recall, and the two gates."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.operators.grouping import Rows, map_groups

OUTCOME = "document_id long, page int, raw_text string, kind string, predicted_type string, gold_type string, silent boolean, hallucinated boolean"


def squeezed(text: str | None) -> str:
    return "".join((text or "").casefold().split())


def value_ok(prediction: dict, gold: dict) -> bool:
    """The gold value is given, or an ambiguous one is left open or resolved with evidence to one of its readings."""
    resolved, normalized = prediction["resolved_value"], prediction["normalized"]
    if gold["normalized"] is not None:
        return (resolved or normalized) == gold["normalized"]
    if resolved is None:
        return normalized is None
    return prediction["evidence"] is not None and resolved in gold["candidates"]


def match_document(predicted: list[dict], gold: list[dict], texts: dict[int, str], by: str = "text") -> list[dict]:
    """Outcomes of one document. In gold order each item takes its best open prediction: same type, right value, first."""
    readings = lambda x: {*(x["candidates"] or []), *filter(None, [x["normalized"]])}
    key = (lambda x: squeezed(x["raw_text"])) if by == "text" else (lambda x: frozenset(readings(x)))
    open_ = [(p["page"], key(p), p) for p in sorted(predicted, key=lambda p: p["at"])]
    out = []
    for g in sorted(gold, key=lambda g: g["at"]):
        page, wanted = g["page"], key(g)
        fits = [i for i, (n, k, _) in enumerate(open_) if n == page and k == wanted]
        if not fits:
            out.append({"page": page, "raw_text": g["raw_text"], "kind": "missed", "gold_type": g["date_type"]})
            continue
        rank = lambda i: (open_[i][2]["date_type"] != g["date_type"], not value_ok(open_[i][2], g))  # noqa: B023, E731
        p = open_.pop(min(fits, key=rank))[2]
        right = p["date_type"] == g["date_type"] and value_ok(p, g)
        unsaid = g["normalized"] is None and p["evidence"] is None and bool(p["normalized"] or p["resolved_value"])
        out.append(
            {"page": page, "raw_text": p["raw_text"], "kind": "match" if right else "mismatch", "predicted_type": p["date_type"],
             "gold_type": g["date_type"], "silent": unsaid}
        )
    for page, _, p in open_:
        absent = squeezed(p["raw_text"]) not in squeezed(texts.get(page))
        out.append({"page": page, "raw_text": p["raw_text"], "kind": "extra", "predicted_type": p["date_type"], "hallucinated": absent})
    return [{"predicted_type": None, "gold_type": None, "silent": False, "hallucinated": False} | o for o in out]


def match_gold(predicted: DataFrame, gold: DataFrame, pages: DataFrame, by: str = "text") -> DataFrame:
    """Outcomes of all documents. Both sides: document_id, page, at (order), raw_text, date_type, normalized, candidates;
    predictions also resolved_value and evidence. Pages: document_id, n, text."""
    fields = ["document_id", "page", "at", "raw_text", "date_type", "normalized", "candidates", "resolved_value", "evidence"]
    none = F.lit(None).cast("string")
    rows = (
        predicted.select(F.lit("p").alias("side"), *fields)
        .unionByName(gold.withColumns({"resolved_value": none, "evidence": none}).select(F.lit("g").alias("side"), *fields))
        .unionByName(
            pages.select(
                F.lit("t").alias("side"), "document_id", F.col("n").alias("page"), F.lit(0).alias("at"), F.col("text").alias("raw_text"),
                none.alias("date_type"), none.alias("normalized"), F.lit(None).cast("array<string>").alias("candidates"),
                none.alias("resolved_value"), none.alias("evidence"),
            )
        )
    )

    def run(group: Rows) -> Rows:
        part = {s: [r for r in group if r["side"] == s] for s in "pgt"}
        out = match_document(part["p"], part["g"], {r["page"]: r["raw_text"] for r in part["t"]}, by)
        return [{"document_id": group[0]["document_id"], **o} for o in out]

    return map_groups(rows, ["document_id"], [], run, OUTCOME)


def counted(outcomes: DataFrame) -> DataFrame:
    """(date_type, tp, fp, fn) rows, one for each outcome and type it counts for."""
    one = lambda kind, tp, fp, fn, t: F.when(F.col("kind") == kind, F.array(F.struct(F.col(t).alias("date_type"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))))
    both = F.when(
        F.col("kind") == "mismatch",
        F.array(
            F.struct(F.col("predicted_type").alias("date_type"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
            F.struct(F.col("gold_type").alias("date_type"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
        ),
    )
    cells = F.coalesce(one("match", 1, 0, 0, "predicted_type"), both, one("missed", 0, 0, 1, "gold_type"), one("extra", 0, 1, 0, "predicted_type"))
    return outcomes.select(F.explode(cells).alias("c")).select("c.*")


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1")]


def scores(cells: DataFrame) -> DataFrame:
    """Counts and rates by type, and their total in the row ``(all)``."""
    summed = cells.rollup("date_type").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), F.grouping("date_type").alias("_all"))
    return summed.select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("date_type")).alias("date_type"), "tp", "fp", "fn", *rates())


def detection(outcomes: DataFrame) -> DataFrame:
    """Counts and rates with types ignored."""
    found = outcomes.agg(
        F.count_if(F.col("kind").isin("match", "mismatch")).alias("tp"), F.count_if(F.col("kind") == "extra").alias("fp"),
        F.count_if(F.col("kind") == "missed").alias("fn"),
    )
    return found.select("tp", "fp", "fn", *rates())


def gates(outcomes: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Hallucinations and silent resolutions by group and in total; ``passed`` where both are none."""
    groups = groups or ["document_id"]
    found = outcomes.rollup(*groups).agg(
        F.count_if("hallucinated").alias("hallucinations"), F.count_if("silent").alias("silent_resolutions")
    )
    return found.withColumn("passed", (F.col("hallucinations") + F.col("silent_resolutions")) == 0)


def report(outcomes: DataFrame) -> DataFrame:
    """The whole evaluation as one JSON text: scores by type, detection, and the gates by document."""
    rate = ["tp", "fp", "fn", "precision", "recall", "f1"]
    parts = {
        "types": scores(counted(outcomes)).agg(F.to_json(F.array_sort(F.collect_list(F.struct("date_type", *rate)))).alias("json")),
        "detection": detection(outcomes).select(F.to_json(F.struct(*rate)).alias("json")),
        "gates": gates(outcomes).where("document_id IS NULL").select(F.to_json(F.struct("hallucinations", "silent_resolutions", "passed")).alias("json")),
    }
    tagged = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("part"), "json") for name, df in parts.items()))
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.max(F.when(F.col("part") == n, F.col("json")))) for n in parts))
    return tagged.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def report_table(rows: list[dict], columns: list[str]) -> str:
    """Rows as text in columns of fixed width."""
    cells = [columns, *([str(r[c]) for c in columns] for r in rows)]
    widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in chain(cells))


def check_gold(gold: DataFrame) -> DataFrame:
    """Gold items that give neither or both of a value and two readings at least."""
    readings = F.coalesce(F.size("candidates"), F.lit(0))
    return gold.where(F.col("normalized").isNotNull() == (readings >= 2))
