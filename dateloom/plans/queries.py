"""Registered queries of the date operators over the driver's tables, and the SQL that gives the same rows.

Text with dates is printed from known columns; the SQL side never reads a date, it
computes what was printed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dateloom.functions import columns as fc
from dateloom.functions.vocabulary import FAMILY_OF, TAXONOMY, TYPE_LABELS, TYPES
from dateloom.operators import checks, export, extraction, labelling, layout, ledger, order, scoring, verification
from dateloom.plans import batch, synth
from dateloom.sources import ingest
from dateloom.streaming import stream

TODAY = "1999-06-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "orders") -> DataFrame:
    """A table whose rows are read by Python: dealt over all cores where its few files would keep them on one."""
    df, cores = t(spark, sf, name), spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


# --- printed dates -------------------------------------------------------------------------------

#: What the lines of ``synth.document_lines`` hold, in DuckDB.
GOLD = f"""
    base AS (
        SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, ({synth.FORMATS!r})[(o_orderkey % {len(synth.FORMATS)}) + 1] AS style FROM orders
    ), marked AS (
        SELECT *, strftime(day, '%Y-%m-%d') AS iso, strftime(day, '%Y-%d-%m') AS swapped,
               style IN ('month_year_slash', 'mon_year', 'month_year') AS by_month,
               regexp_matches(style, '^(dmy|mdy|spaced)_') AND day(day) <= 12 AND day(day) <> month(day) AS two
        FROM base WHERE NOT (style = 'roman_space' AND month(day) IN (1, 5, 10))
    ), gold AS (
        SELECT *, CASE WHEN by_month THEN substr(iso, 1, 7) WHEN NOT two THEN iso END AS normalized,
               CASE WHEN by_month THEN substr(iso, 1, 7) WHEN two THEN least(iso, swapped) || '|' || greatest(iso, swapped) ELSE iso END AS candidates,
               CASE WHEN by_month THEN 'month' ELSE 'day' END AS precision
        FROM marked
    )
"""


@query(f"""WITH {GOLD} SELECT o_orderkey, 1 AS i, normalized, candidates, precision, 'expiry' AS label, 0.9::DOUBLE AS confidence,
           CASE WHEN two THEN 'ambiguous_numeric_date' WHEN by_month THEN 'month_precision' ELSE '' END AS reasons FROM gold""")
def x_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Every printed format."""
    lines = synth.document_lines(texts(spark, sf))
    return extraction.extract(lines).select(
        "o_orderkey", "i", "normalized", F.array_join("candidates", "|").alias("candidates"), "precision", "label", "confidence",
        F.array_join("review_reasons", ",").alias("reasons"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS normalized, 'Exp1ry: ' || translate(strftime(o_orderdate, '%Y-%m-%d'), '0', 'O') AS text,
          contains(strftime(o_orderdate, '%Y-%m-%d'), '0') AS repaired, 'expiry' AS label FROM orders""")
def x_ocr(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged digits and field words."""
    lines = texts(spark, sf).select(
        "o_orderkey", F.concat(F.lit("Exp1ry: "), synth.damaged(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("digits"))).alias("text")
    )
    found = extraction.extract(lines)
    return found.select("o_orderkey", "normalized", "text", F.array_contains("review_reasons", "ocr_repaired").alias("repaired"), "label")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS normalized FROM orders""")
def x_roman_ocr(spark: SparkSession, sf: str) -> DataFrame:
    """Roman months with I read as l, in capitals again after repair."""
    roman = F.element_at(F.array(*map(F.lit, synth.ROMAN)), F.month("o_orderdate"))
    noisy = F.when(F.length(roman) > 2, F.translate(roman, "I", "l")).otherwise(roman)
    text = F.concat(F.lit("Expiry "), F.date_format("o_orderdate", "dd"), F.lit("."), noisy, F.lit("."), F.date_format("o_orderdate", "yyyy"))
    lines = texts(spark, sf).select("o_orderkey", text.alias("text"))
    return extraction.extract(lines).select("o_orderkey", "normalized")


@query(f"""WITH {GOLD} SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS normalized FROM base""")
def x_declared_order(spark: SparkSession, sf: str) -> DataFrame:
    """A declared order leaves one reading."""
    lines = texts(spark, sf).select("o_orderkey", F.concat(F.lit("EXP "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("text"))
    return extraction.extract(lines, order="dmy").select("o_orderkey", "normalized")


@query("""SELECT o_orderkey, label, strftime(o_orderdate, '%Y-%m-%d') AS normalized FROM orders,
          (VALUES (1, 'manufacture'), (2, 'expiry'), (3, 'unknown')) AS v(i, label)""")
def x_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each date takes the word next to it, none reaches past another date."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("Mfg: "), iso, F.lit("  Exp: "), iso, F.lit("  Other: "), iso)
    return extraction.extract(texts(spark, sf).select("o_orderkey", text.alias("text"))).select("o_orderkey", "label", "normalized")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS hits FROM orders""")
def x_lookalikes(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities, verbs, impossible dates and bare references are no dates."""
    year = F.date_format("o_orderdate", "yyyy")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("Range: 10-"), year, F.lit(" ng/mL")))
        .when(kind == 1, F.concat(F.lit("Patients may "), year, F.lit(" mg daily, ref "), year, F.lit("-01")))
        .when(kind == 2, F.concat(F.lit("Expiry: 31/02/"), year))
        .otherwise(F.concat(F.lit("EXP 03."), year))
    )
    lines = texts(spark, sf).select("o_orderkey", text.alias("text"))
    found = lines.withColumn("h", extraction.hits_of(F.col("text")))
    return found.select("o_orderkey", F.size("h").alias("hits"))


@query("SELECT doc_id, 0::BIGINT AS hits FROM documents WHERE false")
def x_negative_control(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X15 over every document: none prints a date."""
    return extraction.extract(t(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT p_partkey, lower(p_name) AS folded, p_name AS mended, '' AS fields FROM part")
def x_fold_and_fields(spark: SparkSession, sf: str) -> DataFrame:
    """X1, X2, X17 over part names, which hold no field word and no damage."""
    return t(spark, sf, "part").select(
        "p_partkey", extraction.folded(F.col("p_name")).alias("folded"), extraction.mended(F.col("p_name")).alias("mended"),
        F.array_join(extraction.fields_named(F.col("p_name")), ",").alias("fields"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') END AS value,
          CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' END AS precision FROM orders""")
def x_loose(spark: SparkSession, sf: str) -> DataFrame:
    """The forgiving reader of quotes; two months make none."""
    kind = F.col("o_orderkey") % 3
    d = F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.concat(F.lit("the "), F.date_format(d, "d"), F.lit(" day of "), F.date_format(d, "MMMM"), F.lit(", "), F.date_format(d, "yyyy")))
        .when(kind == 1, F.concat_ws(" ", F.date_format(d, "MMMM"), F.date_format(d, "yyyy")))
        .otherwise(F.concat(F.date_format(d, "MMMM"), F.lit(" March "), F.date_format(d, "yyyy")))
    )
    found = texts(spark, sf).select("o_orderkey", extraction.loose_date(text).alias("r"))
    return found.select("o_orderkey", "r.value", "r.precision")


@query(f"""WITH {GOLD} SELECT b.o_orderkey, normalized, candidates, precision FROM base b LEFT JOIN gold USING (o_orderkey)""")
def x_one_date(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes with exactly one date; a spaced one-letter numeral is read by the forgiving reader alone."""
    lines = synth.document_lines(texts(spark, sf))
    quote = F.when((F.col("style") == "roman_space") & F.month("day").isin(1, 5, 10), F.lit("no date")).otherwise(synth.printed(F.col("day"), F.col("style")))
    found = lines.select("o_orderkey", extraction.one_date(quote).alias("r"))
    return found.select("o_orderkey", "r.normalized", F.array_join("r.candidates", "|").alias("candidates"), "r.precision")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS normalized FROM orders""")
def x_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """The reader as a table function in SQL."""
    extraction.register_sql(spark)
    texts(spark, sf).select("o_orderkey", F.concat(F.lit("Expiry "), F.date_format("o_orderdate", "dd MMM yyyy")).alias("text")).createOrReplaceTempView("dateloom_lines")
    return spark.sql("SELECT o_orderkey, normalized FROM dateloom_lines, LATERAL extract_dates(text)")


# --- candidates ----------------------------------------------------------------------------------


def pages_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A page per order: a heading, an expiry date wrapped after its month, and words on a grid of characters."""
    d = F.col("o_orderdate")
    lines = F.array(F.lit("Certificate of analysis"), F.concat(F.lit("Expiry date: "), F.date_format(d, "MMMM")), F.concat(F.date_format(d, "d, yyyy"), F.lit(" end")))
    rows = texts(spark, sf).select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("n"), lines.alias("lines"))

    def words(line: Column, row: Column) -> Column:
        parts = F.split(line, " ")
        before = F.aggregate(F.slice("lines", 1, row), F.lit(0), lambda a, x: a + F.length(x) + 1)

        def word(w: Column, k: Column) -> Column:
            col = F.length(F.array_join(F.slice(parts, 1, k), " ")) + F.when(k > 0, 1).otherwise(0)
            return F.struct(
                w.alias("text"), (col * 10.0).alias("x0"), (row * 20.0).alias("y0"), ((col + F.length(w)) * 10.0).alias("x1"), (row * 20.0 + 15).alias("y1"),
                (before + col).cast("int").alias("char_start"), (before + col + F.length(w)).cast("int").alias("char_end"), F.lit(0.9).alias("confidence"),
            )

        return F.transform(parts, word)

    return rows.select(
        "document_id", "n", F.array_join("lines", "\n").alias("text"), F.flatten(F.transform("lines", words)).alias("words"), F.lit(1000).alias("width"), F.lit(1000).alias("height")
    )


PAGE_SQL = """
    p AS (SELECT o_orderkey AS document_id, strftime(o_orderdate, '%B') AS m, strftime(o_orderdate, '%-d, %Y') AS dy, strftime(o_orderdate, '%Y-%m-%d') AS iso,
                 'Certificate of analysis' || chr(10) || 'Expiry date: ' || strftime(o_orderdate, '%B') || chr(10) || strftime(o_orderdate, '%-d, %Y') || ' end' AS text FROM orders)
"""


@query(f"""WITH {PAGE_SQL} SELECT document_id, 'p1-c1' AS id, m || chr(10) || dy AS raw_text, iso AS normalized, 37 AS char_start, 38 + length(m) + length(dy) AS char_end,
           text AS context, 'expiry' AS rule_label, 'rules' AS source, 0.0::DOUBLE AS x0, 20.0::DOUBLE AS y0,
           greatest(130.0 + 10 * length(m), 10.0 * length(dy))::DOUBLE AS x1, 55.0::DOUBLE AS y1, 2 AS lines,
           (130.0 + 10 * length(m))::DOUBLE AS first_x1, (10.0 * length(dy))::DOUBLE AS second_x1 FROM p""")
def c_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered candidates with context, box and line boxes of a date that wraps."""
    found = extraction.candidates(pages_of_orders(spark, sf))
    return found.select(
        "document_id", "id", "raw_text", "normalized", "char_start", "char_end", "context", "rule_label", "source", "bbox.*",
        F.size("line_boxes").alias("lines"), F.get("line_boxes", F.lit(0))["x1"].alias("first_x1"), F.get("line_boxes", F.lit(1))["x1"].alias("second_x1"),
    )


@query("""SELECT o_orderkey AS document_id, 'p1-t1' AS id, strftime(o_orderdate, '%Y-%m-%d') AS normalized FROM orders WHERE o_orderkey % 3 = 0""")
def c_transcription(spark: SparkSession, sf: str) -> DataFrame:
    """Transcribed dates beyond those of the text; each text date absorbs one, print damage apart."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    heard = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Exp "), iso, F.lit(" Mfg "), iso)).otherwise(F.concat(F.lit("Exp "), F.translate(iso, "0", "O")))
    pages = texts(spark, sf).select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("n"), F.concat(F.lit("Exp: "), iso).alias("text"), heard.alias("transcription"))
    return extraction.transcription_candidates(pages, extraction.candidates(pages)).select("document_id", "id", "normalized")


# --- document order ------------------------------------------------------------------------------


def numeric_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as printed dates of their customer: every 17th customer writes month first in every 5th order."""
    mixed = (F.col("o_custkey") % 17 == 0) & (F.col("o_orderkey") % 5 == 0)
    raw = F.when(mixed, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return texts(spark, sf).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), raw.alias("raw_text"), F.to_date("o_orderdate").alias("day"))


VOTES = """
    printed AS (SELECT o_custkey AS document_id, o_orderkey AS id, o_orderdate::DATE AS day, o_custkey % 17 = 0 AND o_orderkey % 5 = 0 AS mdy FROM orders),
    votes AS (SELECT *, CASE WHEN day(day) > 12 THEN CASE WHEN mdy THEN 'mdy' ELSE 'dmy' END END AS vote,
                     CASE WHEN mdy THEN strftime(day, '%m/%d/%Y') ELSE strftime(day, '%d/%m/%Y') END AS raw_text FROM printed),
    orders_of AS (SELECT document_id, count(*) FILTER (vote = 'dmy') AS dmy_count, count(*) FILTER (vote = 'mdy') AS mdy_count FROM votes GROUP BY document_id),
    inferred AS (SELECT *, CASE WHEN dmy_count > 0 AND mdy_count > 0 THEN 'conflict' WHEN dmy_count + mdy_count > 0 THEN 'unanimous' ELSE 'no_evidence' END AS status,
                        CASE WHEN dmy_count > 0 AND mdy_count = 0 THEN 'dmy' WHEN mdy_count > 0 AND dmy_count = 0 THEN 'mdy' END AS "order" FROM orders_of)
"""


@query(f"WITH {VOTES} SELECT id, raw_text, vote FROM votes")
def d_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The order that a numeric date proves."""
    return numeric_dates(spark, sf).select("id", "raw_text", fc.order_vote(F.col("raw_text")).alias("vote"))


@query(f"""WITH {VOTES} SELECT id, CASE WHEN NOT mdy THEN strftime(day, '%Y-%m-%d') WHEN day(day) <= 12 THEN strftime(day, '%Y-%d-%m') END AS dmy,
           CASE WHEN mdy THEN strftime(day, '%Y-%m-%d') WHEN day(day) <= 12 THEN strftime(day, '%Y-%d-%m') END AS mdy FROM votes""")
def d_interpret(spark: SparkSession, sf: str) -> DataFrame:
    """A numeric date under either order."""
    return numeric_dates(spark, sf).select("id", fc.interpret(F.col("raw_text"), "dmy").alias("dmy"), fc.interpret(F.col("raw_text"), "mdy").alias("mdy"))


@query(f"""WITH {VOTES}, lists AS (SELECT document_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (vote = 'dmy'), '') AS dmy_evidence,
           coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (vote = 'mdy'), '') AS mdy_evidence FROM votes GROUP BY document_id)
           SELECT document_id, status, "order", dmy_count, mdy_count, dmy_evidence, mdy_evidence FROM inferred JOIN lists USING (document_id)""")
def d_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Unanimous, conflicting or no evidence by document."""
    found = order.infer_order(numeric_dates(spark, sf), "document_id", "id", "raw_text", ["id"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("dmy_evidence", "mdy_evidence")})


@query(f"""WITH {VOTES} SELECT v.document_id, v.id,
           CASE WHEN day(day) > 12 OR day(day) = month(day) THEN strftime(day, '%Y-%m-%d') WHEN "order" IS NULL THEN NULL
                WHEN ("order" = 'mdy') = mdy THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%d-%m') END AS normalized,
           CASE WHEN day(day) > 12 OR day(day) = month(day) THEN '' WHEN status = 'conflict' THEN 'ambiguous_numeric_date,conflicting_document_evidence'
                WHEN status = 'unanimous' THEN 'order_from_document_evidence' ELSE 'ambiguous_numeric_date' END AS reasons
           FROM votes v JOIN inferred USING (document_id)""")
def d_resolve_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits read by the order of their document, conflicts noted."""
    lines = numeric_dates(spark, sf).withColumn("text", F.concat(F.lit("Expiry "), F.col("raw_text"))).drop("raw_text")
    hits = extraction.extract(lines).withColumn("start", F.col("id"))
    found = order.resolve_hits(hits, "document_id")
    return found.select("document_id", "id", "normalized", F.array_join("review_reasons", ",").alias("reasons"))


def labelled_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric dates as labelled ones, every 7th ambiguous one resolved from outside as month first."""
    rows = numeric_dates(spark, sf)
    two = (F.dayofmonth("day") <= 12) & (F.dayofmonth("day") != F.month("day"))
    iso, swapped = F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "yyyy-dd-MM")
    said = two & (F.col("id") % 7 == 0)
    return rows.withColumns(
        {
            "page": F.lit(1), "char_start": F.col("id").cast("int"), "normalized": F.when(~two, iso),
            "candidates": F.when(two, F.array_sort(F.array(iso, swapped))).otherwise(F.array(iso)), "precision": F.lit("day"),
            "date_type": F.lit("issue_date"), "qualifier": F.lit(None).cast("string"),
            "resolved_value": F.when(said, fc.interpret(F.col("raw_text"), "mdy")), "evidence": F.when(said, F.lit("MM/DD/YYYY")),
        }
    )


@query(f"""WITH {VOTES}, quotes AS (
               SELECT document_id, string_agg('"' || raw_text || '" (' || id || ')', ', ' ORDER BY id) AS q
               FROM (SELECT *, row_number() OVER (PARTITION BY document_id, vote ORDER BY id) AS rn FROM votes WHERE vote IS NOT NULL) WHERE rn <= 3 GROUP BY document_id),
           x AS (SELECT v.*, i."order", q, day(day) <= 12 AND day(day) <> month(day) AS two FROM votes v JOIN inferred i USING (document_id) LEFT JOIN quotes USING (document_id))
           SELECT document_id, id,
             CASE WHEN two AND id % 7 = 0 THEN CASE WHEN mdy THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%d-%m') END
                  WHEN two AND "order" IS NOT NULL THEN CASE WHEN ("order" = 'mdy') = mdy THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%d-%m') END END AS resolved_value,
             CASE WHEN two AND id % 7 = 0 THEN 'MM/DD/YYYY' WHEN two AND "order" IS NOT NULL THEN
                  'Other dates in this document are only valid ' || CASE "order" WHEN 'dmy' THEN 'day' ELSE 'month' END || '-first: ' || q END AS evidence FROM x""")
def d_resolve_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved values with quoted evidence on labelled dates."""
    return order.resolve_dates(labelled_numeric(spark, sf)).select("document_id", "id", "resolved_value", "evidence")


@query(f"""WITH {VOTES}, sides AS (SELECT dmy_count AS own, mdy_count AS other FROM orders_of UNION ALL SELECT mdy_count, dmy_count FROM orders_of)
           SELECT coalesce(sum(own) FILTER (own > 1 AND other = 0), 0)::BIGINT AS agree, coalesce(sum(own) FILTER (own = 1 AND other > 0), 0)::BIGINT AS disagree,
                  coalesce(sum(own) FILTER (NOT (own > 1 AND other = 0) AND NOT (own = 1 AND other > 0)), 0)::BIGINT AS abstain, sum(own)::BIGINT AS total FROM sides WHERE own > 0""")
def d_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Each revealing date predicted from the others."""
    return order.leave_one_out(numeric_dates(spark, sf), "document_id", "raw_text")


@query(f"""WITH {VOTES}, e AS (SELECT document_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM
               (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS rn FROM votes WHERE vote IS NOT NULL) WHERE rn <= 3 GROUP BY document_id)
           SELECT v.document_id, v.id, i.status, i."order", CASE WHEN i."order" IS NULL THEN NULL WHEN (i."order" = 'mdy') = mdy THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%d-%m') END AS suggested,
                  CASE WHEN i."order" IS NULL THEN '' ELSE e.ids END AS evidence, i.dmy_count, i.mdy_count
           FROM votes v JOIN inferred i USING (document_id) LEFT JOIN e USING (document_id) WHERE day(day) <= 12 AND day(day) <> month(day)""")
def c_register(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions for ambiguous table cells, from cells with one reading only."""
    rows = labelled_numeric(spark, sf)
    cells = rows.select(
        "document_id", F.col("id").cast("string").alias("id"), F.col("id").alias("at"), "raw_text", "candidates",
        F.when(F.size("candidates") > 1, "ambiguous_date").otherwise("date").alias("value_kind"),
    )
    found = order.suggest_register(cells).where("document_order IS NOT NULL").select("document_id", F.col("at").alias("id"), "document_order.*")
    return found.select("document_id", "id", "status", "order", "suggested", F.array_join("evidence_ids", ",").alias("evidence"), "dmy_count", "mdy_count")


# --- labels and suggestions ----------------------------------------------------------------------

TAXONOMY_SQL = ", ".join(
    f"({i}, '{f}', '{TAXONOMY[f][0]}', '{x}', '{TYPE_LABELS.get(x, x.replace('_', ' ')[:1].upper() + x.replace('_', ' ')[1:])}')"
    for i, (x, f) in enumerate(FAMILY_OF.items())
)


@query(f"SELECT * FROM (VALUES {TAXONOMY_SQL}) AS v(ord, family, family_label, type, type_label)")
def l_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy as a table."""
    return labelling.taxonomy(spark)


@query("SELECT 7 AS families, 31 AS types, 'Product / batch' AS first_label, 'CAPA due date' AS capa")
def l_taxonomy_json(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy as JSON, read back."""
    kind = "array<struct<family:string,label:string,types:array<struct<type:string,label:string>>>>"
    parsed = labelling.taxonomy_json(spark).select(F.from_json("json", kind).alias("x"))
    types = F.flatten(F.transform("x", lambda f: f["types"]))
    return parsed.select(
        F.size("x").alias("families"), F.size(types).alias("types"), F.get("x", F.lit(0))["label"].alias("first_label"),
        F.get(F.filter(types, lambda y: y["type"] == "capa_due_date"), F.lit(0))["label"].alias("capa"),
    )


@query(f"""SELECT l_orderkey, l_partkey, family FROM lineitem JOIN (SELECT type, family, ord FROM (VALUES {TAXONOMY_SQL}) AS v(ord, family, family_label, type, type_label))
           ON ord = l_partkey % {len(TYPES)}""")
def l_family(spark: SparkSession, sf: str) -> DataFrame:
    """L4: the family of a type."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", labelling.family_of(kind).alias("family"))


#: Lines with a date at their end (or after a heading) and the type that the words give.
LINES = [
    ("Expiry: ", "expiry_date"),
    ("This certificate is valid until ", "certificate_valid_until"),
    ("Apostille signed on ", "apostille_date"),
    ("Signed by hand: ", "signature_date"),
    ("Approved by QA: ", "approval_date"),
    ("Effective from ", "effective_date"),
    ("Issued: ", "issue_date"),
    ("Signature\nDate: ", "signature_date"),
    ("Nothing of note ", "unknown"),
    ("Notary public, signed ", "notarization_date"),
]


@query(f"""SELECT o_orderkey AS document_id, ({[x for _, x in LINES]!r})[(o_orderkey % {len(LINES)}) + 1] AS date_type, 0.5::DOUBLE AS confidence FROM orders""")
def l_offline(spark: SparkSession, sf: str) -> DataFrame:
    """Types from the words on the line or the heading above."""
    head = F.element_at(F.array(*(F.lit(x) for x, _ in LINES)), (F.col("o_orderkey") % len(LINES) + 1).cast("int"))
    pages = texts(spark, sf).select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("n"), F.concat(head, F.date_format("o_orderdate", "d MMM yyyy")).alias("text"))
    return labelling.label_offline(extraction.candidates(pages), pages).select("document_id", "date_type", "confidence")


def suggestions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages with one ambiguous date, and label and missed-date suggestions of every kind by the order's key."""
    orders = texts(spark, sf).withColumn("k", (F.col("o_orderkey") % 10).cast("int"))
    pages = orders.select(
        F.col("o_orderkey").alias("document_id"), F.lit(1).alias("n"), "k", "o_orderdate",
        F.concat(F.lit("Expiry 03/04/2031 written DD/MM/YYYY\nSigned the "), F.date_format("o_orderdate", "d"), F.lit(" of "), F.date_format("o_orderdate", "MMMM"), F.lit(" in "), F.date_format("o_orderdate", "yyyy"), F.lit(" here")).alias("text"),
    )
    none = F.lit(None).cast("string")
    label = pages.select(
        "document_id", F.lit(1).alias("page"), F.lit(1).alias("seq"),
        F.when(F.col("k") == 0, "p1-c9").otherwise("p1-c1").alias("candidate_id"),
        F.when(F.col("k") == 1, "made_up").otherwise("expiry_date").alias("date_type"), F.lit(" lot A ").alias("qualifier"),
        F.when(F.col("k") == 2, "2031-05-05").otherwise("2031-04-03").alias("resolved_value"),
        F.when(F.col("k") == 3, none).when(F.col("k") == 4, "03/04/2031").when(F.col("k") == 5, "Expiry 03/04/2031").when(F.col("k") == 6, "written MM/DD/YYYY").otherwise("written DD/MM/YYYY").alias("evidence"),
        F.lit(1.5).alias("confidence"), F.lit("as printed").alias("rationale"),
    )
    second = label.where("document_id % 20 < 10").withColumn("seq", F.lit(2))
    day = F.col("o_orderdate")
    quote = F.concat(F.date_format(day, "d"), F.lit(" of "), F.date_format(day, "MMMM"), F.lit(" in "), F.date_format(day, "yyyy"))
    missed = pages.select(
        "document_id", F.lit(1).alias("page"), F.lit(1).alias("seq"),
        F.when(F.col("k") == 7, "no date at all").when(F.col("k") == 8, "03 Apr 2039").when(F.col("k") == 9, "03/04/2031").otherwise(quote).alias("verbatim_text"),
        F.when(F.col("k") == 6, "made_up").otherwise("signature_date").alias("date_type"), F.lit("").alias("qualifier"), F.lit(0.4).alias("confidence"), F.lit("seen").alias("rationale"),
    )
    return pages, label.unionByName(second), missed, extraction.candidates(pages)


K = "k AS (SELECT o_orderkey AS document_id, o_orderkey % 10 AS k, o_orderdate FROM orders)"


@query(f"""WITH {K} SELECT document_id, 1 AS seq, 'label' AS kind, 'unknown candidate id' AS reason FROM k WHERE k = 0
           UNION ALL SELECT document_id, 2, 'label', 'unknown candidate id' FROM k WHERE k = 0 AND document_id % 20 < 10
           UNION ALL SELECT document_id, 1, 'label', 'date type not in taxonomy' FROM k WHERE k = 1
           UNION ALL SELECT document_id, 2, 'label', 'date type not in taxonomy' FROM k WHERE k = 1 AND document_id % 20 < 10
           UNION ALL SELECT document_id, 1, 'label', 'duplicate label for the same candidate' FROM k WHERE k > 1 AND document_id % 20 < 10
           UNION ALL SELECT document_id, 1 + (document_id % 20 < 10)::INT, 'resolution', CASE k WHEN 2 THEN 'resolved value is not one of the candidate readings' WHEN 3 THEN 'resolved value given without evidence'
               WHEN 4 THEN 'evidence only repeats the date' WHEN 5 THEN 'evidence does not show the day/month order' ELSE 'evidence not found on the page' END FROM k WHERE k BETWEEN 2 AND 6
           UNION ALL SELECT document_id, 2 + (document_id % 20 < 10)::INT, 'missed_date', 'date type not in taxonomy' FROM k WHERE k = 6
           UNION ALL SELECT document_id, 1 + (document_id % 20 < 10)::INT, 'missed_date', CASE k WHEN 7 THEN 'could not parse the text as one date' WHEN 8 THEN 'not found in the page text' ELSE 'duplicate of p1-c1' END FROM k WHERE k >= 7""")
def a_discards(spark: SparkSession, sf: str) -> DataFrame:
    """What is refused of suggestions, in order, with the reason."""
    pages, labels, missed, found = suggestions(spark, sf)
    return verification.verify(pages, found, labels, missed)[1].select("document_id", "seq", "kind", "reason")


@query(f"""WITH {K} SELECT document_id, 'p1-c1' AS id, '03/04/2031' AS raw_text, 'expiry_date' AS date_type, CASE WHEN k >= 7 THEN '2031-04-03' END AS resolved_value,
           CASE WHEN k >= 7 THEN 'written DD/MM/YYYY' END AS evidence, CASE WHEN k < 2 THEN 'rules' ELSE 'rules+ai' END AS source,
           CASE WHEN k < 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN k >= 2 THEN 'lot A' END AS qualifier FROM k
           UNION ALL SELECT document_id, 'p1-a1', strftime(o_orderdate, '%-d') || ' of ' || strftime(o_orderdate, '%B') || ' in ' || strftime(o_orderdate, '%Y'),
           'signature_date', NULL, NULL, 'ai_only', 0.4, NULL FROM k WHERE k < 6""")
def a_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Dates with accepted labels and resolutions, and verified missed dates."""
    pages, labels, missed, found = suggestions(spark, sf)
    dates = verification.verify(pages, found, labels, missed)[0]
    return dates.select("document_id", "id", "raw_text", "date_type", "resolved_value", "evidence", "source", "confidence", "qualifier")


@query(f"""WITH {K}, l AS (SELECT document_id, k, s FROM k, (VALUES (1), (2)) AS v(s) WHERE s = 1 OR document_id % 20 < 10)
           SELECT document_id, s AS seq, CASE WHEN k = 0 THEN 'unknown candidate id' WHEN k = 1 THEN 'date type not in taxonomy' WHEN s = 2 THEN 'duplicate label for the same candidate' END AS reason FROM l""")
def l_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Labels judged as one join, without the pages."""
    _, labels, _, found = suggestions(spark, sf)
    return labelling.judge_labels(labels, found).select("document_id", "seq", "reason")


@query(f"""WITH {K} SELECT document_id, CASE WHEN k < 2 THEN 'rules' ELSE 'rules+ai' END AS source, 'expiry_date' AS date_type, 'product' AS family,
           CASE WHEN k < 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM k""")
def l_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted labels on candidates, offline ones on the rest."""
    pages, labels, _, found = suggestions(spark, sf)
    return labelling.apply_labels(found, pages, labels)[0].select("document_id", "source", "date_type", "family", "confidence")


@query(f"""WITH p AS (SELECT o_orderkey AS document_id, strftime(o_orderdate, '%d,') || ({synth.ROMAN!r})[month(o_orderdate)] || strftime(o_orderdate, '.%Y') AS printed,
                  strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
           SELECT document_id, CASE WHEN document_id % 3 > 0 THEN printed END AS raw_text, CASE WHEN document_id % 3 > 0 THEN iso END AS normalized,
                  CASE WHEN document_id % 3 > 0 THEN 7 END::INT AS char_start, CASE WHEN document_id % 3 = 0 THEN 'not found in the page text' END AS reason FROM p""")
def a_relocated(spark: SparkSession, sf: str) -> DataFrame:
    """A4: dates that a transcription reads stand where the page prints them, in its own spelling; every third page prints another year."""
    roman, d = F.element_at(F.array(*map(F.lit, synth.ROMAN)), F.month("o_orderdate")), F.col("o_orderdate")
    year = F.date_format(d, "yyyy")
    other = F.when(F.col("o_orderkey") % 3 == 0, (year.cast("int") + 1).cast("string")).otherwise(year)
    pages = texts(spark, sf).select(
        F.col("o_orderkey").alias("document_id"), F.lit(1).alias("n"),
        F.concat(F.lit("Sealed "), F.date_format(d, "dd"), F.lit(","), roman, F.lit("."), other, F.lit(" in Bonn")).alias("text"),
        F.concat(F.lit("Sealed "), F.date_format(d, "dd"), F.lit("."), roman, F.lit("."), year).alias("transcription"),
    )
    rules = extraction.candidates(pages)
    found = rules.unionByName(extraction.transcription_candidates(pages, rules), allowMissingColumns=True)
    dates, refused = batch.verify_heard(pages, found)
    none = F.lit(None).cast("string")
    kept = dates.select("document_id", "raw_text", "normalized", "char_start", none.alias("reason"))
    return kept.unionByName(refused.select("document_id", none.alias("raw_text"), none.alias("normalized"), F.lit(None).cast("int").alias("char_start"), "reason"))


# --- checks --------------------------------------------------------------------------------------


def typed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as typed dates of their order: type, precision and qualifier by the part's and supplier's key."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linenumber", "l_quantity"))
    kinds = F.array(*map(F.lit, TYPE_CYCLE))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    month, open_ = F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 7 == 0
    rows = t(spark, sf, "lineitem").withColumn("at", at)
    return rows.select(
        F.col("l_orderkey").alias("document_id"), F.col("at").alias("id"), (F.col("at") % 2 + 1).alias("page"), (F.col("at") * 10).alias("char_start"), day.alias("raw_text"),
        F.when(~open_, F.when(month, F.substring(day, 1, 7)).otherwise(day)).alias("normalized"), F.array(day, F.lit("2100-01-01")).alias("candidates"),
        F.when(month, "month").otherwise("day").alias("precision"), F.element_at(kinds, (F.col("l_partkey") % len(TYPE_CYCLE) + 1).cast("int")).alias("date_type"),
        F.when(F.col("l_partkey") % 3 == 0, "Approved by").alias("qualifier"), F.lit(None).cast("string").alias("resolved_value"),
    )


TYPE_CYCLE = [
    "manufacture_date", "expiry_date", "retest_date", "signature_date", "effective_date", "issue_date", "certificate_issue_date",
    "notarization_date", "apostille_date", "translation_certification_date", "certificate_valid_until", "inspection_date",
]

TYPED = f"""
    typed AS (
        SELECT l_orderkey AS document_id, nr AS id, nr % 2 + 1 AS page, nr * 10 AS char_start, l_suppkey % 5 = 0 AS by_month, l_suppkey % 7 = 0 AS open_,
               l_shipdate::DATE AS day, strftime(l_shipdate, '%Y-%m-%d') AS raw_text, ({TYPE_CYCLE!r})[(l_partkey % {len(TYPE_CYCLE)}) + 1] AS date_type, l_partkey % 3 = 0 AS approved
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_linenumber, l_quantity) AS nr FROM lineitem)
    ), d AS (
        SELECT *, CASE WHEN open_ THEN NULL WHEN by_month THEN last_day(day) ELSE day END AS v,
               CASE WHEN by_month THEN strftime(day, '%Y-%m') || ' (month precision, compared as ' || strftime(last_day(day), '%Y-%m-%d') || ')' ELSE strftime(day, '%Y-%m-%d') END AS shown,
               row_number() OVER (PARTITION BY document_id ORDER BY page, char_start) AS pos
        FROM typed
    )
"""


def flags_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    return df.select("document_id", "rule", "severity", "message", F.array_join("date_ids", ",").alias("date_ids"))


def pair_sql(rule: str, later: str, name: str) -> str:
    return f"""WITH {TYPED}, f AS (SELECT * FROM d WHERE date_type = 'manufacture_date' AND v IS NOT NULL), l AS (SELECT * FROM d WHERE date_type = '{later}' AND v IS NOT NULL),
        nf AS (SELECT document_id, count(*) AS n FROM f GROUP BY 1), nl AS (SELECT document_id, count(*) AS n FROM l GROUP BY 1),
        near AS (SELECT f.document_id, f.pos AS fp, l.pos AS lp,
                   row_number() OVER (PARTITION BY l.document_id, l.pos ORDER BY abs(l.char_start - f.char_start), NOT (f.char_start < l.char_start), f.pos) AS rf,
                   row_number() OVER (PARTITION BY f.document_id, f.pos ORDER BY abs(l.char_start - f.char_start), (l.char_start < f.char_start), l.pos) AS rl
                 FROM f JOIN l ON f.document_id = l.document_id AND f.page = l.page),
        pairs AS (SELECT f.document_id, f.id AS fid, l.id AS lid, f.shown AS fs, l.shown AS ls, (nf.n = 1 AND nl.n = 1) OR coalesce(rf = 1 AND rl = 1, false) AS paired
                  FROM f JOIN l ON f.document_id = l.document_id AND l.v <= f.v JOIN nf ON nf.document_id = f.document_id JOIN nl ON nl.document_id = f.document_id
                  LEFT JOIN near ON near.document_id = f.document_id AND near.fp = f.pos AND near.lp = l.pos)
        SELECT document_id, '{rule}' AS rule, CASE WHEN paired THEN 'error' ELSE 'warning' END AS severity,
               '{name} ' || ls || ' is not after manufacture ' || fs || CASE WHEN paired THEN '.' ELSE '; these dates may belong to different lots.' END AS message,
               fid || ',' || lid AS date_ids FROM pairs"""


@query(pair_sql("expiry_before_manufacture", "expiry_date", "Expiry"))
def v_expiry_before_manufacture(spark: SparkSession, sf: str) -> DataFrame:
    """Expiry on or before manufacture; nearest pairs are errors."""
    return flags_of(spark, checks.not_after(checks.prepared(typed_dates(spark, sf)), "expiry_before_manufacture", "manufacture_date", "expiry_date", 1))


@query(pair_sql("retest_before_manufacture", "retest_date", "Retest"))
def v_retest_before_manufacture(spark: SparkSession, sf: str) -> DataFrame:
    """V2: retest on or before manufacture."""
    return flags_of(spark, checks.not_after(checks.prepared(typed_dates(spark, sf)), "retest_before_manufacture", "manufacture_date", "retest_date", 2))


@query(f"""WITH {TYPED} SELECT s.document_id, 'signature_before_effective' AS rule, 'warning' AS severity,
           'Approval signature ' || s.shown || ' is before the document ' || replace(replace(e.date_type, '_date', ''), '_', ' ') || ' date ' || e.shown || '.' AS message, s.id || ',' || e.id AS date_ids
           FROM d s JOIN d e USING (document_id) WHERE s.date_type = 'signature_date' AND s.approved AND e.date_type IN ('effective_date', 'issue_date') AND s.v < e.v""")
def v_signature(spark: SparkSession, sf: str) -> DataFrame:
    """V3: approval signatures before the document's own dates."""
    return flags_of(spark, checks.signature_before_effective(checks.prepared(typed_dates(spark, sf))))


@query(f"""WITH {TYPED}, s AS (SELECT *, CASE date_type WHEN 'certificate_issue_date' THEN 0 WHEN 'notarization_date' THEN 1 WHEN 'apostille_date' THEN 2 WHEN 'translation_certification_date' THEN 3 END AS stage FROM d)
           SELECT e.document_id, 'legalization_chain_order' AS rule, 'error' AS severity, upper(substr(l.date_type, 1, 1)) || substr(replace(replace(l.date_type, '_date', ''), '_', ' '), 2) || ' ' || l.shown
           || ' is before ' || replace(replace(e.date_type, '_date', ''), '_', ' ') || ' ' || e.shown || '; expected order: {checks.CHAIN}.' AS message, e.id || ',' || l.id AS date_ids
           FROM s e JOIN s l ON e.document_id = l.document_id AND e.stage < l.stage AND l.v < e.v""")
def v_chain(spark: SparkSession, sf: str) -> DataFrame:
    """V4: stages of legalisation out of order."""
    return flags_of(spark, checks.legalization_chain(checks.prepared(typed_dates(spark, sf))))


@query(f"""WITH {TYPED} SELECT document_id, 'certificate_expired' AS rule, 'error' AS severity, 'Certificate valid until ' || shown || ' has passed (reference date {TODAY}).' AS message, id::VARCHAR AS date_ids
           FROM d WHERE date_type = 'certificate_valid_until' AND v < DATE '{TODAY}'""")
def v_expired(spark: SparkSession, sf: str) -> DataFrame:
    """V5: certificates past their date."""
    return flags_of(spark, checks.certificate_expired(checks.prepared(typed_dates(spark, sf)), TODAY))


@query(f"""WITH {TYPED} SELECT document_id, 'future_past_date' AS rule, 'warning' AS severity, upper(substr(date_type, 1, 1)) || substr(replace(date_type, '_date', ''), 2) || ' ' || shown
           || ' is after the reference date {TODAY}; it should be in the past.' AS message, id::VARCHAR AS date_ids
           FROM d WHERE date_type IN ('signature_date', 'manufacture_date', 'inspection_date', 'audit_date') AND (CASE WHEN by_month THEN date_trunc('month', v) ELSE v END) > DATE '{TODAY}'""")
def v_future(spark: SparkSession, sf: str) -> DataFrame:
    """V6: dates of the past after the reference date."""
    return flags_of(spark, checks.future_past_date(checks.prepared(typed_dates(spark, sf)), TODAY))


@query(f"""WITH {TYPED} SELECT document_id, 'ambiguous_unresolved' AS rule, 'info' AS severity, raw_text || ' could be ' || raw_text || ' or 2100-01-01; choose the reading.' AS message, id::VARCHAR AS date_ids
           FROM d WHERE open_""")
def v_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """V7: dates without a value."""
    return flags_of(spark, checks.ambiguous_unresolved(checks.prepared(typed_dates(spark, sf))))


@query(f"""WITH {VOTES}, x AS (SELECT v.*, i."order", row_number() OVER (PARTITION BY document_id, vote ORDER BY id) AS rn FROM votes v JOIN inferred i USING (document_id)),
           e AS (SELECT document_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM x WHERE vote IS NOT NULL AND rn <= 3 GROUP BY document_id),
           bad AS (SELECT *, CASE WHEN mdy THEN strftime(day, '%Y-%d-%m') ELSE strftime(day, '%Y-%m-%d') END AS by_day, CASE WHEN mdy THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%d-%m') END AS by_month_
                   FROM x WHERE id % 7 = 0 AND day(day) <= 12 AND day(day) <> month(day) AND "order" = 'dmy')
           SELECT b.document_id, 'ai_rules_disagree' AS rule, 'warning' AS severity, 'AI read ' || raw_text || ' as ' || by_month_ || '; other dates in this document are only valid day-first, which reads it as ' || by_day || '.' AS message,
                  b.id || ',' || ids AS date_ids FROM bad b JOIN e USING (document_id)""")
def v_disagree(spark: SparkSession, sf: str) -> DataFrame:
    """V8: outside readings against the document's order."""
    return flags_of(spark, checks.suggestion_disagrees(checks.prepared(labelled_numeric(spark, sf))))


@query(f"""WITH {TYPED} SELECT document_id, id, strftime(v, '%Y-%m-%d') AS effective, CASE WHEN NOT open_ THEN CASE WHEN by_month THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y-%m-%d') END END AS value FROM d""")
def v_effective(spark: SparkSession, sf: str) -> DataFrame:
    """V0: the value to compare; a month is its last day."""
    found = checks.with_effective_value(typed_dates(spark, sf))
    return found.select("document_id", "id", F.date_format("effective_value", "yyyy-MM-dd").alias("effective"), "value")


RULES = "v_expiry_before_manufacture v_retest_before_manufacture v_signature v_chain v_expired v_future v_ambiguous".split()


@query("SELECT rule, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT rule, severity FROM ({ORACLES[r]})" for r in RULES) + ") GROUP BY ALL")
def v_all_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V8 as one report in order; these dates hold no numeric one, so no order to disagree with."""
    found = checks.check_dates(typed_dates(spark, sf), TODAY)
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- documents, runs and reviews -----------------------------------------------------------------

@query("""SELECT o_orderkey AS document_id, 'Expiry ' || strftime(o_orderdate, '%Y-%m-%d') || ' is not after manufacture ' || strftime(o_orderdate, '%Y-%m-%d')
           || CASE severity WHEN 'error' THEN '.' ELSE '; these dates may belong to different lots.' END AS message, severity, date_ids
           FROM orders, (VALUES ('1,3', 'error'), ('2,4', 'error'), ('1,4', 'warning'), ('2,3', 'warning')) AS v(date_ids, severity)""")
def v_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """V9: two lots on a page, whose dates are neighbours by their boxes and not by their offsets in the text."""
    spots = [(1, "manufacture_date", 0, 0.0), (2, "manufacture_date", 100, 500.0), (3, "expiry_date", 110, 20.0), (4, "expiry_date", 10, 520.0)]
    of = lambda i, kind, at, y: F.struct(
        F.lit(i).alias("id"), F.lit(kind).alias("date_type"), F.lit(at).alias("char_start"),
        F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(90.0).alias("x1"), F.lit(y + 15).alias("y1")).alias("bbox"),
    )
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.explode(F.array(*(of(*x) for x in spots))).alias("s"))
    none = F.lit(None).cast("string")
    dates = rows.select(
        "document_id", "s.*", F.lit(1).alias("page"), F.col("day").alias("raw_text"), F.col("day").alias("normalized"), F.array("day").alias("candidates"),
        F.lit("day").alias("precision"), none.alias("qualifier"), none.alias("resolved_value"),
    )
    found = checks.not_after(checks.prepared(dates), "expiry_before_manufacture", "manufacture_date", "expiry_date", 1)
    return found.select("document_id", "message", "severity", F.array_join("date_ids", ",").alias("date_ids"))


#: Review events from the event stream: the user is the date, the event type the action.
ACTION = "CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'reopen' ELSE 'accept' END"
#: The same, with signups asking for what is no action.
ASKED = ACTION.replace("ELSE 'accept'", "ELSE 'publish'")
EVENT_COLUMNS = [
    "event_id AS id", "user_id AS date_id", f"{ACTION} AS action",
    f"CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'audit_date' ELSE 'issue_date' END END AS new_type",
    "CASE WHEN event_type = 'purchase' AND event_id % 3 > 0 THEN concat('20', lpad(CAST(event_id % 30 + 10 AS STRING), 2, '0'), '-01-15') END AS new_value",
    "concat('r', CAST(event_id % 5 AS STRING)) AS reviewer", "'checked' AS reason", "CAST(NULL AS BIGINT) AS carried_from_run",
]
EVENTS = f"""
    ev AS (SELECT event_id AS id, user_id AS date_id, {ACTION} AS action,
        CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'audit_date' ELSE 'issue_date' END END AS new_type,
        CASE WHEN event_type = 'purchase' AND event_id % 3 > 0 THEN concat('20', lpad(CAST(event_id % 30 + 10 AS VARCHAR), 2, '0'), '-01-15') END AS new_value,
        concat('r', CAST(event_id % 5 AS VARCHAR)) AS reviewer FROM events),
    users AS (SELECT DISTINCT user_id AS id FROM events),
    dates AS (SELECT id, id % 20 + 1 AS run_id, id % 4 + 1 AS page, id * 10 AS char_start, 'day' AS precision,
        CASE id % 5 WHEN 0 THEN NULL ELSE '2024-05-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') END AS normalized, ({TYPES!r})[(id % {len(TYPES)}) + 1] AS date_type FROM users)
"""


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").selectExpr(*EVENT_COLUMNS, "ts AS at")


def ledger_dates(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, TYPES))
    users = t(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    value = F.when(F.col("id") % 5 != 0, F.concat(F.lit("2024-05-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    return users.select(
        "id", (F.col("id") % 20 + 1).alias("run_id"), (F.col("id") % 20 + 1).alias("document_id"), (F.col("id") % 4 + 1).alias("page"), (F.col("id") * 10).alias("char_start"),
        F.lit("day").alias("precision"), value.alias("normalized"), F.concat(F.lit("d"), F.col("id")).alias("raw_text"), F.lit(None).cast("string").alias("resolved_value"),
        F.element_at(kinds, (F.col("id") % len(TYPES) + 1).cast("int")).alias("date_type"), F.array(F.lit("2024-05-01"), F.lit("2024-01-05")).alias("candidates"),
        F.when(F.col("id") % 3 > 0, F.struct(F.lit(1.0).alias("x0"))).alias("bbox"),
    )


FOLD_SQL = f"""
    {EVENTS}, last AS (SELECT date_id, arg_max(action, id) AS action, arg_max(new_type, id) FILTER (new_type IS NOT NULL) AS set_type,
                              arg_max(new_value, id) FILTER (new_value IS NOT NULL) AS set_value, count(*) AS n_events FROM ev GROUP BY date_id),
    folded AS (SELECT d.*, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'correct' THEN 'corrected' ELSE 'needs_review' END AS status,
                      coalesce(set_type, date_type) AS current_type, coalesce(set_value, normalized) AS current_value, action AS last_action, n_events
               FROM dates d LEFT JOIN last ON d.id = last.date_id)
"""


@query("""SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS id, arg_min(source, doc_id) AS filename, max(n_chars) AS pages, count(*) AS uploads FROM documents GROUP BY 1""")
def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by content hash; first name, most pages."""
    seen = t(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("pages"))
    return ledger.upsert_documents(seen)


@query("""SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS id, arg_min(source, doc_id) AS filename, max(n_chars) AS pages FROM documents GROUP BY 1""")
def q_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: a second batch of uploads merged into the first."""
    seen = t(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("pages"))
    first, second = seen.where("seq % 2 = 0"), seen.where("seq % 2 = 1")
    return ledger.merge_documents(ledger.upsert_documents(first), second)


RUN_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'reading' WHEN 2 THEN 'failed' ELSE 'done' END"


def runs_of(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS document_id", f"{RUN_STATUS} AS status")


RUNS = f"runs AS (SELECT o_orderkey AS id, o_custkey AS document_id, {RUN_STATUS} AS status FROM orders)"


@query(f"WITH {RUNS} SELECT document_id, max(id) AS id, arg_max(status, id) AS status FROM runs GROUP BY document_id")
def q_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: the run with the largest id."""
    return ledger.latest_run(runs_of(spark, sf))


@query(f"WITH {RUNS} SELECT document_id, max(id) AS id, 'done' AS status FROM runs WHERE status = 'done' GROUP BY document_id")
def q_latest_done(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: the latest run that is done."""
    return ledger.latest_run(runs_of(spark, sf), done_only=True)


@query(f"WITH {RUNS} SELECT (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS document_id, 'v2' AS pipeline_version, 'queued' AS status FROM customer")
def q_create_run(spark: SparkSession, sf: str) -> DataFrame:
    """Q2: a new run for each document, numbered after the last."""
    return ledger.create_runs(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), runs_of(spark, sf), "v2")


STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'reading' WHEN 'click' THEN 'validating' WHEN 'purchase' THEN 'done' ELSE 'lost' END"


@query(f"""WITH c AS (SELECT event_id AS seq, user_id AS run_id, user_id % 25 AS document_id, {STATE} AS status, ts FROM events), k AS (SELECT * FROM c WHERE status <> 'lost')
           SELECT run_id, document_id, arg_max(status, seq) AS status, CASE WHEN arg_max(status, seq) = 'done' THEN strftime(arg_max(ts, seq), '%Y-%m-%d %H:%M:%S') END AS finished_at FROM k GROUP BY 1, 2""")
def q_run_states(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: run states from their changes; unknown names are refused."""
    changes = t(spark, sf, "events").selectExpr("event_id AS seq", "user_id AS run_id", "user_id % 25 AS document_id", f"{STATE} AS status", "ts AS at")
    found = ledger.run_states(changes)
    return found.select("run_id", "document_id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query(f"""WITH c AS (SELECT event_id AS seq, user_id AS run_id, user_id % 25 AS document_id, {STATE} AS status FROM events), k AS (SELECT * FROM c WHERE status <> 'lost'),
           r AS (SELECT run_id, document_id, arg_max(status, seq) AS status FROM k GROUP BY 1, 2) SELECT document_id, max(run_id) AS run_id, arg_max(status, run_id) AS status FROM r GROUP BY 1""")
def q_document_states(spark: SparkSession, sf: str) -> DataFrame:
    """Q3: a document follows its latest run."""
    changes = t(spark, sf, "events").selectExpr("event_id AS seq", "user_id AS run_id", "user_id % 25 AS document_id", f"{STATE} AS status", "ts AS at")
    return ledger.document_states(ledger.run_states(changes))


@query(f"WITH {RUNS} SELECT id, document_id, CASE WHEN status IN ('done', 'failed') THEN status ELSE 'failed' END AS status, status NOT IN ('done', 'failed') AS was_cut FROM runs")
def q_fail_unfinished(spark: SparkSession, sf: str) -> DataFrame:
    """Q4: cut runs fail at start-up."""
    return ledger.fail_unfinished(runs_of(spark, sf))


@query(f"""WITH {RUNS}, l AS (SELECT document_id, max(id) AS id, arg_max(status, id) AS status FROM runs GROUP BY 1), dn AS (SELECT document_id, max(id) AS id FROM runs WHERE status = 'done' GROUP BY 1)
           SELECT c_custkey AS document_id, CASE WHEN l.status IN ('done', 'queued', 'reading') THEN 'reuse' ELSE 'new_run' END AS decision,
                  CASE WHEN l.status IN ('done', 'queued', 'reading') THEN l.id END AS run_id, CASE WHEN l.status IN ('done', 'queued', 'reading') THEN NULL ELSE dn.id END AS carry_from
           FROM customer LEFT JOIN l ON l.document_id = c_custkey LEFT JOIN dn ON dn.document_id = c_custkey""")
def q_submission(spark: SparkSession, sf: str) -> DataFrame:
    """Q23: reuse the latest run or start a new one."""
    return ledger.submission(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), runs_of(spark, sf))


@query(f"WITH {FOLD_SQL} SELECT id, run_id, status, current_type, current_value, last_action, n_events FROM folded")
def q_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Q9, Q10: review state; corrections stay through later events."""
    found = ledger.review_fold(ledger_dates(spark, sf), review_events(spark, sf))
    return ledger.reading_order(found).select("id", "run_id", "status", "current_type", "current_value", "last_action", "n_events")


@query(f"WITH {FOLD_SQL} SELECT id FROM folded WHERE status = 'needs_review' AND coalesce(last_action, 'reopen') = 'reopen'")
def q_needs_review(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: no event, or a reopening last."""
    return ledger.needs_review(ledger_dates(spark, sf), review_events(spark, sf)).select("id")


@query(f"WITH {EVENTS} SELECT id, date_id, action, row_number() OVER (PARTITION BY date_id ORDER BY id) AS turn FROM ev")
def q_history(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: events of a date, oldest first."""
    return ledger.history(review_events(spark, sf)).select("id", "date_id", "action", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {FOLD_SQL}, dd AS (SELECT id, id % 20 + 1 AS run_id FROM dates), fl AS (SELECT DISTINCT id, run_id FROM dates WHERE id % 6 = 0),
           nd AS (SELECT run_id, count(*) AS n FROM dd GROUP BY 1), nf AS (SELECT run_id, count(*) AS n FROM fl GROUP BY 1),
           nr AS (SELECT run_id, count(*) AS n FROM folded WHERE coalesce(last_action, 'reopen') = 'reopen' GROUP BY 1)
           SELECT g.i AS id, CASE WHEN g.i <= 20 THEN g.i END AS run_id, CASE WHEN g.i <= 20 THEN 'done' END AS run_status, coalesce(nd.n, 0) AS n_dates, coalesce(nf.n, 0) AS n_flags, coalesce(nr.n, 0) AS n_needs_review
           FROM (SELECT unnest(range(1, 26)) AS i) g LEFT JOIN nd ON nd.run_id = g.i LEFT JOIN nf ON nf.run_id = g.i LEFT JOIN nr ON nr.run_id = g.i""")
def q_list_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: documents with the state and counts of their latest run; those without a run stay."""
    documents = spark.range(1, 26).select("id", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    runs = spark.range(1, 21).select("id", F.col("id").alias("document_id"), F.lit("done").alias("status"))
    dates = ledger_dates(spark, sf)
    flags = dates.where("id % 6 = 0").select("id", "run_id")
    return ledger.list_documents(documents, runs, dates, flags, review_events(spark, sf)).drop("created_at")


@query(f"""WITH {RUNS}, l AS (SELECT document_id, max(id) AS id, arg_max(status, id) AS status FROM runs GROUP BY 1)
           SELECT c_custkey AS id, l.id AS run_id, l.status AS run_status, CASE WHEN l.id IS NOT NULL THEN 1 END AS n_pages FROM customer LEFT JOIN l ON l.document_id = c_custkey""")
def q_document_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Q15: a document with its latest run and page sizes."""
    pages = t(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("n"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    found = ledger.document_detail(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), runs_of(spark, sf), pages)
    return found.select("id", "run_id", "run_status", F.size("page_sizes").alias("n_pages"))


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, user_id AS date_id, {ASKED} AS action, CASE event_id % 11 WHEN 1 THEN ' ' ELSE 'r' END AS reviewer, CASE event_id % 11 WHEN 2 THEN NULL ELSE 'why' END AS reason,
               CASE event_id % 11 WHEN 3 THEN 'made_up' END AS new_type, CASE event_id % 11 WHEN 4 THEN '2024-02-31' WHEN 5 THEN '2024-02' WHEN 6 THEN '2024-02-03' END AS new_value FROM events)
           SELECT event_id, CASE WHEN action = 'publish' THEN 'unknown_action' WHEN event_id % 11 = 1 THEN 'reviewer_missing' WHEN event_id % 11 = 2 THEN 'reason_missing'
               WHEN action = 'correct' AND new_type IS NULL AND new_value IS NULL THEN 'correction_empty' WHEN action <> 'correct' AND (new_type IS NOT NULL OR new_value IS NOT NULL) THEN 'change_without_correction'
               WHEN new_type IS NOT NULL THEN 'type_unknown' WHEN new_value = '2024-02-31' THEN 'value_malformed' WHEN date_id % 7 = 0 THEN 'date_not_found' WHEN date_id % 20 + 1 <= 3 THEN 'run_frozen'
               WHEN date_id % 2 = 0 AND length(new_value) = 10 THEN 'day_on_month_date' END AS error FROM r""")
def q_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: the first reason why a review is refused."""
    rest = F.col("event_id") % 11
    requests = t(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("date_id"), F.expr(ASKED).alias("action"), F.when(rest == 1, " ").otherwise("r").alias("reviewer"), F.when(rest != 2, "why").alias("reason"),
        F.when(rest == 3, "made_up").alias("new_type"), F.when(rest == 4, "2024-02-31").when(rest == 5, "2024-02").when(rest == 6, "2024-02-03").alias("new_value"),
    )
    dates = ledger_dates(spark, sf).where("id % 7 <> 0").withColumn("precision", F.when(F.col("id") % 2 == 0, "month").otherwise("day"))
    runs = spark.range(1, 24).select("id", F.when(F.col("id") > 20, F.col("id") - 20).otherwise(F.col("id")).alias("document_id"))
    return ledger.admit(requests, dates, runs).select("event_id", "error")


@query(f"""WITH {FOLD_SQL}, n AS (SELECT *, CASE WHEN id % 9 = 0 THEN '2024-05-09' ELSE normalized END AS new_norm FROM dates), o AS (SELECT * FROM folded),
           m AS (SELECT n.id + 1000000 AS date_id, o.last_action, o.current_type, n.date_type, o.current_value, n.new_norm, o.normalized FROM n JOIN o ON n.id = o.id AND n.new_norm IS NOT DISTINCT FROM o.normalized
                 WHERE o.last_action IS NOT NULL AND n.id % 8 <> 0),
           c AS (SELECT *, CASE WHEN current_type <> date_type THEN current_type END AS nt, CASE WHEN current_value IS DISTINCT FROM new_norm THEN current_value END AS nv FROM m)
           SELECT date_id, 0 AS step, CASE last_action WHEN 'reopen' THEN 'correct' ELSE last_action END AS action, nt AS new_type, nv AS new_value FROM c
           WHERE CASE WHEN last_action = 'reopen' THEN nt IS NOT NULL OR nv IS NOT NULL ELSE NOT (current_value IS NULL AND new_norm IS NOT NULL) END
           UNION ALL SELECT date_id, 1, 'reopen', NULL, NULL FROM c WHERE last_action = 'reopen' AND (nt IS NOT NULL OR nv IS NOT NULL)""")
def q_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    """Q13: decisions copied to the equal dates of a new run."""
    old = ledger_dates(spark, sf)
    new = old.withColumn("normalized", F.when(F.col("id") % 9 == 0, "2024-05-09").otherwise(F.col("normalized")))
    events = review_events(spark, sf)
    done = new.where("id % 8 = 0").select(
        (F.col("id") + 5_000_000).alias("id"), (F.col("id") + 1_000_000).alias("date_id"), F.lit("accept").alias("action"), F.lit(None).cast("string").alias("new_type"),
        F.lit(None).cast("string").alias("new_value"), F.lit("r").alias("reviewer"), F.lit("first").alias("reason"), F.lit(None).cast("long").alias("carried_from_run"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("at"),
    )
    events = events.withColumn("at", F.col("at").cast("timestamp_ntz")).unionByName(done)
    return ledger.carry_over(old, new.withColumn("id", F.col("id") + 1_000_000), events, 1).select("date_id", "step", "action", "new_type", "new_value")


def flag_rows(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.concat(F.lit("rule_"), (F.col("event_id") % 4).cast("string"))
    severity = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "warning").otherwise("info")
    return t(spark, sf, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20 + 1).alias("run_id"), rule.alias("rule"), severity.alias("severity"), F.lit("m").alias("message"),
        F.array(F.col("user_id"), F.col("user_id") + 1).alias("date_ids"),
    )


@query("""WITH f AS (SELECT event_id AS id, 'rule_' || (event_id % 4) AS rule, unnest([user_id, user_id + 1]) AS date_id FROM events) SELECT date_id, string_agg(rule, ',' ORDER BY id) AS rules FROM f GROUP BY date_id""")
def q_flags_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """Q14, Q16: the flags of each date in order."""
    return ledger.flags_by_date(flag_rows(spark, sf)).select("date_id", F.array_join("rules", ",").alias("rules"))


@query("""WITH f AS (SELECT event_id AS id, user_id % 20 + 1 AS run_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM events)
          SELECT id, run_id, severity, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, id) AS place FROM f QUALIFY place <= 5 OR count(*) OVER (PARTITION BY run_id) <= 6""")
def q_top_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Q18: the first flags of each run by severity."""
    return ledger.top_flags(flag_rows(spark, sf)).select("id", "run_id", "severity", F.col("place").cast("long").alias("place"))


FAMILY_SQL = f"fam AS (SELECT * FROM (VALUES {TAXONOMY_SQL}) AS v(ord, family, family_label, type, type_label)), forder AS (SELECT family, row_number() OVER (ORDER BY min(ord)) - 1 AS family_ord FROM fam GROUP BY family)"


@query(f"""WITH {FOLD_SQL}, {FAMILY_SQL} SELECT id, f.run_id, forder.family AS current_family, family_ord::INT AS family_ord, count(*) OVER (PARTITION BY f.run_id, forder.family) AS family_size
           FROM folded f JOIN fam ON fam.type = current_type JOIN forder ON forder.family = fam.family""")
def q_by_family(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: dates by the family of their current type."""
    return ledger.by_family(ledger.review_fold(ledger_dates(spark, sf), review_events(spark, sf))).select("id", "run_id", "current_family", "family_ord", "family_size")


@query(f"""WITH {FOLD_SQL} SELECT run_id, count(*) AS n_dates, count(*) FILTER (status = 'needs_review') AS n_needs_review, 0::BIGINT AS n_carried, count(*) FILTER (current_value IS NULL) AS n_ambiguous FROM folded GROUP BY run_id""")
def q_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Q19: counts of a run's review."""
    return ledger.review_counts(ledger.review_fold(ledger_dates(spark, sf), review_events(spark, sf)))


@query(f"WITH {EVENTS} SELECT run_id, page, count(*) AS n_dates, count(*) FILTER (id % 3 > 0) AS n_boxed FROM dates GROUP BY 1, 2")
def q_dates_per_page(spark: SparkSession, sf: str) -> DataFrame:
    """Q20: dates and boxed dates of each page."""
    return ledger.dates_per_page(ledger_dates(spark, sf))


@query("""SELECT o_orderkey, 'Batch record Expiry: ' AS before, strftime(o_orderdate, '%Y-%m-%d') AS match, ' and some more words that follow it up to the…' AS after, strftime(o_orderdate, '%b %Y') AS label FROM orders""")
def q_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Q21, Q22: words around a date, and a month's short name."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("Batch  record\nExpiry: "), iso, F.lit(" and some more words that follow it up to the very end of the line"))
    rows = t(spark, sf, "orders").select("o_orderkey", text.alias("text"), iso.alias("raw"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    return rows.select("o_orderkey", fc.snippet(F.col("text"), F.col("raw")).alias("s"), fc.month_label(F.col("m")).alias("label")).select("o_orderkey", "s.*", "label")


# --- exports -------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN '' END || p_name AS v FROM part)
          SELECT p_partkey, CASE WHEN p_partkey % 7 <= 4 THEN '''' || v ELSE coalesce(v, '') END AS cell FROM x""")
def k_csv_cell(spark: SparkSession, sf: str) -> DataFrame:
    """K3: cells that no spreadsheet runs."""
    start = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "\t", "", None])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", fc.csv_cell(F.concat(start, F.col("p_name"))).alias("cell"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') WHEN 1 THEN 'document' WHEN 2 THEN 'a_b' ELSE 'x.tar' END || '-run-' || p_partkey || '.csv' AS name FROM part""")
def k_filename(spark: SparkSession, sf: str) -> DataFrame:
    """K4: safe export names."""
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.concat(F.col("p_name"), F.lit(".pdf"))).when(kind == 1, "...pdf").when(kind == 2, "._a/b c_.pdf").otherwise("x.tar.gz")
    name = F.when(kind == 2, "a b.pdf").otherwise(name)
    return t(spark, sf, "part").select("p_partkey", fc.export_name(name, F.col("p_partkey"), "csv").alias("name"))


@query(f"""WITH {FOLD_SQL} SELECT id::VARCHAR AS date_id, run_id::VARCHAR AS run_id, status, current_type, coalesce(current_value, '') AS current_value, '2024-05-01 | 2024-01-05' AS candidates,
           'f' || (id % 20 + 1) AS document, coalesce(last_action, '') AS last_action, CASE WHEN id % 6 = 0 THEN 'late | odd' ELSE '' END AS flags FROM folded""")
def k_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the CSV export; a cut of its 25 columns, which tests hold whole."""
    found = export.export_rows(export_dates(spark, sf), review_events(spark, sf), export_flags(spark, sf), export_documents(spark))
    return found.select("date_id", "run_id", "status", "current_type", "current_value", "candidates", "document", "last_action", "flags")


def export_dates(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return ledger_dates(spark, sf).withColumns({"qualifier": none, "evidence": none, "source": F.lit("rules"), "confidence": F.lit(0.5), "context": F.lit("- text")})


def export_flags(spark: SparkSession, sf: str) -> DataFrame:
    dates = ledger_dates(spark, sf).where("id % 6 = 0")
    one = dates.select(F.col("id") * 2, "run_id", F.lit("late").alias("rule"), F.lit("error").alias("severity"), F.lit("m").alias("message"), F.array("id").alias("date_ids"))
    two = dates.select(F.col("id") * 2 + 1, "run_id", F.lit("odd").alias("rule"), F.lit("info").alias("severity"), F.lit("m").alias("message"), F.array("id").alias("date_ids"))
    return one.union(two).toDF("id", "run_id", "rule", "severity", "message", "date_ids")


def export_documents(spark: SparkSession) -> DataFrame:
    return spark.range(1, 21).select("id", F.concat(F.lit("f"), F.col("id")).alias("filename"))


@query(f"""WITH {FOLD_SQL} SELECT run_id, count(*) AS n_dates, coalesce(sum(n_events), 0)::BIGINT AS n_events, 2 * count(*) FILTER (id % 6 = 0) AS n_flags, 'f' || run_id AS filename FROM folded GROUP BY run_id""")
def k_export_json(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the JSON export, read back."""
    runs = spark.range(1, 21).select("id", F.col("id").alias("document_id"), F.lit("done").alias("status"))
    found = export.export_json(export_dates(spark, sf), review_events(spark, sf), export_flags(spark, sf), export_documents(spark), runs, "2024-01-01T00:00:00+00:00")
    kind = "struct<document:struct<filename:string>,dates:array<struct<history:array<struct<action:string>>>>,flags:array<struct<rule:string>>>"
    parsed = found.select("run_id", F.from_json("json", kind).alias("x"))
    events = F.aggregate("x.dates", F.lit(0).cast("long"), lambda n, d: n + F.size(d["history"]))
    return parsed.where(F.size("x.dates") > 0).select(
        "run_id", F.size("x.dates").cast("long").alias("n_dates"), events.alias("n_events"), F.size("x.flags").cast("long").alias("n_flags"), "x.document.filename"
    )


@query("""SELECT f.event_id AS flag_id, f.date_id FROM (SELECT event_id, unnest([user_id, user_id + 1]) AS date_id FROM events) f WHERE date_id NOT IN (SELECT user_id FROM events)""")
def k_flag_references(spark: SparkSession, sf: str) -> DataFrame:
    """K5, K6: flags that refer to dates there are not."""
    return export.unknown_flag_dates(flag_rows(spark, sf), ledger_dates(spark, sf))


# --- evaluation ----------------------------------------------------------------------------------


def evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted and gold dates of customers with errors planted by the order's key: wrong type, missed, invented, silent."""
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    raw = F.concat("iso", F.lit(" #"), F.col("at"))
    rows = rows.select("*", raw.alias("raw_text"), (F.col("at") % 17).alias("k"))
    none = F.lit(None).cast("string")
    gold = rows.where("k <> 3").select(
        "document_id", "page", "at", "raw_text", F.lit("expiry_date").alias("date_type"), F.when(F.col("k") != 4, F.col("iso")).alias("normalized"),
        F.when(F.col("k") == 4, F.array("iso", F.lit("2100-01-01"))).alias("candidates"),
    )
    predicted = rows.where("k <> 2").select(
        "document_id", "page", "at", F.when(F.col("k") == 5, F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(F.col("k") == 1, "retest_date").otherwise("expiry_date").alias("date_type"), F.col("iso").alias("normalized"), F.array("iso").alias("candidates"),
        none.alias("resolved_value"), none.alias("evidence"),
    )
    pages = rows.where("k <> 6").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("raw_text")), " ").alias("text"))
    return predicted, gold, pages.select("document_id", F.lit(1).alias("n"), "text")


KIND = "k AS (SELECT o_custkey AS document_id, o_orderkey % 17 AS k FROM orders)"
CELLS = f"""{KIND}, cells AS (
    SELECT 'expiry_date' AS date_type, 1 AS tp, 0 AS fp, 0 AS fn FROM k WHERE k NOT IN (1, 2, 3, 4, 5) UNION ALL
    SELECT 'retest_date', 0, 1, 0 FROM k WHERE k = 1 UNION ALL SELECT 'expiry_date', 0, 0, 1 FROM k WHERE k = 1 UNION ALL
    SELECT 'expiry_date', 0, 0, 1 FROM k WHERE k = 2 UNION ALL SELECT 'expiry_date', 0, 1, 0 FROM k WHERE k = 3 UNION ALL
    SELECT 'expiry_date', 0, 1, 1 FROM k WHERE k = 4 UNION ALL SELECT 'expiry_date', 0, 1, 1 FROM k WHERE k = 5)"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.match_gold(*evaluation(spark, sf))


@query(f"""WITH {KIND}, o AS (SELECT document_id, CASE k WHEN 1 THEN 'mismatch' WHEN 2 THEN 'missed' WHEN 3 THEN 'extra' WHEN 4 THEN 'mismatch' WHEN 5 THEN 'missed' ELSE 'match' END AS kind FROM k
           UNION ALL SELECT document_id, 'extra' FROM k WHERE k = 5) SELECT document_id, kind, count(*) AS n FROM o GROUP BY 1, 2""")
def e_match(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matching of predictions and gold."""
    return outcomes(spark, sf).groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("n"))


RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4)::DOUBLE AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4)::DOUBLE AS f1"""


@query(f"""WITH {CELLS}, s AS (SELECT coalesce(date_type, '(all)') AS date_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cells GROUP BY ROLLUP (date_type))
           SELECT date_type, tp, fp, fn, {RATES} FROM s""")
def e_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 by type and in total."""
    return scoring.scores(scoring.counted(outcomes(spark, sf)))


@query(f"""WITH {KIND}, s AS (SELECT count(*) FILTER (k NOT IN (2, 3, 5)) AS tp, count(*) FILTER (k IN (3, 5)) AS fp, count(*) FILTER (k IN (2, 5)) AS fn FROM k) SELECT tp, fp, fn, {RATES} FROM s""")
def e_detection(spark: SparkSession, sf: str) -> DataFrame:
    """E5: found or not, types ignored."""
    return scoring.detection(outcomes(spark, sf))


@query(f"""WITH {KIND}, s AS (SELECT document_id, count(*) FILTER (k = 5) AS hallucinations, count(*) FILTER (k = 4) AS silent_resolutions FROM k GROUP BY ROLLUP (document_id))
           SELECT *, hallucinations + silent_resolutions = 0 AS passed FROM s""")
def e_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Invented dates and silent resolutions, by document and in total."""
    return scoring.gates(outcomes(spark, sf))


@query(f"""WITH {KIND} SELECT 3 AS types, count(*) FILTER (k = 5) AS hallucinations, count(*) FILTER (k = 4) AS silent_resolutions, count(*) FILTER (k NOT IN (2, 3, 5)) AS found FROM k""")
def e_report(spark: SparkSession, sf: str) -> DataFrame:
    """K7: the report as JSON, read back."""
    kind = "struct<types:array<struct<date_type:string>>,detection:struct<tp:bigint>,gates:struct<hallucinations:bigint,silent_resolutions:bigint>>"
    x = scoring.report(outcomes(spark, sf)).select(F.from_json("json", kind).alias("x"))
    return x.select(F.size("x.types").alias("types"), "x.gates.hallucinations", "x.gates.silent_resolutions", F.col("x.detection.tp").alias("found"))


@query("SELECT 0::BIGINT AS bad")
def e_check_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold items give a value or two readings, never both."""
    return scoring.check_gold(evaluation(spark, sf)[1]).agg(F.count(F.lit(1)).alias("bad"))


@query(f"""WITH {GOLD}, r AS (SELECT b.style, count(*) AS gold, count(g.o_orderkey) AS found FROM base b LEFT JOIN gold g USING (o_orderkey) GROUP BY b.style)
           SELECT style, gold, found, round(found / gold, 4)::DOUBLE AS recall FROM r""")
def e_recall_by_format(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of each printed format of the generator."""
    lines = synth.document_lines(texts(spark, sf))
    hits = extraction.extract(lines).select("o_orderkey", F.col("candidates").alias("read"))
    gold = lines.withColumn("g", synth.gold_of(F.col("day"), F.col("style"))).select("o_orderkey", "style", "g.candidates")
    joined = gold.join(hits, "o_orderkey", "left").groupBy("style").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(F.col("read") == F.col("candidates")).alias("found")
    )
    return joined.withColumn("recall", scoring.ratio(F.col("found"), F.col("gold")))


# --- files and layouts ---------------------------------------------------------------------------

HEADS = ["255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE000", "49492A0008", "4D4D002A00", "504B0304"]


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % len(HEADS) + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("p_name"), F.lit("\x07.bin"))
    return t(spark, sf, "part").select("p_partkey", path.alias("path"), F.concat(F.unhex(head), F.col("p_name").cast("binary")).alias("content"), F.col("p_size").alias("pages"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'tiff' WHEN 4 THEN 'tiff' END AS kind, p_name || '.bin' AS filename,
          CASE WHEN p_partkey % 6 = 5 THEN 'Unsupported file type. Upload a PDF, PNG, JPG or TIFF file.' WHEN p_size > 40 THEN 'The document has more than 40 pages.' END AS error FROM part""")
def s_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Kind by first bytes, display name, and why a file is refused."""
    files = ingest.with_identity(uploads(spark, sf))
    error = ingest.admission_error(F.col("kind"), F.col("bytes"), F.col("pages"), max_pages=40)
    return files.select("p_partkey", "kind", "filename", error.alias("error"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'damaged' END AS failure FROM part")
def s_pdf_failure(spark: SparkSession, sf: str) -> DataFrame:
    """Locked and damaged PDFs."""
    tail = F.when(F.col("p_partkey") % 3 == 0, " /Encrypt startxref %%EOF").when(F.col("p_partkey") % 3 == 1, " cut").otherwise(" startxref 9 %%EOF")
    content = F.concat(F.lit("%PDF-1.7 "), F.col("p_name"), tail).cast("binary")
    return t(spark, sf, "part").select("p_partkey", ingest.pdf_failure(content).alias("failure"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n FROM documents GROUP BY 1")
def s_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes."""
    return t(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0")
def s_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose hash is the recorded one."""
    files = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey")).alias("filename"), F.sha2("p_name", 256).alias("sha256"))
    recorded = files.select("filename", F.when(F.col("p_partkey") % 2 == 0, F.col("sha256")).otherwise("0").alias("sha256"))
    return ingest.verified(files, recorded).select("p_partkey")


def grid_words(spark: SparkSession, sf: str) -> DataFrame:
    """Four words for each part: two on a line, one a little lower on it, one on the next."""
    spots = F.array(*(F.struct(F.lit(w).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0")) for w, x, y in [("b", 30.0, 12.0), ("a", 10.0, 10.0), ("c", 50.0, 14.0), ("d", -5.0, 40.0)]))
    rows = t(spark, sf, "part").select("p_partkey", F.explode(spots).alias("s")).select("p_partkey", "s.*")
    return rows.select("p_partkey", "text", "x0", "y0", (F.col("x0") + 15).alias("x1"), (F.col("y0") + 10).alias("y1"), F.lit(60).alias("width"), F.lit(100).alias("height"))


@query("SELECT p_partkey, w AS text, line, place FROM part, (VALUES ('a', 0, 0), ('b', 0, 1), ('c', 0, 2), ('d', 1, 0)) AS v(w, line, place)")
def s_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words into lines, by the first word of each."""
    return layout.group_lines(grid_words(spark, sf), ["p_partkey"]).select("p_partkey", "text", "line", "place")


@query("""SELECT p_partkey, w AS text, s AS char_start, e AS char_end, x0::DOUBLE AS x0, x1::DOUBLE AS x1, 'a b c' || chr(10) || 'd' AS page FROM part,
          (VALUES ('a', 0, 1, 10, 25), ('b', 2, 3, 30, 45), ('c', 4, 5, 50, 60), ('d', 6, 7, 0, 10)) AS v(w, s, e, x0, x1)""")
def s_join(spark: SparkSession, sf: str) -> DataFrame:
    """Page text, offsets and boxes kept inside the page."""
    lines = layout.group_lines(grid_words(spark, sf), ["p_partkey"])
    words = layout.join_words(lines, ["p_partkey"])
    text = layout.page_text(words, ["p_partkey"]).withColumnRenamed("text", "page")
    return words.join(text, "p_partkey").select("p_partkey", "text", "char_start", "char_end", "x0", "x1", "page")


@query("SELECT p_partkey, w AS text, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM part, (VALUES ('12.03', 0, 22), ('x', 40, 50), (' y', 52, 60)) AS v(w, x0, x1)")
def s_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring fragments without white space are one word."""
    spots = F.array(*(F.struct(F.lit(w).alias("text"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for w, a, b in [("12", 0.0, 10.0), (".03", 12.0, 22.0), ("x", 40.0, 50.0), (" y", 52.0, 60.0)]))
    rows = t(spark, sf, "part").select("p_partkey", F.lit(0).alias("line"), F.explode(spots).alias("s")).select("p_partkey", "line", "s.*", F.lit(0.0).alias("y0"), F.lit(9.0).alias("y1"))
    return layout.merge_fragments(rows, ["p_partkey"]).select("p_partkey", "text", "x0", "x1")


@query("""SELECT p_partkey, p_size / 50.0 >= 0.5 AND p_partkey % 100 / 1000.0 < 0.03 AS stamped, p_partkey % 3 = 0 OR length(replace(p_name, ' ', '')) < 20 OR (p_size / 50.0 >= 0.5 AND p_partkey % 100 / 1000.0 < 0.03) AS ocr FROM part""")
def s_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Stamped scans, and pages to recognise."""
    stamped = layout.stamped_scan(F.col("p_size") / 50.0, (F.col("p_partkey") % 100) / 1000.0, F.lit(1.0))
    return t(spark, sf, "part").select("p_partkey", stamped.alias("stamped"), layout.needs_ocr(F.col("p_name"), stamped, F.col("p_partkey") % 3 != 0).alias("ocr"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 20.0 WHEN 2 THEN 30.0 ELSE 120.0 END::DOUBLE AS x0, CASE p_partkey % 4 WHEN 0 THEN 120.0 WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 ELSE 30.0 END::DOUBLE AS y0 FROM part""")
def s_visible(spark: SparkSession, sf: str) -> DataFrame:
    """The crop box on a turned page."""
    box = lambda *e: F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), e, strict=True)))
    area = layout.visible_area(box(10, 20, 70, 80), box(0, 0, 100, 200), (F.col("p_partkey") % 4 * 90).cast("int"))
    return t(spark, sf, "part").select("p_partkey", area.alias("a")).select("p_partkey", "a.x0", "a.y0")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS pass, count(*) AS words FROM part, range(2) GROUP BY 1, 2")
def s_best_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The recognition pass with the higher mean confidence; the first on a tie."""
    rows = t(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    confidence = F.when((F.col("p_partkey") % 3 == 0) & (F.col("i") >= 2), 0.9).otherwise(0.5)
    words = rows.select("p_partkey", (F.col("i") / 2).cast("int").alias("pass"), confidence.alias("confidence"))
    return layout.best_pass(words, ["p_partkey"]).groupBy("p_partkey", "pass").agg(F.count(F.lit(1)).alias("words"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 5.0 ELSE 80.0 END::DOUBLE AS x0, 10.0::DOUBLE AS y0 FROM part")
def s_original(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes back in the original image: shrunk, and turned by half a turn."""
    box = F.struct(*(F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), (10.0, 20.0, 40.0, 180.0), strict=True)))
    angle = F.when(F.col("p_partkey") % 2 == 0, 0.0).otherwise(180.0)
    found = layout.to_original(box, F.lit(2.0), angle, F.lit(100.0), F.lit(100.0))
    return t(spark, sf, "part").select("p_partkey", found.alias("b")).select("p_partkey", F.round("b.x0", 6).alias("x0"), F.round("b.y0", 6).alias("y0"))


@query("""SELECT o_orderkey AS document_id, strftime(o_orderdate, '%Y-%m-%d') AS normalized, 'expiry_date' AS date_type, 0.0::DOUBLE AS x0, 0::INT AS flags FROM orders""")
def s_process_json(spark: SparkSession, sf: str) -> DataFrame:
    """Page layouts as JSON in, dates and flags as JSON out."""
    text = F.concat(F.lit("Expiry "), F.date_format("o_orderdate", "d MMM yyyy"))
    word = F.concat(F.lit('{"text":"Expiry","bbox":{"x0":0,"y0":0,"x1":9,"y1":9},"char_start":0,"char_end":6,"confidence":null}'), F.lit(',{"text":"date","bbox":{"x0":0,"y0":9,"x1":9,"y1":19},"char_start":7,"char_end":20,"confidence":null}'))
    page = F.concat(F.lit('[{"n":1,"width":100,"height":100,"text":"'), text, F.lit('","text_source":"pdf","words":['), word, F.lit('],"transcription":null}]'))
    layouts = texts(spark, sf).select(F.col("o_orderkey").alias("document_id"), page.alias("layouts_json"))
    kind = "struct<dates:array<struct<normalized:string,date_type:string,bbox:struct<x0:double>>>,flags:array<struct<rule:string>>>"
    parsed = batch.process_json(layouts, TODAY).select("document_id", F.from_json("result", kind).alias("r"))
    one = F.get("r.dates", F.lit(0))
    return parsed.select("document_id", one["normalized"].alias("normalized"), one["date_type"].alias("date_type"), one["bbox"]["x0"].alias("x0"), F.size("r.flags").alias("flags"))


# --- streams -------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT date_id, arg_max(action, id) AS last_action, count(*) AS n_events FROM ev GROUP BY date_id")
def st_review_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of a stream of reviews; as a batch it is the same plan."""
    return stream.fold_reviews(review_events(spark, sf)).select("date_id", "last_action", "n_events")
