"""Page layout: lines of words, text with offsets, boxes of spans, and the decisions taken before reading a page.

Words are structs (text, x0, y0, x1, y1, char_start, char_end, confidence); a page
holds them in one array, so that box look-ups need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dateloom.operators.grouping import Rows, map_groups

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
# Least characters of a text layer, area shares of a stamped scan, and the gap of joined fragments.
LEAST_CHARACTERS, IMAGE_SHARE, GLYPH_SHARE, JOIN_GAP = 20, 0.5, 0.03, 3.0


def union_box(words: Column) -> Column:
    """The box around all words, null if there are none."""
    edge = lambda name, pick: pick(F.transform(words, lambda w: w[name])).alias(name)
    box = F.struct(edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max))
    return F.when(F.size(words) > 0, box)


def words_in(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["char_start"] < end) & (start < w["char_end"]))


def span_box(words: Column, start: Column, end: Column) -> Column:
    """The box around the words that overlap a span."""
    return union_box(words_in(words, start, end))


def line_boxes(words: Column, text: Column, start: Column, end: Column) -> Column:
    """One box for each printed line of a span that wraps, else an empty array."""
    inside = words_in(words, start, end)
    shape = F.struct(*(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(-1).alias("until"))
    empty = F.filter(F.array(shape), lambda _: F.lit(False))

    def add(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        own = F.struct(*(w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), w["char_end"].cast("int").alias("until"))
        grown = F.struct(
            F.least(last["x0"], w["x0"]).alias("x0"), F.least(last["y0"], w["y0"]).alias("y0"),
            F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["y1"], w["y1"]).alias("y1"),
            w["char_end"].cast("int").alias("until"),
        )
        between = F.substr(text, last["until"] + 1, w["char_start"] - last["until"])
        broken = (F.size(lines) == 0) | F.contains(between, F.lit("\n"))
        kept = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
        return F.when(broken, F.concat(lines, F.array(own))).otherwise(F.concat(kept, F.array(grown)))

    lines = F.aggregate(inside, empty, add)
    boxes = F.transform(lines, lambda b: F.struct(*(b[c].alias(c) for c in ("x0", "y0", "x1", "y1"))))
    return F.when(F.size(boxes) > 1, boxes).otherwise(F.array().cast(f"array<{BOX}>"))


def group_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with their line and place in it: a word opens a line when its middle is below the line's first word."""

    def lines(page: Rows) -> Rows:
        placed: list[Rows] = []
        bottom = float("-inf")
        for word in page:
            if (word["y0"] + word["y1"]) / 2 > bottom:
                placed.append([])
                bottom = word["y1"]
            placed[-1].append(word)
        return [w | {"line": n, "place": i} for n, line in enumerate(placed) for i, w in enumerate(sorted(line, key=lambda w: w["x0"]))]

    schema = T.StructType([*words.schema.fields, T.StructField("line", T.IntegerType()), T.StructField("place", T.IntegerType())])
    return map_groups(words, keys, ["y0", "x0"], lines, schema)


def join_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Offsets in the page text: words joined by spaces, lines by line feeds; boxes kept inside the page (width, height)."""
    in_order = Window.partitionBy(*keys).orderBy("line", "place")
    before = F.coalesce(F.sum(F.length("text") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clamp = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most).cast("double")).alias(c)
    return words.select(
        *keys, "line", "place", "text",
        before.cast("int").alias("char_start"), (before + F.length("text")).cast("int").alias("char_end"),
        clamp("x0", "width"), clamp("y0", "height"), clamp("x1", "width"), clamp("y1", "height"),
    )


def page_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each page from its placed words."""
    lines = words.groupBy(*keys, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda w: w["text"]), " ").alias("t")
    )
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda w: w["t"]), "\n").alias("text")
    )


def merge_fragments(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring fragments of a line, at most ``JOIN_GAP`` apart and without white space between, as one."""
    in_line = Window.partitionBy(*keys, "line").orderBy("x0")
    apart = F.col("x0") - F.lag("x1").over(in_line)
    spaced = F.col("text").rlike(r"^\s") | F.lag("text").over(in_line).rlike(r"\s$")
    opens = (apart.isNull() | (apart > JOIN_GAP) | spaced).cast("int")
    numbered = fragments.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(in_line))
    return numbered.groupBy(*keys, "line", "_island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).drop("_island")


def stamped_scan(image_area: Column, glyph_area: Column, page_area: Column) -> Column:
    """A scan with a little text stamped on it: mostly image, hardly any glyphs."""
    return (image_area / page_area >= IMAGE_SHARE) & (glyph_area / page_area < GLYPH_SHARE)


def needs_ocr(text: Column, stamped: Column, readable: Column) -> Column:
    """Whether a page's text layer is missing, too short, stamped on a scan or unreadable."""
    return ~F.coalesce(readable, F.lit(False)) | stamped | (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < LEAST_CHARACTERS)


def visible_area(crop: Column, media: Column, rotation: Column) -> Column:
    """The part of the crop box on the page, in the page's own turned coordinates (x0, y0, x1, y1 from the top left)."""
    x0, y0 = F.greatest(crop["x0"], media["x0"]), F.greatest(crop["y0"], media["y0"])
    x1, y1 = F.least(crop["x1"], media["x1"]), F.least(crop["y1"], media["y1"])
    left, low, right, high = x0 - media["x0"], y0 - media["y0"], x1 - media["x0"], y1 - media["y0"]
    wide, tall = media["x1"] - media["x0"], media["y1"] - media["y0"]
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    turned = (
        F.when(rotation == 90, box(low, left, high, right))
        .when(rotation == 180, box(wide - right, low, wide - left, high))
        .when(rotation == 270, box(tall - high, wide - right, tall - low, wide - left))
        .otherwise(box(left, tall - high, right, tall - low))
    )
    return F.when((x0 < x1) & (y0 < y1), turned)


def best_pass(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of the recognition pass with the higher mean confidence; the first pass wins ties."""
    means = words.groupBy(*keys, "pass").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("_mean"))
    best = means.groupBy(*keys).agg(F.max_by("pass", F.struct("_mean", -F.col("pass"))).alias("pass"))
    return words.join(best, [*keys, "pass"])


def to_original(box: Column, scale: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box of the straightened, enlarged image in the original image: shrunk, turned back about the centre."""
    cx, cy, rad = width / 2, height / 2, F.radians(angle)
    xs, ys = [], []
    for x in ("x0", "x1"):
        for y in ("y0", "y1"):
            dx, dy = box[x] / scale - cx, box[y] / scale - cy
            xs.append(cx + dx * F.cos(rad) - dy * F.sin(rad))
            ys.append(cy + dx * F.sin(rad) + dy * F.cos(rad))
    edges = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    return F.struct(*(v.alias(k) for k, v in edges.items()))
