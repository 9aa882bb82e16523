"""Benchmark passages in documents: one automaton over the windows of all items, one scan per text.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
A window is ``width`` consecutive words of an item, or a shorter item whole. All
windows go into one Aho-Corasick automaton, words being spelled by number; a text's
words run through it once, and every occurrence marks its words. Translation
keeps byte positions, so marked words map straight back to the original text.

Items are broadcast in blocks of at most ``block_bytes``; usually there is one. A
larger benchmark is split by hash. Each block is a pass of its own over the table,
written to the shared folder with its marks, so that a worker holds one automaton at
a time and builds it once; the marks of all passes are united.

Edge cases: a null or empty text has no words and no hits; items that are null or
wordless have no windows; equal items each count under their own ids; a null
item id reads as the empty string; other columns of ``docs`` pass through
untouched; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import bound_batches, fresh, materialize

WIDTH = 10
#: Item text of one automaton, which takes some 170 bytes of a worker's memory for each byte of text.
BLOCK_BYTES = 1 << 20
#: Letters and digits stay (A-Z in lower case), bytes from 0x80 stay, everything else is a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[^ ]+")
FOUND = "struct<n_words:bigint,hits:array<int>,items:array<string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """The automaton over the windows of some items.

    A word of the items is two characters, the digits of its number, and any other word
    is two zeros, so a window is a string twice its words long. The two digits come from
    two alphabets, so none is found between words; each alphabet has about as many letters
    as the root of the square of the vocabulary, since the automaton tries a node's
    letters one by one.
    """

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        split = [(item_id, words_of(text)) for item_id, text in items]
        known = dict.fromkeys(w for _, words in split for w in words)
        base = int(len(known) ** 0.5) + 1
        self.spelling = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(known)}
        windows: dict[str, set[str]] = {}
        for item_id, words in split:
            spelled = "".join(map(self.spelling.__getitem__, words))
            for i in range(0, max(1, len(spelled) - 2 * width + 1) if words else 0, 2):
                windows.setdefault(spelled[i : i + 2 * width], set()).add(item_id)
        self.automaton = ahocorasick.Automaton() if windows else None
        for window, ids in windows.items():
            self.automaton.add_word(window, (len(window) // 2, tuple(ids)))
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Word count, marked word runs as [first, end, first, end, ...], and the ids of the items found."""
        words = words_of(text) if text else []
        if not words or self.automaton is None:
            return len(words), [], []
        get = self.spelling.get
        found = list(self.automaton.iter("".join([get(w, "\0\0") for w in words])))
        if not found:
            return len(words), [], []
        runs: list[int] = []
        for first, end in sorted((at // 2 - n + 1, at // 2 + 1) for at, (n, _) in found):
            if runs and first <= runs[-1]:
                runs[-1] = max(runs[-1], end)
            else:
                runs += [first, end]
        return len(words), runs, sorted({i for _, (_, ids) in found for i in ids})


@lru_cache(maxsize=1)
def windows_of(block: Broadcast, width: int) -> Windows:
    return Windows(block.value, width)


def character_spans(text: str, runs: list[int]) -> list[int]:
    """Marked word runs as [start, end, ...] character offsets into the original text."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    edges = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(FOLD))]
    spans, at, chars = [], 0, 0
    for first, end in zip(runs[::2], runs[1::2], strict=True):
        for b in (edges[first][0], edges[end - 1][1]):
            chars += len(raw[at:b].decode("utf-8", "surrogatepass"))
            at = b
            spans.append(chars)
    return spans


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Broadcast]:
    """The items as broadcast lists, each of about ``block_bytes`` at most, one after another."""
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    ).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    share = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    context = benchmark.sparkSession.sparkContext
    return (context.broadcast([tuple(r) for r in rows.where(share == b).collect()]) for b in range(blocks))


def hits_column(block: Broadcast, text: Column, width: int) -> Column:
    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        scan = windows_of(block, width).scan
        found = [scan(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.list_(pa.int32())),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ],
            names=["n_words", "hits", "items"],
        )

    return find(text)


def merged_runs(runs: Column) -> Column:
    """Unite marked runs, sorted [(first, end), ...], of several blocks."""
    start = F.array().cast("array<struct<first:int,end:int>>")

    def add(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], run["end"]).alias("end"))
        touches = F.coalesce(run["first"] <= last["end"], F.lit(False))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(head, F.array(joined))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), start, add)


def pairs(flat: Column) -> Column:
    """[a, b, c, d] as [(a, b), (c, d)]."""
    both = F.transform(flat, lambda x, i: F.struct(x.alias("first"), F.get(flat, i + 1).alias("end"), i.alias("at")))
    return F.transform(
        F.filter(both, lambda s: s["at"] % 2 == 0),
        lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    out: str = "found",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, hits (word runs), items (sorted ids), contaminated.

    A column of that name is replaced; all others stay as they are.
    """
    bound_batches(docs.sparkSession)
    names: list[str] = []
    marked = docs
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        if names:
            marked = materialize(marked, "benchmark-marks")
        names.append(fresh(marked, f"{out}_{len(names)}"))
        marked = marked.withColumn(names[-1], hits_column(block, F.col(text), width))
    if len(names) == 1:
        runs, items = pairs(F.col(names[0])["hits"]), F.col(names[0])["items"]
    else:
        runs = merged_runs(F.concat(*(pairs(F.col(n)["hits"]) for n in names)))
        items = F.array_sort(F.array_distinct(F.concat(*(F.col(n)["items"] for n in names))))
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    result = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        runs.alias("hits"),
        items.alias("items"),
        (hit > 0).alias("contaminated"),
    )
    return marked.withColumn(out, result).drop(*names)


def original_spans(text: Column, runs: Column) -> Column:
    """Word runs as (first, end) character offsets into the original text."""

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def spans(texts: pa.Array, marked: pa.Array) -> pa.Array:
        out = []
        for t, m in zip(texts.to_pylist(), marked.to_pylist(), strict=True):
            flat = character_spans(t or "", [x for r in m or [] for x in (r["first"], r["end"])])
            out.append([{"first": a, "end": b} for a, b in zip(flat[::2], flat[1::2], strict=True)])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))

    return spans(text, runs)


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document, with the digest of the items found in it."""
    found = find_contamination(docs.select(doc_id, "text"), benchmark)
    return found.select(
        doc_id,
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        F.col("found.contaminated").alias("contaminated"),
    )
