"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; a binary classifier for each bit weighs the hashed
1- to 4-byte n-grams of a text (log odds between the languages with the bit and
those without, languages counting alike). Decoding sums, for each language, the
classifiers' losses against its codeword, weighted by how well each classifier
separates the training languages, and picks the least. The score is the chosen
language's share after softmax over the losses; a text is ambiguous if that share
is below ``AMBIGUOUS`` or it has no letter.

Training reads at most ``SAMPLE_PER_LANGUAGE`` labelled texts of each language (the
rows with the smallest hashes of their ids), each whole, and of at most ``LANGUAGES``
labels, those with the most rows; only n-gram counts by language reach the driver, at
most ``LANGUAGES`` x ``FEATURES`` of them.

Edge cases: null, empty and letterless texts are ``und`` with score 0; labels that
are null teach nothing, a blank one is a label like others; with no labelled text at all every text is
``und``, but none with a letter is ambiguous; with one language every text with a letter is that one; extra columns
pass through ``predict`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import bound_batches

SAMPLE_PER_LANGUAGE, SAMPLE_CELLS = 1_500, 4_096
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
ORDERS = (1, 2, 3, 4)
#: Bytes of a text whose n-grams are weighed at once, so that a text of any length takes the memory of one block.
BLOCK = 1 << 15
#: Languages that are learned at most: those with the most labelled rows.
LANGUAGES = 256
AMBIGUOUS = 0.5
UNKNOWN = "und"
#: A log odds of one n-gram counts this much: neighbouring n-grams overlap and are no independent evidence.
TEMPER = 0.25
#: White space, digits and ASCII marks are one separator.
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed odd multiplier for hashing n-grams (2^64 divided by the golden ratio).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PREDICTION = "struct<lang:string,score:double,ambiguous:boolean>"


def features(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text's letters, one entry per occurrence, in blocks of bounded size."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(FOLD) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    whole = np.frombuffer(raw, np.uint8)
    for lo in range(0, len(whole), BLOCK):
        octets = whole[lo : lo + BLOCK + ORDERS[-1] - 1].astype(np.uint64)
        gram = np.zeros(len(octets), np.uint64)
        for n in ORDERS:
            if len(octets) < n:
                break
            gram = (gram[: len(octets) - n + 1] << np.uint64(8)) | octets[n - 1 :]
            mixed = (gram[:BLOCK] + np.uint64(n << 40)) * MULTIPLIER  # n-grams that start in this block
            yield (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def feature_counts(text: str) -> np.ndarray:
    out = np.zeros(FEATURES, np.int64)
    for found in features(text):
        out += np.bincount(found, minlength=FEATURES)
    return out


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 / -1 per language: all splits up to 7 languages, else the best of seeded dense codes."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 7:
        columns = [
            [1 if i in chosen or i == 0 else -1 for i in range(languages)]
            for n in range(languages - 1)
            for chosen in combinations(range(1, languages), n)
        ]
        return np.array(columns, dtype=np.int8).T.reshape(languages, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        gaps = (bits - code.astype(int) @ code.T.astype(int)) // 2
        if (gap := int(gaps[~np.eye(languages, dtype=bool)].min())) > apart:
            best, apart = code, gap
    return best


@dataclass
class LanguageCode:
    """The trained classifiers: log odds of each n-gram for each bit, codewords and bit weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    @classmethod
    def train(cls, languages: list[str], counts: np.ndarray) -> LanguageCode:
        """``counts``: occurrences of each feature in each language's sample."""
        code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        bits = code.shape[1] if code.ndim == 2 else 0
        odds = np.zeros((FEATURES, bits), np.float32)
        for b in range(bits):
            odds[:, b] = np.log(share[code[:, b] > 0].mean(axis=0) / share[code[:, b] < 0].mean(axis=0))
        expected = share @ odds * code if bits else np.zeros((len(languages), 0))
        weights = np.maximum(expected.min(axis=0), 1e-6) if bits else np.zeros(0)
        return cls(languages, code, odds, (weights / weights.sum() * bits if bits else weights).astype(np.float64))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = TEMPER * sum(self.odds[found].sum(axis=0, dtype=np.float64) for found in features(text))
        losses = np.logaddexp(0, -self.code * margins) @ self.weights
        shares = np.exp(losses.min() - losses)
        best = int(np.argmin(losses))
        score = float(shares[best] / shares.sum())
        return self.languages[best], score, score < AMBIGUOUS


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: those whose CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_language(values: dict[str, int]) -> Column:
    """The value of the row's language."""
    return F.try_element_at(F.create_map(*(x for k, n in values.items() for x in (F.lit(k), F.lit(n).cast("long")))), F.col("lang"))


def sample_limits(rows: DataFrame, per_language: int, languages: int) -> dict[str, int]:
    """For each language the hash up to which at most ``per_language`` rows lie (all of them where there are no more).

    The hashes of a language are cut at about eight times the rows asked for and
    counted in ``SAMPLE_CELLS`` cells, so no language's rows ever meet in one task.
    """
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    if not sizes:
        return {}
    ends = {x: 2**62 if n <= per_language else int(min(1.0, 8 * per_language / n) * 2**62) for x, n in sizes.items()}
    end = by_language(ends)
    cell = F.floor(F.col("order") / (end / SAMPLE_CELLS))
    cells = rows.where(F.col("lang").isin(list(sizes)) & (F.col("order") <= end)).groupBy("lang", cell.alias("cell")).count().collect()
    limits = {}
    for x, n in sizes.items():
        held, limit = 0, 0
        for at, count in sorted((r["cell"], r["count"]) for r in cells if r["lang"] == x):
            held += count
            if held > per_language and limit:
                break
            limit = min(ends[x], int((at + 1) * (ends[x] / SAMPLE_CELLS)) - 1) if at + 1 < SAMPLE_CELLS else ends[x]
        limits[x] = ends[x] if n <= per_language else limit
    return limits


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    languages: int = LANGUAGES,
) -> LanguageCode:
    """Fit the classifiers on a bounded, hash-ordered sample of the labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string")), 2).alias("order"),
    ).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    last = sample_limits(rows, per_language, languages)
    if not last:
        return LanguageCode.train([], np.zeros((0, FEATURES)))
    learned = sorted(last)
    sample = rows.where(F.col("order") <= by_language(last)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                into = totals.setdefault(one, np.zeros(FEATURES, np.int64))
                into += feature_counts(words.as_py())
        for one, n in totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])],
                ["lang", "feature", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(learned), FEATURES))
    at = {x: i for i, x in enumerate(learned)}
    for r in counted.toLocalIterator():
        counts[at[r["lang"]], r["feature"]] = r["n"]
    return LanguageCode.train(learned, counts)


def predict(docs: DataFrame, model: LanguageCode, text: str = "text", out: str = "predicted") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, ambiguous."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def of(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        names, kinds = ("lang", "score", "ambiguous"), (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays(
            [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names
        )

    return docs.withColumn(out, of(F.col(text)))


def identify(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: the held-out flag, the predicted language, its score, and whether the text is ambiguous."""
    found = predict(docs.select(doc_id, "text"), train(docs, doc_id))
    return found.select(
        doc_id,
        held_out(F.col(doc_id)).alias("held_out"),
        F.col("predicted.lang").alias("lang_pred"),
        F.col("predicted.score").alias("score"),
        F.col("predicted.ambiguous").alias("ambiguous"),
    )
