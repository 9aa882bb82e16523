"""The stages on a small corpus against plain Python, and the registered queries against their SQL."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from dateloom.llm.decontamination import words_of
from dateloom.llm.registry import ORACLES
from dateloom.llm.simhash import near_copies
from tests.llm.fixtures import PLAIN, clashing, documents, empty
from tests.test_queries import DIR, canonical, sql  # noqa: F401

QUERIES = ["op2_decontamination", "op5_exact_dedup", "op8_rendezvous_sharding", "op9_license_scan", "op10_length_buckets"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    base = " ".join(f"alpha{i} beta{i}" for i in range(200))
    rows = [r for r in PLAIN if r[0] is not None] + [(100, base, "en", "s"), (101, base.replace("alpha7 ", "other "), "en", "s"), (102, f"{base} tail", "en", "s"), (103, "Here: Quick brown fox jumps over the lazy dog and ran away", "en", "s")]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b", "quick brown fox jumps over the lazy dog and ran")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def expected(rows):
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    kept = dict(first.values())
    root = {i: i for i in kept}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept.items() for w in [t.lower().split()]}
    for _ in kept:
        for a in kept:
            for b in kept:
                if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                    root[a] = min(root[a], root[b])
    kept = {i: t for i, t in kept.items() if root[i] == i}
    window = b" quick brown fox jumps over the lazy dog and ran "
    return {i for i, t in kept.items() if window not in b" " + b" ".join(words_of(t)) + b" "}


def test_run_equals_brute_force(spark, corpus):
    folder, rows = corpus
    found = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected(rows))


def test_near_copies_are_found(spark):
    """Pairs of texts with some words changed: nine in ten of those at 0.8 or more, and none of the others."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, near = [], set()
    for i in range(300):
        one = rng.choices(words, [1 / (k + 3) for k in range(3000)], k=rng.choice((60, 200, 600)))
        two = list(one)
        for k in rng.sample(range(len(two)), len(two) * rng.choice((1, 2, 3)) // 60 or 1):
            two[k] = f"x{rng.randrange(10**6)}"
        sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (one, two)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            near.add(2 * i + 1)
        rows += [(2 * i, " ".join(one), "en", "s"), (2 * i + 1, " ".join(two), "en", "s")]
    rows += [(900, "a b c", "en", "s"), (901, "c b a", "en", "s"), (None, "A  b c", "en", "s"), (902, "a b c", "en", "s")]
    gone = {r.id for r in near_copies(documents(spark, rows)).collect() if (r.id, r.same) != (r.keep_id, r.keep_same)}
    assert {None, 902} <= gone and not gone & {900, 901}
    assert gone - {None, 902} <= near and len(gone & near) >= 0.9 * len(near) and len(near) > 100


def test_stages_keep_columns_and_bear_awkward_tables(spark, corpus):
    folder, _ = corpus
    for docs in (clashing(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLES])
def test_query_equals_sql(spark, sql, name):  # noqa: F811
    from dateloom.llm.registry import QUERIES as found

    result, wanted = found[name](spark, DIR), sql.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(wanted.columns)
    assert canonical(result.columns, result.collect()) == canonical(wanted.columns, wanted.fetchall())


def test_every_near_copy_is_found(spark):
    """texts whose copies are few enough words apart to link, but not their copies' copies, and a line in all of them."""
    rng = random.Random(5)
    line = [f"line{i}" for i in range(9)]
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((7, 30, 60, 200)))]
        for _ in range(30):
            text = list(base)
            for k in rng.sample(range(len(text)), min(len(text), rng.randrange(1 + len(text) // 25 + (len(text) < 10)))):
                text[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(line + text if rng.random() < 0.5 else text), "en", "s"))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t, *_ in rows)]
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = up(a), up(b)
                root[max(p, q)] = min(p, q)
    found = {r.id: r.keep_id for r in near_copies(documents(spark, rows)).collect()}
    assert found == {i: up(i) for i in range(len(rows))} and 20 < len(set(found.values())) < len(rows) - 50
