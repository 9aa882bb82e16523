"""Token files, decontamination, suffix tree, SimHash and language identification."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dateloom.llm import golay, suffix_tree
from dateloom.llm.decontamination import Windows, character_spans, contamination_report, find_contamination, original_spans, words_of
from dateloom.llm.language_id import LanguageCode, codewords, feature_counts, identify
from dateloom.llm.components import components as star_components
from dateloom.llm.simhash import Linker, golay_keys, link_rows, near_duplicates, near_links, text_fingerprint
from dateloom.llm.suffix_tree import score_documents
from dateloom.llm.token_files import PieceEncoder, encoder, read_token_files, token_ids, write_token_files
from tests.llm.fixtures import PLAIN, clashing, documents, empty

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


ITEMS = [("i1", "quick brown fox jumps over the lazy dog and runs away from"), ("i2", "Hund"), ("i3", None), ("i4", "!!"), ("i5", "Quick, brown FOX jumps over the lazy dog and runs")]
RUNS = {
    "tokens": lambda spark, d: token_ids(d, BPE),
    "contamination": lambda spark, d: contamination_report(d, benchmark(spark, ITEMS)),
    "scores": lambda spark, d: score_documents(d),
    "simhash": lambda spark, d: near_duplicates(d),
    "language": lambda spark, d: identify(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_tables(spark, name):
    assert RUNS[name](spark, empty(spark)).count() == 0
    assert RUNS[name](spark, clashing(spark)).count() == len(PLAIN)


PIECES = [" ", "  ", "-", "--", "ñandú", "The", "²", " ", "\n", "\n\n", "\t", " \n", "a", "the", ".", ",", "...", "'s", "don't", "é", "1", "12,000", "_", "_.", "日本", "🙂", "<|endoftext|>", "\0", "\x1c", "\x85", ". ", ", "]


FRESH = tokenizers.Tokenizer.from_file(BPE)


def fresh_ids(text):
    """What the tokenizer file gives, read by nothing of ours."""
    return FRESH.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_pieces_encode_like_whole_texts(text):
    encode = encoder(BPE)
    assert encode([text]) == [np.array(fresh_ids(text), encode.dtype).tobytes()]


def test_special_tokens_in_a_text_are_read_as_the_tokenizer_reads_them():
    text = "one <|endoftext|> two<|endoftext|>.three"
    assert fresh_ids(text).count(FRESH.token_to_id("<|endoftext|>")) == 2
    assert encoder(BPE)([text]) == [np.array(fresh_ids(text), encoder(BPE).dtype).tobytes()]


def test_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr("dateloom.llm.token_files.CACHED_PIECES", 3)
    encode = PieceEncoder(BPE)
    for text in ["one two three four", "five six", "one six"]:
        assert encode([text])[0] == np.array(fresh_ids(text), encode.dtype).tobytes()


def test_token_files_round_trip(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path / "t")
    manifest = write_token_files(docs, BPE, folder)
    found = read_token_files(docs, folder, manifest, encoder(BPE).dtype).collect()
    rows = sorted(PLAIN, key=lambda r: (r[0] is not None, r[0]))
    at, wanted = 0, []
    for i, t, *_ in rows:
        ids = [*fresh_ids(t or ""), 0]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def brute_contamination(text, items, width=10):
    words = words_of(text or "")
    hit, ids = set(), set()
    for name, body in items:
        w = words_of(body or "")
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window = w[i : i + width]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    ids.add(name)
    return len(words), len(hit), len(ids)


@pytest.mark.parametrize("block", [1 << 20, 40, 25])
def test_contamination_equals_brute_force(spark, block):
    """Also with the items in three and in five blocks."""
    found = find_contamination(documents(spark), benchmark(spark, ITEMS), block_bytes=block)
    rows = found.select("text", "found.*").collect()
    for r in rows:
        assert (r.n_words, r.n_hit, len(r["items"])) == brute_contamination(r.text, ITEMS)
        assert r.contaminated == (r.n_hit > 0)


def test_an_automaton_finds_what_a_search_finds():
    """Also words outside the items, words that are parts of others, and windows that overlap."""
    rng = np.random.default_rng(1)
    names = [f"{a}{b}" for a in ("x", "xy", "y") for b in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(names, 12))) for k in range(40)]
    windows = Windows(items, 3)
    for _ in range(100):
        text = " ".join(rng.choice([*names, "other"], 200))
        _, runs, ids = windows.scan(text)
        assert (sum(runs[1::2]) - sum(runs[::2]), len(ids)) == brute_contamination(text, items, 3)[1:]
    assert Windows([("a", None or "")], 3).scan("x")[1:] == ([], [])


def test_other_columns_stay(spark):
    docs = documents(spark).withColumns({n: F.lit(n) for n in ("found_0", "_found_0", "found_1")})
    out = find_contamination(docs, benchmark(spark, ITEMS), block_bytes=25)
    assert out.columns == [*docs.columns, "found"] and {r["found_0"] + r["_found_0"] + r["found_1"] for r in out.collect()} == {"found_0_found_0found_1"}


def test_marks_map_back_to_the_original(spark):
    text = "Süß! Quick-brown;  ünd fox"
    assert character_spans(text, [1, 3]) == [5, 16] and text[5:16] == "Quick-brown"
    df = find_contamination(documents(spark, [(1, text, "en", "s")]), benchmark(spark, [("a", "quick brown")]))
    assert [tuple(s) for s in df.select(original_spans(F.col("text"), F.col("found.hits"))).first()[0]] == [(5, 16)]


def test_empty_benchmark_marks_nothing(spark):
    assert contamination_report(documents(spark), benchmark(spark, [])).where("contaminated").count() == 0


def test_base_score_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_WORDS", 200)
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 40)), "en", "s") for i in range(120)] + [(500, None, "en", "s")]
    found = score_documents(documents(spark, rows)).collect()
    words = {i: [*(t or "").lower().encode().split(), b"\n"] for i, t, *_ in rows}
    taught = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(taught.values()), len(taught)
    assert len(found) == len(rows)
    for r in found:
        base = sum(math.log10((taught[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(words[r.doc_id]), sum(taught[w] > 0 for w in words[r.doc_id]))
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in found if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_tree(texts, learns, depth):
    """The tree by the definition, in plain Python: the probability function, and the states kept."""
    split = [[*(t or "").lower().encode().split(), b"\n"] for t in texts]
    taught = [w for w, yes in zip(split, learns, strict=True) if yes]
    words = Counter(w for ws in taught for w in ws)
    tokens, unknown = sum(words.values()), (sum(n == 1 for n in words.values()) + 0.5) / (sum(words.values()) + 1)
    after = defaultdict(Counter)
    for ws in taught:
        for i in range(1, len(ws)):
            for d in range(1, min(depth, i) + 1):
                after[tuple(ws[i - d : i])][ws[i]] += 1
    states = {}

    def p(context, word):
        for d in range(len(context)):
            if context[d:] in states:
                return smoothed(context[d:], word, sum(after[context[d:]].values()), after[context[d:]][word])
        return (1 - unknown) * words[word] / tokens if words[word] else unknown

    def smoothed(context, word, n, count, seen=None):
        seen = len(after[context]) if seen is None else seen
        return (max(count - 0.75, 0) + 0.75 * seen * p(context[1:], word)) / n

    for context in sorted(after, key=len):
        n, gain = sum(after[context].values()), 0.0
        if n < 2 or any(words[w] < 2 for w in context):
            continue
        for word, c in after[context].items():
            parent = p(context[1:], word)
            if c == 1:  # left out, the word is unseen here: it has the discounts of the others, times the parent's share of it
                alone = max(0.75 * (len(after[context]) - 1), 0.25) / (n - 1) * parent
            else:
                alone = max(c - 1 - 0.75, 0.25) / (n - 1)
            gain += c * (math.log(alone) - math.log(parent))
        if gain >= 2.0:
            states[context] = True
    return split, p, states


@pytest.mark.parametrize(("depth", "large", "chunk"), [(3, 500_000, 10**6), (3, 30, 300), (2, 5, 300), (4, 12, 500)])
def test_model_score_equals_brute_force(spark, monkeypatch, depth, large, chunk):
    """Also with several chunks and owners, and with most states too large for an owner."""
    for name, value in (("CHUNK_WORDS", chunk), ("RUNS_A_PART", 400), ("KEYS_A_PART", 300)):
        monkeypatch.setattr(suffix_tree, name, value)
    rng = np.random.default_rng(2)
    phrases = [" ".join(f"v{x}" for x in rng.integers(0, 15, 6)) for _ in range(12)]
    texts = [" ".join(rng.choice(phrases, 4)) + " " + " ".join(f"v{x}" for x in (rng.pareto(1, 8) * 3).astype(int)) for _ in range(70)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, None, "", "only unknown words"])]
    learns = [zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows]
    split, p, states = brute_tree([t for _, t, *_ in rows], learns, depth)
    wanted = {i: sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), w)) for k, w in enumerate(ws)) for (i, *_), ws in zip(rows, split, strict=True)}
    found = {r.doc_id: r.score for r in score_documents(documents(spark, rows), depth=depth, large=large).collect()}
    assert {len(x) for x in states} == set(range(1, depth + 1)) and len(found) == len(rows)
    for i, score in wanted.items():
        assert math.isclose(found[i], score, rel_tol=1e-5), (i, found[i], score)


def test_learning_leaves_neither_shuffles_nor_hashes(spark, monkeypatch):
    """When runs are sent, the disk holds no shuffle of the stages before and no word hashes, and the session's setting is as it was."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shuffles = lambda: {name for name in str(disk.getAllFiles().mkString(" ")).split() if "/shuffle_" in name}
    before, was, held, score = shuffles(), spark.conf.get(setting), [], suffix_tree.score_chunks

    def watched(session, folder, *rest):
        till = time.time() + 20  # executors delete in the background
        while shuffles() - before and time.time() < till:
            time.sleep(0.1)
        held.append((shuffles() - before, list(Path(folder.removeprefix("file:")).rglob("*.voc")), spark.conf.get(setting)))
        return score(session, folder, *rest)

    monkeypatch.setattr(suffix_tree, "score_chunks", watched)
    monkeypatch.setattr(suffix_tree, "CHUNK_WORDS", 300)
    assert score_documents(documents(spark, [(i, f"a b w{i % 7} " * 30, "en", "s") for i in range(40)]), large=30).count() == 40
    assert held == [(set(), [], was)]


def test_next_word_distributions_sum_to_one():
    """After kept states of one and of two words the known words and the unknown one have all the probability."""
    learned = np.array([1.0, 6, 5, 0, 0, 9, 0, 0, 0, 0])  # next words 1..4 and the unknown one, after word 1 alone and after words 2, 1
    following = np.array([1, 2, 3, 4, 0] * 2)
    root = np.array([0.05, 0.15, 0.4, 0.3, 0.1] * 2)
    words = [np.ones(10, int), np.array([0] * 5 + [2] * 5)]
    p = suffix_tree.subtree(words, following, learned, root, np.zeros(10, np.int8))
    assert math.isclose(p[:5].sum(), 1) and math.isclose(p[5:].sum(), 1) and p[5] > p[0] > root[0]


def test_frequent_pairs_are_contexts_whatever_their_lift(spark):
    """The word after "a b" or "b b" is certain, but neither pair is commoner than 1.5 times chance."""
    found = score_documents(documents(spark, [(i, "a b b " * 100, "en", "s") for i in range(40)])).collect()
    assert all(r.score / r.n_tokens > -0.1 for r in found) and any(r.held_out for r in found)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 20_000).astype(np.int32)
    low, high, error = golay.tables()
    fixed = words ^ error[low[words & 0xFFF] ^ high[words >> 12]]
    assert (np.bitwise_count(words ^ fixed) <= 3).all() and all(golay.remainder(int(x)) == 0 for x in fixed[:200])
    flips = words ^ (1 << rng.integers(0, 23, len(words))).astype(np.int32) ^ (1 << rng.integers(0, 23, len(words))).astype(np.int32)
    a, new_a = golay.nearby(words, 23)
    b, new_b = golay.nearby(flips, 23)
    assert all(set(x[m]) & set(y[n]) for x, m, y, n in zip(a, new_a, b, new_b, strict=True))


def components(prints, links):
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(int(a))] = find(int(b))
    groups = {}
    for p in root:
        groups.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


def planted_prints():
    rng = np.random.default_rng(3)
    prints = [rng.integers(-(2**63), 2**63 - 1, 150, dtype=np.int64)]
    for _ in range(7):
        prints.append(prints[-1] ^ (np.int64(1) << rng.integers(0, 63, 150)))
    return np.unique(np.concatenate(prints))


def true_links(prints):
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= 4
    return [(prints[i], prints[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]


@pytest.mark.parametrize("small", [24, 2])
def test_links_join_what_brute_force_joins(monkeypatch, small):
    monkeypatch.setattr("dateloom.llm.simhash.SMALL_GROUP", small)
    prints = planted_prints()
    key, own = golay_keys(prints)
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 500]), pa.array(own[i : i + 500])], ["key", "print"]) for i in range(0, len(key), 500)]
    links = [x for b in link_rows(iter(batches), 4) for x in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)]
    assert components(prints, links) == components(prints, true_links(prints)) and len(links) < len(prints)


def test_blocks_of_large_groups_join_what_brute_force_joins(spark):
    """Groups of more than five rows, compared block by block."""
    prints = planted_prints()
    table = spark.createDataFrame([(int(p),) for p in prints], "print long")
    links = [(r.a, r.b) for r in near_links(table, group_rows=5).collect()]
    assert components(prints, links) == components(prints, true_links(prints))


@pytest.mark.parametrize("large", [10**6, 3])
def test_components_equal_brute_force(spark, large):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(i % 2, i) for i in range(400, 440)]
    found = star_components(spark.createDataFrame(links, "a long, b long"), "a", "b", large_node=large).collect()
    groups = components({x for ab in links for x in ab if ab[0] != ab[1]}, [x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in found} == {x: g[0] for g in groups for x in g}


def test_a_document_without_id_links_its_neighbours(spark):
    """Of three texts in a chain the middle one has no id; three without id are a component without one."""
    texts, prints = ["a b c d e f g"], []
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words), " ".join(["x", *words[1:]]), " ".join(["x", "y", *words[2:]])]
    prints = [text_fingerprint(t) for t in chain]
    rows = [(1, chain[0], "en", "s"), (None, chain[1], "en", "s"), (3, chain[2], "en", "s")]
    found = near_duplicates(documents(spark, rows + [(None, t, "en", "s") for t in texts * 2])).collect()
    near = [(a ^ b).bit_count() <= 4 for a, b in ((prints[0], prints[1]), (prints[1], prints[2]))]
    assert all(near)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1)]


def test_linker_keeps_a_forest():
    tight = np.arange(16, dtype=np.int64)
    assert len(list(Linker(4).large(tight, np.ones(16, bool)))) == 15


def test_near_duplicates_equal_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(i, base.replace(f"word{i * 7}", f"other{i}") if i else base, "en", "s") for i in range(12)]
    rows += [(20 + i, " ".join(f"{c}{i}{k}" for k in range(50)), "en", "s") for i, c in enumerate("abc")] + [(30, None, "en", "s"), (31, "", "en", "s")]
    found = near_duplicates(documents(spark, rows)).collect()
    prints = {i: text_fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_fingerprint_by_the_definition():
    import xxhash

    text = "A b c d e f"
    values = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c d", "b c d e", "c d e f")]
    bits = sum(1 << i for i in range(64) if sum(v >> i & 1 for v in values) * 2 > 3)
    assert text_fingerprint(text) == bits and text_fingerprint("x y") == xxhash.xxh64_intdigest("x y", 42) and text_fingerprint(" ") == 0


def test_codewords_differ():
    for k in (2, 3, 4, 7, 8, 20):
        code = codewords(k).astype(int)
        gaps = (code.shape[1] - code @ code.T) // 2
        assert code.shape[0] == k and gaps[~np.eye(k, dtype=bool)].min() >= max(1, code.shape[1] // 5)


def test_languages_are_told_apart_on_held_out_rows(spark):
    words = {"en": "the of and to in is that with for this", "de": "der die und das ist nicht mit von ein für", "fr": "le la les et des est que pour une dans"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang, "s") for i, lang in enumerate(list(words) * 60)]
    rows += [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "the and of", None, "s"), (903, "日本", "en", "s")]
    found = {r.doc_id: r for r in identify(documents(spark, rows)).collect()}
    held = [(found[i].lang_pred, lang) for i, _, lang, _ in rows[:180] if found[i].held_out]
    assert len(held) > 20 and all(a == b for a, b in held)
    assert (found[900].lang_pred, found[900].score, found[901].lang_pred) == ("und", 0.0, "und") and found[902].lang_pred == "en"
    assert found[903].lang_pred in words and all(0 <= r.score <= 1 for r in found.values())


def test_blocks_of_a_long_text_give_the_counts_of_the_whole(monkeypatch):
    text = "".join(f"wörd{i} über the {i}" for i in range(400))
    whole = feature_counts(text)
    for block in (7, 64, 1000):
        monkeypatch.setattr("dateloom.llm.language_id.BLOCK", block)
        assert (feature_counts(text) == whole).all()


def test_a_text_of_megabytes_takes_the_memory_of_a_block():
    import tracemalloc

    counts = np.random.default_rng(0).integers(1, 50, (8, 1 << 15)).astype(float)
    model = LanguageCode.train([f"l{i}" for i in range(8)], counts)
    text = "Some words of a long text, " * 750_000
    tracemalloc.start()
    assert model.predict(text)[0] in model.languages
    assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    tracemalloc.stop()


def test_only_the_commonest_labels_are_learned(spark):
    from dateloom.llm.language_id import train

    rows = [(i, f"text {lang} {i}", lang, "s") for i, lang in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 2)]
    assert train(documents(spark, rows), languages=2).languages == ["aa", "bb"]


def test_without_labels_all_is_unknown(spark):
    docs = documents(spark, [(1, "some text", None, "s")])
    assert [r.lang_pred for r in identify(docs).collect()] == ["und"]
    one = LanguageCode.train(["en"], np.ones((1, 1 << 15)))
    assert one.predict("text") == ("en", 1.0, False) and feature_counts("a").sum() == 6 and feature_counts(" ! ").sum() == 1
