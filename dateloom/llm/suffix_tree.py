"""A probabilistic suffix tree over words, and the score of every document under it.

Symbols are the words of a text and one end mark; all words never seen in learning
are one more symbol. The root has the words' frequencies, with the share of words
seen once kept for the unknown one (Good-Turing). A state is a context of one to
``DEPTH`` words that learning saw at least twice. It is kept if its next-word distribution
diverges from its parent's, which is that of the longest kept state that is a proper suffix
of it: leaving each occurrence out in turn, the occurrences must be likelier after the
state than after its parent. No state is thrown out before that test. Distributions are
smoothed by absolute discounting towards the parent's, so each sums to one. A word is
scored after the longest kept state that is a suffix of what stands before it.

Documents are dealt into chunks of about as many words as one task read, each a few
files in the shared folder: word numbers, word hashes, document ids. An ``exchange`` then
gives each word its count and a number of its own, small for frequent words; with it the hashes
have served and are deleted, as is each shuffle of learning when its query ends. All states that
end in one word are one subtree, so each chunk sends its different runs of ``DEPTH`` + 1
words, with how often it learned them, to the owner of the last word but one; the owner has all it takes to
count, test and smooth that subtree, and answers with the probability of each run. So the whole tree
takes one shuffle each way.

A word (or longer state) with more than ``LARGE`` runs is no one's: its next words are counted
by an ``exchange``, which splits them evenly, its test adds up sums over them, and its longer
contexts have owners of their own, down to ``DEPTH``. There are at most runs / ``LARGE`` such
states at each depth, and they alone reach the driver. Keys are whole numbers of states and
words, not hashes of them; only words are told apart by a hash, of 64 bits.

Edge cases: a null, empty or wordless text is the end mark alone; a null id counts
as a learning one; with nothing to learn from every word is unknown; equal ids each
get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateloom.llm.common import bound_batches, delete_path, finish, freed_shuffles, release, scratch_mark, scratch_path, text_or_empty
from dateloom.llm.files import open_fs

#: Least learning occurrences of a context; discount from each seen next word; least gain of a kept state in nats.
LEAST_COUNT, DISCOUNT, LEAST_GAIN = 2, 0.75, 2.0
#: Words of the longest state.
DEPTH = 3
#: Words after which a task starts a new chunk, keys that one task of an exchange adds up, and runs that one owner is given.
CHUNK_WORDS, KEYS_A_PART, RUNS_A_PART = 1_500_000, 2_000_000, 2_000_000
#: Occurrences beyond which a state has no owner.
LARGE = 500_000
NO_ID = -(2**63)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END = b"\n"
SQUEEZE, EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Fixed odd multipliers for scattering numbers.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    edges = edges - edges[0]
    solid = ~BLANKS[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = edges[:-1][edges[:-1] < edges[1:]]
    begins[inner] = solid[inner]  # texts stand side by side
    written = np.cumsum(begins)
    through = np.concatenate([[0], written])[edges]
    offsets = np.flatnonzero(begins[solid]).astype(np.int64)
    joined = LOWER[data[solid]]
    offsets = np.append(offsets, len(joined))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]), np.diff(through)


def scatter(x: np.ndarray) -> np.ndarray:
    """Numbers spread evenly over 64 bits, no two to the same one."""
    x = x.astype(np.uint64) * MIX_A
    x ^= x >> np.uint64(32)
    return x * MIX_B


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of the key at every place."""
    return np.unique(keys, return_inverse=True)


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of keys, and the number of the key at every place."""
    order = np.argsort(keys)  # keys that are equal may come in any order, which no result tells
    put = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = put[1:] != put[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row of whole numbers, in the order of rows; keys that outgrow 64 bits are numbered anew on the way."""
    key, bound = np.zeros(len(columns[0]), np.uint64), 1
    for column in columns:
        size = int(column.max(initial=0)) + 1
        if bound * size >= 2**64:
            first, key = alike(key)
            key, bound = key.astype(np.uint64), len(first)
        key = key * np.uint64(size) + column.astype(np.uint64)
        bound *= size
    return key


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, like bytes together, compressed; of whole numbers from 0 no more bytes than the greatest needs."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values)
    if values.dtype.kind == "i" and values.min() >= 0:
        values = values.astype(np.min_scalar_type(values.max()))
    planes = values.reshape(len(values), -1).view(np.uint8).T
    return bytes([values.itemsize]) + SQUEEZE.compress(planes.tobytes())


def unpack(data: bytes, dtype: str, columns: int = 1) -> np.ndarray:
    if not data:
        return np.empty((0, columns) if columns > 1 else 0, dtype)
    width, raw = data[0], np.frombuffer(EXPAND.decompress(memoryview(data)[1:]), np.uint8)
    held = dtype if width == np.dtype(dtype).itemsize else f"<u{width}"
    out = np.ascontiguousarray(raw.reshape(width * columns, -1).T).view(held).astype(dtype, copy=False)
    return out[:, 0] if columns == 1 else out


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    fs, path = open_fs(folder)
    for key, values in arrays.items():
        own = f"{path}/{name}.{key}-{uuid.uuid4().hex[:8]}"
        with fs.open_output_stream(own) as out:
            out.write(pack(values) if len(values) else b"")
        if fs.get_file_info(f"{path}/{name}.{key}").type == pafs.FileType.NotFound:
            fs.move(own, f"{path}/{name}.{key}")
        else:
            fs.delete_file(own)


def load(folder: str, name: str, key: str, dtype: str, columns: int = 1) -> np.ndarray:
    fs, path = open_fs(folder)
    data = b""
    if fs.get_file_info(f"{path}/{name}.{key}").type != pafs.FileType.NotFound:  # a channel without keys has no answer
        with fs.open_input_stream(f"{path}/{name}.{key}") as f:
            data = f.read()
    return unpack(data, dtype, columns) if data else np.empty((0, columns) if columns > 1 else 0, dtype)


def hashes_in(folder: str) -> str:
    """Where the chunks' word hashes are until the words have their numbers."""
    return f"{folder}/hashes"


def learning(doc_id: Column) -> Column:
    """Documents to learn from: those whose CRC-32 of the id as text does not leave 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def write_chunks(docs: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write the chunks of (id, learns, text) rows; returns their names and word counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(hashes_in(folder))
        fs.create_dir(path, recursive=True)
        texts: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids, learns = [], []

        def close() -> pa.RecordBatch:
            name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:8]}"
            coded, counts = pa.concat_arrays(texts).dictionary_encode(), np.concatenate(lengths)
            vocabulary = [*coded.dictionary.to_pylist(), END]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            every = np.full(int(counts.sum()), len(vocabulary) - 1, np.int32)
            inner = np.ones(len(every), bool)
            inner[np.cumsum(counts) - 1] = False
            every[inner] = coded.indices.to_numpy()
            save(hashes_in(folder), name, voc=hashes)
            save(folder, name, tok=every, ids=np.array(ids, np.int64), use=np.array(learns, np.uint8), len=counts)
            for x in (texts, ids, learns, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict({"name": [name], "words": [len(every)]})

        held = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                words, counts = words_of(some.column(2))
                texts.append(words)
                lengths.append(counts + 1)
                ids += some.column(0).fill_null(NO_ID).to_pylist()
                learns += some.column(1).to_pylist()
                held += len(words) + len(counts)
                if held >= CHUNK_WORDS:
                    yield close()
                    held = 0
        if held:
            yield close()

    return sorted((r["name"], r["words"]) for r in docs.mapInArrow(write, "name string, words long").collect())


@dataclass
class LargeStates:
    """The states of one depth that have no owner: sorted keys (number of the parent among its like, and the word before), and
    for each how often it was learned, how many next words it has, and whether it is kept."""

    keys: np.ndarray
    count: np.ndarray | None = None
    seen: np.ndarray | None = None
    keep: np.ndarray | None = None


@dataclass
class Model:
    """What holds for the whole corpus: learning words, how many are distinct, how many occur once, the greatest word number; large states by depth."""

    depth: int
    tokens: int = 0
    distinct: int = 0
    once: int = 0
    numbers: int = 0
    large: list[LargeStates] = field(default_factory=list)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """The root's probability of words with these counts; 0 stands for the unknown word."""
        unknown = (self.once + 0.5) / (self.tokens + 1)
        return np.where(counts > 0, (1 - unknown) * counts / max(self.tokens, 1), unknown)

    def key(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One number for a state's number and a word's."""
        return state.astype(np.uint64) * np.uint64(self.numbers + 1) + word.astype(np.uint64)


class Chunk:
    """One chunk's files, and the places of its words that stand after some state."""

    def __init__(self, folder: str, name: str, model: Model) -> None:
        self.folder, self.name, self.model = folder, name, model
        self.tokens = load(folder, name, "tok", "<i4")
        self.lengths = load(folder, name, "len", "<i8")
        self.contexts: list[np.ndarray] = []
        self.use = np.repeat(load(folder, name, "use", "u1"), self.lengths).astype(bool)

    @cached_property
    def words(self) -> np.ndarray:
        """(learning count, number) of each word of the chunk's vocabulary; the number of unlearned words is 0."""
        return load(self.folder, self.name, "w", "<i8", 2)

    @cached_property
    def at(self) -> np.ndarray:
        """Places after a word that can be a state."""
        first = np.zeros(len(self.tokens), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        at = np.flatnonzero(~first)
        return at[self.words[self.tokens[at - 1], 0] >= LEAST_COUNT]

    @cached_property
    def numbers(self) -> np.ndarray:
        """The different numbers of the vocabulary, 0 first. A number's rank is its place here."""
        return np.unique(np.append(self.words[:, 1], 0))

    @cached_property
    def ranks(self) -> np.ndarray:
        """The rank of each word's number."""
        return np.searchsorted(self.numbers, self.words[:, 1])

    @cached_property
    def counts(self) -> np.ndarray:
        """The learning count that goes with each rank."""
        out = np.zeros(len(self.numbers), np.int64)
        out[self.ranks] = self.words[:, 0]
        return out

    @cached_property
    def next(self) -> np.ndarray:
        """Ranks of the words at the places."""
        return self.ranks[self.tokens[self.at]]

    @cached_property
    def reach(self) -> np.ndarray:
        """How many words of its text stand before each place."""
        return self.at - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)[self.at]

    def before(self, d: int) -> np.ndarray:
        """Ranks of the words ``d`` before each place; 0 where the context cannot reach so far."""
        while len(self.contexts) < d:
            back = len(self.contexts) + 1
            there = self.reach >= back
            word = self.tokens[np.where(there, self.at - back, 0)]
            there &= self.words[word, 0] >= LEAST_COUNT
            if self.contexts:
                there &= self.contexts[-1] > 0
            self.contexts.append(np.where(there, self.ranks[word], 0))
        return self.contexts[d - 1]

    def candidates(self, d: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose context of ``d`` words has a large parent (``state`` is its number, -1 for none), and the context's keys."""
        here = np.flatnonzero((state >= 0) & (self.before(d) > 0))
        return here, self.model.key(state[here], self.numbers[self.before(d)[here]])

    def large_at(self, d: int, state: np.ndarray) -> np.ndarray:
        """The number of each place's large state of ``d`` words, or -1."""
        here, keys = self.candidates(d, state)
        known = self.model.large[d - 1].keys
        found = np.searchsorted(known, keys)
        hit = found < len(known)
        hit[hit] = known[found[hit]] == keys[hit]
        out = np.full(len(self.at), -1, np.int64)
        out[here[hit]] = found[hit]
        return out

    def grams(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places after a large state; sorted distinct keys of the state with the next word, and the key's number at each place."""
        here = np.flatnonzero(state >= 0)
        return here, *distinct(scatter(self.model.key(state[here], self.numbers[self.next[here]])))

    def descend(self, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Down the large states: each place's state at depth ``upto`` (or -1), the probability of its word so far, and the depth reached."""
        state, p = np.zeros(len(self.at), np.int64), self.model.root(self.words[self.tokens[self.at], 0])
        depth = np.zeros(len(self.at), np.int8)
        for d in range(1, upto + 1):
            state = self.large_at(d, state)
            table = self.model.large[d - 1]
            if table.keep is None:
                break
            here, _, number = self.grams(state)
            depth[here] = d
            of = state[here]
            count = load(self.folder, self.name, f"n{d}", "<i8", 2)[number, 0]
            longer = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * table.seen[of] * p[here]) / np.maximum(table.count[of], 1)
            p[here] = np.where(table.keep[of], longer, p[here])
        return state, p, depth

    def runs(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What goes to owners: the places, the run's number at each, and of each run, in the order of owners: a place,
        its owner; then the probability so far and the depth reached of all places."""
        _, p, depth = self.descend(len(self.model.large))
        words = np.stack([self.before(d) for d in range(1, self.model.depth + 1)])
        reach = np.minimum(depth, self.model.depth - 1)
        sent = np.flatnonzero((depth < self.model.depth) & (words[reach, np.arange(len(depth))] > 0))
        first, number = alike(joint([*(w[sent] for w in words), self.next[sent]]))
        place = sent[first]
        route = self.numbers[words[0][place]].astype(np.uint64)
        for d in range(1, self.model.depth):
            route = np.where(depth[place] >= d, scatter(route) ^ self.numbers[words[d][place]].astype(np.uint64), route)
        owner = ((scatter(route) >> np.uint64(32)) % np.uint64(owners)).astype(np.min_scalar_type(owners))
        by_owner = np.argsort(owner, kind="stable")
        rank = np.empty(len(place), np.int64)
        rank[by_owner] = np.arange(len(place))
        return sent, rank[number], place[by_owner], owner[by_owner].astype(np.int64), p, depth

    def scores(self, owners: int, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known words, base score and model score of each document, given the owners' probabilities in the order of runs."""
        count = self.words[self.tokens, 0]
        sent, number, _, _, reached, _ = self.runs(owners)
        p = self.model.root(count)
        p[self.at] = reached
        p[self.at[sent]] = answers[number]
        edge = np.cumsum(self.lengths) - self.lengths
        total = lambda x: np.add.reduceat(x, edge) if len(edge) else np.empty(0)
        floor = np.log10(self.model.tokens + self.model.distinct + 1)
        return total((count > 0).astype(np.int64)), total(np.log10(count + 1)) - self.lengths * floor, total(np.log10(p))


def evidence(count: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """What one next word adds to its state: (count, seen, seen once, weighted log of its share over the parent's)."""
    more = count >= 2
    gain = np.where(more, count * np.log(np.maximum(count - 1 - DISCOUNT, 0.25) / parent), 0.0)
    return np.stack([count.astype(float), (count >= 1).astype(float), (count == 1).astype(float), gain], axis=1)


def kept(n: np.ndarray, seen: np.ndarray, once: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The divergence test: the log likelihood gained over the parent when each occurrence is left out in turn."""
    rest = np.maximum(n - 1, 1)
    backed_off = np.log(np.maximum(DISCOUNT * (seen - 1), 0.25) / rest)
    return (n >= LEAST_COUNT) & (once * backed_off + gain - (n - once) * np.log(rest) >= LEAST_GAIN)


def subtree(words: list[np.ndarray], following: np.ndarray, learned: np.ndarray, p: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The probability of each run, given all runs of the same subtrees: how often each was learned, and what is known down to ``depth``."""
    order = np.argsort(joint([*words, following]))  # states stand together
    words, following, learned, depth = [w[order] for w in words], following[order], learned[order], depth[order]
    p = p[order].astype(float)
    step = np.uint64(int(following.max(initial=0)) + 1)
    inside, new = np.ones(len(order), bool), np.zeros(len(order), bool)
    for d, word in enumerate(words, 1):
        inside &= word > 0
        new[1:] |= word[1:] != word[:-1]
        here = np.flatnonzero(inside & (depth < d))
        if not len(here):
            continue
        state = np.cumsum(new)[here]
        of = np.cumsum(np.diff(state, prepend=state[0]) != 0)
        parent, size = p[here], int(of[-1]) + 1
        first, gram = alike(of.astype(np.uint64) * step + following[here].astype(np.uint64))
        count = np.bincount(gram, weights=learned[here])
        first = first[count > 0]
        adds = evidence(count[count > 0], parent[first])
        sums = np.stack([np.bincount(of[first], weights=x, minlength=size) for x in adds.T])
        keep = kept(*sums)
        longer = (np.maximum(count[gram] - DISCOUNT, 0) + DISCOUNT * sums[1][of] * parent) / np.maximum(sums[0][of], 1)
        p[here] = np.where(keep[of], longer, parent)
    out = np.empty(len(order))
    out[order] = p
    return out


Request = tuple[str, np.ndarray, np.ndarray]


def ask_words(chunk: Chunk) -> Request:
    hashes = load(hashes_in(chunk.folder), chunk.name, "voc", "<u8")
    order = np.argsort(hashes)
    return "w", hashes[order], np.bincount(chunk.tokens[chunk.use], minlength=len(hashes))[order].astype(np.int64)


def ask_next_words(chunk: Chunk) -> Request:
    """How often each next word was learned after each large state of the greatest depth there is."""
    d = len(chunk.model.large)
    state, _, _ = chunk.descend(d)
    here, keys, number = chunk.grams(state)
    learned = number[chunk.use[chunk.at[here]]]
    return f"n{d}", keys, np.bincount(learned, minlength=len(keys)).astype(np.int64)


def exchange(
    spark: SparkSession, folder: str, chunks: list[tuple[str, int]], model: Model, ask: Callable[[Chunk], Request]
) -> tuple[int, int, int, int]:
    """Send each chunk's keys and counts, add up those of equal keys, and save the sums as files of the chunks.

    With each sum goes a second number. For words it is the word's own, frequent words having small
    ones; for other keys it is 1 in the first chunk to hold the key and 0 in others. Returns the
    total, how many keys have a sum above 0 and of 1, and the greatest number.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, sum(n for _, n in chunks)) / KEYS_A_PART))))
    parts = 1 << bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            channel, keys, values = ask(Chunk(folder, row["name"], model))
            cut = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys)), np.arange(parts + 1))
            used = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "channel": [channel] * len(used),
                    "part": pa.array(used, pa.int32()),
                    "chunk": pa.array([row["chunk"]] * len(used), pa.int32()),
                    "name": [row["name"]] * len(used),
                    "keys": pa.array([pack(np.diff(keys[cut[p] : cut[p + 1]], prepend=np.uint64(0))) for p in used], pa.binary()),
                    "vals": pa.array([pack(values[cut[p] : cut[p + 1]]) for p in used], pa.binary()),
                },
                schema=pa.schema(
                    [("channel", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("name", pa.string())]
                    + [("keys", pa.binary()), ("vals", pa.binary())]
                ),
            )

    def add_up(group: list[dict]) -> list[dict]:
        keys = [np.cumsum(unpack(r["keys"], "<u8"), dtype=np.uint64) for r in group]
        every, values = np.concatenate(keys), np.concatenate([unpack(r["vals"], "<i8") for r in group])
        order = np.argsort(every, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        sums = np.add.reduceat(values[order], start)
        out = np.zeros((len(every), 2), np.int64)
        each = np.diff(np.concatenate([start, [len(every)]]))
        out[order, 0] = np.repeat(sums, each)
        if group[0]["channel"] == "w":
            number = np.empty(len(sums), np.int64)
            number[np.argsort(-sums, kind="stable")] = np.arange(len(sums)) * parts + group[0]["part"] + 1
            out[order, 1] = np.repeat(np.where(sums > 0, number, 0), each)
        else:
            out[order[start], 1] = 1
        edges = np.cumsum([0, *map(len, keys)])
        found = [
            {"chunk": r["chunk"], "name": r["name"], "channel": r["channel"], "part": r["part"], "vals": pack(out[a:b])}
            for r, a, b in zip(group, edges, edges[1:], strict=False)
        ]
        totals = np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum(), out[:, 1].max()])
        return [*found, {"chunk": 0, "name": "", "channel": "", "part": -1, "vals": totals.astype("<i8").tobytes()}]

    schema = pa.schema([("chunk", pa.int32()), ("name", pa.string()), ("channel", pa.string()), ("part", pa.int32()), ("vals", pa.binary())])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"]):
            yield pa.RecordBatch.from_pylist(add_up(list(rows)), schema=schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["name"]):
            if name:
                held = list(rows)
                channel, values = held[0]["channel"], np.concatenate([unpack(r["vals"], "<i8", 2) for r in held])
                if channel == "w":  # in the order of the chunk's vocabulary
                    sums, values = values, np.empty_like(values)
                    values[np.argsort(load(hashes_in(folder), name, "voc", "<u8"))] = sums
                save(folder, name, **{channel: values})
                continue
            found = np.stack([np.frombuffer(r["vals"], "<i8") for r in rows])
            yield pa.RecordBatch.from_pydict(dict(zip(TOTALS, ([int(x)] for x in [*found[:, :3].sum(axis=0), found[:, 3].max()]), strict=True)))

    sent = chunk_rows(spark, chunks).mapInArrow(send, "channel string, part int, chunk int, name string, keys binary, vals binary")
    summed = (
        sent.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "chunk")
        .mapInArrow(answers, "chunk int, name string, channel string, part int, vals binary")
    )
    saved = (
        summed.repartitionById(len(chunks), F.col("chunk"))
        .sortWithinPartitions("name", "part")
        .mapInArrow(keep, ", ".join(f"{x} long" for x in TOTALS))
    )
    found = saved.agg(*(F.sum(x) for x in TOTALS[:3]), F.max(TOTALS[3])).first()
    return tuple(int(x or 0) for x in found)


TOTALS = ("total", "distinct", "once", "greatest")


def chunk_rows(spark: SparkSession, chunks: list[tuple[str, int]]) -> DataFrame:
    """(chunk, name), one row and one task a chunk."""
    table = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(chunks)], "chunk int, name string")
    return table.repartitionById(len(chunks), F.col("chunk"))


def find_large(spark: SparkSession, folder: str, chunks: list[tuple[str, int]], model: Model, large: int) -> np.ndarray:
    """Keys of the states one word longer than those of ``model.large`` that may stand before more than ``large`` words, sorted.

    A chunk leaves out what it holds a few times only; even if all did, a quarter of ``large`` would be missing.
    """
    few = large / 4 / len(chunks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            chunk = Chunk(folder, row["name"], model)
            d = len(model.large) + 1
            state, _, _ = chunk.descend(d - 1)
            keys, n = np.unique(chunk.candidates(d, state)[1], return_counts=True)
            often = n > few
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

    found = chunk_rows(spark, chunks).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["key"] for r in found.where(F.col("n") > 0.75 * large).collect()], np.int64).view(np.uint64))


def judge_large(spark: SparkSession, folder: str, chunks: list[tuple[str, int]], model: Model) -> LargeStates:
    """The large states of the greatest depth with their sums, and whether they are kept."""
    d, size = len(model.large), len(model.large[-1].keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            chunk = Chunk(folder, row["name"], model)
            state, p, _ = chunk.descend(d)
            here, keys, number = chunk.grams(state)
            count, first = load(folder, row["name"], f"n{d}", "<i8", 2).T if len(keys) else np.empty((2, 0), np.int64)
            place = np.empty(len(keys), np.int64)
            place[number] = here
            own = (first > 0) & (count > 0)
            sums = np.zeros((size, 4))
            np.add.at(sums, state[place[own]], evidence(count[own], p[place[own]]))
            used = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, sums[used].T)], ["state", "n", "seen", "once", "gain"])

    rows = chunk_rows(spark, chunks).mapInArrow(add, "state long, n double, seen double, once double, gain double")
    sums = np.zeros((size, 4))
    for r in rows.groupBy("state").agg(*(F.sum(x) for x in ("n", "seen", "once", "gain"))).collect():
        sums[r[0]] = r[1:]
    return LargeStates(model.large[-1].keys, sums[:, 0], sums[:, 1], kept(*sums.T))


def learn(spark: SparkSession, folder: str, chunks: list[tuple[str, int]], depth: int, large: int) -> Model:
    """Words and large states; the rest of the tree lives with its owners."""
    model = Model(depth, *exchange(spark, folder, chunks, Model(depth), ask_words))
    delete_path(spark, hashes_in(folder))
    for _ in range(depth):
        keys = find_large(spark, folder, chunks, model, large)
        if not len(keys):
            break
        model.large.append(LargeStates(keys))
        exchange(spark, folder, chunks, model, ask_next_words)
        model.large[-1] = judge_large(spark, folder, chunks, model)
    return model


#: Types of what goes with the words of runs: how often each was learned and the depth reached; the probability so far of
#: those that reached any, and the learning counts of the different next words, in order, from which the others have theirs.
RUN_EXTRAS = (("learned", "<i8"), ("depth", "i1"), ("p", "<f4"), ("counts", "<i8"))


def score_chunks(spark: SparkSession, folder: str, chunks: list[tuple[str, int]], model: Model, schema: str) -> DataFrame:
    owners = max(1, -(-sum(n for _, n in chunks) // RUNS_A_PART))
    words = [f"w{d}" for d in range(1, model.depth + 1)]
    columns = [*words, "next", *(x for x, _ in RUN_EXTRAS)]
    dtypes = dict.fromkeys([*words, "next"], "<i8") | dict(RUN_EXTRAS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            chunk = Chunk(folder, row["name"], model)
            sent, number, place, owner, p, depth = chunk.runs(owners)
            values = {f"w{d}": chunk.numbers[chunk.before(d)[place]] for d in range(1, model.depth + 1)}
            following, p = chunk.next[place], p[place].astype("<f4")
            values |= {"next": chunk.numbers[following], "depth": depth[place]}
            values["learned"] = np.bincount(number[chunk.use[chunk.at[sent]]], minlength=len(place)).astype(np.int64)
            cut = np.searchsorted(owner, np.arange(owners + 1))
            used = [o for o in range(owners) if cut[o] < cut[o + 1]]
            packed = {x: [pack(v[cut[o] : cut[o + 1]]) for o in used] for x, v in values.items()}
            packed |= {"p": [], "counts": []}
            for of in (slice(cut[o], cut[o + 1]) for o in used):
                packed["counts"].append(pack(chunk.counts[np.unique(following[of])]))
                packed["p"].append(pack(p[of][values["depth"][of] > 0]))
            yield pa.RecordBatch.from_pydict(
                {"owner": pa.array(used, pa.int32()), "chunk": pa.array([row["chunk"]] * len(used), pa.int32())}
                | {x: pa.array(packed[x], pa.binary()) for x in columns}
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["owner"]):
            group = list(rows)
            found = {x: [unpack(r[x], dtypes[x]) for r in group] for x in columns}
            edges = np.cumsum([0, *map(len, found["next"])])
            for i, counts in enumerate(found.pop("counts")):
                p = model.root(counts[np.unique(found["next"][i], return_inverse=True)[1]])
                p[found["depth"][i] > 0] = found["p"][i]
                found["p"][i] = p
            whole = {x: np.concatenate(found.pop(x)) for x in list(found)}
            p = subtree([whole.pop(w) for w in words], *(whole.pop(x) for x in ("next", "learned", "p", "depth"))).astype("<f4")
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([r["chunk"] for r in group], pa.int32()),
                    "owner": pa.array([owner] * len(group), pa.int32()),
                    "p": pa.array([pack(p[a:b]) for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                }
            )

    names = [name for name, _ in chunks]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"]):
            chunk = Chunk(folder, names[number], model)
            ids, use = load(folder, chunk.name, "ids", "<i8"), load(folder, chunk.name, "use", "u1")
            known, base, score = chunk.scores(owners, np.concatenate([unpack(r["p"], "<f4") for r in rows]).astype(float))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=ids == NO_ID),
                    pa.array(use == 0),
                    pa.array(chunk.lengths, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(np.full(len(ids), model.tokens), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(score, pa.float64()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    binary = ", ".join(f"{x} binary" for x in columns)
    sent = chunk_rows(spark, chunks).mapInArrow(send, f"owner int, chunk int, {binary}")
    answered = (
        sent.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", "chunk").mapInArrow(answer, "chunk int, owner int, p binary")
    )
    # A chunk that sent nothing is to be scored too.
    every = chunk_rows(spark, chunks).select("chunk", F.lit(-1).alias("owner"), F.lit(b"").alias("p"))
    gathered = answered.unionByName(every).repartitionById(len(chunks), F.col("chunk"))
    return gathered.sortWithinPartitions("chunk", "owner").mapInArrow(total, schema)


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, large: int = LARGE
) -> DataFrame:
    """One row per document: its words, how many are known, the base score and the model's."""
    bound_batches(docs.sparkSession)
    spark, mark = docs.sparkSession, scratch_mark()
    folder = scratch_path(spark, "suffix-tree")
    ready = docs.select(
        F.col(doc_id).cast("long").alias("id"), learning(F.col(doc_id)).alias("learns"), text_or_empty(text).alias("text")
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    chunks = write_chunks(ready, folder)
    if not chunks:
        release(spark, mark)
        return spark.createDataFrame([], schema)
    with freed_shuffles(spark):
        model = learn(spark, folder, chunks, depth, large)
    return finish(score_chunks(spark, folder, chunks, model, schema), "scores", mark)
