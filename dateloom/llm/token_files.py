"""Token ids as flat unsigned-integer files with 64-bit document offsets, in ascending document order.

A range partition by document id gives each task one run of documents. The task
appends ids to ``<name>.ids`` (little-endian; 16 bits if the vocabulary fits, else
32), document starts within the file to ``<name>.off`` (one more than documents)
and document ids to ``<name>.doc`` (both 64 bits). File names are new for each
attempt; the manifest lists those of the attempts that succeeded, with the base
of each file from prefix sums over the token counts. Readers map the files.

Encoding goes through a per-process cache of pieces: a word with the space before
it, a mark that ends it, or a line feed. Pre-tokens of a byte-level vocabulary never
reach past a lone white-space character, nor from a letter to a mark, so a piece
encodes alike wherever it stands; texts with runs of white space, or with a special
token written out (which the tokenizer reads as that token), are encoded whole.
New words of letters go straight to the tokenizer's model, if that gives what the whole
tokenizer gives for some words tried at the start.

Edge cases: a null or empty text has the end id alone; a null id comes first and
is stored as the smallest 64-bit integer; ids may repeat; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import bound_batches, scratch_path, text_or_empty
from dateloom.llm.files import open_fs, read_array, write_bytes

#: Pieces that a process keeps encoded.
CACHED_PIECES = 1_200_000
NO_ID = -(2**63)
MANIFEST = "part long, name string, docs long, tokens long, base long"
#: White space other than the plain space and the line feed; a full stop or comma after something other than a letter or digit.
_OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ODD_MARK = re.compile(r"[.,](?<=[\W_][.,])")


#: Byte-level vocabularies write each byte as a letter: printable ones of Latin-1 as they are, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def bytes_as_letters(word: str) -> str:
    if word.isascii():
        return word.replace(" ", "\u0120")
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_AS_LETTERS)


def pieces_of(text: str) -> list[str] | None:
    """A text cut where no pre-token reaches across; None if white space stands in runs, which takes the whole text to read."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or any(c in text for c in _OTHER_BLANKS):
        return None
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0") + "\0"
    if not _ODD_MARK.search(text):
        cut = cut.replace(".\0", "\0.\0").replace(",\0", "\0,\0")
    return cut.split("\0")


class PieceEncoder:
    """Encodes texts with one tokenizer file, piece by piece."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 2**16
        self.dtype, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.known: dict[str, bytes] = {"": b""}
        tried = [" the", "Hello", " naïve", " Größenordnung", "x", " antidisestablishmentarianism", " слово", "日本"]
        self.direct = self.by_model(tried) == self.encode(tried)

    def encode(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_model(self, words: list[str]) -> list[bytes]:
        """As ``encode`` for words of letters, each one pre-token, where the model reads bytes as letters."""
        code, tokenize = self.code, self.tokenizer.model.tokenize
        return [array(code, [t.id for t in tokenize(bytes_as_letters(w))]).tobytes() for w in words]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are new."""
        if len(self.known) > CACHED_PIECES:
            self.known = {"": b""}
        missing = pieces - self.known.keys()
        words = [x for x in missing if x.removeprefix(" ").isalpha()]
        self.known.update(zip(words, self.by_model(words) if self.direct else self.encode(words), strict=True))
        others = list(missing.difference(words))
        self.known.update(zip(others, self.encode(others), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [None if any(x in t for x in self.special) else pieces_of(t) for t in texts]
        self.learn(set(chain.from_iterable(s for s in split if s)))
        whole = iter(self.encode([t for t, s in zip(texts, split, strict=True) if s is None]))
        of = self.known.__getitem__
        return [next(whole) if s is None else b"".join(map(of, s)) for s in split]


@cache
def encoder(tokenizer_file: str) -> PieceEncoder:
    return PieceEncoder(tokenizer_file)


def write_token_files(
    docs: DataFrame,
    tokenizer_file: str,
    folder: str,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    texts_at_once: int = 500,
) -> list[tuple[int, str, int, int, int]]:
    """Write the files of all documents; returns the manifest's rows (part, name, docs, tokens, base)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        width = np.dtype(encode.dtype).itemsize
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:08d}-{uuid.uuid4().hex[:8]}"
        docs_written, at = 0, 0
        with (
            fs.open_output_stream(f"{path}/{name}.ids") as ids,
            fs.open_output_stream(f"{path}/{name}.off") as offsets,
            fs.open_output_stream(f"{path}/{name}.doc") as keys,
        ):
            offsets.write(np.array([0], "<i8").tobytes())
            for batch in batches:
                for lo in range(0, batch.num_rows, texts_at_once):
                    some = batch.slice(lo, texts_at_once)
                    found = encode(some.column(1).to_pylist())
                    lengths = np.array([len(x) // width + 1 for x in found], "<i8")
                    ids.write(b"".join(chain.from_iterable((x, end) for x in found)))
                    offsets.write((at + np.cumsum(lengths)).astype("<i8").tobytes())
                    keys.write(np.asarray(some.column(0).fill_null(NO_ID), "<i8").tobytes())
                    at += int(lengths.sum())
                    docs_written += some.num_rows
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "docs": [docs_written], "tokens": [at]},
            schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
        )

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id")
    )
    rows = sorted(ordered.mapInArrow(write, "part long, name string, docs long, tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([r.tokens for r in rows], dtype=np.int64)])
    manifest = [(r.part, r.name, r.docs, r.tokens, int(b)) for r, b in zip(rows, bases, strict=False)]
    drop_strays(folder, {m[1] for m in manifest})
    width = encoder(tokenizer_file).dtype
    write_bytes(f"{folder}/manifest.json", json.dumps({"dtype": width, "end_id": end_id, "files": manifest}).encode())
    return manifest


def drop_strays(folder: str, names: set[str]) -> None:
    """Delete what failed or repeated attempts have left."""
    import pyarrow.fs as pafs

    fs, path = open_fs(folder)
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.base_name.partition(".")[0] not in names:
            fs.delete_file(info.path)


def read_token_files(docs: DataFrame, folder: str, manifest: list[tuple], dtype: str, docs_at_once: int = 4_096) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{folder}/{row['name']}"
                ids, offsets, keys = read_array(f"{stem}.ids", dtype), read_array(f"{stem}.off", "<i8"), read_array(f"{stem}.doc", "<i8")
                for lo in range(0, len(keys), docs_at_once):
                    edge = np.asarray(offsets[lo : lo + docs_at_once + 1])
                    wide = np.asarray(ids[edge[0] : edge[-1]]).astype("<u4")
                    at = edge - edge[0]
                    doc = np.asarray(keys[lo : lo + docs_at_once])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc, pa.int64(), mask=doc == NO_ID),
                            pa.array(edge[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(edge), pa.int64()),
                            pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = docs.sparkSession.createDataFrame([m for m in manifest if m[2]], MANIFEST)
    return files.repartition(max(1, len(manifest))).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read them back as one row per document."""
    bound_batches(docs.sparkSession)
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, tokenizer_file, folder, end_id)
    return read_token_files(docs, folder, manifest, encoder(tokenizer_file).dtype)
