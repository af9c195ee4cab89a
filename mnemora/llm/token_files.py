"""Token ids as flat binary files.

A data set is a folder with a part for each partition of the writer, in ascending order of document ids:

    part-00000-<name>.bin   token ids, unsigned little-endian, 16 bits if the vocabulary fits, else 32
    part-00000-<name>.idx   int64: documents, those of them with a null id; the ids of the documents; the offset of
                            each in the .bin, in ids, and the end
    base.json               for each part its name, its documents and ids, and the sums of those before it

The place of a document in the whole is its part's base plus its offset; a reader maps the files into memory, or reads
stretches of them where the store is not mounted. Every attempt of a task writes files of its own name, and base.json,
written last, names those of the attempt that Spark took: nothing is renamed or overwritten, so tasks may run again, or
twice, on any store.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

PARTS = "part int, documents long, ids long, name string"
#: Documents that a reader holds at once.
READ_ROWS = 4096


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(store: fs.FileSystem, path: str, *data: bytes) -> None:
    with store.open_output_stream(path) as out:
        for d in data:
            out.write(d)


def write_token_files(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int, vocabulary: int, folder: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[tuple[int, int, int]]:
    """Writes the ids of every whole text of docs, end_id after each, and returns (part, documents, ids).

    encode() makes, in each task, the function from texts to arrays of ids. Rows go to parts by ranges of ids, rows
    with the same id by the hash of their text; null ids come first; equal rows follow each other, in one part. Null
    texts count as empty and have the end id alone; very long texts are encoded whole. An empty table gives a data set
    of no documents; columns besides id and text are not read. A part's ids are held in memory until they are written,
    so `parts` (spark.sql.shuffle.partitions) sets the memory of a task.
    """
    spark = docs.sparkSession
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.repartitionByRange(parts or partitions(spark), "id", "key").sortWithinPartitions("id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, ids, nulls, sizes, data = encode(), [], 0, [], []
        for b in batches:
            nulls += b["id"].null_count
            ids.append(b["id"].fill_null(0).to_numpy())
            for x in code(b["text"].to_pylist()):
                sizes.append(len(x) + 1)
                data.append(np.append(x, end_id).astype(kind).tobytes())
        if sizes:
            part = TaskContext.get().partitionId()
            own, at = _store(folder)
            name = f"part-{part:05d}-{uuid.uuid4().hex}"
            head = np.array([len(sizes), nulls], np.int64)
            offsets = np.cumsum([0, *sizes], dtype=np.int64)
            _put(own, f"{at}/{name}.bin", *data)
            _put(own, f"{at}/{name}.idx", np.concatenate([head, *ids, offsets]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([name])], ["part", "documents", "ids", "name"])

    made = sorted(tuple(r) for r in d.mapInArrow(run, PARTS).collect())  # a row for each part
    bases = list(accumulate((k for _, _, k, _ in made), initial=0))
    rows = list(accumulate((n for _, n, _, _ in made), initial=0))
    meta = {"dtype": np.dtype(kind).name, "parts": [{"part": p, "name": name, "documents": n, "ids": k, "document_base": r, "id_base": b} for (p, n, k, name), r, b in zip(made, rows, bases)]}
    _put(store, f"{root}/base.json", json.dumps(meta).encode())
    return [(p, n, k) for p, n, k, _ in made]


class TokenFiles:
    """Reads a data set. Files in a local or mounted folder are mapped into memory, others are read."""

    def __init__(self, folder: str):
        self.store, self.root = _store(folder)
        with self.store.open_input_stream(f"{self.root}/base.json") as f:
            meta = json.loads(f.read())
        self.dtype, self.parts = np.dtype(meta["dtype"]), meta["parts"]

    def _reader(self, name: str, dtype: np.dtype) -> Callable[[int, int], np.ndarray]:
        """From two places in a file, counted in numbers, to the numbers between them."""
        path = f"{self.root}/{name}"
        if isinstance(self.store, fs.LocalFileSystem):
            whole = np.memmap(path, dtype, "r")
            return lambda a, b: whole[a:b]
        file = self.store.open_input_file(path)
        return lambda a, b: np.frombuffer(file.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)

    def documents(self, part: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the whole data set, token ids) of each document of a part, in order."""
        entry = next(p for p in self.parts if p["part"] == part)
        index, data = self._reader(f"{entry['name']}.idx", np.dtype("<i8")), self._reader(f"{entry['name']}.bin", self.dtype)
        n, nulls = map(int, index(0, 2))
        for s in range(0, n, READ_ROWS):
            e = min(s + READ_ROWS, n)
            ids, offsets = index(2 + s, 2 + e), index(2 + n + s, 3 + n + e)
            tokens = data(int(offsets[0]), int(offsets[-1]))
            for k in range(e - s):
                yield (None if s + k < nulls else int(ids[k])), entry["id_base"] + int(offsets[k]), tokens[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]]


def read_token_files(spark, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of a data set, read from its files.

    start: the ids of all documents before it; n_tokens: its own, the end included; ids_crc32: unsigned CRC-32 of
    the ids as little-endian unsigned 32-bit integers.
    """
    parts = [(p["part"],) for p in TokenFiles(folder).parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles(folder)
        for b in batches:
            for part in b["part"].to_pylist():
                rows = ((i, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, s, x in files.documents(part))
                while found := list(islice(rows, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(parts, "part int").repartition(max(1, len(parts)))
    return frame.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def _byte_letters() -> list[str]:
    """The letter by which a byte-level model writes each byte: printable ones themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


_LETTERS = _byte_letters()
#: Letters that the model's normaliser leaves whole and lower-cases one by one, then punctuation that it never joins
#: to them. All other words go through the library's whole chain.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,]*)")


def _packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers; an array costs less than numpy's for a few."""
    return array("I", ids).tobytes()


class WordTokenizer:
    """Encodes texts with a tokenizers-library model that never joins across ASCII white space.

    Texts are cut at ASCII white space. A word's ids are the library's and are kept for the next time that it comes,
    as are those of plain words without their case and punctuation; a memory that has `most` words is emptied
    and filled anew, and words of more than `longest` bytes are not kept.
    """

    def __init__(self, path: str, most: int = 300_000, most_plain: int = 900_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.most, self.most_plain, self.longest = most, most_plain, longest

    def _chain(self, words: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, letters: str) -> bytes:
        found = self.plain.get(letters)
        if found is None:
            name = letters if letters.isascii() else "".join(map(_LETTERS.__getitem__, letters.encode()))
            found = _packed([t.id for t in self.model.tokenize(name)])
            if len(letters) <= self.longest:
                if len(self.plain) >= self.most_plain:
                    self.plain.clear()
                self.plain[letters] = found
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, rest, plain = {}, [], self.plain.get
        for w in words:
            letters = w.rstrip(b".,")
            if letters.isalpha():  # of bytes: ASCII letters alone, most of all words
                marks, letters = w[len(letters) :].decode(), letters.lower().decode()
            elif m := PLAIN.fullmatch(w.decode()):
                letters, marks = m[1].lower(), m[2]
            else:
                rest.append(w)
                continue
            found = plain(letters) or self._plain(letters)
            out[w] = found + (plain(marks) or self.plain.setdefault(marks, self._chain([marks])[0])) if marks else found
        out.update(zip(rest, self._chain([w.decode() for w in rest])))
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode().split() for t in texts]
        out: list[np.ndarray] = []
        for s in range(0, len(split), 256):
            group = split[s : s + 256]
            if len(self.known) > self.most:
                self.known.clear()
            new = self._learn(list(set().union(*group).difference(self.known)))
            self.known |= new
            out += [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32) for words in group]
            for w in new:
                if len(w) > self.longest:
                    del self.known[w]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> Callable[[], WordTokenizer]:
    """For write_token_files: one tokenizer for each worker process."""

    def make() -> WordTokenizer:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        return _TOKENIZERS[path]

    return make
