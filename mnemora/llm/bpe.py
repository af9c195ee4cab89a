"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the pieces are short; the pieces are encoded on their own; neighbours are joined up the
tree by encoding a window round the seam again. The window grows on both sides until it ends where the tokens
outside are proven to stand. White space is the proof, not a comparison of tokens, which could agree by chance: no match of the split pattern goes on from a character that is not white space to one
that is, and the pattern looks at nothing before a match. So a match starts at every white space that follows
another character, in the piece and in the joined text alike, and what lies beyond two such places is the same in
both. Where a piece has no such place, the window takes all of it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Characters of a piece that is encoded directly, and ids of one that is decoded directly.
LEAF, LEAF_IDS = 512, 256
#: Rows of a batch that are held with their ids at once.
ROWS = 512
#: Characters by which a window first reaches over the seam on either side.
WINDOW = 64
#: A white space after another character. Python's white space includes all that the split pattern calls so.
PLACE = re.compile(r"\S[ \t\n\r\f\v]")


class TreeEncoder:
    """encode(text) gives the ids that encode_ordinary of the tiktoken library gives; decode(ids) the bytes."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.base.encode_ordinary(text[start:end])
        seam = (start + end) // 2
        return self._join(text, start, self._tree(text, start, seam), seam, self._tree(text, seam, end), end)

    def _join(self, text: str, start: int, left: list[int], seam: int, right: list[int], end: int) -> list[int]:
        low, high = self._place_before(text, start, seam), self._place_after(text, seam, end)
        kept, size = len(left), len(text[low:seam].encode())
        while size > 0:
            kept -= 1
            size -= len(self.bytes_of[left[kept]])
        dropped, size = 0, len(text[seam:high].encode())
        while size > 0:
            size -= len(self.bytes_of[right[dropped]])
            dropped += 1
        return left[:kept] + self.base.encode_ordinary(text[low:high]) + right[dropped:]

    def _place_before(self, text: str, start: int, seam: int) -> int:
        reach = self.window
        while True:
            low = max(start, seam - reach)
            at = max((m.start() + 1 for m in PLACE.finditer(text, low, seam)), default=start)
            if at > start or low == start:
                return at
            reach *= 2

    def _place_after(self, text: str, seam: int, end: int) -> int:
        reach = self.window
        while True:
            high = min(end, seam + reach)
            if m := PLACE.search(text, seam, high):
                return m.start() + 1
            if high == end:
                return end
            reach *= 2

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens: halves are decoded on their own and joined up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.cache
def encoder(ranks_path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> TreeEncoder:
    """One encoder for each worker process."""
    return TreeEncoder(ranks_path, pattern, leaf, window)


def encode_frame(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row of docs; a null text counts as empty and has no ids.

    Every row gives one row, repeated rows and null ids too; texts are encoded whole, however long; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        for b in (b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS)):
            ids = pa.array([e.encode(t or "") for t in b["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["id"], ids], ["id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_frame(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(id, bytes binary) of every row of (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([e.decode(x) for x in b["ids"].to_pylist()], pa.binary())], ["id", "bytes"])

    kind = encoded.select("id").schema[0].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {kind}, bytes binary")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): every text encoded and its ids decoded, in one pass and no exchange.

    The digest of the ids is of their decimals joined by single spaces; that of the decoded bytes is of the bytes
    that the ids stand for. Nulls, empty and very long texts, repeated rows and an empty table: as encode_frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        decimal: Callable[[int], bytes] = [b"%d" % i for i in range(len(e.bytes_of))].__getitem__
        for b in (b.slice(s, ROWS) for b in batches for s in range(0, b.num_rows, ROWS)):
            n, coded, plain, kept = [], [], [], []
            for t in b["text"].to_pylist():
                ids = e.encode(t or "")
                n.append(len(ids))
                coded.append(_hex(b" ".join(map(decimal, ids))))
                plain.append(_hex(e.decode(ids)))
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [b["id"], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        give_back()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", ids array<int>" if with_ids else ""
    return d.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
