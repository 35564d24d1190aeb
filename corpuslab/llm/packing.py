"""Packing documents into training sequences by bounded-space online best-fit.

A document becomes its token ids followed by the end id. Documents longer than
a sequence are cut into full pieces with the shorter piece first; only that
piece, and documents that fit as they are, compete for space. Pieces are dealt
by hash into groups of about ``group_pieces`` (so every task packs a bounded
number, whatever the corpus size) and each group is packed online, in an order
fixed by a hash: a piece goes to the open bin with the least free space that
holds it, found as the lowest set bit of a bitset keyed by free space. At most
``open_bins`` bins are open; when another is needed, the fullest closes first.

Defined cases: null text packs as an empty text (one end id); equal rows are
packed once each; ties are broken by ids, so a rerun gives the same sequences
up to rows that are equal in every column; an empty table gives no rows; other
columns are ignored, whatever their names; a special token's string in a text is
that token's id, as in the tokenizers library by default.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import materialize, plain_names

@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder with the vocabulary of a byte-level BPE file of
    ``tokenizers``; its ids are those that library gives for the same file
    (tested), for special tokens' strings in a text too."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)})
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(texts: list[str], path: str, special: bool = False) -> Iterator[np.ndarray]:
    """uint32 ids of each text. With ``special``, as the tokenizers library does
    by default, a special token's string is that token; without, ordinary text
    (the library's ``encode_special_tokens``)."""
    enc = encoder(path)
    for text in texts:
        yield enc.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for s in range(first, n, capacity):
        yield s, capacity


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; one map pass."""
    schema = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            texts = [t or "" for t in b.column("text").to_pylist()]
            at, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(token_ids(texts, tokenizer, special=True)):
                raw = memoryview(own.tobytes() + end_id.to_bytes(4, "little"))
                for k, (s, n) in enumerate(cut(len(own) + 1, capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s:4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return plain_names(df, "doc_id", "text").mapInArrow(
        run, f"doc_id {schema}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins of one group: a bitset of the free spaces that occur, and the
    bins of each free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.bits ^= 1 << free
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.made
            self.made += 1
            if length < self.capacity:
                if self.open == self.most:
                    self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
                    self.open -= 1
                self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
        elif free != self.capacity:
            self.open -= 1  # filled exactly
        return b, self.capacity - free


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
         open_bins: int = 1024, group_pieces: int = 200_000) -> DataFrame:
    """The pieces of ``df`` (doc_id, text) with sequence_id and offset."""
    cut_up = materialize(pieces(df, tokenizer, capacity, end_id), "pieces")
    groups = max(1, -(-cut_up.filter(F.col("length") < capacity).count() // group_pieces))
    dealt = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    rows = cut_up.withColumn("order", dealt).withColumn("group", F.pmod("order", F.lit(groups)))
    ordered = (rows.repartition(groups, "group")
               .sortWithinPartitions("group", "order", "doc_id", "piece"))

    names = cut_up.columns

    def run(batches):
        group, bins = None, None
        for b in batches:
            seq, off = [], []
            for g, n in zip(b.column("group").to_pylist(), b.column("length").to_pylist()):
                if g != group:
                    group, bins = g, Bins(capacity, open_bins)
                k, o = bins.place(n)
                seq.append((g << 40) | k)
                off.append(o)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.schema.fields)
    return ordered.mapInArrow(run, f"{fields}, sequence_id long, offset long")
