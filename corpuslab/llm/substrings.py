"""Removal of repeated passages: every window of ``window`` words whose exact
word sequence starts anywhere else is found, and the words it covers go.

Windows are counted by super-k-mer partitioning. A window's minimiser is its
``m``-word sequence with the smallest hash (the first of equals), so equal
windows have equal minimisers at equal places. Consecutive windows that share a
minimiser occurrence travel as one packed string to the minimiser's bucket; a
bucket is read sorted, equal strings are repeated as a whole, and the windows of
different strings are sorted and compared as text. Hashes only choose buckets.

* Documents are dealt into chunks of about ``chunk_bytes`` (one longer document
  is a chunk of its own, worked on in slices): equal strings of a chunk travel
  once, with all their places. Chunks lie compressed in the checkpoint folder,
  texts are read once.
* A packed string holds two bytes for each of the 65,535 words that a bounded
  sample (``SAMPLE_CHUNKS`` chunks) has most often, and any other word as it is.
  The sample changes sizes only: equal words have equal codes, different words
  different ones, so strings and windows are compared without being unpacked.
* First only the minimisers' hashes travel. A string whose minimiser occurs
  nowhere else has no repeated window, so it stays at home.
* A minimiser that more than ``most`` strings share (a frequent phrase in many
  contexts) would be a hot bucket. Its strings go on to a next round with longer
  minimisers, and at last with whole windows, of which equal ones are one string
  a chunk. All windows of a minimiser go together, in all chunks.
* Only (chunk, start, bits) rows come back to the chunks.

Defined cases: words are runs other than ASCII white space, taken as they are;
null, empty and blank texts have none; texts shorter than a window lose nothing;
a null id is an id, repeated rows are documents each (which repeat each other);
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm.common import broadcast_if_short, materialize, plain_names

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_WORDS = 1 << 18
SAMPLE_CHUNKS = 64
OTHER = 0xFFFF          # stands before a word without a code and its length
ROW = "key long, packed binary, chunk long, start int, more array<int>"


# ---- words and super-k-mers ----------------------------------------------------

class Words:
    """The words of documents as codes: ``code`` has word i at
    ends[i - 1]..ends[i], and ``docs[i]`` is its document. A word of the
    vocabulary is two bytes; any other is OTHER, its length and its bytes."""

    def __init__(self, lines: list[list[bytes]], vocabulary: dict[bytes, int]):
        words = [w for line in lines for w in line]
        ids = np.fromiter((vocabulary.get(w, OTHER) for w in words), dtype=np.uint16, count=len(words))
        other = np.flatnonzero(ids == OTHER).tolist()
        size = np.full(len(words), 2, dtype=np.int64)
        for i in other:
            size[i] = 6 + len(words[i])
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = np.zeros(int(ends[-1]), dtype=np.uint8)
        raw[ends[:-1]], raw[ends[:-1] + 1] = ids & 255, ids >> 8
        self.code = raw.tobytes()
        if other:
            code = bytearray(self.code)
            for i in other:
                lo = int(ends[i])
                code[lo + 2:lo + 6 + len(words[i])] = len(words[i]).to_bytes(4, "little") + words[i]
            self.code = bytes(code)
        self._place(ends, np.repeat(np.arange(len(lines)), [len(x) for x in lines]))

    def _place(self, ends: np.ndarray, docs: np.ndarray) -> None:
        self.raw = np.frombuffer(self.code, dtype=np.uint8)
        self.starts, self.ends, self.docs = ends[:-1], ends[1:], docs

    @classmethod
    def of_strings(cls, strings: list[bytes], counts: list[int]) -> Words:
        """Of packed strings of so many words, each a document."""
        self = cls.__new__(cls)
        self.code = b"".join(strings)
        places, before = [np.zeros(1, np.int64)], 0
        for s, n in zip(strings, counts):
            places.append(code_ends(s, n) + before)
            before += len(s)
        self._place(np.concatenate(places), np.repeat(np.arange(len(strings)), counts))
        return self

    def __len__(self) -> int:
        return len(self.starts)


def code_ends(code: bytes, n: int) -> np.ndarray:
    """Ends of the n words of a packed string."""
    if len(code) == 2 * n:
        return np.arange(2, 2 * n + 1, 2)
    ends, at = np.empty(n, np.int64), 0
    for i in range(n):
        at += 6 + int.from_bytes(code[at + 2:at + 6], "little") if code[at] == 255 == code[at + 1] else 2
        ends[i] = at
    return ends


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    def run(x):
        out = np.full(size, x, dtype=np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from sums over prefixes."""
    size = 1 << max(16, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * inverse[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * power[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of h[i:i + width] for every i."""
    value, at, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.where(left, value[:-step], value[step:])
        have += step
    return at


def super_kmers(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key) of every run of windows that share a
    minimiser occurrence. Windows are numbered by their first word and lie
    within one document."""
    out = [[], [], []]
    for lo in range(0, len(words) - window + 1, SLICE_WORDS):
        hi = min(len(words), lo + SLICE_WORDS + window - 1)
        docs = words.docs[lo:hi]
        whole = np.flatnonzero(docs[:hi - lo - window + 1] == docs[window - 1:])
        if not len(whole):
            continue
        base = words.starts[lo]
        h = hashes(words.raw[base:words.ends[hi - 1]], words.starts[lo:hi - m + 1] - base, words.ends[lo + m - 1:hi] - base)
        at = first_minimum(h, window - m + 1)[whole]
        cut = np.flatnonzero(np.diff(at)) + 1
        out[0].append(whole[np.concatenate([[0], cut])] + lo)
        out[1].append(whole[np.concatenate([cut - 1, [len(whole) - 1]])] + lo)
        out[2].append(h[at[np.concatenate([[0], cut])]].view(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def packed_strings(words: Words, first: np.ndarray, last: np.ndarray, window: int) -> list[bytes]:
    """Of every run: the number of its windows (one byte) and its words' codes."""
    lo, hi, n = words.starts[first].tolist(), words.ends[last + window - 1].tolist(), (last - first + 1).tolist()
    return [bytes((k,)) + words.code[a:b] for a, b, k in zip(lo, hi, n)]


# ---- chunks --------------------------------------------------------------------

def chunks(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, ids, words (their number), data: the documents of ``df`` in runs,
    one line each, words joined by blanks, compressed."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3).compress
        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").cast(pa.binary())
            lines, size, lo, n_words = [], 0, 0, 0
            for i in range(b.num_rows):
                text = (texts[i].as_py() or b"").split()
                line = b" ".join(text)
                if lines and size + len(line) > chunk_bytes:
                    yield _chunk((part << 32) + nth, ids.slice(lo, i - lo), n_words, pack(b"\n".join(lines)))
                    lines, size, lo, n_words, nth = [], 0, i, 0, nth + 1
                lines.append(line)
                size += len(line) + 1
                n_words += len(text)
            if lines:
                yield _chunk((part << 32) + nth, ids.slice(lo), n_words, pack(b"\n".join(lines)))
                nth += 1

    return plain_names(df, "doc_id", "text").mapInArrow(run, f"chunk long, ids array<{kind}>, words long, data binary")


def _chunk(chunk: int, ids: pa.Array, n_words: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
         pa.array([n_words], pa.int64()), pa.array([data], pa.binary())], ["chunk", "ids", "words", "data"])


def _unpacked(column) -> Iterator[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    for x in column:
        yield d.decompress(x.as_buffer())


def _lines(data: bytes) -> list[list[bytes]]:
    return [line.split(b" ") if line else [] for line in data.split(b"\n")]


def vocabulary(table: DataFrame) -> list[bytes]:
    """The most frequent words of at most ``SAMPLE_CHUNKS`` chunks, in order."""
    seen: Counter = Counter()
    chosen = [r[0] for r in table.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLE_CHUNKS).collect()]
    for r in table.filter(F.col("chunk").isin(chosen)).select("data").toLocalIterator():
        (data,) = _unpacked([pa.scalar(r["data"], pa.binary())])
        seen.update(data[:1 << 20].split())
    return sorted(w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OTHER])


# ---- strings of all rounds -----------------------------------------------------

def shared_keys(table: DataFrame, window: int, m: int, known: list[bytes], most: int) -> DataFrame:
    """chunk, shared, hot: the keys of a chunk's strings that other strings (of
    this or another chunk) have, at most ``most`` in all or more."""
    def run(batches):
        codes = {w: i for i, w in enumerate(known)}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), _unpacked(b.column("data"))):
                key, n = np.unique(super_kmers(Words(_lines(data), codes), window, m)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), chunk)), pa.array(n)], ["key", "chunk", "n"])

    pairs = table.select("chunk", "data").mapInArrow(run, "key long, chunk long, n long")
    total = F.sum("n").over(W.partitionBy("key"))  # a row a chunk and key
    return (pairs.select("key", "chunk", total.alias("n")).filter("n > 1").groupBy("chunk").agg(
        F.collect_list(F.when(F.col("n") <= most, F.col("key"))).alias("shared"),
        F.collect_list(F.when(F.col("n") > most, F.col("key"))).alias("hot")))


def first_strings(chosen: DataFrame, window: int, m: int, known: list[bytes]) -> DataFrame:
    """The packed strings (``ROW``) of the chunks (chunk, data, keys) that have
    one of the keys, equal strings of a chunk once."""
    def run(batches):
        codes = {w: i for i, w in enumerate(known)}
        for b in batches:
            keys = b.column("keys")
            for at, (chunk, data) in enumerate(zip(b.column("chunk").to_pylist(), _unpacked(b.column("data")))):
                words = Words(_lines(data), codes)
                first, last, key = super_kmers(words, window, m)
                own = np.isin(key, keys[at].values.to_numpy())
                first, last, key = first[own], last[own], key[own]
                places: dict[bytes, list[int]] = {}
                row = []
                for i, (s, f) in enumerate(zip(packed_strings(words, first, last, window), first.tolist())):
                    if s in places:
                        places[s].append(f)
                    else:
                        places[s] = [f]
                        row.append(i)
                yield _rows(key[row], list(places), np.full(len(row), chunk), list(places.values()))

    return chosen.select("chunk", "data", "keys").mapInArrow(run, ROW)


def _rows(key, packed, chunk, starts) -> pa.RecordBatch:
    first = np.fromiter((s[0] for s in starts), dtype=np.int32, count=len(starts))
    more = pa.array([s[1:] if len(s) > 1 else None for s in starts], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(packed, pa.binary()), pa.array(chunk, pa.int64()), pa.array(first), more],
        ["key", "packed", "chunk", "start", "more"])


def next_strings(rows: DataFrame, window: int, m: int) -> DataFrame:
    """``rows`` cut again, by longer minimisers."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                strings = part.column("packed").to_pylist()
                words = Words.of_strings([s[1:] for s in strings], [s[0] + window - 1 for s in strings])
                first, last, key = super_kmers(words, window, m)
                doc = words.docs[first]
                from_start = (first - np.searchsorted(words.docs, doc)).tolist()
                before = [[s, *(r or [])] for s, r in zip(part.column("start").to_pylist(), part.column("more").to_pylist())]
                yield _rows(key, packed_strings(words, first, last, window), part.column("chunk").to_numpy()[doc],
                            [[x + o for x in before[d]] for d, o in zip(doc.tolist(), from_start)])

    return rows.mapInArrow(run, ROW)


# ---- buckets -------------------------------------------------------------------

class Bucket:
    """The strings of one key, as they come sorted; ``found`` gets (chunk, start, bits)."""

    def __init__(self, window: int):
        self.window = window
        self.found: tuple[list, list, list] = ([], [], [])
        self.strings: list[tuple[bytes, int, int]] = []  # packed, chunk, start (-1: marked)

    def _mark(self, chunk: int, starts: list[int], bits: int) -> None:
        self.found[0].extend([chunk] * len(starts))
        self.found[1].extend(starts)
        self.found[2].extend([bits] * len(starts))

    def add(self, packed: bytes, chunk: int, start: int, more: list[int] | None) -> None:
        whole = (1 << packed[0]) - 1
        again = bool(self.strings) and self.strings[-1][0] == packed
        if again and self.strings[-1][2] >= 0:
            _, c, s = self.strings[-1]
            self._mark(c, [s], whole)
            self.strings[-1] = (packed, c, -1)
        if again or more:
            self._mark(chunk, [start, *(more or [])], whole)
        if not again:
            self.strings.append((packed, chunk, -1 if more else start))

    def close(self) -> None:
        """Windows of different strings: sorted, equal neighbours are repeats."""
        if len(self.strings) < 2:
            return
        windows = []
        for i, (packed, _, _) in enumerate(self.strings):
            n = packed[0]
            ends = (code_ends(packed[1:], n + self.window - 1) + 1).tolist()
            lo = 1
            for j in range(n):
                windows.append((packed[lo:ends[j + self.window - 1]], i, j))
                lo = ends[j]
        windows.sort()
        bits = [0] * len(self.strings)
        for (a, i, j), (b, k, l) in zip(windows, windows[1:]):
            if a == b:
                bits[i] |= 1 << j
                bits[k] |= 1 << l
        for (_, chunk, start), own in zip(self.strings, bits):
            if own and start >= 0:
                self._mark(chunk, [start], own)


def repeats(rows: DataFrame, window: int) -> DataFrame:
    """(chunk, start, bits): runs of windows with repeats, bit j for window start + j."""
    def run(batches):
        key_now, bucket = None, Bucket(window)
        for b in batches:
            key = b.column("key").to_numpy()
            if not len(key):
                continue
            lows = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.append(lows, len(key)))
            # a string alone in its bucket, at one place, repeats nothing
            busy = (sizes > 1) | b.column("more").is_valid().to_numpy(zero_copy_only=False)[lows]
            busy[0] = busy[-1] = True  # the bucket may go on in another batch
            columns = [b.column(c) for c in ("packed", "chunk", "start", "more")]
            found = bucket.found
            for lo, size in zip(lows[busy].tolist(), sizes[busy].tolist()):
                k = int(key[lo])
                if k != key_now:
                    bucket.close()
                    key_now, bucket = k, Bucket(window)
                    bucket.found = found
                for r in zip(*(c.slice(lo, size).to_pylist() for c in columns)):
                    bucket.add(*r)
            yield _found(found)
            bucket.found = ([], [], [])
        bucket.close()
        yield _found(bucket.found)

    return rows.repartition("key").sortWithinPartitions("key", "packed").mapInArrow(run, "chunk long, start int, bits long")


def _found(found: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32()),
                                       pa.array(found[2], pa.int64())], ["chunk", "start", "bits"])


# ---- the operator --------------------------------------------------------------

def covered(n: int, starts: np.ndarray, bits: np.ndarray, window: int) -> np.ndarray:
    """Whether each of n words is covered by a marked window."""
    change = np.zeros(n + 1, dtype=np.int64)
    for j in range(window):
        at = starts[(bits >> j) & 1 == 1] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:n]) > 0


def kept(table: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document."""
    kind = table.schema["ids"].dataType.elementType.simpleString()
    per_chunk = marks.groupBy("chunk").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))

    def run(batches):
        for b in batches:
            ids, marks = b.column("ids"), b.column("marks")
            for i, data in enumerate(_unpacked(b.column("data"))):
                own = ids[i].values
                lines = _lines(data)
                lows = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
                found = marks[i].values if marks[i].is_valid else None
                starts, bits = ((np.empty(0, np.int64),) * 2 if found is None else
                                (found.field("start").to_numpy().astype(np.int64), found.field("bits").to_numpy()))
                gone = covered(int(lows[-1]), starts, bits, window)
                removed = np.concatenate([[0], np.cumsum(gone)])[lows]
                for d in np.flatnonzero(np.diff(removed)).tolist():
                    lines[d] = [lines[d][k] for k in np.flatnonzero(~gone[lows[d]:lows[d + 1]]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.diff(lows)), pa.array(np.diff(removed)),
                     pa.array([b" ".join(x) for x in lines], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    return (table.select("chunk", "ids", "data").join(per_chunk, "chunk", "left").select("ids", "data", "marks")
            .mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string"))


def remove_repeats(df: DataFrame, window: int = 35, minimisers: tuple[int, ...] = (6, 20), most: int = 8192,
                   chunk_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by blanks) for
    every row of ``df`` (doc_id, text). ``minimisers``: their lengths in words,
    round by round, before whole windows."""
    if not 1 <= window <= 62:
        raise ValueError("a string's windows are marked by the bits of one long")
    table = materialize(chunks(df, chunk_bytes), "substring-chunks")
    lengths = [m for m in minimisers if m < window] + [window]
    known = vocabulary(table)
    keys = materialize(shared_keys(table, window, lengths[0], known, most), "substring-keys")

    def strings_of(column: str) -> DataFrame:
        some = keys.filter(F.size(column) > 0).select("chunk", F.col(column).alias("keys"))
        return first_strings(table.join(some, "chunk"), window, lengths[0], known)

    settled = [strings_of("shared")]
    strings = strings_of("hot")
    for m in lengths[1:]:
        strings = materialize(strings, "substring-strings")
        if strings.isEmpty():
            break
        strings = next_strings(strings, window, m)
        if m < window:
            strings = materialize(strings, "substring-strings")
            hot = broadcast_if_short(materialize(
                strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"), "substring-hot"))
            settled.append(strings.join(hot, "key", "left_anti"))
            strings = strings.join(hot, "key", "left_semi")
    settled.append(strings)
    marks = materialize(repeats(functools.reduce(DataFrame.union, settled), window), "substring-marks")
    return kept(table, marks, window)
