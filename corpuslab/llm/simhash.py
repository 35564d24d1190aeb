"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's fingerprint has 64 bits; two documents are linked when their
fingerprints differ in at most 4. Distinct fingerprints are the unit of work
(exact copies collapse before anything else). A fingerprint is cut into
segments A, B (23 bits each) and C (18 bits). If two fingerprints differ in at
most 4 bits, the pigeonhole principle leaves one of these cases:

* A agrees, or B agrees                       -> key: that segment
* A and B differ in at most 2 bits each       -> key: Golay indices of A and of B
* one of A, B differs in 3 bits, the other in
  1, and C agrees                             -> key: C and the Golay index of the other

so each pair meets under at least one key (about 41 keys a fingerprint), and
every meeting is verified with the bit distance. Keys shared by more than
``block`` fingerprints are dealt into blocks, each pair of blocks being a cell
of its own, so no task holds a whole group. A cell returns a spanning forest of
its verified links (never all its pairs); components of the union follow by
label propagation.

Defined cases: null, empty or blank text has fingerprint 0 and is linked like
any other; fewer than ``shingle`` words make one shingle; repeated rows give
repeated result rows; rows without id take part, and component_id is null only
if a whole component has no id; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import golay
from corpuslab.llm.common import append_columns, materialize, other_columns_aside, plain_names
from corpuslab.llm.graph import connected_components

LOW23 = (1 << 23) - 1
TASK_FPS = 1 << 15  # distinct fingerprints whose keys one task makes


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """64-bit SimHash of the text's word shingles (A-Z lower-cased)."""
    import xxhash

    words = (raw or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                    dtype=np.uint64, count=len(words) - k + 1)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` with a long column ``__fp``; one map pass."""
    def run(texts):
        raw = texts.cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in raw), dtype=np.uint64, count=len(raw))
        return [pa.array(fps.view(np.int64))]

    return append_columns(df, ["text"], {"__fp": T.LongType()}, run)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of every fingerprint (uint64)."""
    a = (fps & np.uint64(LOW23)).astype(np.int64)
    b = ((fps >> np.uint64(23)) & np.uint64(LOW23)).astype(np.int64)
    c = (fps >> np.uint64(46)).astype(np.int64)
    every = np.arange(len(fps))
    at_a, ga = golay.keys(a)
    at_b, gb = golay.keys(b)
    n_b = np.bincount(at_b, minlength=len(fps))
    first_b = np.cumsum(n_b) - n_b
    rep = np.repeat(np.arange(len(at_a)), n_b[at_a])  # each key of A with each key of B
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(n_b[at_a]) - n_b[at_a], n_b[at_a])
    pair = (ga[rep] << 12) | gb[first_b[at_a[rep]] + nth]
    kinds = [(every, a), (every, b), (at_a, (c[at_a] << 12) | ga), (at_b, (c[at_b] << 12) | gb), (at_a[rep], pair)]
    return (np.concatenate([p for p, _ in kinds]),
            np.concatenate([(k << 3) | i for i, (_, k) in enumerate(kinds)]))


def _forest(cell: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell: (fingerprint, smallest fingerprint linked to it
    within the batch) for all rows with a verified link inside their cell."""
    n = len(fps)
    label = np.arange(n)
    live = np.arange(n - 1)
    shift = 1
    while len(live := live[live + shift < n]):
        live = live[cell[live] == cell[live + shift]]
        near = live[np.bitwise_count(fps[live] ^ fps[live + shift]) <= max_bits]
        if len(near):
            _settle(label, near, near + shift)
        shift += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the rows' classes: repeat until both ends of every link agree."""
    while True:
        la, lb = label[a], label[b]
        diff = la != lb
        if not diff.any():
            break
        hi, lo = np.maximum(la[diff], lb[diff]), np.minimum(la[diff], lb[diff])
        np.minimum.at(label, hi, lo)
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def _links(max_bits: int):
    def run(batches):
        held_c, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            c = np.concatenate([held_c, b.column("cell").to_numpy()])
            f = np.concatenate([held_f, b.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(c, c[-1])) if len(c) else 0  # the last cell may go on
            held_c, held_f = c[cut:], f[cut:]
            yield _as_batch(*_forest(c[:cut], f[:cut], max_bits))
        yield _as_batch(*_forest(held_c, held_f, max_bits))
    return run


def _as_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def link_forest(fps: DataFrame, max_bits: int = 4, block: int = 2048) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs of ``fps`` (fp
    long, distinct, written) at most ``max_bits`` <= 4 apart."""
    if max_bits > 4:
        raise ValueError("the keys guarantee pairs of up to 4 differing bits")

    def run(batches):
        for b in batches:
            all_fps = b.column("fp").to_numpy()
            for i in range(0, len(all_fps), 20_000):
                f = all_fps[i:i + 20_000]
                at, key = fuzzy_keys(f.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[at])], ["key", "fp"])

    # about 41 keys each: the tasks follow the number of fingerprints, not their files
    tasks = -(-fps.count() // TASK_FPS) or 1
    keyed = fps.repartition(tasks, "fp").mapInArrow(run, "key long, fp long")
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
                      .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-keys")
    cells = keyed.select(F.col("key").alias("cell"), "fp")
    if not hot.isEmpty():
        joined = keyed.join(hot, "key", "left")
        # every fingerprint of a hot key goes to the cells (own block, other block)
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = (joined.filter("blocks is not null").select("key", "fp", own.alias("x"), other.alias("y"))
                 .select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("cell"), "fp"))
        cells = joined.filter("blocks is null").select(F.col("key").alias("cell"), "fp").union(dealt)
    return (cells.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(_links(max_bits), "a long, b long"))


def classes(df: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, fp), classes (fp, component_id, keeper)) of ``df``; keeper
    is the component's smallest fingerprint among those with the smallest id."""
    rows = materialize(with_fingerprint(plain_names(df, "doc_id", "text"), shingle)
                       .select("doc_id", F.col("__fp").alias("fp")), "fingerprints")
    lowest = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    linked = connected_components(link_forest(lowest.select("fp"), max_bits))
    labelled = lowest.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp"))
    roots = labelled.groupBy("label").agg(first.alias("first")).select(
        "label", F.col("first.low").alias("component_id"), F.col("first.fp").alias("keeper"))
    return rows, labelled.join(roots, "label").select("fp", "component_id", "keeper")


def components(df: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, fingerprint (16 hex
    digits) and component_id, the smallest doc_id reachable over links."""
    rows, cls = classes(df, shingle, max_bits)
    return rows.join(cls, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@other_columns_aside("doc_id", "text")
def keep_one(df: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row
    with the smallest id stays, with all its columns (of rows sharing that id, or
    all without one, a row with the smallest fingerprint; of those one)."""
    _, cls = classes(df, shingle, max_bits)
    # one fingerprint of each component holds the kept row
    cls = materialize(cls.filter("fp = keeper").drop("keeper"), "classes")
    wide = with_fingerprint(df, shingle)
    hit = wide.join(cls.withColumnRenamed("fp", "__fp").withColumnRenamed("component_id", "__low"), "__fp")
    return (hit.filter(F.col("doc_id").eqNullSafe(F.col("__low")))
            .dropDuplicates(["__fp"]).drop("__fp", "__low"))
