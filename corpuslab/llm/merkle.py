"""A Merkle manifest of a dataset: one leaf a row, one tree a source, one tree
over the sources' roots, and an inclusion witness for every row.

Every node is the SHA-256 (lowercase hex) of its children's digests as hex text;
``arity`` consecutive nodes make one parent, a last run may be shorter (even one
node), until one node is left.

Witnesses are built by incremental append. A block is an aligned run of
arity^height nodes, read as a stream in order; complete subtrees that still wait
for siblings are held open, each with the partial witnesses of its members, and
whenever the last sibling of a run arrives (or the stream ends) the run becomes
one subtree and every member's witness is extended by its siblings to the left
and right. A block yields its root. Block roots are further appends to the same
tree: they form blocks of the next round, until each source has one node, and the
sources' roots are appended the same way to the tree on top. Going down again,
every block receives the witness of its own root, which its members' witnesses
go on with. Only digests are shuffled, never texts; a task holds one block.

A witness is an array of (left, right): per level the siblings' digests, joined,
on both sides. ``folded`` recomputes the root from a leaf and its witness.

Plan: one map pass over the texts gives narrow leaf rows; they are range-sorted
by (source, id, leaf) into the checkpoint folder, numbered per part, and dealt
to (source, block) groups. A source with a third of all rows is many ranges and
many blocks.

Defined cases: null columns count as ``-``; a null id sorts first; rows with
equal ids are ordered by their leaves, rows equal in every column are leaves
each; a null source is a source of its own before all others; a source of one
row has its leaf as subroot; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm.common import materialize, plain_names

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"
ROOTS = "struct<root:string,subroot:string>"
STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`"))) for c in FIELDS]), 256)


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, start, lambda h, w: F.sha2(F.concat(w["left"], h, w["right"]), 256))


def siblings(witness: Column) -> Column:
    """All siblings' digests of a witness, left to right, level by level."""
    return F.concat_ws("", F.transform(witness, lambda w: F.concat(w["left"], w["right"])))


# ---- appending to one block --------------------------------------------------

class OpenTree:
    """A tree that grows by appends, with the witnesses of all members so far.

    ``open[h]`` holds the subtrees of height h that wait for siblings, as
    (digest, first member, end)."""

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(height + 1)]
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self.open[0].append((digest, at, at + 1))
        h = 0
        while h < self.height and len(self.open[h]) == self.arity:
            self._complete(h)
            h += 1

    def _complete(self, h: int) -> None:
        """The open subtrees of height h become one; their members learn their siblings."""
        run = self.open[h]
        digests = [d for d, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            step = ("".join(digests[:i]), "".join(digests[i + 1:]))
            for m in range(first, end):
                self.witness[m].append(step)
        parent = hashlib.sha256("".join(digests).encode()).hexdigest()
        self.open[h + 1].append((parent, run[0][1], run[-1][2]))
        self.open[h] = []

    def finish(self) -> str:
        """The root, once no more appends come."""
        for h in range(self.height):
            if self.open[h]:
                self._complete(h)
        return self.open[self.height][0][0]


def block_height(n: int, arity: int, height: int) -> int:
    """Levels that a block of a tree over n nodes rises: all of the tree, if one
    block holds it."""
    h = 0
    while h < height and n > 1:
        n, h = -(-n // arity), h + 1
    return h


# rows of a block table: g (group), block, pos (-1: what comes from above, the
# roots and the witness of the block's own root), n (nodes of the group), digest,
# roots, steps, payload
def _blocks(arity: int, height: int, attach: bool):
    """Arrow function over rows sorted by (g, block, pos). Without ``attach``:
    one row (g, pos, n, digest) a block. With it: (g, digest, roots, steps,
    payload) of every member."""
    def close(key, rows: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(rows)
        roots, top_steps = None, []
        if attach:
            roots, top_steps = t["roots"].slice(0, 1), t["steps"][0].as_py()
            t = t.slice(1)
        n = t["n"][0].as_py()
        tree = OpenTree(arity, block_height(n, arity, height))
        for d in t["digest"].to_pylist():
            tree.append(d)
        root = tree.finish()
        if not attach:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()),
                 pa.array([-(-n // arity ** height)], pa.int64()), pa.array([root], pa.string())], ["g", "pos", "n", "digest"])
        rest = [(s["left"], s["right"]) for s in top_steps]
        steps = [[{"left": a, "right": b} for a, b in own + rest] for own in tree.witness]
        t = t.combine_chunks()
        return pa.table([t["g"], t["digest"], roots.take(pa.array(np.zeros(len(t), np.int64))), pa.array(steps, STEP_TYPE),
                         t["payload"]], names=["g", "digest", "roots", "steps", "payload"]).combine_chunks().to_batches()[0]

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            g, block = b.column("g"), b.column("block").to_numpy()
            names = np.asarray(g.to_pylist(), dtype=object)
            new = np.flatnonzero((block[1:] != block[:-1]) | (names[1:] != names[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                now = (names[lo], int(block[lo]))
                if now != key and held:
                    yield close(key, held)
                    held = []
                key = now
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        if held:
            yield close(key, held)
    return run


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def _climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Tables (g, pos, n, digest) of the nodes that each round appends, the last
    with one node a group."""
    tables = [nodes]
    while not tables[-1].filter("n > 1").isEmpty():
        rows = _dealt(tables[-1].select("g", "pos", "n", "digest"), arity ** height)
        up = (rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
              .mapInArrow(_blocks(arity, height, False), "g string, pos long, n long, digest string"))
        tables.append(materialize(up, "merkle-blocks"))
    return tables


def _descend(tables: list[DataFrame], top: DataFrame, arity: int, height: int) -> DataFrame:
    """(g, digest, roots, steps, payload) of the first table's nodes; ``top``: (g,
    roots, steps) of every group's single node."""
    above = top.select("g", F.lit(0).cast("long").alias("block"), "roots", "steps")
    size = arity ** height
    for nodes in reversed(tables[:-1] or tables):
        with_payload = nodes if "payload" in nodes.columns else nodes.withColumn("payload", F.struct("pos"))
        members = _dealt(with_payload, size).select(
            "g", "block", "pos", "n", "digest", F.lit(None).cast(ROOTS).alias("roots"),
            F.lit(None).cast(STEP).alias("steps"), "payload")
        kind = members.schema["payload"].dataType.simpleString()
        heads = above.select("g", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"),
                             F.lit(None).cast("string").alias("digest"), "roots", "steps", F.lit(None).cast(kind).alias("payload"))
        out = (members.union(heads).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
               .mapInArrow(_blocks(arity, height, True), f"g string, digest string, roots {ROOTS}, steps {STEP}, payload {kind}"))
        if nodes is tables[0]:
            return out
        above = materialize(out.select("g", F.col("payload.pos").alias("block"), "roots", "steps"), "merkle-witnesses")
    raise AssertionError("no nodes")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (g, ...) with pos, the place in its group in the given order, and
    n, the group's size. Rows are range-sorted as a whole; of the parts only
    their counts a group are summed up."""
    cut = (rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
           .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    cut = materialize(cut, "merkle-sorted")
    run = W.partitionBy("g").orderBy("__part")
    offsets = (cut.groupBy("g", "__part").agg(F.count(F.lit(1)).alias("c"), F.min("__at").alias("__first"))
               .withColumn("__off", F.sum("c").over(run) - F.col("c")).withColumn("n", F.sum("c").over(W.partitionBy("g")))
               .drop("c"))
    return (cut.join(offsets, ["g", "__part"])
            .withColumn("pos", F.col("__at") - F.col("__first") + F.col("__off")).drop("__at", "__part", "__first", "__off"))


def _group(source: Column) -> Column:
    """A source as a string that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def manifest(df: DataFrame, arity: int = 3, height: int = 7, **carried: Column) -> DataFrame:
    """doc_id, source, leaf, subroot, root, witness and the ``carried`` columns
    (expressions over ``df``'s fields, for example other leaves) of every row of
    ``df`` (doc_id, source, lang, n_chars, text)."""
    if not 2 <= arity ** height <= 1 << 16:
        raise ValueError("a block holds 2 to 65,536 nodes")
    # written once: the range sort reads its keys twice, the texts are read once
    narrow = materialize(plain_names(df, *FIELDS).select(
        _group(F.col("source").cast("string")).alias("g"), F.col("doc_id").alias("id"), leaf().alias("digest"),
        F.struct("doc_id", "source", *[c.alias(n) for n, c in carried.items()]).alias("payload")), "merkle-leaves")
    leaves = _climb(materialize(_numbered(narrow, "id", "digest"), "merkle-numbered"), arity, height)
    # the tree on top: one group, whose members are the sources' roots in their order
    over = _numbered(leaves[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest",
                                       F.struct(F.col("g").alias("name")).alias("payload")), "name")
    tops = _climb(materialize(over, "merkle-sources"), arity, height)
    root = tops[-1].select("g", F.struct(F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot")).alias("roots"),
                           F.array().cast(STEP).alias("steps"))
    sources = materialize(_descend(tops, root, arity, height).select(
        F.col("payload.name").alias("g"), F.struct(F.col("roots.root").alias("root"), F.col("digest").alias("subroot")).alias("roots"),
        "steps"), "merkle-tops")
    return _descend(leaves, sources, arity, height).select(
        "payload.doc_id", "payload.source", F.col("digest").alias("leaf"), "roots.subroot", "roots.root",
        F.col("steps").alias("witness"), *[F.col(f"payload.{n}").alias(n) for n in carried])


def verify(rows: DataFrame, claimed: str) -> DataFrame:
    """``rows`` of a manifest with folded_root, recomputed from the leaves in
    column ``claimed``, and verified: whether it is the manifest's root."""
    out = rows.withColumn("folded_root", folded(F.col(f"`{claimed}`"), F.col("witness")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
