"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of a bigram, a unigram and a
uniform part,

    p(w | v) = a_b c(vw) / c(v) + u_b c(w) / N + z_b / (V + 1),

with weights for each bucket b of the context's frequency c(v) (powers of two).
The weights are learned by expectation-maximisation on held-out documents (one
training fold): their events are counted by bucket and by the size of the two
estimates that the other training documents give, and that table, whose size is
fixed, is what EM iterates over. Counts cover all training documents.

How the counts meet the texts: documents are dealt by hash into chunks of about
``chunk_chars`` characters. A chunk lists its distinct grams with their counts
once, dealt by hash over ``buckets``; a bucket adds up the lists of all chunks
and answers each list with the corpus counts, in the list's order; a chunk's
answers come back to its documents, which are then scored. Frequent words are
one entry per chunk, so no task sees a hot key, and no table of all grams is
ever held by one task or the driver. The grams exchanged grow with the corpus; the
rows that carry them are at most one for each chunk and bucket that have a gram in
common, and never more than the distinct grams of all chunks.

Tokens are identified by 64-bit hashes (bigrams by 48 bits within their bucket).

Defined cases: null or blank text is the end token alone; a word not seen in
training has c = 0; no training documents -> N = V = 0, base score 0; no
held-out documents -> default weights; repeated rows are counted and scored each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import materialize

TRAIN, HELD, OTHER = 0, 1, 2  # counted; counted and used for the weights; only scored
END, START = np.uint64(1), np.uint64(2)
CONTEXT_BUCKETS = 40
GRID = 48  # cells of the held-out table per estimate
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class Chunk:
    """The documents of a chunk as indices into its distinct words."""

    def __init__(self, raw_texts):
        import xxhash

        index: dict[bytes, int] = {}
        ids, self.lengths = array("i"), []
        for raw in raw_texts:
            words = (raw or b"").lower().split()
            self.lengths.append(len(words) + 1)
            ids.append(1)
            ids.extend([index.setdefault(w, len(index) + 2) for w in words])
            ids.append(0)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in index), dtype=np.uint64, count=len(index))
        self.hashes = np.concatenate([np.array([END, START]), np.where(hashes < 3, hashes + np.uint64(3), hashes)])
        self.ids = np.frombuffer(ids, dtype=np.int32).astype(np.int64)
        inside = self.ids[1:] != 1  # a pair does not cross into the next document
        self.left, self.right = self.ids[:-1][inside], self.ids[1:][inside]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        pairs, self.pair = np.unique(self.left * len(self.hashes) + self.right, return_inverse=True)
        self.pair_count = np.bincount(self.pair, minlength=len(pairs))
        v, w = pairs // len(self.hashes), pairs % len(self.hashes)
        self.pair_hash = _mix(self.hashes[v] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[w])
        self.word_count = np.bincount(self.ids, minlength=len(self.hashes))

    def dealt(self, buckets: int):
        """For every bucket: positions of its words and of its pairs, by hash."""
        out = []
        for h in (_mix(self.hashes), self.pair_hash):
            b = (h >> np.uint64(32)).astype(np.int64) % buckets
            order = np.lexsort((h, b))
            out.append(np.split(order, np.searchsorted(b[order], np.arange(1, buckets))))
        return list(zip(range(buckets), *out))


def _short(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _pack(counts: np.ndarray) -> bytes:
    small = counts.astype("<u8")
    width = 1 if not len(small) or small.max() < 256 else 8
    return bytes([width]) + small.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()),
                  ("word_n", pa.binary()), ("pairs", pa.binary()), ("pair_n", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.binary()),
                     ("pairs", pa.binary()), ("train_words", pa.binary()), ("train_pairs", pa.binary()),
                     ("n", pa.int64()), ("v", pa.int64()), ("train_n", pa.int64()), ("train_v", pa.int64())])
_ASK_SQL = "bucket int, chunk long, part int, words binary, word_n binary, pairs binary, pair_n binary"
_ANSWER_SQL = ("bucket int, chunk long, part int, words binary, pairs binary, train_words binary, train_pairs binary, "
               "n long, v long, train_n long, train_v long")


def _asker(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        part, chunk = table["part"][0].as_py(), table["chunk"][0].as_py()
        c = Chunk(table["raw"].to_pylist())
        return _batch([{"bucket": b, "chunk": chunk, "part": part, "words": c.hashes[w].astype("<u8").tobytes(),
                        "word_n": _pack(c.word_count[w]), "pairs": _short(c.pair_hash[p]),
                        "pair_n": _pack(c.pair_count[p])} for b, w, p in c.dealt(buckets) if len(w) or len(p)], _ASK)
    return ask


def _totals(lists: list[np.ndarray], counts: list[np.ndarray], parts: list[int]):
    """(distinct hashes, for each list the places of its hashes, count in the
    fitted documents, count in all training documents)."""
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    part = np.repeat(parts, [len(x) for x in lists])
    n = np.concatenate(counts)
    fit = np.bincount(place, weights=n * (part == TRAIN), minlength=len(distinct)).astype(np.int64)
    every = np.bincount(place, weights=n * (part != OTHER), minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(x) for x in lists])[:-1]
    return distinct, np.split(place, ends), fit, every


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    parts = [r["part"] for r in rows]
    uw, pw, fit_w, all_w = _totals([np.frombuffer(r["words"], dtype="<u8") for r in rows],
                                   [_unpack(r["word_n"]) for r in rows], parts)
    _, pp, fit_p, all_p = _totals([_long(r["pairs"]) for r in rows], [_unpack(r["pair_n"]) for r in rows], parts)
    token = uw != START
    out = []
    for i, r in enumerate(rows):
        held = r["part"] == HELD
        first = i == 0  # the bucket's totals travel with one row
        out.append({"bucket": r["bucket"], "chunk": r["chunk"], "part": r["part"],
                    "words": _pack(all_w[pw[i]]), "pairs": _pack(all_p[pp[i]]),
                    "train_words": _pack(fit_w[pw[i]]) if held else None,
                    "train_pairs": _pack(fit_p[pp[i]]) if held else None,
                    "n": int(all_w[token].sum()) if first else 0, "v": int((all_w[token] > 0).sum()) if first else 0,
                    "train_n": int(fit_w[token].sum()) if first else 0,
                    "train_v": int((fit_w[token] > 0).sum()) if first else 0})
    return _batch(out, _ANSWER)


def _placed(c: Chunk, answers: list[dict], buckets: int, words: str, pairs: str) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the chunk's words and pairs from its answers."""
    by = {a["bucket"]: a for a in answers}
    cw, cp = np.zeros(len(c.hashes), np.int64), np.zeros(len(c.pair_hash), np.int64)
    for b, w, p in c.dealt(buckets):
        if not len(w) and not len(p):
            continue  # not asked
        got_w, got_p = _unpack(by[b][words]), _unpack(by[b][pairs])
        if len(got_w) != len(w) or len(got_p) != len(p):
            raise RuntimeError("a chunk's documents changed between two reads of the input")
        cw[w], cp[p] = got_w, got_p
    return cw, cp


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(CONTEXT_BUCKETS - 1, 1 + np.log2(np.maximum(1, count)).astype(np.int64)), 0)


def _cell(x: np.ndarray) -> np.ndarray:
    """0 for 0, else 1..GRID-1 by the logarithm of the estimate."""
    return np.where(x > 0, np.clip(GRID - 1 + 2 * np.log2(np.maximum(x, 1e-12)), 1, GRID - 1).astype(np.int64), 0)


def _held_table(buckets: int, n: int):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(docs["raw"].to_pylist())
        cw, cp = _placed(c, answers.to_pylist(), buckets, "train_words", "train_pairs")
        context = cw[c.left]
        f2 = np.divide(cp[c.pair], context, out=np.zeros(len(c.left)), where=context > 0)
        f1 = cw[c.right] / max(1, n)
        cell = (context_bucket(context) * GRID + _cell(f2)) * GRID + _cell(f1)
        cells, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": pa.array(cells), "n": pa.array(np.bincount(at).astype(float)),
                         "f2": pa.array(np.bincount(at, weights=f2)), "f1": pa.array(np.bincount(at, weights=f1))})
    return run


def em_weights(table, v: int, rounds: int = 60) -> np.ndarray:
    """(bucket, [bigram, unigram, uniform]) weights from the held-out table, a
    pandas frame (cell, n, sums of f2 and f1)."""
    out = np.tile(np.array([0.5, 0.4, 0.1]), (CONTEXT_BUCKETS, 1))
    if not len(table):
        return out
    b = (table["cell"].to_numpy() // (GRID * GRID)).astype(int)
    n = table["n"].to_numpy()
    est = np.stack([table["f2"].to_numpy() / n, table["f1"].to_numpy() / n, np.full(len(n), 1 / (v + 1))], axis=1)
    everywhere = out[0]
    for own in (np.zeros(len(b), dtype=int), b):  # first one set for all contexts: the start and prior of each bucket's
        lam = np.tile(everywhere, (CONTEXT_BUCKETS, 1))
        for _ in range(rounds):
            share = lam[own] * est
            share *= (n / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(own, weights=share[:, k], minlength=CONTEXT_BUCKETS) for k in range(3)], axis=1)
            total += everywhere + 1e-6
            lam = total / total.sum(axis=1, keepdims=True)
        everywhere = lam[0] if own is not b else everywhere
    return lam


def _scorer(buckets: int, n: int, v: int, lam: np.ndarray):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(docs["raw"].to_pylist())
        cw, cp = _placed(c, answers.to_pylist(), buckets, "words", "pairs")
        context, right = cw[c.left], cw[c.right]
        f2 = np.divide(cp[c.pair], context, out=np.zeros(len(c.left)), where=context > 0)
        w = lam[context_bucket(context)]
        p = w[:, 0] * f2 + w[:, 1] * right / max(1, n) + w[:, 2] / (v + 1)
        base = np.log10((right + 1) / (n + v + 1))
        size = len(c.lengths)
        return pa.table({
            "doc_id": docs["doc_id"].combine_chunks(), "n_tokens": pa.array(np.array(c.lengths, dtype=np.int64)),
            "n_known": pa.array(np.bincount(c.doc, weights=right > 0, minlength=size).astype(np.int64)),
            "base_score": pa.array(np.bincount(c.doc, weights=base, minlength=size)),
            "score": pa.array(np.bincount(c.doc, weights=np.log10(p), minlength=size))})
    return run


def score(df: DataFrame, part: Column, chunk_chars: int = 3_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every
    row of ``df`` (doc_id, text). ``part``: TRAIN, HELD or OTHER of each row."""
    rows = df.select("doc_id", F.col("text").cast("binary").alias("raw"), part.cast("int").alias("part"))
    sizes = {r["part"]: r["chars"] or 0 for r in
             rows.groupBy("part").agg(F.sum(F.octet_length("raw")).alias("chars")).collect()}  # three rows
    chunks = F.create_map(*[F.lit(x) for p in (TRAIN, HELD, OTHER)
                            for x in (p, max(1, math.ceil(sizes.get(p, 0) / chunk_chars)))])
    rows = rows.withColumn("chunk", F.col("part") * F.lit(1 << 40)
                           + F.pmod(F.xxhash64("doc_id", "raw"), chunks[F.col("part")]))
    buckets = max(1, math.ceil(sum(sizes.values()) / (4 * chunk_chars)))
    # a chunk or a few, or a bucket or a few, a task: what it holds does not grow with the input
    tasks = max(1, math.ceil(sum(sizes.values()) / chunk_chars))
    rows = rows.repartition(tasks, "chunk")
    asked = rows.groupBy("chunk").applyInArrow(_asker(buckets), _ASK_SQL).repartition(2 * buckets, "bucket")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER_SQL), "lm-answers")
    total = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "train_n", "train_v")]).first()
    reply = answers.drop("n", "v", "train_n", "train_v").repartition(tasks, "chunk")
    held = (rows.filter(F.col("part") == HELD).groupBy("chunk")
            .cogroup(reply.filter(F.col("part") == HELD).groupBy("chunk"))
            .applyInArrow(_held_table(buckets, total["train_n"]), "cell long, n double, f2 double, f1 double")
            .groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "f2", "f1")]))
    table = held.toPandas().sort_values("cell")  # at most CONTEXT_BUCKETS * GRID * GRID rows
    lam = em_weights(table, total["train_v"]) if total["n"] else np.tile([0.0, 0.0, 1.0], (CONTEXT_BUCKETS, 1))
    ids = df.schema["doc_id"].dataType.simpleString()
    return (rows.groupBy("chunk").cogroup(reply.drop("train_words", "train_pairs").groupBy("chunk"))
            .applyInArrow(_scorer(buckets, total["n"], total["v"], lam),
                          f"doc_id {ids}, n_tokens long, n_known long, base_score double, score double")
            .withColumn("train_tokens", F.lit(total["n"]).cast("long")))
