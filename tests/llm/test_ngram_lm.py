import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import ngram_lm as lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("chunk_chars", [500, 6_000_000])
def test_scores_match_brute_force(odd_docs, chunk_chars):
    fold = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4))
    part = F.when(fold == 3, lm.OTHER).when(fold == 2, lm.HELD).otherwise(lm.TRAIN)
    docs = odd_docs
    rows = lm.score(docs, part, chunk_chars).collect()
    data = [(r["doc_id"], r["text"], r["p"]) for r in docs.withColumn("p", part).collect()]
    assert len(rows) == len(data)
    uni, start, pair = Counter(), 0, Counter()
    for _, t, p in data:
        if p != lm.OTHER:
            w = tokens(t)
            uni.update(w)
            start += 1
            pair.update(zip(["start", *w], w))
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for i, t, _ in data:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        want[i, len(w), sum(uni[x] > 0 for x in w), round(base, 6)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)
    assert got == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_model_counts_and_mixture(odd_docs):
    """Interpolated probabilities from brute-force counts and the same weights."""
    part = F.lit(lm.TRAIN)
    docs = odd_docs.filter("doc_id < 20")
    uni, ctx, pair = Counter(), Counter(), Counter()
    for r in docs.collect():
        w = tokens(r["text"])
        uni.update(w)
        ctx.update(["start", *w[:-1]])
        pair.update(zip(["start", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    a, u, z = 0.5, 0.4, 0.1  # no held-out documents: the default weights
    for r in lm.score(docs, part).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        w = tokens(r["text"])
        want = sum(math.log10(a * pair[c, x] / ctx[c] + u * uni[x] / n + z / (v + 1)) for c, x in zip(["start", *w[:-1]], w))
        assert r["score"] == pytest.approx(want, abs=1e-6)


def test_em_raises_the_held_out_likelihood():
    r = np.random.default_rng(1)
    cells = r.integers(0, lm.CONTEXT_BUCKETS * lm.GRID * lm.GRID, 300)
    n = r.integers(1, 50, 300).astype(float)
    table = pd.DataFrame({"cell": cells, "n": n, "f2": n * r.random(300) * (r.random(300) < 0.6), "f1": n * r.random(300) * 0.01})
    b = cells // (lm.GRID * lm.GRID)
    est = np.stack([table["f2"] / n, table["f1"] / n, np.full(300, 1 / 1001)], axis=1)
    like = lambda lam: float((n * np.log((lam[b] * est).sum(axis=1))).sum())
    start = np.tile([0.5, 0.4, 0.1], (lm.CONTEXT_BUCKETS, 1))
    lam = lm.em_weights(table, 1000)
    assert np.allclose(lam.sum(axis=1), 1)
    assert like(lam) > like(start)


def test_empty(odd_docs):
    assert lm.score(odd_docs.limit(0), F.lit(lm.TRAIN)).count() == 0
    only = lm.score(odd_docs.filter("doc_id = 1"), F.lit(lm.OTHER)).first()
    assert (only["train_tokens"], only["base_score"], only["score"], only["n_known"]) == (0, 0, 0, 0)


def test_rows_exchanged_are_bounded_by_the_grams():
    """Far more buckets than grams: only buckets with a gram get a row, and
    buckets beyond 65,536 are used."""
    import pyarrow as pa

    table = pa.table({"chunk": [1, 1], "part": [0, 0], "raw": [b"a b c d a b", b"a b"]})
    rows = lm._asker(1 << 20)(table).to_pylist()
    chunk = lm.Chunk([b"a b c d a b", b"a b"])
    assert len(rows) <= len(chunk.hashes) + len(chunk.pair_hash)
    assert max(r["bucket"] for r in rows) > 1 << 16
    assert sum(len(r["words"]) for r in rows) == 8 * len(chunk.hashes)
