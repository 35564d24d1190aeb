import math
import random

import numpy as np

from corpuslab.llm import toxicity

from .conftest import prose


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then
    the same to its left and right."""
    best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
               key=lambda x: (x[0], -(x[2] - x[1])), default=None)
    if best is None or best[0] <= 0:
        return []
    _, i, j = best
    return brute_segments(scores[:i]) + [best] + [(s, a + j, b + j) for s, a, b in brute_segments(scores[j:])]


def test_segments_match_their_definition():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-0.37, -0.37, -0.37, 1.01, 2.3, 0.55]) * 1 for _ in range(r.randint(0, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(np.array(at, dtype=int), np.array([scores[i] for i in at]), 0.37)
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_lambda_is_a_root():
    g, w = np.array([2.0, 3.0]), np.array([1.0, 1.0])
    lam = toxicity._lambda(g, w, 0.5, 98.0)
    assert math.isclose((w * np.exp(lam * g)).sum() + 98 * math.exp(-0.5 * lam), 100, rel_tol=1e-6)


def corpus(spark, make_docs, n=400):
    r, rows, labels = random.Random(2), [], []
    for i in range(n):
        words = prose("en", r.randint(30, 200), i).split()
        toxic = i % 5 == 0
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["vile", "scummy", "rotten"]) for _ in range(4)]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1 if toxic else 0))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_passages(spark, make_docs):
    docs, labels = corpus(spark, make_docs)
    model = toxicity.fit(docs.filter("doc_id < 300"), labels)
    rows = toxicity.score(docs.filter("doc_id >= 300"), model).collect()
    assert sum((r["toxic_score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows) >= 0.97 * len(rows)
    for r in rows:
        assert 0 <= r["toxic_score"] <= 1
        for p in r["passages"]:
            words = toxicity.words(r["text"])[p["first"]:p["end"]]
            assert {"vile", "scummy", "rotten"} & set(words)


def test_defined_cases(spark, make_docs, odd_docs):
    docs, labels = corpus(spark, make_docs)
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["toxic_score"] < 0.5 and r["score"] == "s" for r in rows)
    assert toxicity.score(odd_docs.limit(0), model).count() == 0
    flat = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["toxic_score"] for r in toxicity.score(odd_docs, flat).collect()} == {0.0}


def test_the_scan_is_linear_in_the_hits():
    """Falling left sums, the worst case of a plain walk back, and random hits."""
    import time

    import numpy as np

    r = np.random.default_rng(1)
    for places, gains in ((np.arange(40_000) * 100, np.full(40_000, 3.0)), (np.arange(40_000) * 3, r.random(40_000))):
        began = time.time()
        found = toxicity.maximal_segments(places, gains, 0.05)
        assert time.time() - began < 2 and found


def test_limits_are_chosen_by_the_calibration_rows(make_docs):
    """With a harmful choice beside a good one the good one is taken."""
    r = random.Random(2)
    rows = [(i, prose("en", 40, i) + (" vile filth" if i % 4 == 0 else "") + f" w{r.randrange(5)}", "en", "s") for i in range(400)]
    docs = make_docs(rows)
    labels = docs.select("doc_id", (docs["doc_id"] % 4 == 0).cast("int").alias("toxic"))
    strict = toxicity.fit(docs, labels, choices=((1e9, 0.7),))
    both = toxicity.fit(docs, labels, choices=((1e9, 0.7), (3.5, 0.7)))
    assert not strict.gains and {"vile", "filth"} <= set(both.gains)
