import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpuslab.llm import whitening as wh
from corpuslab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n string, vec string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def brute(rows, k=32):
    """Exact n, deviations, and numpy's eigenvectors of the exact covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[Fraction(r[j] * n - sums[j], n) for j in range(d)] for r in x]
    cov = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    flat = np.array([[float(c) for c in r] for r in y]) @ u / np.sqrt(e)
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], flat, e / np.trace(cov)


def test_eigenvectors_of_hard_matrices():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectra = [np.linspace(1, 40, 40), np.repeat([7.0, 3.0, 1.0, 0.5], 10), np.full(40, 2.0),
               np.concatenate([[1e8, 1e8 + 1, 1e8 + 2], np.linspace(1, 2, 37)]), 1 + 1e-12 * np.arange(40),
               np.concatenate([np.zeros(30), np.arange(1, 11)])]
    for s in spectra:
        v = (q * s) @ q.T
        values, vectors = wh.leading_components(v, 32)
        want = np.sort(s)[::-1][:32]
        want = want[want > 1e-9 * want[0]]
        assert len(values) == len(want)
        assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        assert np.abs(v @ vectors - vectors * values).max() < 1e-10 * want[0]
    for v in (np.diag([3.0, 2.0, 1.0]), np.array([[4.0]]), np.zeros((3, 3)), np.empty((0, 0))):
        values, vectors = wh.leading_components(v, 2)
        assert np.allclose(v @ vectors, vectors * values)


def test_moments_merge_to_the_whole():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (1000, 5)) + wh.OFFSET
    whole = wh.Moments.of(x)
    parts = wh.Moments.of(x[:1]).merge(wh.Moments.of(x[1:400]).merge(wh.Moments.of(x[400:])))
    assert parts.n == 1000 and list(parts.sums) == x.sum(axis=0).tolist()
    assert np.allclose(parts.scatter / 1000, np.cov(x.T, bias=True), rtol=1e-11)
    assert np.allclose(whole.scatter, parts.scatter, rtol=1e-11)


def test_whitened_rows_equal_the_exact_computation(spark, monkeypatch):
    """With repeated rows, a null id, unusable vectors and many merge rounds."""
    monkeypatch.setattr(wh, "FAN", 3)
    r = random.Random(5)
    good = [(i, [r.gauss(0, 1 + j) + (r.random() if j else 0) for j in range(6)]) for i in range(300)]
    good += [good[3], good[3], (None, good[5][1])]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] * 6)]
    rows = wh.by_component(wh.whiten(frame(spark, good + bad).repartition(17), 4)).collect()
    n, dev, flat, explained = brute(good, 4)
    assert len(rows) == 4 * len(good) and {x["n"] for x in rows} == {n}
    assert all(x["identity_error"] < 1e-9 for x in rows)
    sign = {}
    for x in rows:
        if x["vec_id"] is None:
            continue
        at, c = next(i for i, g in enumerate(good) if g[0] == x["vec_id"]), x["component"] - 1
        assert x["deviation"] == dev[at]
        assert math.isclose(x["explained"], explained[c], rel_tol=1e-9)
        want = flat[at, c]
        if abs(want) > 0.1:
            assert sign.setdefault(c, np.sign(want * x["whitened"])) == np.sign(want * x["whitened"])
        assert math.isclose(abs(x["whitened"]), abs(want), rel_tol=1e-6, abs_tol=1e-6)


def test_odd_tables(spark):
    out = lambda rows: wh.by_component(wh.whiten(frame(spark, rows))).collect()
    assert out([]) == [] and out([(1, None)]) == [] and out([(1, [1.0, 2.0])]) == []
    assert out([(i, [0.5, 0.25]) for i in range(5)]) == []  # no variance
    # a shorter vector reads as padded; one direction of variance gives one component
    line = out([(1, [1.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])])
    assert sorted((x["vec_id"], x["component"], x["deviation"]) for x in line) == [
        (1, 1, 192 ** 2), (2, 1, 0), (3, 1, 192 ** 2)]
    # entries beyond 64-bit integers
    huge = out([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])])
    assert {x["deviation"] for x in huge if x["vec_id"] != 3} == {None} and all(math.isfinite(x["whitened"]) for x in huge)


@pytest.mark.parametrize("query", ["op13_whitening"])
def test_the_query_equals_the_exact_computation(spark, query):
    rows = QUERIES[query](spark, SF).collect()
    given = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    given = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, dev, flat, explained = brute(given)
    by_id = {}
    for x in rows:
        by_id.setdefault(x["vec_id"], {})[x["component"]] = x
    assert len(rows) == 32 * n and set(by_id) == {i for i, _ in given}
    signs = np.sign([[by_id[i][c + 1]["whitened"] for c in range(32)] for i, _ in given] * flat)
    for c in range(32):
        assert len(set(signs[np.abs(flat[:, c]) > 0.05, c])) == 1
    for at, (i, _) in enumerate(given):
        for c in range(32):
            x = by_id[i][c + 1]
            assert x["deviation"] == dev[at] and math.isclose(x["explained"], explained[c], rel_tol=1e-9)
            assert math.isclose(abs(x["whitened"]), abs(flat[at, c]), rel_tol=1e-6, abs_tol=1e-7)
            assert x["identity_error"] < 1e-9
