import math

import numpy as np
import pytest
from pyspark.sql import types as T

from corpuslab.llm import kmeans_tree, pivot_search

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()),
                    T.StructField("cell", T.StringType())])


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + 0.3 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(700)]
    hot = out[3][1]
    out += [(1000 + i, hot) for i in range(400)]  # copies of one vector
    out += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, hot),
            (2100, [0.0] * 8), (2200, [1.0, 2.0]), (20, out[20][1]), (20, out[20][1])]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "c") for i, v in rows], VEC)


def usable(rows, zero=True):
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.array(list(v) + [0.0] * (8 - len(v)), dtype=np.float32).astype(float)
        if zero or v.any():
            out[i] = v
    return out


def test_exact_top_k(table, rows):
    have = {i: np.floor(64 * v).astype(int) for i, v in usable(rows).items()}
    ids = np.array(list(have))
    x = np.array(list(have.values()))
    got = {}
    for cell_rows in (64, 4096):
        for r in pivot_search.top_k(table, k=20, every=20, pivots=5, cell_rows=cell_rows, rounds=(1, 3)).collect():
            got.setdefault((cell_rows, r["query_id"]), []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in have if i % 20 == 0]
    assert set(got) == {(c, q) for c in (64, 4096) for q in queries}
    for (_, q), own in got.items():
        s = x @ have[q]
        order = sorted((-int(v), int(i)) for i, v in zip(ids, s) if i != q)[:20]
        assert sorted(own) == [(n + 1, i, -v) for n, (v, i) in enumerate(order)]


def test_bounds_leave_most_of_clustered_data_out(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    x = (centres[np.arange(8000) % 40] + 0.1 * r.normal(size=(8000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "s", "c") for i, v in enumerate(x)], VEC)
    found = pivot_search.top_k(df, k=20, every=100, cell_rows=256).toPandas()
    z = np.floor(64 * x.astype(float)).astype(int)
    for q, own in found.groupby("query_id"):
        s = z @ z[q]
        s[q] = -2 ** 40
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        own = own.sort_values("rank")
        assert own["vec_id"].tolist() == best.tolist() and own["score"].tolist() == s[best].tolist()
    compared = found.groupby("query_id")["compared"].first() / len(x)
    print("share of vectors compared:", compared.mean(), compared.max())
    assert found["query_id"].nunique() == 80 and compared.mean() < 0.5


@pytest.mark.parametrize("split_rows", [4096, 40])
def test_tree_search(table, rows, split_rows, monkeypatch):
    """With 40, the leaves of the first tree (of at least 16 in a sample of 100)
    have trees of their own."""
    have = usable(rows, zero=False)
    ids = np.array(list(have))
    x = np.array(list(have.values()))
    splits, plain = [], kmeans_tree._split
    monkeypatch.setattr(kmeans_tree, "_split", lambda *a: splits.append(plain(*a)) or splits[-1])
    found = kmeans_tree.search(table, k=10, every=20, sample=300 if split_rows > 40 else 100, leaf_rows=32, calibration=50,
                               cell_rows=64, split_rows=split_rows, split_sample=200).collect()
    assert len(splits) == (split_rows == 40)
    for fine, below in splits:  # every vector has its leaf, some leaves are of second trees
        assert fine.count() == len({v.tobytes() for v in have.values()})
        assert fine.filter(f"cell % {kmeans_tree.LEAVES} > 0").count() > 0 and below.filter("tree is not null").count() > 0
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in have if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        d = np.sqrt(((x - have[q]) ** 2).sum(axis=1))
        best = sorted((v, int(i)) for i, v in zip(ids, d) if i != q)[:10]
        own.sort()
        assert len(own) == 10 and [n for n, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        where = dict(zip(ids.tolist(), d))
        for _, i, s in own:
            assert s == pytest.approx(where[i], abs=1e-12)
        hits += len({i for _, i, _ in own} & {i for _, i in best})
    assert hits >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("search", [lambda t: pivot_search.top_k(t, k=20, every=20), lambda t: kmeans_tree.search(t, k=10, every=20)])
def test_few_and_no_rows(spark, table, search):
    assert search(table.limit(0)).count() == 0
    few = table.filter("vec_id in (0, 20, 21)")
    got = sorted((r["query_id"], r["vec_id"]) for r in search(few).collect())
    assert got == [(0, 20), (0, 21), (20, 0), (20, 21)]
    assert search(table.filter("vec_id = 0")).count() == 0


def test_visits_come_in_order_and_reach_every_leaf():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4))
    tree = kmeans_tree.Tree()
    tree.grow(x, 4, 20, r)
    leaf = tree.leaf_of(x)
    for i in range(20):
        order = list(tree.visit(x[i]))
        assert order[0] == leaf[i]
        assert sorted(order) == list(range(tree.leaves))
