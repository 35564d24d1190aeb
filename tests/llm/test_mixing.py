import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import mixing

from .conftest import prose


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and w[s] * rest / share > most * sizes[s]] if share else []
        if not over:
            break
        full.update(over)
    for s in names:
        target[s] = most * sizes[s] if s in full else w[s] * rest / share
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 1000, None: 3}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = brute_targets(sizes)
    for r in mixing.targets(table).collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_mix(make_docs, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in odd_docs.collect():
        sizes[r["source"]] += words(r["text"])
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["target"] // max(1, r["source_size"]) * r["size"]  # whole epochs first
        assert r["taken"] % max(1, r["size"]) == 0  # whole documents
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        longest = max(words(r["text"]) for r in odd_docs.collect() if r["source"] == s)
        assert abs(taken[s] - t) <= 1 + longest / 2
    assert sorted(map(str, mixing.mix(odd_docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_applied_mix_has_the_words_taken(odd_docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(odd_docs).collect():
        want[r["doc_id"]] += r["taken"]
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    for r in out.collect():
        got[r["doc_id"]] += words(r["text"])
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mixing.apply_mix(odd_docs.limit(0)).count() == 0


def test_rows_taken_equal_a_plain_sort(spark, make_docs, monkeypatch):
    """Few and many buckets, equal keys in one of them, many small sources."""
    r = random.Random(3)
    rows = [(i, prose("en", r.randrange(0, 60), i) + " $$" * r.randrange(3), "en", f"s{i % 7 if i < 300 else i % 90}") for i in range(500)]
    docs = make_docs(rows + rows[:9])
    u = mixing.unit_hash("doc_id", "source", "text", seed=4)
    size = mixing.words(F.col("text"))
    keyed = docs.select("doc_id", "source", size.alias("size"), mixing.row_key(4).alias("row"),
                        (-F.log(u) / mixing.quality(F.col("text"), size)).alias("key")).collect()
    by_source = defaultdict(list)
    for x in keyed:
        by_source[x["source"]].append(x)
    target = brute_targets({s: sum(x["size"] for x in xs) for s, xs in by_source.items()})
    want = []
    for s, xs in by_source.items():
        total = sum(x["size"] for x in xs)
        epochs = int(target[s] // total) if total else 0
        left = round(target[s] - epochs * total)
        for x in sorted(xs, key=lambda x: (x["key"], x["row"])):
            part = x["size"] if 2 * left >= x["size"] and left > 0 else 0
            left = left - x["size"] if part else -1 if x["size"] else left
            want.append((x["doc_id"], epochs * x["size"] + part))
    for buckets in (4, 1024):
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        got = [(x["doc_id"], x["taken"]) for x in mixing.mix(docs).collect()]
        assert sorted(got) == sorted(want)


def test_buckets_hold_even_parts_of_poor_rows(spark, make_docs):
    """Low weights pile keys up far out; the buckets still hold few rows each."""
    rows = [(i, "$$$ ### " * 5 + str(i), "en", "s") for i in range(4000)] + [(9000 + i, prose("en", 20, i), "en", "t") for i in range(200)]
    docs = make_docs(rows)
    u = mixing.unit_hash("doc_id", "source", "text", seed=4)
    keyed = docs.select("source", (-F.log(u) / mixing.quality(F.col("text"), mixing.words(F.col("text")))).alias("key"))
    counts = mixing.with_range_bucket(keyed, "key", 256, "bucket").groupBy("source", "bucket").count().agg(F.max("count")).first()[0]
    assert counts <= 42  # one hundredth


def test_better_documents_come_first(make_docs):
    """A fractional source prefers prose to symbols."""
    rows = [(i, prose("en", 50, i), "en", "c") for i in range(200)]
    rows += [(1000 + i, "### $$$ %%% " * 17, "en", "c") for i in range(200)]
    rows += [(5000 + i, prose("en", 60, i), "en", "a") for i in range(200)] + [(9000, "x", "en", "b")]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(make_docs(rows)).filter("source = 'c'").collect()}
    assert sum(taken[i] for i in range(200)) > 3 * sum(taken[1000 + i] for i in range(200))
