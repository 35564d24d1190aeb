import re
from collections import Counter

import corpus_pipeline
from corpuslab.llm import mixing
from corpuslab.llm.common import materialize

from .conftest import prose
from .test_pii import base
from .test_simhash import brute_components, brute_fp


def test_each_stage_on_its_own_input(spark, make_docs, odd_docs):
    words = prose("en", 300, 5).split()
    extra = [(500 + i, " ".join(words[:-1] + [f"z{i}"]), "en", "s1") for i in range(4)]
    extra += [(600 + i, prose("de", 40, 50 + i) + f" u{i}@mail.example.com 10.0.0.{i}", "de", "s2") for i in range(6)]
    docs = odd_docs.unionByName(make_docs(extra))
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], ""), f"test-{name}"))
    found, single, clean, mixed, packed = steps[1:]
    assert all(s.columns == docs.columns for s in steps[1:5])

    letters = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert Counter(r["text"] for r in found.collect()) == Counter(r["text"] for r in letters)

    rows = found.collect()
    groups = {}
    for r, c in zip(rows, brute_components([brute_fp(r["text"]) for r in rows])):
        groups.setdefault(c, []).append(r["doc_id"])
    want = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(want)

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        if not base(t):
            assert after[i] == t or "[" in after[i]
        assert not base(after[i])

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(clean.select("doc_id", "source", "text")).collect() if r["taken"]}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(got) == taken

    assert packed.filter("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0


def test_empty_table_goes_through(spark, odd_docs):
    docs = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"empty-{name}")
        assert docs.count() == 0
