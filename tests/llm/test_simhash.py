import random

import numpy as np
import xxhash

from corpuslab.llm import golay, graph, simhash

from .conftest import prose


def brute_fp(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(fps, bits=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_golay_words_two_bits_apart_share_a_key():
    r = random.Random(1)
    for _ in range(400):
        x = r.getrandbits(23)
        y = x ^ sum(1 << b for b in r.sample(range(23), 2))
        at, key = golay.keys(np.array([x, y, x]))
        assert set(key[at == 0]) & set(key[at == 1])
        assert len(key[at == 0]) in (1, 6)


def test_fingerprints_four_bits_apart_share_a_key():
    r = random.Random(2)
    for _ in range(400):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), 4))
        at, key = simhash.fuzzy_keys(np.array([x, y], dtype=np.uint64))
        assert set(key[at == 0]) & set(key[at == 1])


def test_links_match_brute_force_with_split_groups(spark):
    """Blocks far smaller than the groups: links across blocks are found too."""
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {}
    for f, c in zip(signed, brute_components(fps)):
        want.setdefault(c, set()).add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for block in (8, 2048):
        got = {}
        for row in graph.connected_components(simhash.link_forest(table, 4, block)).collect():
            got.setdefault(row["label"], set()).add(row["node"])
        assert {frozenset(v) for v in got.values()} == want


def test_components_and_defined_cases(make_docs, odd_docs):
    base = prose("en", 400, 1).split()
    near = [(200 + i, " ".join(base[:-1] + [f"w{i}"]), "en", "s") for i in range(6)]
    docs = odd_docs.unionByName(make_docs(near))
    rows = simhash.components(docs).collect()
    assert len(rows) == docs.count()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [brute_fp(t) for _, t in texts]
    low = {}
    for (i, _), c in zip(texts, brute_components(fps)):
        low.setdefault(c, []).append(i)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in low.items()}
    want = sorted(map(str, ((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(texts, fps, brute_components(fps)))))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in rows) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, least.values()))
    assert simhash.components(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_one_row_stays_of_a_group_without_ids_or_with_one_id_twice(make_docs):
    def near(seed):
        words = prose("en", 300, seed).split()
        return [" ".join(words[:-1] + [f"z{i}"]) for i in range(4)]

    no_id, one_id = near(71), near(72)
    for group in (no_id, one_id):  # different fingerprints, one component
        fps = [brute_fp(t) for t in group]
        assert len(set(fps)) > 1 and len(set(brute_components(fps))) == 1
    rows = [(None, t, "en", "s") for t in no_id] + [(5, t, "en", "s") for t in one_id]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(make_docs(rows)).collect()) == ["5", "None"]


def test_a_long_chain_of_near_duplicates_is_one_component(spark, monkeypatch):
    """2,000 fingerprints in a shuffled chain, each four bits from the one
    before: one component, in a number of rounds that a logarithm bounds."""
    r = random.Random(7)
    chain = [r.getrandbits(64)]
    while len(chain) < 2000:
        chain.append(chain[-1] ^ sum(1 << b for b in r.sample(range(64), 4)))
    signed = [x - (1 << 64) if x >> 63 else x for x in set(chain)]
    r.shuffle(signed)
    links = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), block=64)
    rounds = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    got = {x["node"]: x["label"] for x in graph.connected_components(links).collect()}
    assert got == dict.fromkeys(signed, min(signed))
    assert rounds.count("stars") <= 22


def test_components_of_a_bare_path(spark):
    r = random.Random(8)
    nodes = r.sample(range(10_000), 600)
    edges = list(zip(nodes[:-1], nodes[1:])) + [(-5, -5), (-7, -6)]
    got = {x["node"]: x["label"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(nodes, min(nodes)) | {-7: -7, -6: -7}


def test_keys_need_no_large_table():
    """Every Python worker makes the keys: what they need must stay small."""
    import tracemalloc

    import numpy as np

    from corpuslab.llm import golay

    words = np.random.default_rng(2).integers(0, 1 << 23, 5000)
    for cached in (f for f in vars(golay).values() if hasattr(f, "cache_clear")):
        cached.cache_clear()
    tracemalloc.start()
    try:
        golay.keys(words)
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    assert np.array_equal(golay.syndromes(words), golay._remainder(words))
