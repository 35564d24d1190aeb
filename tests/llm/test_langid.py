from corpuslab.llm import langid

from .conftest import prose


def train(make_docs, n=60):
    return make_docs([(i, prose(x, 40, i), x, "s") for i, x in enumerate(["en", "de", "fr"] * n)])


def test_held_out_accuracy(make_docs):
    model = langid.fit(train(make_docs))
    test = make_docs([(i, prose(x, 12, 1000 + i), x, "s") for i, x in enumerate(["en", "de", "fr"] * 40)])
    rows = langid.identify(test, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_defined_cases(make_docs, odd_docs):
    model = langid.fit(train(make_docs))
    out = langid.identify(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["score"] == "s" and r["a.b"] == "ab"
        if not letters:
            assert r["lang_score"] == 0
    assert langid.identify(odd_docs.limit(0), model).count() == 0


def test_nothing_to_learn(make_docs):
    model = langid.fit(make_docs([(1, "some text", None, "s")]))
    assert langid.identify(make_docs([(1, "some text", None, "s")]), model).first()["lang_pred"] == "und"


def test_filter_has_no_false_negatives(make_docs):
    import numpy as np

    model = langid.fit(train(make_docs))
    text = prose("de", 200, 3)
    for _, g, _ in langid.grams([text]):
        hit = model.hits(np.unique(g))[:, 0]
        assert ((hit >> np.uint64(model.langs.index("de"))) & np.uint64(1)).mean() > 0.95


def plain_grams(text):
    """n -> n-grams of every run of letters between two marks."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return {n: [f" {w} "[i:i + n] for w in words for i in range(len(w) + 3 - n)] for n in (3, 4)}


def test_scores_as_by_plain_sets(make_docs):
    """The filters without a Bloom filter: a set of grams for each language."""
    from collections import Counter

    rows = [(i, prose(x, 40, i) + f" größe{i}, l'été {x}{x}", x, "s") for i, x in enumerate(["en", "de", "fr"] * 30)]
    counts = {}
    for _, text, lang, _ in rows:
        for n, gs in plain_grams(text).items():
            counts.setdefault((lang, n), Counter()).update(gs)
    share = {key: {g: c / sum(own.values()) for g, c in own.items()} for key, own in counts.items()}
    sets = {(lang, n): {g for g, p in own.items() if p >= 2e-5 and p >= 0.3 * max(share[x, n].get(g, 0) for x in ("en", "de", "fr"))}
            for (lang, n), own in share.items()}
    cover = {key: sum(share[key][g] for g in own) for key, own in sets.items()}

    tests = [(i, " ".join(prose(x, 60, 500 + i + k) for k, x in enumerate(langs)), None, "s") for i, langs in enumerate(
        [("en",), ("de",), ("fr",), ("en", "de"), ("fr", "en", "en"), ("de", "fr", "de", "de")] * 5)]
    got = {r["doc_id"]: r for r in langid.identify(make_docs(tests), langid.fit(make_docs(rows))).collect()}
    for i, text, _, _ in tests:
        own = plain_grams(text)
        score = {x: sum(sum(g in sets[x, n] for g in own[n]) for n in (3, 4))
                 / sum(len(own[n]) * cover[x, n] for n in (3, 4)) for x in ("en", "de", "fr")}
        first, second = sorted(score.values())[:0:-1]
        best = max(score, key=score.get)
        if first - second > 0.05:
            assert got[i]["lang_pred"] == best
        assert abs(got[i]["lang_score"] - score[got[i]["lang_pred"]] / sum(score.values())) < 0.02
