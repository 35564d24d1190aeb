"""Training batches (F3) and subword BLEU."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import ngram, subword
from corpuslab.operators import corpus as C
from corpuslab.operators import metrics as M


def _examples(spark, n):
    r = random.Random(n)
    rows = [(f"g{i}", r.choice(["de", "de", "de", "fr"]), r.choice([0, 1, 5, 15, 16, 40, 190])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "gid string, language string, length int")


@pytest.mark.parametrize("per_language", [False, True])
def test_batches_hold_the_budget_and_every_example(spark, per_language):
    rows, df = _examples(spark, 700)
    got = C.training_batches(df, 256, 16, 7, per_language).collect()
    assert sorted(r["gid"] for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        assert r["batch_set"] == (r["language"] if per_language else "ALL") and r["length_bucket"] == r["length"] // 16
        by.setdefault((r["batch_set"], r["visit"]), []).append(r)
    for (name, visit), own in by.items():
        assert len({(r["length_bucket"], r["batch_no"]) for r in own}) == 1
        assert sum(max(1, r["length"]) for r in own) < 256 + 192
    for name in {k[0] for k in by}:  # every batch has one place
        assert sorted(v for s, v in by if s == name) == list(range(1, sum(s == name for s, _ in by) + 1))
    again = C.training_batches(df.repartition(9), 256, 16, 7, per_language).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_padding_report(spark):
    df = spark.createDataFrame([("ALL", 1, 4), ("ALL", 1, 2), ("ALL", 2, 0)], "batch_set string, visit long, length int")
    r = C.padding_report(df).first()
    assert (r["batches"], r["examples"], r["tokens"], r["padded_tokens"], r["padding_share"]) == (2, 3, 6, 8, 0.25)


def test_lengths_come_in_mixed_order(spark):
    rows, df = _examples(spark, 700)
    got = C.training_batches(df, 128).groupBy("visit").agg(F.first("length_bucket").alias("b")).orderBy("visit").collect()
    order = [r["b"] for r in got]
    assert order != sorted(order) and np.mean([a == b for a, b in zip(order, order[1:])]) < 0.7


@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model")


def test_subword_bleu_equals_plain_counting(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pairs = [("the house near the river", "the old house near a river"), ("", "a b"), (None, "c"), ("x ü 漢字", "x ü 漢字"), ("ERROR", "z")]
    df = spark.createDataFrame(pairs, "hyp string, english string")
    st = M.segment_stats(df, rouge=False, chrf=False, bleu=False, sp_model=model)
    rows = {r["hyp"]: list(r["sp_st"]) for r in st.collect()}
    for h, ref in pairs:
        a, b = sp.encode("" if h in (None, "ERROR") else h), sp.encode(ref)
        assert rows[h][:2] == [len(a), len(b)] and rows[h] == ngram.bleu_segment(a, b)
    ids = df.select(subword.token_column(model, F.col("english")).alias("t")).collect()
    assert [list(r["t"]) for r in ids] == [sp.encode(x) for _, x in pairs]


def test_a_missing_model_is_said(tmp_path, model):
    with pytest.warns(UserWarning, match="13a"):
        assert subword.usable_model([str(tmp_path / "no.model")]) is None
    assert subword.usable_model([str(tmp_path / "no.model"), model]) == model and subword.label(model) == "piece_bpe_32k"


def test_counts_of_a_batch_equal_those_of_each_pair(monkeypatch):
    """Pairs are counted together: over chunks, shared references, empty texts,
    texts whose 13a replacements join words, and too many symbols for one key."""
    import random

    r = random.Random(3)
    parts = ["a", "b", "1", ".", ",", " ", " ", "\t", "-\n", "&amp;", "amp;", "<skipped>", "é", "漢", "\x85", "running", "3.5"]
    refs = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 9, 60]))) for _ in range(60)]
    refs += ["".join(chr(0x4E00 + r.randrange(3000)) + " " * (i % 3 == 0) for i in range(4000))]
    pairs = [("".join(c for c in t if r.random() < 0.8), t) for t in refs for _ in range(3)] + [("", ""), ("a", "")]
    cw, t13, rw = ngram._py_tokenisers()
    want = {"chrf": [ngram.chrf_segment("".join(h.split()), "".join(t.split()), cw(h), cw(t)) for h, t in pairs],
            "bleu": [ngram.bleu_segment(t13(h), t13(t)) for h, t in pairs],
            "rouge": [[ngram.lcs(rw(h), rw(t)), len(rw(h)), len(rw(t))] for h, t in pairs]}
    for chars in (100, 1 << 17):
        monkeypatch.setattr(ngram, "CHUNK_CHARS", chars)
        assert ngram.SegmentStats(True, False, True, True).rows(*map(list, zip(*pairs))) == want
    assert ngram.token_bleu_rows([h.split() for h, _ in pairs], [t.split() for _, t in pairs]) == [
        ngram.bleu_segment(h.split(), t.split()) for h, t in pairs]


def test_batches_stay_in_arrow(monkeypatch):
    """Only a slice of a batch's rows is Python objects at a time."""
    import pyarrow as pa

    held = []

    class Watched(ngram.SegmentStats):
        def rows(self, hyps, refs):
            held.append((len(hyps), len(refs)))
            return super().rows(hyps, refs)

    monkeypatch.setattr(ngram, "SLICE_ROWS", 3)
    hyps, refs = ["a b", None, "", "c\x1cd", "é é", "x", "y z"], ["a c", "b", None, "c d", "é", "x", "z"]
    got = [x for part in ngram.arrow_stats(Watched(True, True, True, True), [(pa.array(hyps), pa.array(refs))])
           for x in part.to_pylist()]
    want = ngram.SegmentStats(True, True, True, True).rows([x or "" for x in hyps], [x or "" for x in refs])
    assert got == [dict(zip(want, row)) for row in zip(*want.values())]
    assert held == [(3, 3), (3, 3), (1, 1)]


def test_token_lists_are_counted_in_arrow(monkeypatch):
    """Runs of rows, null lists and null tokens; what a plain count gives."""
    import pyarrow as pa

    monkeypatch.setattr(ngram, "CHUNK_CHARS", 5)
    hyps = [["a", "b", "a"], None, [], ["x"] * 9, ["a", None, "b"], ["c"]]
    refs = [["a", "b"], ["q"], None, ["x"] * 4, ["a", None, "c"], ["c"]]
    parts = list(ngram.arrow_bleu_rows(pa.array(hyps), pa.array(refs)))
    assert len(parts) > 2
    assert [row for part in parts for row in part] == [ngram.bleu_segment(h or [], r or []) for h, r in zip(hyps, refs)]


def test_runs_of_a_spread_document_are_not_dealt_again(spark, tmp_path):
    """Statistics of a document's runs are made where the document is: one shuffle."""
    from corpuslab.operators import metrics as M
    from corpuslab.plans import fixtures as X

    spark.createDataFrame([(i, "en", f"a b {i}. c") for i in range(40)], "doc_id long, lang string, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    runs = X.predictions(spark, str(tmp_path))
    st = M.segment_stats(runs, segment_keys=("doc_id",))
    assert st._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    again = M.segment_stats(runs, segment_keys=("model", "doc_id"))   # dealt by other keys
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert sorted(st.select("doc_id", "model", "setting", "chrf_st").collect()) == sorted(
        again.select("doc_id", "model", "setting", "chrf_st").collect())


def test_lcs_of_hypotheses_side_by_side(monkeypatch):
    """One pass over a reference serves all its hypotheses; empty ones, tokens
    the reference lacks, more carries than free bits, and a pair by itself."""
    r = random.Random(9)
    for at in range(60):
        ref = np.array([r.randrange(1 + at % 9) for _ in range(r.choice([0, 1, 70, 300]))], dtype=np.int64)
        hyps = [np.array([r.randrange(12) if r.random() < 0.2 else x for x in ref.tolist() * 2 if r.random() < 0.6], dtype=np.int64)
                for _ in range(5)] + [ref, ref[:0], ref[::-1]]
        for room in (1 << 22, 300, 1):
            monkeypatch.setattr(ngram, "MASK_BYTES", room)
            assert ngram.lcs_of_many(ref, hyps) == [ngram.lcs(ref.tolist(), h.tolist()) for h in hyps]


def test_runs_of_pairs_are_numbered_anew(monkeypatch):
    """More symbols than one key holds are no matter when each run has few."""
    pairs = [([str(i), str(i + 1), "x", str(i)], [str(i), "x", str(i), str(i + 1)]) for i in range(200)]
    want = [ngram.bleu_segment(h, t) for h, t in pairs]
    for most in (1, 9, 1 << 17):
        monkeypatch.setattr(ngram, "COUNT_SYMBOLS", most)
        assert ngram.token_bleu_rows(*zip(*pairs)) == want


def test_predictions_without_token_arrays(spark):
    """The stand-in runs drop the tokens that a plain count drops, on odd white
    space and null keys, and in generated code (no lambda over an array)."""
    from corpuslab.plans import fixtures as X

    r = random.Random(4)
    space = ["\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", " ", "  ", " \n"]
    texts = ["".join(r.choice(["", r.choice(space)]) + r.choice(["a", "x", "$1", "\\", "\u200b", "word"]) + r.choice(space)
                     for _ in range(r.choice([0, 1, 2, 8, 9, 10, 30]))) for _ in range(150)]
    rows = [(i - 40 if i % 20 else None, "a", t if i % 31 else None) for i, t in enumerate([*texts, "", " ", "\u3000", "b" * 50000])]
    got = X.predictions(spark, None, spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for m, s, p in X.RUNS:
        for d, _, t in rows:
            w = None if t is None else t.split()
            hyp = None if w is None else " ".join(x for i, x in enumerate(w) if d is not None and (i + d) % p)
            if d is not None and (d + p) % 41 == 0:
                hyp = None
            if d is not None and (d + p) % 37 == 0:
                hyp = "ERROR"
            want.append((m, s, d, None if w is None else " ".join(w), hyp))
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got.select("model", "setting", "doc_id", "english", "hyp").collect())


def test_subword_tokens_as_spaced_text(spark):
    """bleu_tokens takes its tokens as text that white space parts; the counts
    are those of the array of tokens."""
    from corpuslab.plans import score_queries as S

    rows = [("abcdefgh ij klmno", "abcdefgh ijk klmno"), ("", "a"), ("abcd", "abcd abcde"), ("éééé漢 ab", "éééé漢 ab"), ("x", None)]
    df = spark.createDataFrame(rows, "hyp string, english string")
    cut, found = (lambda c: F.regexp_replace(c, S.SUBWORD_CUT, "$0 ")), (lambda c: F.regexp_extract_all(c, F.lit(S.SUBWORD_RE), 0))
    a, b = ([tuple(x["sp_st"]) for x in M.segment_stats(df, rouge=False, chrf=False, bleu=False, sp_hyp_tokens=f("hyp"),
                                                         sp_ref_tokens=f("english")).collect()] for f in (cut, found))
    assert sorted(a) == sorted(b)


def test_dropped_tokens_without_a_counted_group(spark):
    """The pattern of a run has its kept tokens one after another (a counted
    group took half as long again), for every step and first token."""
    from corpuslab.plans import fixtures as X

    texts = ["", "a", "$1 \\ b", " ".join(f"w{i}" for i in range(40)), "x " + "y" * 30000, None]
    df = spark.createDataFrame([(t, d, p) for t in texts for d in (-5, 0, 1, 7, 2 ** 40) for p in (1, 2, 3, 9, 12)], "t string, d long, p int")
    got = df.select("*", X.drop_tokens("t", F.col("d"), F.col("p")).alias("h"))
    assert "{" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        assert r["h"] == (None if r["t"] is None else " ".join(x for i, x in enumerate(r["t"].split()) if (i + r["d"]) % r["p"]))


def test_words_that_no_rule_stems_stay_in_arrow():
    """Only words with an ending of some rule go through the stemmer."""
    import pyarrow as pa

    from corpuslab.functions import porter

    r = random.Random(5)
    ends = ["", *porter.STEP4, *(a for a, _ in porter.STEP2 + porter.STEP3), "s", "ed", "ing", "y", "e", "ll", "ies", "eed"]
    words = ["".join(r.choice("aeiouybcdlt1") for _ in range(r.randrange(7))) + r.choice(ends) for _ in range(4000)]
    words += ["Ab", "a-b", "é", "", "skies", "howe", "proceed", "canning", "map", "abcdK"]
    stays = ngram.own_stems(pa.array(words, pa.large_string()))
    assert all(porter.stem(w) == w or len(w) <= 3 for w, s in zip(words, stays) if s)
    assert not any(s for w, s in zip(words, stays) if not (w.isascii() and w.isalnum() and w == w.lower()))
    assert sum(stays) > 300

    def steps(w):  # all rules, whatever the ending
        for step in (porter._step1a, porter._step1b, porter._step1c, porter._step2, porter._step3, porter._step4, porter._step5):
            w = step(w)
        return w

    assert all(porter.stem(w) == steps(w) for w in words if len(w) > 2 and w == w.lower() and w not in porter.IRREGULAR)
    for w in words:  # kinds of letters, as the rule says it letter by letter
        assert porter._kinds(w) == "".join("c" if porter._cons(w, i) else "v" for i in range(len(w)))


def test_words_are_cut_in_arrow(spark):
    """Runs of characters by arrays over a batch: slices, nulls, empty texts, long characters."""
    import re

    import pyarrow as pa

    from corpuslab.plans import score_queries as S

    r = random.Random(6)
    texts = [None if r.random() < 0.1 else "".join(r.choice("abcdé漢😀 \t ") for _ in range(r.choice([0, 1, 4, 5, 8, 30]))) for _ in range(400)]
    want = [None if t is None else re.sub(r"[^ ]{4}(?=[^ ])", lambda m: m[0] + " ", t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        got = subword.cut_words(pa.array(texts, kind), 4)
        got.validate(full=True)
        assert got.to_pylist() == want and subword.cut_words(pa.array(texts, kind).slice(7, 90), 4).to_pylist() == want[7:97]
    for few in ([], [None], [""], ["", "abcde", ""]):
        assert subword.cut_words(pa.array(few, pa.string()), 4).to_pylist() == [x and x.replace("abcde", "abcd e") for x in few]
    df = spark.createDataFrame([(t, u) for t, u in zip(texts, texts[1:])], "hyp string, english string")
    a, b = ([tuple(x["sp_st"]) for x in M.segment_stats(df, rouge=False, chrf=False, bleu=False, sp_hyp_tokens=f("hyp"),
                                                         sp_ref_tokens=f("english")).collect()]
            for f in (lambda c: subword.pieces(S.SUBWORD_CHARS, F.col(c)), lambda c: F.regexp_replace(c, S.SUBWORD_CUT, "$0 ")))
    assert sorted(a) == sorted(b)
