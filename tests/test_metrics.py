"""Metric statistics against brute force, identities, LCS, stemming, bootstrap."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpuslab.functions import ngram
from corpuslab.functions.porter import stem
from corpuslab.operators import metrics as M

from .conftest import SF_SMALL


def _docs(n=60):
    con = duckdb.connect()
    return [r[0] for r in con.execute(
        f"SELECT text FROM read_parquet('{SF_SMALL}/documents.parquet') ORDER BY doc_id LIMIT {n}").fetchall()]


def _brute_counts(h, r, n):
    a = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
    b = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
    return sum(a.values()), sum(b.values()), sum((a & b).values())


def test_chrf_and_bleu_segment_stats_vs_brute_force():
    cw, t13, _ = ngram._py_tokenisers()
    for t in _docs():
        toks = t.split()
        h = " ".join(toks[::3] + toks[1::3])
        hc, rc = "".join(h.split()), "".join(t.split())
        want = []
        for n in range(1, 7):
            want += _brute_counts(list(hc), list(rc), n)
        for n in range(1, 3):
            want += _brute_counts(cw(h), cw(t), n)
        assert ngram.chrf_segment(hc, rc, cw(h), cw(t)) == want
        ht, rt = t13(h), t13(t)
        st = [_brute_counts(ht, rt, n) for n in range(1, 5)]
        assert ngram.bleu_segment(ht, rt) == [len(ht), len(rt)] + [s[2] for s in st] + [s[0] for s in st]


def _dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_bit_parallel_lcs_equals_dp():
    rnd = random.Random(5)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 40))]
        assert ngram.lcs(a, b) == _dp_lcs(a, b) == ngram.lcs(b, a)


# classic examples of the Porter paper / common implementations
PORTER = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
          "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
          "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
          "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
          "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
          "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal",
          "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
          "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
          "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
          "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate",
          "cease": "ceas", "controll": "control", "roll": "roll", "sky": "sky", "generously": "gener"}


def test_porter_examples():
    bad = {w: (stem(w), s) for w, s in PORTER.items() if stem(w) != s}
    assert not bad


def _score(spark, pairs, rouge=True):
    df = spark.createDataFrame([("g", i, h, r) for i, (h, r) in enumerate(pairs)],
                               "g string, doc_id long, hyp string, english string")
    st = M.segment_stats(df, rouge=rouge)
    return M.score_groups(st, ["g"], src_lang=None).first()


def test_identical_text_scores_100(spark):
    s = "the cat sat on the mat with another cat today"
    row = _score(spark, [(s, s), ("a b c d e", "a b c d e")])
    assert row["chrf++"] == 100.0 and row["BLEU"] == 100.0 and row["ROUGE-L"] == 100.0


def test_empty_and_failed_outputs(spark):
    row = _score(spark, [("ERROR", "a b c d"), (None, "a b c d"), ("a b c d", "a b c d")])
    assert row["n"] == 3 and row["empty_outputs"] == 2 and row["empty_pct"] == 66.67


def test_metric_smoke_pair(spark):
    row = _score(spark, [("the cat sat", "the cat sat down")])
    assert 0 < row["chrf++"] < 100 and 0 <= row["BLEU"] < 100
    # ROUGE-L: lcs 3, P = 1, R = 0.75 -> F = 0.857142...
    assert row["ROUGE-L"] == 85.71


def test_permutation_invariance(spark):
    docs = _docs(12)
    pairs = [(" ".join(t.split()[::2]), t) for t in docs]
    a, b = _score(spark, pairs), _score(spark, list(reversed(pairs)))
    assert a.asDict() == b.asDict()


def test_bootstrap_paired_and_bounded(spark):
    docs = _docs(40)
    rows = [(m, i, " ".join(t.split()[::k]), t) for i, t in enumerate(docs) for m, k in (("m1", 2), ("m2", 3))]
    df = spark.createDataFrame(rows, "model string, doc_id long, hyp string, english string")
    st = M.compact_stats(M.segment_stats(df, rouge=False), ["model", "doc_id"])
    ci = {r["model"]: r for r in M.bootstrap_ci(st, ["model"], "doc_id", 200, 42).collect()}
    full = {r["model"]: r["chrf++"] for r in M.score_groups(st, ["model"], rouge=False, src_lang=None).collect()}
    for m in ("m1", "m2"):
        assert ci[m]["chrf++_ci_lo"] <= full[m] + 1 and full[m] - 1 <= ci[m]["chrf++_ci_hi"]
        assert ci[m]["chrf++_ci_lo"] <= ci[m]["chrf++_mean"] <= ci[m]["chrf++_ci_hi"]
    # fewer than 2 segments -> no interval
    one = st.filter("doc_id = 0")
    assert M.bootstrap_ci(one, ["model"], "doc_id", 50, 42).count() == 0


def test_poisson_bootstrap_close_to_multinomial(spark):
    docs = _docs(60)
    rows = [("m1", i, " ".join(t.split()[::2]), t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "model string, doc_id long, hyp string, english string")
    st = M.compact_stats(M.segment_stats(df, rouge=False), ["model", "doc_id"])
    a = M.bootstrap_ci(st, ["model"], "doc_id", 300, 42).first()
    b = M.weight_bootstrap_ci(st, ["model"], "doc_id", 300, 42).first()
    full = M.score_groups(st, ["model"], rouge=False, src_lang=None).first()["chrf++"]
    assert abs(a["chrf++_mean"] - full) < 2 and abs(b["chrf++_mean"] - full) < 2
    assert b["chrf++_ci_lo"] < full < b["chrf++_ci_hi"]


def test_bleu_without_a_common_word_is_zero(spark):
    df = spark.createDataFrame([("a b c d e", "v w x y z"), ("a b c d e", "a w x y z")], "hyp string, english string")
    rows = M.segment_stats(df, rouge=False, chrf=False).collect()
    cols = ", ".join(f"b{i} double" for i in range(M.N_BLEU))
    got = [spark.createDataFrame([tuple(float(x) for x in r["bleu_st"])], cols).select(M.bleu_score("b").alias("s")).first()["s"]
           for r in rows]
    assert got[0] == 0.0 and got[1] > 0.0


def test_rouge_on_reordered_and_stemmed_words(spark):
    df = spark.createDataFrame([("dogs running quickly", "the dog runs quick"), ("b a", "a b")], "hyp string, english string")
    st = M.segment_stats(df, chrf=False, bleu=False)
    rows = [(r["rouge_st"][0], r["rouge_st"][1], r["rouge_st"][2]) for r in st.collect()]
    assert rows[0][1:] == (3, 4) and rows[0][0] >= 2  # dog(s), run(s|ning) match only when stemmed
    assert rows[1] == (1, 2, 2)


def test_broadcast_limit_respects_off(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value, want in (("-1", 0), ("10485760", 64 << 20), ("100MB", 100 << 20), ("2g", 512 << 20)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            assert M.broadcast_limit(spark) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_with_very_many_symbols():
    """Beyond what one packed key holds: the other counting path, same counts."""
    import random
    from collections import Counter

    r = random.Random(4)
    ref = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(5000))
    hyp = ref[100:2000] + "".join(chr(0x4E00 + r.randrange(6000)) for _ in range(500)) + ref[:700]
    side = ngram.Counted(ref, ngram.CHAR_ORDER)
    assert not side.packs
    want = []
    for n in range(1, ngram.CHAR_ORDER + 1):
        a, b = (Counter(x[i:i + n] for i in range(len(x) - n + 1)) for x in (hyp, ref))
        want += [sum(a.values()), sum(b.values()), sum((a & b).values())]
    assert side.against(hyp) == want
    few = ngram.Counted(ref[:300], ngram.CHAR_ORDER)
    assert few.packs and few.against(hyp)[0] == len(hyp)


def test_persisted_frames_are_released_with_the_result(spark):
    import gc

    from corpuslab.session import hold, released_with_result

    blocks = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    gc.collect()
    before = blocks()
    result = released_with_result(lambda: hold(spark.range(50).withColumn("x", F.lit(1))).groupBy("x").count())
    assert result.first()["count"] == 50 and blocks() == before + 1
    del result
    gc.collect()
    assert blocks() == before
