"""Candidate ranking ties, resume idempotence, batch function retry."""

from pyspark.sql import functions as F

from corpuslab.operators import inference as I
from corpuslab.operators import reports as R


def test_rank_ties_by_token_nulls_last(spark):
    df = spark.createDataFrame([("m", "de", "b", 50.0), ("m", "de", "a", 50.0), ("m", "de", "c", None),
                                ("m", "de", "d", 60.0)], "model string, language string, src_token string, `chrf++` double")
    got = [r["src_token"] for r in R.rank_candidates(df).orderBy("rank_in_language").collect()]
    assert got == ["d", "a", "b", "c"]


def test_resume_twice_equals_once(spark):
    items = spark.range(20).select(F.col("id").alias("gid"))
    earlier = spark.createDataFrame([(0, "x"), (1, " "), (2, "ERROR")], "gid long, hyp string")
    pend = I.pending_items(items, earlier, "gid")
    assert sorted(r[0] for r in pend.collect()) == [1] + list(range(3, 20))
    new = pend.select("gid", F.lit("y").alias("hyp"))
    merged = I.merge_resumed(earlier, new)
    assert I.pending_items(items, merged, "gid").count() == 0
    assert merged.count() == 20


def test_batch_halving_on_memory_error():
    calls = []

    def fn(batch):
        calls.append(len(batch))
        if len(batch) > 4:
            raise MemoryError
        return [t.upper() for t in batch]

    out = I._run_batched(fn, [str(i) for i in range(10)], None, 16)
    assert out == [str(i) for i in range(10)] and calls[:3] == [10, 8, 4]


def test_predict_batches_keys_and_strip(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "gid long, src string")

    def factory():
        return lambda texts: [f"  {t[::-1]}  " for t in texts]

    got = {r["gid"]: r["hyp"] for r in I.predict_batches(df, factory, "src", ["gid"], 1).collect()}
    assert got == {1: "c b a", 2: ""}


def test_missing_source_token_is_an_error(spark):
    import pytest
    df = spark.createDataFrame([("de", 1), ("xx", 2)], "language string, gid long")
    toks = I.token_table(spark, {"de": "deu_Latn"})
    with pytest.raises(Exception, match="no source token configured for language xx"):
        I.attach_source_token(df, toks).collect()
    ok = I.attach_source_token(df.filter("language = 'de'"), toks).collect()
    assert ok[0]["src_lang"] == "deu_Latn"


def test_unknown_candidates_go_and_a_language_without_one_is_an_error(spark):
    import pytest
    cands = spark.createDataFrame([("de", "a"), ("de", "x"), ("fr", "b")], "language string, token string")
    vocab = spark.createDataFrame([("a",), ("b",), ("b",)], "token string")
    kept = I.require_known(I.known_candidates(cands, vocab))
    assert sorted((r["language"], r["token"]) for r in kept.collect()) == [("de", "a"), ("fr", "b")]
    with pytest.raises(Exception, match="no known candidate for language fr"):
        I.require_known(I.known_candidates(cands, vocab.filter("token = 'a'"))).collect()


def test_corpus_order(spark):
    names = ["MACRO", "zz", "Santali", "aa", "Bhili", "Gondi"]
    df = spark.createDataFrame([("m", "s", x) for x in names], "model string, setting string, language string")
    got = {r["language"]: r["position"] for r in R.corpus_order(df).collect()}
    assert sorted(got, key=got.get) == ["Bhili", "Gondi", "Santali", "aa", "zz", "MACRO"] and set(got.values()) == set(range(1, 7))
