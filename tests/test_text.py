"""Missing-value spellings and scalar helpers."""


from corpuslab.functions import text as T


def _one(spark, col, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_missing_value_spellings(spark):
    vals = [None, "", " ", "NA", "error", " None ", "<pad>", " x ", "\tx\t", "nan", "ok"]
    assert _one(spark, T.blank_trim("s"), vals) == ["", "", "", "NA", "error", "None", "<pad>", "x", "x", "nan", "ok"]
    assert _one(spark, T.fold_failures("s"), vals) == ["", "", "", "NA", "", "", "", "x", "x", "", "ok"]
    assert _one(spark, T.na_to_null("s"), ["NA", "null", "x", "", "N/A"]) == [None, None, "x", None, None]


def test_to_number(spark):
    assert _one(spark, T.to_number("s"), ["1.5", "", "nan", "abc", " 2 ", None]) == [1.5, None, None, None, 2.0, None]


def test_lang_code_and_ci_label(spark):
    assert _one(spark, T.lang_code("s"), ["Bhili", "Santali", "French"]) == ["bhb", "sat", "fre"]
    df = spark.createDataFrame([(45.3, 50.0), (None, None)], "lo double, hi double")
    assert [r[0] for r in df.select(T.ci_label("lo", "hi")).collect()] == ["[45.3, 50.0]", ""]


def test_split_group_and_word_count(spark):
    df = spark.createDataFrame([("de__deu__x",), ("nogroup",)], "g string")
    lang, tok = T.split_group("g")
    assert [tuple(r) for r in df.select(lang, tok).collect()] == [("de", "deu__x"), (None, None)]
    assert _one(spark, T.word_count("s"), [" a  b\tc ", "", None]) == [3, 0, 0]


def test_safe_pct_rate(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "x long, n long")
    assert [r[0] for r in df.select(T.safe_pct("x", "n")).collect()] == [100.0, 33.33]


def test_only_texts_with_white_edges_are_trimmed(spark):
    """trim with a character set makes a table of a whole text: texts without
    white space at an end go past it, with the result of a plain strip."""
    from pyspark.sql import functions as F

    from corpuslab.functions import text as X

    texts = [f"{a}{m}{z}" for a in ["", " ", "\t", " ", "　", "​", "é"] for m in ["", "x", "a b", "\x85"]
             for z in ["", " ", "\n ", "\x1c", "\x85", " ", "à", "぀", "漠", "​"]] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.ustrip("t").alias("s"))
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in df.collect())
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.range(1).select(X.ustrip(F.lit(5)).alias("s")).first()["s"] == "5"
