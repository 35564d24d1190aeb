"""Readers / writers on hand-made files in a fresh scratch folder."""

import os
import random
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpuslab.operators import corpus as C
from corpuslab.operators import inference as I
from corpuslab.sources import io as IO
from corpuslab.sources import versions as V


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_wide_csv_bom_multiline_short_rows(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    _write(os.path.join(d, "Bhili.csv"),
           '﻿English, HINDI ,Bhili\n"a line\nwith a break","h","b1"\n"x ""q""",,b2\nonly english\n')
    raw = IO.read_wide(spark, os.path.join(d, "Bhili.csv"), ["Bhili", "Gondi"])
    assert raw.select("__lang").distinct().collect()[0][0] == "Bhili"
    pairs = IO.read_pairs(raw.drop("__lang"), ["Bhili", "Gondi"]).collect()
    got = sorted((r.english, r.hindi, r.tribal) for r in pairs)
    assert got == sorted([("a line\nwith a break", "h", "b1"), ('x "q"', None, "b2"), ("only english", None, None)])


def test_require_columns_and_long_layout(spark):
    df = spark.createDataFrame([("de", "e", "t")], "` Language ` string, ENGLISH string, Tribal string")
    out = IO.require_columns(df, ["language", "english", "tribal"], optional=["hindi"])
    assert sorted(out.columns) == ["english", "hindi", "language", "tribal"]
    try:
        IO.require_columns(df, ["language", "nope"])
        raise AssertionError("expected a missing-column error")
    except ValueError as e:
        assert "nope" in str(e)


def test_na_folding_on_read(spark):
    df = spark.createDataFrame([("de", "NA", "x"), ("de", "ok", "null")], "language string, english string, tribal string")
    rows = IO.read_pairs(df, ["de"]).collect()
    assert [(r.english, r.tribal) for r in rows] == [(None, "x"), ("ok", None)]


def test_write_corpus_ignore_unless_forced(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    p = os.path.join(d, "corpus")
    now = lambda: spark.read.option("header", True).csv(V.current(spark, p))
    plain = lambda: sorted(r.t for r in now().collect())
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "t string")
    IO.write_corpus(make("a"), p)
    IO.write_corpus(make("b", "c"), p)          # no-op: a complete target exists
    assert plain() == ["a"]
    for n in range(3):  # forced writes replace, also while they read what they replace
        old = now()
        assert IO.write_corpus(old.unionByName(make(f"x{n}")), p, force=True) == p
    assert plain() == ["a", "x0", "x1", "x2"]
    assert now().columns == ["t"]


def test_write_corpus_after_a_crashed_write(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="corpuslab-io-"), "corpus")
    read = lambda: sorted(r.t for r in IO.read_wide(spark, p).collect())
    boom = spark.createDataFrame([("c",)], "t string").select(F.raise_error(F.lit("crash")).cast("string").alias("t"))

    def crash(**how):
        try:
            IO.write_corpus(boom, p, **how)
        except Exception as e:
            assert "crash" in str(e)
        else:
            raise AssertionError("expected the write to fail")

    crash()  # files, but no version
    IO.write_corpus(spark.createDataFrame([("a",), ("b",)], "t string"), p)
    assert read() == ["a", "b"]
    crash(force=True)
    assert read() == ["a", "b"]


def test_headers_are_parsed_where_files_are_read(spark):
    """A quoted line break in a header, compression, tabs, odd orders, no rows."""
    import gzip

    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    _write(os.path.join(d, "Gondi.csv"), 'english,"hi\nndi",Gondi\n1,2,3\n"4\n4",5,6,extra\n')
    with gzip.open(os.path.join(d, "Bhili.csv.gz"), "wt", encoding="utf-8") as f:
        f.write('\ufeffBhili, English \n"b ""1""",e1\nb2\n')
    _write(os.path.join(d, "Mundari.tsv"), "english\tmundari\nx,y\tz\n")
    _write(os.path.join(d, "Santali.csv"), "english,Santali\n")
    _write(os.path.join(d, "empty.csv"), "")
    wide = IO.read_wide(spark, d)
    assert set(wide.columns) == {"english", "hi\nndi", "gondi", "bhili", "mundari", "santali", "__lang"}
    got = {(r["__lang"], r["english"], r["hi\nndi"], r["gondi"], r["bhili"], r["mundari"]) for r in wide.collect()}
    assert got == {("Gondi", "1", "2", "3", None, None), ("Gondi", "4\n4", "5", "6", None, None),
                   ("Bhili", "e1", None, None, 'b "1"', None), ("Bhili", None, None, None, "b2", None),
                   ("Mundari", "x,y", None, None, None, "z")}
    pairs = IO.read_corpus_folder(spark, d, ["Gondi", "Bhili", "Mundari", "Santali"]).collect()
    assert sorted((r.language, r.tribal) for r in pairs) == [
        ("Bhili", 'b "1"'), ("Bhili", "b2"), ("Gondi", "3"), ("Gondi", "6"), ("Mundari", "z")]
    _write(os.path.join(d, "Ho.csv"), "english,other\n1,2\n")
    try:
        IO.read_corpus_folder(spark, d, ["Ho"]).collect()
        raise AssertionError("expected an error naming file and column")
    except Exception as e:
        assert "Ho.csv" in str(e) and "'ho'" in str(e)


def test_many_files_in_one_task_keep_their_headers(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    for i in range(40):
        _write(os.path.join(d, f"f{i}.csv"), "a,b\n" * (i % 2) + "b,a\n" * (1 - i % 2) + f"{i},x{i}\n" * (i % 5))
    rows = IO.read_by_name(spark, IO.data_files(spark, d), ["a", "b"])
    want = sorted((str(i), f"x{i}") if i % 2 else (f"x{i}", str(i)) for i in range(40) for _ in range(i % 5))
    assert sorted((r.a, r.b) for r in rows.coalesce(1).collect()) == want


def test_too_many_columns_is_an_error(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    _write(os.path.join(d, "w.csv"), ",".join(f"c{i}" for i in range(200)) + "\n")
    try:
        IO.read_by_name(spark, IO.data_files(spark, d), ["c1"]).collect()
        raise AssertionError("expected an error")
    except Exception as e:
        assert "w.csv" in str(e)


def test_folder_of_wide_files_with_their_own_headers(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    _write(os.path.join(d, "Bhili.csv"), "English,Hindi,Bhili\ne1,h1,b1\n")
    _write(os.path.join(d, "Gondi.csv"), "Hindi,English,Gondi\nh2,e2,g2\nh3\n")
    got = sorted((r.language, r.english, r.hindi, r.tribal) for r in IO.read_corpus_folder(spark, d, ["Bhili", "Gondi"]).collect()
                 if r.english)
    assert got == [("Bhili", "e1", "h1", "b1"), ("Gondi", "e2", "h2", "g2")]
    wide = {(r["__lang"], r["english"], r["hindi"], r["gondi"]) for r in IO.read_wide(spark, d).collect()}
    assert wide == {("Bhili", "e1", "h1", None), ("Gondi", "e2", "h2", "g2"), ("Gondi", None, "h3", None)}
    try:
        IO.read_corpus_folder(spark, d, ["Bhili", "Santali", "Mundari"])
        raise AssertionError("expected an error naming the missing languages")
    except ValueError as e:
        assert "Santali" in str(e) and "Mundari" in str(e)


def test_predictions_by_name_short_rows_and_missing_values(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    for run, text in {"m1/a": "gid,language,tribal,english,hyp,src_lang\n1,de,t,e,NA,tok\n2,de,t,e,out\n",
                      "m1/b": "hyp,src_lang,english,gid\nout2,tok2,e2,7\n", "m2/a": "gid,text\n1,x\n"}.items():
        os.makedirs(os.path.join(d, run))
        _write(os.path.join(d, run, "predictions.csv"), text)
    os.makedirs(os.path.join(d, "m3/a"))
    _write(os.path.join(d, "m3/a", "predictions.csv"), "")
    rows = IO.read_predictions(spark, d).collect()
    bad = {(r.model, r.setting): r.missing for r in IO.unreadable_runs(spark, d).collect()}
    assert bad == {("m2", "a"): ["hyp"], ("m3", "a"): ["hyp"]}
    got = sorted((r.model, r.setting, r.gid, r.tribal, r.english, r.hyp or "-", r.src_lang or "-") for r in rows if r.setting == "a")
    assert got == [("m1", "a", "1", "t", "e", "-", "tok"), ("m1", "a", "2", "t", "e", "out", "-")]
    (b,) = [r for r in rows if r.setting == "b"]
    assert (b.gid, b.tribal, b.english, b.hyp, b.src_lang) == ("7", None, "e2", "out2", "tok2")


def test_replayed_prediction_batch_keeps_its_rows(spark):
    from corpuslab.plans.stream_queries import PARTIAL, predict_step

    d = os.path.join(tempfile.mkdtemp(prefix="corpuslab-io-"), "out")
    done = spark.createDataFrame([(1, "old"), (2, "\t\u00a0")], "doc_id long, hyp string")
    IO.append_partial(done.filter("doc_id = 1"), d, -1)
    batch = spark.createDataFrame([(1, "de"), (2, "de"), (3, "fr")], "doc_id long, lang string")
    read = lambda: sorted((r.doc_id, r.hyp) for r in IO.read_partials(spark, d, PARTIAL).collect())
    predict_step(batch, 0, d)
    once = read()
    predict_step(batch, 0, d)  # the same batch again, as after a crash
    assert read() == once == [(1, "old"), (2, "new de"), (3, "new fr")]
    predict_step(batch, 1, d)  # another batch finds everything done
    assert read() == once


def test_write_table_tsv_and_csv(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    df = spark.createDataFrame([("a,b", " x ")], "c1 string, c2 string")
    IO.write_table(df, os.path.join(d, "report"))
    tsv = spark.read.option("header", True).option("sep", "\t").option("ignoreTrailingWhiteSpace", False) \
        .option("ignoreLeadingWhiteSpace", False).csv(os.path.join(d, "report.tsv")).collect()
    csv = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(os.path.join(d, "report.csv")).collect()
    assert tuple(tsv[0]) == tuple(csv[0]) == ("a,b", " x ")


def test_append_events_and_read_index(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    cols = IO.RUN_INDEX_COLUMNS
    row = lambda ev, st: ("2024-01-02 03:04:05", ev, "infer", "lbl", "", st, "log1", "", "")
    IO.append_events(spark.createDataFrame([row("started", "")], ", ".join(f"{c} string" for c in cols)), d)
    IO.append_events(spark.createDataFrame([row("finished", "ok")], ", ".join(f"{c} string" for c in cols)), d)
    idx = IO.read_run_index(spark, d)
    assert sorted(r.event for r in idx.collect()) == ["finished", "started"]
    assert idx.filter(F.col("ts").isNull()).count() == 0


def test_usable_pairs_observation_counts_drops(spark):
    df = spark.createDataFrame([(1, 0, "de", "e", "", "t"), (2, 0, "de", " ", "", "t"), (3, 0, "xx", "e", "", "t"),
                                (4, 0, "de", None, "", "t")],
                               "doc_id long, part long, lang string, english string, hindi string, tribal string")
    obs = Observation("pairs")
    kept = C.usable_pairs(df, ["de"], obs).collect()
    assert [r.doc_id for r in kept] == [1]
    assert obs.get["rows_in"] == 4


def test_pre_post_hooks(spark):
    df = spark.createDataFrame([(1, "abc", "tokA")], "gid long, src string, tok string")
    out = I.predict_batches(df, lambda: (lambda texts: [t.upper() for t in texts]), "src", ["gid"],
                            token_col="tok", pre=lambda s, k: f"{k}:{s}", post=lambda t: t + "!").collect()
    assert out[0]["hyp"] == "TOKA:ABC!" and out[0]["src_lang"] == "tokA"


def test_packed_outputs_read_as_plain_ones(spark, tmp_path):
    """Compressed outputs of runs: the same rows, and fewer bytes."""
    rows = [(m, "s", str(i), None if i == 7 else f'say "x,{i}"\n and ' + "again " * 50) for m in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "model string, setting string, gid string, hyp string")
    size, got = {}, {}
    for name, how in (("plain", lambda w: w), ("packed", IO.packed)):
        root = str(tmp_path / name)
        how(IO.csv_writer(df.write.partitionBy("model", "setting"))).csv(root)
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*"))
        got[name] = sorted(map(str, IO.read_predictions(spark, root, ["gid", "hyp"], layout="hive").collect()))
    assert got["packed"] == got["plain"] and len(got["plain"]) == len(rows)
    assert size["packed"] < size["plain"] / 2


def test_tight_outputs_read_as_plain_ones(spark, tmp_path):
    """Outputs of runs written without a sort, one gzip file a folder and task: the same rows, fewer bytes than LZ4."""
    draw = random.Random(1)
    text = lambda: " ".join("".join(draw.choices("etaoinshr", k=6)) for _ in range(60))
    rows = [(m, f"s {i % 3}", str(i), None if i == 7 else f'say "x,{i}"\n{text()}') for m in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "model string, setting string, gid string, hyp string").repartition(2)
    key, size, got = "spark.sql.maxConcurrentOutputFileWriters", {}, {}
    before = spark.conf.get(key)
    for name, how, most in (("packed", IO.packed, 64), ("tight", IO.tight, 64), ("few", IO.tight, 2)):
        root = str(tmp_path / name)
        with IO.unsorted_folders(spark, most):
            assert spark.conf.get(key) == str(most)
            how(IO.csv_writer(df.write.partitionBy("model", "setting"))).csv(root)
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*"))
        got[name] = sorted(map(str, IO.read_predictions(spark, root, ["gid", "hyp"], layout="hive").collect()))
    assert got["tight"] == got["packed"] == got["few"] and len(got["tight"]) == len(rows)
    assert size["tight"] < size["packed"] * 0.8
    with pytest.raises(ZeroDivisionError), IO.unsorted_folders(spark):
        1 / 0
    assert spark.conf.get(key) == before
