"""Streams over several micro-batches against their batch twins, and tables
that are replaced by versions."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import runlog as L
from corpuslab.sources import versions as V
from corpuslab.streaming import live as S

LOG = ("model string, setting string, ord long, step long, loss string, eval_loss string, samples_per_s string, tokens_per_s string, "
       "gpu_mem_gb string, epoch string, lr string, elapsed_min string, eta_min string")


def _log_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for o in range(n):
        model, setting = r.choice([("m1", "a"), ("m1", "a"), ("m2", "b"), (None, "b"), ("quiet", "a")])
        loss = "" if model == "quiet" else r.choice(["", "nan", f"{r.randrange(9)}.5"])
        rows.append((model, setting, o, 10 * o, loss, r.choice(["", "", "bad", f"{r.randrange(4)}.25"]),
                     *[str(r.randrange(99)) for _ in range(7)]))
    return rows


def _stream(spark, rows, schema, files, seed=0):
    """The rows dealt into files in a mixed order, one file a trigger."""
    d = tempfile.mkdtemp(prefix="corpuslab-stream-")
    random.Random(seed).shuffle(rows)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{d}/t")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/t"), d


def _plain(df, *drop):
    return sorted(map(str, (tuple(r) for r in df.drop(*drop).collect())))


@pytest.mark.parametrize("files", [1, 5])
def test_board_over_triggers_equals_its_batch_twin(spark, files):
    rows = _log_rows(400, files)
    batch = spark.createDataFrame(rows, LOG)
    stream, d = _stream(spark, list(rows), LOG, files)
    board = S.updates_to_table(S.board_updates(stream), S.RUN, f"{d}/board", f"{d}/ckpt").cache()
    want = L.latest_point(batch)
    got = S.board_rows(board)
    assert got.columns == want.columns
    # a null model is a run of the board, whose batch twin joins on equal keys only
    assert _plain(got.filter("model is not null").drop("last_eval_loss", "best_eval_loss", "best_eval_step")) == \
        _plain(want.filter("model is not null").drop("last_eval_loss", "best_eval_loss", "best_eval_step"))
    assert _plain(got.filter("model is not null")) == _plain(want.filter("model is not null"))
    points = S.board_points(board).select("model", "setting", "recent_rank", "ord", "step", "loss", "eval_loss", "eta_min")
    last = L.recent_points(batch, S.RECENT).select("model", "setting", F.col("recent_rank").cast("long").alias("recent_rank"),
                                                   "ord", "step", "loss", "eval_loss", "eta_min")
    assert _plain(points) == _plain(last)
    assert got.filter("model = 'quiet'").count() == 0


def test_only_telling_rows_reach_the_state(spark):
    rows = [("m", "s", o, o, f"{o % 7}.5", f"{o % 5}.5" if o % 9 == 0 else "", *["1"] * 7) for o in range(9000)]
    d = L.numeric_log(spark.createDataFrame(rows, LOG).coalesce(1))
    few = d.mapInPandas(S.telling_rows(), d.schema).collect()
    assert len(few) <= S.RECENT + 6
    old = dict.fromkeys(S._names(S.SUMMARY))
    assert S.fold_points(dict(old), [r.asDict() for r in few]) == S.fold_points(dict(old), [r.asDict() for r in d.collect()])


@pytest.mark.parametrize("files", [1, 4])
def test_crash_tails_hold_the_last_lines(spark, files):
    r = random.Random(files)
    rows = [(f"log{r.randrange(3)}", o, f"line {o}" if o % 11 else None, "x", r.random() < 0.1) for o in range(300)]
    schema = "log_file string, ord long, line string, label string, crashed boolean"
    d = tempfile.mkdtemp(prefix="corpuslab-stream-")
    for i in range(files):  # appended in log order, one part a trigger
        size = 300 // files
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.parquet(f"{d}/t/p{i}")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{d}/t/*"))
    got = S.append_to_table(S.crash_tails(stream), f"{d}/out", f"{d}/ckpt").collect()
    want = []
    for name in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == name]
        for k, x in enumerate(own):
            if x[4]:
                tail = own[max(0, k + 1 - S.TAIL):k + 1]
                want += [(x[1], name, "x", len(tail) - i, t[1], t[2]) for i, t in enumerate(tail)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_upsert_twice_gives_the_same_table(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="corpuslab-ver-"), "t")
    schema = "k string, v int"
    S.upsert(spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], schema), d, ("k",))
    batch = spark.createDataFrame([("b", 2), (None, 2), ("c", 2)], schema)
    for _ in range(2):
        S.upsert(batch, d, ("k",))
        assert _plain(V.read(spark, d, schema)) == sorted(map(str, [("a", 1), ("b", 2), (None, 2), ("c", 2)]))


def test_a_reader_always_finds_a_version(spark, monkeypatch):
    d = os.path.join(tempfile.mkdtemp(prefix="corpuslab-ver-"), "t")
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    read = lambda: sorted(r[0] for r in V.read(spark, d, "v int").collect())
    assert V.current(spark, d) is None and read() == []
    V.publish(make(1, 2), d)
    held = spark.read.parquet(V.current(spark, d))
    with pytest.raises(Exception, match="stop"):  # fails while it writes
        V.publish(make(3).select(F.raise_error(F.lit("stop")).cast("int").alias("v")), d)
    assert read() == [1, 2]
    with monkeypatch.context() as m:  # dies before its pointer
        m.setattr(V, "_claim", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            V.publish(make(4), d)
    assert read() == [1, 2]
    with open(os.path.join(d, V.POINTERS, "0000000002"), "w") as f:  # dies inside its pointer
        f.write('{"folder": "data-')
    assert read() == [1, 2]
    V.publish(make(5), d)  # takes the next free number
    assert read() == [5] and sorted(r[0] for r in held.collect()) == [1, 2]
    for i in range(4):
        V.publish(V.read(spark, d, "v int").union(make(10 + i)), d)
    assert read() == [5, 10, 11, 12, 13]
    assert len([n for n in os.listdir(os.path.join(d, V.POINTERS)) if n.isdigit()]) == 2


def test_crash_tails_share_the_keys_of_their_state(spark, monkeypatch):
    """Many logs, one of them without a name, over few keys and two triggers."""
    monkeypatch.setattr(S, "BUCKETS", 3)
    r = random.Random(5)
    rows = [(r.choice([None, *(f"log{i}" for i in range(40))]), o, f"line {o}", "x", r.choice([True, False, False, None])) for o in range(2400)]
    d = tempfile.mkdtemp(prefix="corpuslab-stream-")
    schema = "log_file string, ord long, line string, label string, crashed boolean"
    for i in range(2):
        part = rows[i * 1200:(i + 1) * 1200]
        spark.createDataFrame(r.sample(part, len(part)), schema).coalesce(1).write.parquet(f"{d}/t/p{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/t/*")
    got = S.append_to_table(S.crash_tails(stream), f"{d}/out", f"{d}/ckpt").collect()
    want = []
    for name in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == name]
        for k, x in enumerate(own):
            tail = own[max(0, k + 1 - S.TAIL):k + 1] if x[4] else []
            want += [(x[1], name, "x", len(tail) - i, t[1], t[2]) for i, t in enumerate(tail)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
