"""Partial saves of inference (K4, F1) and the index as a stream."""

import os
import signal
import tempfile

from corpuslab.operators import inference as I
from corpuslab.sources import io as IO
from corpuslab.streaming import live as S
from corpuslab.streaming import saves as SV

SCHEMA = "gid long, hyp string"


def _job(flag):
    """A batch function that kills its own worker process at item 'boom', once."""
    def make():
        def fn(texts):
            again = os.path.exists(flag)
            if "boom" in texts and not again:
                open(flag, "w").close()
                os.kill(os.getpid(), signal.SIGKILL)
            return [f"{t}/{2 if again else 1}" for t in texts]
        return fn
    return lambda df: I.predict_batches(df, make, "text", ["gid"], 4)


def test_a_killed_task_loses_few_batches(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-saves-")
    out, flag = f"{d}/out", f"{d}/flag"
    rows = [(i, "boom" if i == 137 else f"t{i}") for i in range(200)]
    items = spark.createDataFrame(rows, "gid long, text string").coalesce(1)
    run = lambda work: SV.predict_with_saves(items, _job(flag), "gid", out, f"{d}/{work}", SCHEMA,
                                             batch_size=4, save_every=3, files_per_trigger=2)
    try:
        run("job1")
        raise AssertionError("the killed worker should have ended the job")
    except Exception:
        assert os.path.exists(flag)
    first = {r["gid"] for r in SV.read_saves(spark, out, SCHEMA).collect()}
    # every trigger holds 2 files of 3 batches of 4; the one with 'boom' was lost
    assert 137 not in first and len(first) % 24 == 0 and len(first) >= 96
    done = {r["gid"]: r["hyp"] for r in run("job1").collect()}
    assert set(done) == set(range(200))
    assert {g for g, h in done.items() if h.endswith("/1")} == first  # saved rows were not computed again
    assert {r["gid"]: r["hyp"] for r in run("job2").collect()} == done  # another job finds all done


def test_blank_outputs_are_redone_by_another_job(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-saves-")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "gid long, text string")
    say = lambda word: lambda df: I.predict_batches(df, lambda: lambda ts: [word if t == "b" else t for t in ts], "text", ["gid"])
    go = lambda work, word: sorted(tuple(r)[:2] for r in SV.predict_with_saves(
        items, say(word), "gid", f"{d}/out", f"{d}/{work}", SCHEMA).collect())
    assert go("j1", " ") == [(1, "a")]
    assert go("j2", "x") == [(1, "a"), (2, "x")]
    assert go("j3", "y") == [(1, "a"), (2, "x")]
    assert SV.predict_with_saves(items.limit(0), say("x"), "gid", f"{d}/none", f"{d}/j4", SCHEMA).count() == 0


def test_replayed_index_lines_count_once(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-index-")
    cols = IO.RUN_INDEX_COLUMNS
    line = lambda ts, ev, n: (f"2024-01-0{ts}", ev, "infer", "lbl", "", "", "log1", "", f"a, \"b\" {n}")
    schema = ", ".join(f"{c} string" for c in cols)
    old = [line("1 00:00:00", "started", 1), line("1 01:00:00", "finished", 2)]
    IO.append_events(spark.createDataFrame(old, schema), f"{d}/i")
    IO.append_events(spark.createDataFrame([*old, line("1 02:00:00", "started", 3)], schema), f"{d}/i")
    stream = IO.read_run_index(spark, f"{d}/i", stream=True, watermark="1 day")
    got = S.append_to_table(stream, f"{d}/out", f"{d}/ckpt").collect()
    assert sorted((r["event"], r["command"]) for r in got) == [("finished", 'a, "b" 2'), ("started", 'a, "b" 1'), ("started", 'a, "b" 3')]
