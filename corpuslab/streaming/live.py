"""Structured Streaming views of live runs.

The reference polls log files; here the logs are a streaming source
(``readStream`` over a folder of appended files) and each view is a
streaming query. Aggregation state is bounded by the number of runs / log files, so no
watermark is needed. Every query has a batch twin in ``corpuslab.operators``
that gives the same rows.

* T1 ``board_updates``   — keyed state (``transformWithState``): per run latest
  point, start / min loss, best eval and the last 15 points; a trigger sends only
  the runs it touched, which ``upsert`` merges into a versioned table.
* T2 ``run_index_state`` — per log file last start + last finish, in update mode,
  merged the same way; a run with no later finish is 'running' immediately (not a
  stream-stream join).
* T3 ``incremental_predict`` — foreachBatch: anti-join against what is
  already written, predict, write under ``batch=<id>`` (idempotent replay).
* T4 ``incremental_scores``  — foreachBatch: per-group statistic sums per
  micro-batch under ``batch=<id>``; readers sum them (additive, exact).
* T5 ``crash_feed``       — append-mode filter on failed finishes;
  ``crash_tails`` keeps the last lines of every log file as keyed state and sends
  them when a run crashes.

Readers of a versioned table always find its last complete version
(``sources/versions.py``).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpuslab.operators.runlog import board_columns, numeric_log
from corpuslab.session import checkpoint_dir
from corpuslab.sources import versions

RUN = ("model", "setting")
RECENT = 15      # points of a run that the board shows
TAIL = 20        # lines of a crashed run's log
BUCKETS = 1024   # keys of the state of crash_tails


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A table's own files as a stream, nothing is copied. A table is a folder
    of files, or one file, which the glob filter picks out of its folder."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hpath).isFile()
    r = (spark.readStream.schema(spark.read.parquet(path).schema)
         .option("maxFilesPerTrigger", files_per_batch))
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else r.parquet(path)


# ---- T1: the live board ---------------------------------------------------

POINT = ("ord long, step long, epoch string, loss string, eval_loss string, lr string, samples_per_s string, "
         "eta_min string")
#: What the state keeps of a run besides its last points; ``p_`` is the latest training point.
SUMMARY = ("p_ord long, p_step long, p_epoch string, p_loss double, p_samples_per_s string, p_tokens_per_s string, "
           "p_gpu_mem_gb string, p_elapsed_min string, p_eta_min string, start_ord long, start_loss double, min_loss double, "
           "eval_ord long, last_eval_loss double, best_eval_loss double, best_eval_ord long, best_eval_step long")
BOARD = f"model string, setting string, {SUMMARY}, recent array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def telling_rows(keys=RUN, recent: int = RECENT):
    """Of each batch of log rows only those that the board can show: per run the
    first, last and smallest loss, the last and best evaluation and the last
    points. A run with most of the rows sends a few dozen a batch to its state."""
    keys = list(keys)

    def run(frames):
        import pandas as pd

        for f in frames:
            if f.empty:
                continue
            f = f.sort_values("ord", ignore_index=True)
            by = lambda rows: rows.groupby(keys, sort=False, dropna=False)
            keep = by(f).tail(recent).index
            for c in ("loss_n", "eval_loss_n"):
                own = f[f[c].notna()]
                if len(own):
                    ends = by(own).head(1).index.union(by(own).tail(1).index)
                    keep = keep.union(ends).union(pd.Index(by(own)[c].idxmin()))
            yield f.loc[keep]
    return run


class RunBoard(StatefulProcessor):
    """State of one run: its summary and its last points."""

    def init(self, handle) -> None:
        self.summary = handle.getValueState("summary", SUMMARY)
        self.recent = handle.getListState("recent", POINT)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = pd.concat(list(rows)).sort_values("ord")
        new = new.astype(object).where(new.notna(), None)
        old = self.summary.get() if self.summary.exists() else [None] * len(_names(SUMMARY))
        s = fold_points(dict(zip(_names(SUMMARY), old)), new.to_dict("records"))
        self.summary.update(tuple(s.values()))
        points = [tuple(p) for p in self.recent.get()] if self.recent.exists() else []
        points += list(new[_names(POINT)].itertuples(index=False, name=None))
        points = sorted(points)[-RECENT:]
        self.recent.put(points)
        yield pd.DataFrame([{"model": key[0], "setting": key[1], **s,
                             "recent": [dict(zip(_names(POINT), p)) for p in points]}])

    def close(self) -> None:
        pass


def fold_points(s: dict, rows: list[dict]) -> dict:
    """The summary after more log rows, in any order."""
    for r in rows:
        o, loss, ev = r["ord"], r["loss_n"], r["eval_loss_n"]
        if loss is not None:
            if s["p_ord"] is None or o > s["p_ord"]:
                s.update({"p_ord": o, "p_loss": loss, **{f"p_{c}": r[c] for c in (
                    "step", "epoch", "samples_per_s", "tokens_per_s", "gpu_mem_gb", "elapsed_min", "eta_min")}})
            if s["start_ord"] is None or o < s["start_ord"]:
                s.update(start_ord=o, start_loss=loss)
            s["min_loss"] = loss if s["min_loss"] is None else min(loss, s["min_loss"])
        if ev is not None:
            if s["eval_ord"] is None or o > s["eval_ord"]:
                s.update(eval_ord=o, last_eval_loss=ev)
            if s["best_eval_loss"] is None or (ev, o) < (s["best_eval_loss"], s["best_eval_ord"]):
                s.update(best_eval_loss=ev, best_eval_ord=o, best_eval_step=r["step"])
    return s


def board_updates(log: DataFrame) -> DataFrame:
    """A stream of training-log rows as a stream of board rows (``BOARD``),
    one for every run that a trigger touched."""
    rows = numeric_log(log).select(*RUN, *dict.fromkeys(_names(POINT) + [
        "tokens_per_s", "gpu_mem_gb", "elapsed_min", "loss_n", "eval_loss_n"]))
    few = rows.mapInPandas(telling_rows(), rows.schema)
    return few.groupBy(*RUN).transformWithStateInPandas(RunBoard(), BOARD, "Update", "None")


def board_rows(board: DataFrame, keys=RUN) -> DataFrame:
    """The board of runs that have a training point."""
    seen = board.filter(F.col("p_ord").isNotNull())
    return seen.select(*keys, *board_columns(lambda c: F.col(f"p_{c}"), F.col("p_loss")))


def board_points(board: DataFrame, keys=RUN) -> DataFrame:
    """The last points of every run, newest first (rank 1)."""
    at = F.posexplode(F.reverse("recent")).alias("at", "point")
    points = board.select(*keys, at)
    return points.select(*keys, (F.col("at") + 1).cast("long").alias("recent_rank"), "point.*")


# ---- T2: the run index ------------------------------------------------------

def run_index_state(stream: DataFrame) -> DataFrame:
    """Per log file the latest start and the latest finish (by log order)."""
    st = F.col("event") == "started"
    fin = F.col("event") == "finished"
    return stream.groupBy("log_file").agg(
        F.max_by(F.struct("ord", "ts", "label"), F.when(st, F.col("ord"))).alias("s"),
        F.max_by(F.struct("ord", "status", "duration_min"), F.when(fin, F.col("ord"))).alias("f"))


def run_index_rows(state: DataFrame, label_len: int = 28) -> DataFrame:
    """Current state per invocation: a finish logged after the latest start
    completes it, otherwise 'running'; orphan finishes are dropped."""
    after = F.col("f.ord") > F.col("s.ord")
    return state.filter(F.col("s").isNotNull()).select(
        F.col("s.ord").alias("ord"), F.unix_micros(F.col("s.ts").cast("timestamp")).alias("ts_us"), "log_file",
        F.substring("s.label", 1, label_len).alias("label"),
        F.when(after & (F.col("f.duration_min") != ""), F.col("f.duration_min")).otherwise(F.lit("-")).alias("duration_min"),
        F.when(after & (F.col("f.status") != ""), F.col("f.status")).otherwise(F.lit("running")).alias("status"))


def crash_feed(stream: DataFrame) -> DataFrame:
    """T5: failed finishes, as they arrive."""
    return stream.filter((F.col("event") == "finished") & (F.col("status") == "FAILED")).select(
        "ord", "log_file", "label", "status")


class LogTail(StatefulProcessor):
    """State of a bucket of log files: the last lines of each. Rows of a trigger
    are taken in log order; a crash sends the lines up to and with its own."""

    def init(self, handle) -> None:
        self.lines = handle.getListState("lines", "log_file string, ord long, line string")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        new = pd.concat(list(rows), ignore_index=True)
        old = list(self.lines.get()) if self.lines.exists() else []
        log = np.array([x[0] for x in old] + new["log_file"].tolist(), dtype=object)
        at = np.array([x[1] for x in old] + new["ord"].astype("Int64").astype(object).where(new["ord"].notna(), None).tolist(), dtype=object)
        line = np.array([x[2] for x in old] + new["line"].tolist(), dtype=object)
        label = np.array([None] * len(old) + new["label"].tolist(), dtype=object)
        crashed = np.array([False] * len(old) + [x is not None and x == True for x in new["crashed"]], dtype=bool)  # noqa: E712
        of = pd.factorize(log, use_na_sentinel=False)[0]
        # what was kept stays before what is new
        place = np.empty(len(log), dtype=np.int64)
        place[len(old) + np.argsort(new["ord"].to_numpy(), kind="stable")] = len(old) + np.arange(len(new))
        place[:len(old)] = np.arange(len(old))
        order = np.lexsort((place, of))
        log, at, line, label, crashed, of = (x[order] for x in (log, at, line, label, crashed, of))
        first = np.searchsorted(of, of)                 # a log's first line
        end = np.searchsorted(of, of, side="right")
        here = np.arange(len(of))
        ends = np.flatnonzero(crashed)
        n = np.minimum(ends - first[ends] + 1, TAIL)
        crash = np.repeat(ends, n)
        from_end = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum()))
        shown = crash - from_end + 1
        kept = np.flatnonzero(end - here <= TAIL)
        self.lines.put(list(zip(log[kept], at[kept], line[kept])))
        yield pd.DataFrame({"ord": pd.array(at[crash], dtype="Int64"), "log_file": log[crash], "label": label[crash],
                            "from_end": from_end.astype(np.int32), "line_ord": pd.array(at[shown], dtype="Int64"), "line": line[shown]})

    def close(self) -> None:
        pass


def crash_tails(lines: DataFrame) -> DataFrame:
    """T5: the last lines of every crashed run, when it crashes. ``lines``: a
    stream (log_file, ord, line, label, crashed). Logs are keyed by ``BUCKETS`` hash
    buckets, as every key costs calls between the state store and Python. A
    bucket's lines of one trigger are held in memory while they are put in order;
    the state is ``TAIL`` lines a log."""
    schema = "ord long, log_file string, label string, from_end int, line_ord long, line string"
    return (lines.select(F.pmod(F.xxhash64("log_file"), F.lit(BUCKETS)).alias("bucket"), "log_file", "ord", "line", "label", "crashed")
            .groupBy("bucket").transformWithStateInPandas(LogTail(), schema, "Append", "None"))


# ---- running a stream over everything available -----------------------------

@contextmanager
def keyed_state(spark: SparkSession):
    """While a stream with keyed state starts: the state store that it needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append_to_table(sdf: DataFrame, path: str, ckpt: str) -> DataFrame:
    """Run an append-mode query over everything available into Parquet files
    (the file sink's log makes a replayed batch count once)."""
    with keyed_state(sdf.sparkSession):
        q = (sdf.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)


def upsert(batch: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Rows of ``batch`` replace those of the same key in the versioned table.
    Merging a batch twice gives the same table."""
    old = versions.read(batch.sparkSession, path, batch.schema)
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(batch.select(*keys).alias("n"), same, "left_anti")
    versions.publish(kept.unionByName(batch), path)


def updates_to_table(sdf: DataFrame, keys: tuple[str, ...], path: str, ckpt: str) -> DataFrame:
    """Run an update-mode query over everything available; each trigger's rows
    are merged into the versioned table ``path``. Nothing passes the driver."""
    with keyed_state(sdf.sparkSession):
        q = (sdf.writeStream.foreachBatch(lambda df, _: upsert(df, path, keys)).outputMode("update")
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    return versions.read(sdf.sparkSession, path, sdf.schema)


def foreach_batch_to(sdf: DataFrame, fn, ckpt: str) -> None:
    """Run ``fn(batch_df, batch_id)`` over everything available."""
    q = (sdf.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
