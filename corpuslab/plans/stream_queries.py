"""Registered streaming queries (T1-T5); each oracle is the batch twin's SQL.

``readStream`` reads the tables' own files (availableNow); the stand-in views
are part of the stream. State and outputs go to tables in the shared checkpoint
folder, and the finished result is returned.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import blank_trim
from corpuslab.operators import inference as I
from corpuslab.operators import metrics as M
from corpuslab.operators.layout import spread
from corpuslab.plans import fixtures as X
from corpuslab.plans import runlog_queries as RQ
from corpuslab.plans import score_queries as SQ
from corpuslab.plans.inference_queries import EARLIER, _earlier
from corpuslab.plans.registry import query
from corpuslab.plans.sqltext import bt
from corpuslab.sources import io as IO
from corpuslab.streaming import live as S
from corpuslab.streaming import saves as SV


def _board(spark, sf):
    stream = X.loss_log(spark, sf, S.table_stream(spark, sf, "events"))
    return S.updates_to_table(S.board_updates(stream), S.RUN, S.scratch(spark, "board"), S.scratch(spark, "ckpt"))


@query("live_training_board", sql=X.with_ctes(X.LOSS_LOG_SQL, RQ.NUM) + RQ.BOARD_SQL)
def live_training_board(spark, sf):
    """Live board over a replayed training-log stream (keyed state, updates)."""
    return S.board_rows(_board(spark, sf))


@query("live_recent_points", sql=X.with_ctes(X.LOSS_LOG_SQL) + f"""SELECT * FROM (SELECT model, setting, ord, step, epoch, loss, eval_loss,
 lr, samples_per_s, eta_min, row_number() OVER (PARTITION BY model, setting ORDER BY ord DESC) AS recent_rank FROM loss_log)
 WHERE recent_rank <= {S.RECENT}""")
def live_recent_points(spark, sf):
    """The last points of every run, from the same state as the board."""
    return S.board_points(_board(spark, sf))


@query("live_run_index", sql=X.with_ctes(X.RUN_INDEX_SQL, RQ.PAIR_SQL)
       + "SELECT ord, epoch_us(ts) AS ts_us, log_file, label, duration_min, status FROM paired")
def live_run_index(spark, sf):
    """Current state per invocation from a replayed run-index stream."""
    stream = X.run_index(spark, sf, S.table_stream(spark, sf, "events"))
    state = S.updates_to_table(S.run_index_state(stream), ("log_file",), S.scratch(spark, "run_index"), S.scratch(spark, "ckpt"))
    return S.run_index_rows(state)


@query("live_index_lines", sql=X.with_ctes(X.RUN_INDEX_SQL, RQ.PAIR_SQL) + """SELECT ord, epoch_us(date_trunc('second', ts)) AS ts_us, log_file,
 label, duration_min, status FROM paired""")
def live_index_lines(spark, sf):
    """S8 as a stream, then T2: the index as appended CSV files, all lines of
    which are replayed once; a line's number stands in its command."""
    folder = S.scratch(spark, "index")
    lines = X.run_index(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event", F.lit("infer").alias("script"), "label", "duration_min",
        "status", "log_file", F.lit("").alias("run_dir"), F.concat(F.lit("line "), "ord").alias("command"))
    IO.append_events(lines, folder)
    IO.append_events(lines, folder)
    # the stand-in's lines span a month and are not appended in their order
    stream = IO.read_run_index(spark, folder, stream=True, watermark="62 days")
    stream = stream.withColumn("ord", F.regexp_extract("command", "([0-9]+)$", 1).cast("long"))
    state = S.updates_to_table(S.run_index_state(stream), ("log_file",), S.scratch(spark, "run_index"), S.scratch(spark, "ckpt"))
    return S.run_index_rows(state)


@query("saved_predictions", sql=X.with_ctes(X.ITEMS_DONE_SQL) + """SELECT doc_id, concat('new ', lang) AS hyp FROM items_done""")
def saved_predictions(spark, sf):
    """F1 with K4: a batch function over all items, saved every few batches."""
    items = X.items_done(spark, sf).select("doc_id", "lang")
    fn = lambda: lambda texts: [f"new {t}" for t in texts]
    run = lambda batch: I.predict_batches(batch, fn, "lang", ["doc_id"], 32)
    return SV.predict_with_saves(items, run, "doc_id", S.scratch(spark, "saves"), S.scratch(spark, "job"), PARTIAL).select("doc_id", "hyp")


@query("crash_feed", sql=X.with_ctes(X.RUN_INDEX_SQL) + """SELECT ord, log_file, label, status FROM run_index
 WHERE event = 'finished' AND status = 'FAILED'""")
def crash_feed(spark, sf):
    """T5: failed invocations as an append-mode stream."""
    stream = X.run_index(spark, sf, S.table_stream(spark, sf, "events"))
    return S.append_to_table(S.crash_feed(stream), S.scratch(spark, "crashes"), S.scratch(spark, "ckpt"))


@query("crash_tails", sql=X.with_ctes(X.LOG_LINES_SQL) + f""", n AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY ord) AS at FROM log_lines)
 SELECT c.ord, c.log_file, c.label, CAST(c.at - l.at + 1 AS INTEGER) AS from_end, l.ord AS line_ord, l.line
 FROM n c JOIN n l ON l.log_file = c.log_file AND l.at BETWEEN c.at - {S.TAIL - 1} AND c.at WHERE c.crashed""")
def crash_tails(spark, sf):
    """T5: the last lines of every crashed run, from a replayed stream of log lines."""
    stream = X.log_lines(spark, sf, S.table_stream(spark, sf, "events"))
    return S.append_to_table(S.crash_tails(stream), S.scratch(spark, "tails"), S.scratch(spark, "ckpt"))


@query("incremental_predict", sql=X.with_ctes(X.ITEMS_DONE_SQL, EARLIER) + f"""SELECT doc_id, hyp FROM earlier WHERE {bt('hyp')} <> ''
 UNION ALL SELECT doc_id, concat('new ', lang) AS hyp FROM items_done
 WHERE doc_id NOT IN (SELECT doc_id FROM earlier WHERE {bt('hyp')} <> '')""")
def incremental_predict(spark, sf):
    """Items arrive as a stream; each micro-batch predicts only items that
    have no non-blank output from another batch yet and replaces its own
    folder, so a replayed batch writes the same rows again."""
    out = S.scratch(spark, "predictions")
    IO.append_partial(_earlier(spark, sf).filter(blank_trim("hyp") != "").select("doc_id", "hyp"), out, -1)
    stream = X.items_done(spark, sf, S.table_stream(spark, sf, "documents")).select("doc_id", "lang")
    replayed = []

    def step(batch, batch_id):
        predict_step(batch, batch_id, out)
        if not replayed:  # the first batch is delivered twice, as after a crash
            replayed.append(batch_id)
            predict_step(batch, batch_id, out)

    S.foreach_batch_to(stream, step, S.scratch(spark, "ckpt"))
    return IO.read_partials(spark, out, PARTIAL).select("doc_id", "hyp")


PARTIAL = "doc_id long, hyp string"


def predict_step(batch, batch_id, out):
    """One micro-batch of T3."""
    done = IO.read_partials(batch.sparkSession, out, PARTIAL, except_batch=batch_id)
    pend = I.pending_items(batch, done, "doc_id")
    IO.append_partial(pend.select("doc_id", F.concat(F.lit("new "), "lang").alias("hyp")), out, batch_id)


INCR_SQL = SQ._w(SQ.CHRF_LONG, SQ.BLEU_SEG) + f""", c AS MATERIALIZED (SELECT model, setting, language, round(score, 2) AS "chrf++" FROM
 {SQ.sql_chrf_from_long("(SELECT model, setting, language, o, sum(hh) AS H, sum(rr) AS R, sum(mm) AS M FROM clong GROUP BY ALL)", "model, setting, language")}),
 b AS MATERIALIZED (SELECT model, setting, language, round({SQ.sql_bleu()}, 2) AS "BLEU" FROM
 (SELECT model, setting, language, sum(sys_len) AS sys_len, sum(ref_len) AS ref_len,
  {", ".join(f"sum(m{n}) AS m{n}, sum(t{n}) AS t{n}" for n in range(1, 5))} FROM bseg GROUP BY ALL))
 SELECT c.model, c.setting, c.language, c."chrf++", b."BLEU" FROM c JOIN b ON c.model = b.model AND c.setting = b.setting AND c.language = b.language"""


@query("incremental_scores", sql=INCR_SQL)
def incremental_scores(spark, sf):
    """T4: predictions arrive as a stream; each micro-batch adds its summed
    chrF++/BLEU statistics per (model, setting, language) under batch=<id>;
    the corpus scores are the formula over the sum of all batches (exact)."""
    out = S.scratch(spark, "stat_sums")
    stream = S.table_stream(spark, sf, "documents").select("doc_id", "lang", "text")

    def step(batch, batch_id):
        pred = X.predictions(spark, sf, spread(batch, "doc_id"))
        st = M.segment_stats(pred, rouge=False, segment_keys=("doc_id",))
        sums = st.groupBy(*SQ.KEYS).agg(*M.stat_sums("chrf_st", M.N_CHRF, "c"), *M.stat_sums("bleu_st", M.N_BLEU, "b"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    S.foreach_batch_to(stream, step, S.scratch(spark, "ckpt"))
    parts = spark.read.parquet(out)
    cols = [f"c{i}" for i in range(M.N_CHRF)] + [f"b{i}" for i in range(M.N_BLEU)]
    tot = parts.groupBy(*SQ.KEYS).agg(*[F.sum(c).alias(c) for c in cols])
    return tot.select(*SQ.KEYS, F.round(M.chrf_score("c"), 2).alias("chrf++"), F.round(M.bleu_score("b"), 2).alias("BLEU"))
