"""Registered run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import elapsed_minutes as elapsed_min_col
from corpuslab.operators import reports as R
from corpuslab.operators import runlog as L
from corpuslab.plans import fixtures as X
from corpuslab.plans.registry import query
from corpuslab.plans.report_queries import SECONDS, TIMING_SQL
from corpuslab.plans.sqltext import to_number
from corpuslab.sources import io as IO
from corpuslab.streaming.live import scratch

RUN = ["model", "setting"]
# ---- fixed values -------------------------------------------------------
EFFECTIVE_BATCH = 32      # batch 16 x accumulation 2
PLANNED_STEPS = 250_000
RECENT_N = 15
MEAN_SRC_TOKENS = 24.5    # stand-in: the logs have no texts
# ------------------------------------------------------------------------

NUM = f"""num AS (SELECT *, {to_number('loss')} AS loss_n, {to_number('eval_loss')} AS eval_loss_n,
 {to_number('samples_per_s')} AS sps_n, {to_number('tokens_per_s')} AS tps_n, {to_number('gpu_mem_gb')} AS mem_n FROM loss_log)"""

STATS_SQL = f"""tr AS (SELECT * FROM num WHERE loss_n IS NOT NULL),
 a AS (SELECT model, setting, arg_min(loss_n, ord) AS first, arg_max(loss_n, ord) AS last, min(loss_n) AS min_loss,
   var_samp(loss_n) AS var, stddev_samp(loss_n) AS sd, count(*) AS n_logged_points, avg(sps_n) AS sps, avg(tps_n) AS tps,
   max(mem_n) AS mem FROM tr GROUP BY ALL),
 hit AS (SELECT tr.model, tr.setting, arg_min(tr.step, tr.ord) AS step_to_90pct_reduction FROM tr JOIN a
   ON tr.model = a.model AND tr.setting = a.setting WHERE a.first - a.last > 0 AND tr.loss_n <= a.first - 0.9 * (a.first - a.last)
   GROUP BY ALL),
 ev AS (SELECT model, setting, min(eval_loss_n) AS best, arg_min(step, (eval_loss_n, ord)) AS best_eval_step,
   arg_max(eval_loss_n, ord) AS final_eval, count(*) AS n_evals FROM num WHERE eval_loss_n IS NOT NULL GROUP BY ALL),
 stats AS (SELECT a.model, a.setting, round(first, 4) AS initial_loss, round(last, 4) AS final_loss, round(min_loss, 4) AS min_loss,
   round(first - last, 4) AS loss_reduction, round(var, 6) AS loss_variance, round(sd, 4) AS loss_std,
   hit.step_to_90pct_reduction, n_logged_points, round(sps, 2) AS mean_samples_per_s, round(tps, 1) AS mean_tokens_per_s,
   round(mem, 2) AS peak_gpu_mem_gb, round(best, 4) AS best_eval_loss, ev.best_eval_step, round(final_eval, 4) AS final_eval_loss, ev.n_evals
   FROM a LEFT JOIN hit ON a.model = hit.model AND a.setting = hit.setting
   LEFT JOIN ev ON a.model = ev.model AND a.setting = ev.setting)"""


def _w(*ctes):
    return X.with_ctes(X.LOSS_LOG_SQL, NUM, *ctes)


@query("loss_curve_stats", sql=_w(STATS_SQL) + "SELECT * FROM stats")
def loss_curve_stats(spark, sf):
    """A12 + P8: convergence, stability and plateau statistics per run."""
    return L.loss_curve_stats(X.loss_log(spark, sf))


BOARD_SQL = """, tr AS (SELECT * FROM num WHERE loss_n IS NOT NULL),
 a AS (SELECT model, setting, arg_max((step, loss_n, samples_per_s, tokens_per_s, gpu_mem_gb, epoch, elapsed_min, eta_min), ord) AS p,
   arg_min(loss_n, ord) AS start_loss, min(loss_n) AS min_loss FROM tr GROUP BY ALL),
 ev AS (SELECT model, setting, arg_max(eval_loss_n, ord) AS last_eval_loss, min(eval_loss_n) AS best_eval_loss,
   arg_min(step, (eval_loss_n, ord)) AS best_eval_step FROM num WHERE eval_loss_n IS NOT NULL GROUP BY ALL)
 SELECT a.model, a.setting, p[1] AS step, p[6] AS epoch, round(p[2], 4) AS loss, round(start_loss, 4) AS start_loss,
  round(min_loss, 4) AS min_loss, p[3] AS samples_per_s, p[4] AS tokens_per_s, p[5] AS gpu_mem_gb, p[7] AS elapsed_min, p[8] AS eta_min,
  round(last_eval_loss, 4) AS last_eval_loss, round(best_eval_loss, 4) AS best_eval_loss, best_eval_step
 FROM a LEFT JOIN ev ON a.model = ev.model AND a.setting = ev.setting"""


@query("latest_point", sql=_w() + BOARD_SQL)
def latest_point(spark, sf):
    """The live board's numbers per run, as a batch query."""
    return L.latest_point(X.loss_log(spark, sf))


@query("recent_points", sql=X.with_ctes(X.LOSS_LOG_SQL) + f"""SELECT model, setting, ord, step, loss, eval_loss,
 CAST(recent_rank AS BIGINT) AS recent_rank FROM (SELECT *, row_number() OVER (PARTITION BY model, setting ORDER BY ord DESC) AS recent_rank
 FROM loss_log) WHERE recent_rank <= {RECENT_N}""")
def recent_points(spark, sf):
    """Last 15 logged points per run."""
    r = L.recent_points(X.loss_log(spark, sf), RECENT_N)
    return r.select(*RUN, "ord", "step", "loss", "eval_loss", F.col("recent_rank").cast("long"))


@query("progress_eta", sql=X.with_ctes(X.LOSS_LOG_SQL) + """, f AS (SELECT model, setting, arg_min((ts, step), ord) AS f, max(step) AS planned
 FROM loss_log GROUP BY ALL)
 SELECT l.model, l.setting, l.ord, l.step,
  round((epoch_us(l.ts) - epoch_us(l.f[1])) / 1e6 / 60.0, 2) AS elapsed_min,
  round(sps, 4) AS sec_per_step, round(CASE WHEN sps <> 0 THEN 32.0 / sps END, 2) AS samples_per_s,
  round(CASE WHEN sps <> 0 THEN 32.0 / sps END * 24.5, 1) AS tokens_per_s,
  planned - l.step AS remaining_steps,
  round((planned - l.step) * sps / 60.0, 1) AS eta_min
 FROM (SELECT l.*, f.f, f.planned, CASE WHEN l.step - f.f[2] > 0 THEN (epoch_us(l.ts) - epoch_us(f.f[1])) / 1e6 / (l.step - f.f[2]) END AS sps
  FROM loss_log l JOIN f ON l.model = f.model AND l.setting = f.setting) l""")
def progress_eta(spark, sf):
    """Elapsed time, seconds per step and ETA of every logged point."""
    return L.progress_eta(X.loss_log(spark, sf), effective_batch=EFFECTIVE_BATCH, tokens_per_example=MEAN_SRC_TOKENS)


COSTS_SQL = f"""costs AS (SELECT model, setting, steps, steps * {EFFECTIVE_BATCH} AS examples_seen,
  round(secs / 60.0, 1) AS train_minutes, round(secs / 3600.0, 2) AS train_hours,
  round(secs / greatest(steps, 1), 3) AS sec_per_step, round(steps * {EFFECTIVE_BATCH} / greatest(secs, 1e-6), 2) AS examples_per_sec,
  steps < {PLANNED_STEPS} AS early_stopped, CAST(steps * {EFFECTIVE_BATCH} * {MEAN_SRC_TOKENS} AS BIGINT) AS tokens_seen_approx
 FROM (SELECT model, setting, max(step) AS steps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM loss_log GROUP BY ALL))"""


@query("training_costs", sql=X.with_ctes(X.LOSS_LOG_SQL, COSTS_SQL) + "SELECT * FROM costs")
def training_costs(spark, sf):
    """P17 + P18: examples seen, wall time, per-step cost, early stop flag."""
    return L.training_costs(X.loss_log(spark, sf), EFFECTIVE_BATCH, PLANNED_STEPS, MEAN_SRC_TOKENS)


_REPORT_SQL = f"""report AS (SELECT c.*, s.initial_loss, s.final_loss, s.min_loss, s.loss_reduction, s.loss_variance, s.loss_std,
  s.step_to_90pct_reduction, s.mean_samples_per_s, s.mean_tokens_per_s, s.peak_gpu_mem_gb, s.best_eval_loss, s.best_eval_step,
  s.final_eval_loss, s.n_evals, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS DOUBLE) AS epochs_requested,
  CAST(NULL AS DOUBLE) AS epochs_completed, {PLANNED_STEPS} AS max_steps_planned, c.steps > {PLANNED_STEPS} AS extended,
  s.n_logged_points AS n_train, CAST(NULL AS BIGINT) AS n_dev, {EFFECTIVE_BATCH} AS effective_batch,
  CAST({MEAN_SRC_TOKENS} AS DOUBLE) AS mean_src_tokens, CAST(NULL AS DOUBLE) AS "trainable_params_M", 'fp32' AS precision,
  s.final_loss AS train_loss FROM costs c JOIN stats s ON c.model = s.model AND c.setting = s.setting)"""


def _training_rows(log):
    """The runs' training records from their logs; what a log does not tell is
    not in the record."""
    c = L.training_costs(log, EFFECTIVE_BATCH, PLANNED_STEPS, MEAN_SRC_TOKENS)
    s = L.loss_curve_stats(log).withColumnRenamed("n_logged_points", "n_train")
    return c.join(s, RUN).withColumns({
        "max_steps_planned": F.lit(PLANNED_STEPS), "extended": F.col("steps") > PLANNED_STEPS,
        "effective_batch": F.lit(EFFECTIVE_BATCH), "mean_src_tokens": F.lit(MEAN_SRC_TOKENS),
        "precision": F.lit("fp32"), "train_loss": F.col("final_loss")})


def _training_records(spark, sf):
    """S6 over the runs' training records, which are written from the logs first (K3)."""
    root = scratch(spark, "train_metrics")
    IO.write_nested(_training_rows(X.loss_log(spark, sf)), root, partition_by=tuple(RUN))
    return IO.read_run_json(spark, root, "", L.TRAINING_FIELDS, layout="hive")


@query("training_report", sql=_w(STATS_SQL, COSTS_SQL, _REPORT_SQL) + "SELECT * FROM report")
def training_report(spark, sf):
    """One row per trained run with all fields of its training record,
    read from per-run JSON; untrained runs are omitted."""
    return L.training_report(_training_records(spark, sf))


@query("stack_curves", sql=X.with_ctes(X.LOSS_LOG_SQL) + """SELECT model, setting, ord, step, loss, NULL AS eval_loss FROM loss_log WHERE loss <> ''
 UNION ALL SELECT model, setting, ord, step, NULL, eval_loss FROM loss_log WHERE loss = ''""")
def stack_curves(spark, sf):
    """Per-run training and evaluation logs (different columns) stacked."""
    log = X.loss_log(spark, sf)
    return R.stack_frames([log.filter(F.col("loss") != "").select(*RUN, "ord", "step", "loss"),
                           log.filter(F.col("loss") == "").select(*RUN, "ord", "step", "eval_loss")])


PAIR_SQL = """ls AS (SELECT log_file, arg_max((ord, ts, label), ord) AS s FROM run_index WHERE event = 'started' GROUP BY ALL),
 done AS (SELECT f.log_file, arg_max((f.status, f.duration_min), f.ord) AS f FROM run_index f JOIN ls ON f.log_file = ls.log_file
   WHERE f.event = 'finished' AND f.ord > ls.s[1] GROUP BY ALL),
 paired AS (SELECT ls.s[1] AS ord, ls.s[2] AS ts, ls.log_file, substr(ls.s[3], 1, 28) AS label,
   coalesce(nullif(done.f[2], ''), '-') AS duration_min, coalesce(nullif(done.f[1], ''), 'running') AS status
   FROM ls LEFT JOIN done ON ls.log_file = done.log_file)"""


@query("pair_run_events", sql=X.with_ctes(X.RUN_INDEX_SQL, PAIR_SQL) + "SELECT ord, epoch_us(ts) AS ts_us, log_file, label, duration_min, status FROM paired")
def pair_run_events(spark, sf):
    """Every invocation with its outcome; unfinished ones are 'running'."""
    p = L.pair_run_events(X.run_index(spark, sf))
    return p.select("ord", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "log_file", "label",
                    "duration_min", "status")


@query("elapsed_minutes", sql=X.with_ctes(X.RUN_INDEX_SQL) + """, ls AS (SELECT log_file, arg_max((ord, ts), ord) AS s FROM run_index
 WHERE event = 'started' GROUP BY ALL)
 SELECT ls.log_file, round((epoch_us(arg_max(f.ts, f.ord)) - epoch_us(ls.s[2])) / 6e7, 2) AS elapsed_min
 FROM run_index f JOIN ls ON f.log_file = ls.log_file WHERE f.event = 'finished' AND f.ord > ls.s[1] GROUP BY ls.log_file, ls.s""")
def elapsed_minutes(spark, sf):
    """Wall minutes from an invocation's start to its last finish event."""
    idx = X.run_index(spark, sf)
    ls = idx.filter(F.col("event") == "started").groupBy("log_file").agg(F.max_by(F.struct("ord", "ts"), "ord").alias("s"))
    f = idx.filter(F.col("event") == "finished").join(ls, "log_file").filter(F.col("ord") > F.col("s.ord"))
    g = f.groupBy("log_file").agg(F.max_by("ts", "ord").alias("end"), F.first("s").alias("s"))
    return g.select("log_file", elapsed_min_col(F.col("s.ts").cast("timestamp"), F.col("end").cast("timestamp")).alias("elapsed_min"))


def run_folders(spark, sf, root):
    """Stand-in run folders, written from the tables. Every run of the
    predictions has outputs, all but the sweep are scored, and one run's outputs
    have no column of outputs. Of the training runs m0 has its record, m2 only
    its end mark, m1 neither, and m3 has left a crash log."""
    pred, log = X.predictions(spark, sf, told=True), X.loss_log(spark, sf)
    own = lambda df, mode="overwrite": df.write.mode(mode).partitionBy(*RUN)
    rows = pred.select(*RUN, F.col("doc_id").cast("string").alias("gid"), "language", "english", "hyp")
    broken = (F.col("model") == "m2") & (F.col("setting") == "ft_a")
    with IO.unsorted_folders(spark):
        IO.tight(IO.csv_writer(own(rows.filter(~broken)))).csv(f"{root}/{L.PREDICTIONS}")
        IO.tight(IO.csv_writer(own(rows.filter(broken).withColumnRenamed("hyp", "output"), "append"))).csv(f"{root}/{L.PREDICTIONS}")
    scored = pred.filter("setting <> 'sweep'").groupBy(*RUN).agg(F.count_if("has_hyp").alias("n"))
    IO.write_nested(scored, f"{root}/{L.METRICS}", partition_by=tuple(RUN))
    own(log.filter("model = 'm3' and loss = 'nan'").select(*RUN, F.concat_ws(" ", "step", "loss").alias("value"))).text(
        f"{root}/{L.CRASH_LOG}")
    own(log.filter("model = 'm2'").select(*RUN).distinct().withColumn("value", F.lit("done"))).text(f"{root}/{L.DONE}")
    env = log.select(*RUN).distinct().select(*RUN, F.concat(F.lit("node"), "model").alias("hostname"), F.array(F.struct(
        F.concat(F.lit("gpu"), F.regexp_extract("model", "[0-9]+", 0)).alias("name"))).alias("gpus"), F.lit("2").alias("torch"))
    IO.write_nested(env, f"{root}/{L.ENVIRONMENT}", partition_by=tuple(RUN))
    IO.write_nested(_training_rows(log).filter("model = 'm0'"), f"{root}/{L.TRAINING}", partition_by=tuple(RUN))
    timing = L.group_timing(pred.withColumn("seconds", F.expr(SECONDS)), "seconds")
    IO.write_nested(L.inference_rollup(timing), f"{root}/{L.INFERENCE}", partition_by=tuple(RUN))


MANIFEST_SQL = f"""runs AS (SELECT DISTINCT model, setting FROM predictions UNION SELECT DISTINCT model, setting FROM loss_log),
 pc AS (SELECT model, setting, count(*) AS n FROM predictions GROUP BY ALL),
 tl AS (SELECT model, setting, count(*) FILTER (WHERE loss = 'nan') AS bad FROM loss_log GROUP BY model, setting),
 roll AS (SELECT model, setting, round(sum(seconds) / 60.0, 2) AS infer_minutes,
   round(sum(n_items) / greatest(sum(seconds), 1e-6), 2) AS sent_per_sec FROM timing GROUP BY ALL),
 m AS (SELECT r.model, r.setting, pc.n IS NOT NULL AS has_pred, tl.model IS NOT NULL AND r.model IN ('m0', 'm2') AS trained, tl.model IS NOT NULL AS logged,
   pc.n IS NOT NULL AND r.setting <> 'sweep' AS has_metrics, coalesce(r.model = 'm3' AND tl.bad > 0, false) AS crashed,
   r.model = 'm2' AND r.setting = 'ft_a' AS broken,
   coalesce(pc.n, 0) AS n_pred, p.train_minutes, p.epochs_completed, p.train_loss, p.mode AS ft_mode, p.n_train,
   roll.infer_minutes, roll.sent_per_sec
   FROM runs r LEFT JOIN pc ON r.model = pc.model AND r.setting = pc.setting
   LEFT JOIN tl ON r.model = tl.model AND r.setting = tl.setting
   LEFT JOIN report p ON r.model = p.model AND r.setting = p.setting AND r.model = 'm0'
   LEFT JOIN roll ON r.model = roll.model AND r.setting = roll.setting)
 SELECT model, setting,
  CASE WHEN has_pred AND NOT has_metrics THEN 'outputs not scored yet' WHEN crashed THEN 'CRASHED'
   WHEN NOT has_pred THEN CASE WHEN trained THEN 'trained, no outputs yet' ELSE 'no outputs' END
   WHEN broken THEN 'outputs cannot be read' ELSE 'ok' END AS status,
  CASE WHEN crashed OR broken THEN 0 ELSE n_pred END AS n_predictions,
  CASE WHEN logged THEN 'node' || model ELSE '' END AS hostname,
  CASE WHEN logged THEN 'gpu' || regexp_extract(model, '[0-9]+') ELSE '' END AS gpu,
  CASE WHEN logged THEN '2' ELSE '' END AS torch, '' AS transformers, train_minutes, epochs_completed, train_loss, ft_mode, n_train,
  infer_minutes, sent_per_sec, model || '/' || setting AS path FROM m"""


@query("run_manifest", sql=X.with_ctes(X.PREDICTIONS_SQL, X.LOSS_LOG_SQL, NUM, STATS_SQL, COSTS_SQL, _REPORT_SQL, TIMING_SQL, MANIFEST_SQL))
def run_manifest(spark, sf):
    """J9 + P12 + P13: one row per run folder: its state from the files it has,
    its rows counted from its outputs, the rest from its records (per-run JSON)."""
    root = scratch(spark, "runs")
    run_folders(spark, sf, root)
    pred = IO.read_predictions(spark, f"{root}/{L.PREDICTIONS}", ["gid"], layout="hive")
    record = lambda name, fields: IO.read_run_json(spark, f"{root}/{name}", "", fields, layout="hive")
    return L.run_manifest(
        L.run_state(IO.run_listing(spark, root, "hive")), pred.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")),
        IO.unreadable_runs(spark, f"{root}/{L.PREDICTIONS}", layout="hive"), record(L.ENVIRONMENT, L.ENVIRONMENT_FIELDS),
        record(L.TRAINING, L.TRAINING_FIELDS), record(L.INFERENCE, L.INFERENCE_FIELDS))


@query("needs_attention_runs", sql=X.with_ctes(X.RUN_INDEX_SQL, PAIR_SQL) + """SELECT ord, log_file, label, status FROM paired
 WHERE status NOT IN ('ok', 'running')""")
def needs_attention_runs(spark, sf):
    """L4: invocations that finished with a status other than ok."""
    p = L.pair_run_events(X.run_index(spark, sf))
    return R.needs_attention(p, ~F.col("status").isin("ok", "running")).select("ord", "log_file", "label", "status")
