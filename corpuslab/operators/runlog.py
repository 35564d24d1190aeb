"""Training / inference run-log analytics.

Log order is an explicit ``ord`` column; first/last/arg-min are ``min_by`` /
``max_by`` aggregates (partial-aggregatable, so a run holding a third of all
log rows is still spread over map tasks), never positional windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import safe_rate, to_number

RUN = ["model", "setting"]


def numeric_log(log: DataFrame) -> DataFrame:
    """Numeric views of the text cells (bad / blank / 'nan' -> NULL)."""
    return log.select("*", *[to_number(c).alias(f"{c}_n") for c in
                             ("loss", "eval_loss", "samples_per_s", "tokens_per_s", "gpu_mem_gb")
                             if c in log.columns])


def loss_curve_stats(log: DataFrame, keys=RUN) -> DataFrame:
    """first/last/min loss, reduction, sample variance and sd, first logged
    step (log order) reaching 90 % of the drop, counts, mean throughput, peak
    memory; eval: best, step of first best, last, count."""
    d = numeric_log(log)
    tr = d.filter(F.col("loss_n").isNotNull())
    a = tr.groupBy(*keys).agg(
        F.min_by("loss_n", "ord").alias("first"), F.max_by("loss_n", "ord").alias("last"),
        F.min("loss_n").alias("min_loss"), F.var_samp("loss_n").alias("var"),
        F.stddev_samp("loss_n").alias("sd"), F.count(F.lit(1)).alias("n_logged_points"),
        F.avg("samples_per_s_n").alias("sps"), F.avg("tokens_per_s_n").alias("tps"),
        F.max("gpu_mem_gb_n").alias("mem"))
    a = a.withColumn("drop", F.col("first") - F.col("last"))
    target = a.filter(F.col("drop") > 0).select(*keys, (F.col("first") - F.lit(0.9) * F.col("drop")).alias("target"))
    hit = (tr.join(target, list(keys)).filter(F.col("loss_n") <= F.col("target"))
           .groupBy(*keys).agg(F.min_by("step", "ord").alias("step_to_90pct_reduction")))
    ev = d.filter(F.col("eval_loss_n").isNotNull()).groupBy(*keys).agg(
        F.min("eval_loss_n").alias("best"),
        F.min_by("step", F.struct("eval_loss_n", "ord")).alias("best_eval_step"),
        F.max_by("eval_loss_n", "ord").alias("final_eval"), F.count(F.lit(1)).alias("n_evals"))
    out = a.join(hit, list(keys), "left").join(ev, list(keys), "left")
    return out.select(
        *keys, F.round("first", 4).alias("initial_loss"), F.round("last", 4).alias("final_loss"),
        F.round("min_loss", 4).alias("min_loss"), F.round("drop", 4).alias("loss_reduction"),
        F.round("var", 6).alias("loss_variance"), F.round("sd", 4).alias("loss_std"),
        "step_to_90pct_reduction", "n_logged_points",
        F.round("sps", 2).alias("mean_samples_per_s"), F.round("tps", 1).alias("mean_tokens_per_s"),
        F.round("mem", 2).alias("peak_gpu_mem_gb"), F.round("best", 4).alias("best_eval_loss"),
        "best_eval_step", F.round("final_eval", 4).alias("final_eval_loss"), "n_evals")


LATEST = ("step", "epoch", "samples_per_s", "tokens_per_s", "gpu_mem_gb", "elapsed_min", "eta_min")


def board_columns(latest, loss) -> list:
    """The board's columns from the latest training point (``latest(name)`` and
    its ``loss``) and the run's summary columns."""
    return [latest("step").alias("step"), latest("epoch").alias("epoch"), F.round(loss, 4).alias("loss"),
            F.round("start_loss", 4).alias("start_loss"), F.round("min_loss", 4).alias("min_loss"),
            *[latest(c).alias(c) for c in LATEST[2:]],
            F.round("last_eval_loss", 4).alias("last_eval_loss"), F.round("best_eval_loss", 4).alias("best_eval_loss"),
            "best_eval_step"]


def latest_point(log: DataFrame, keys=RUN) -> DataFrame:
    """Latest logged training point per run (with epoch, elapsed time and
    ETA as the log has them) + start/min loss + best eval."""
    d = numeric_log(log)
    tr = d.filter(F.col("loss_n").isNotNull())
    a = tr.groupBy(*keys).agg(F.max_by(F.struct("loss_n", *LATEST), "ord").alias("p"),
                              F.min_by("loss_n", "ord").alias("start_loss"), F.min("loss_n").alias("min_loss"))
    ev = d.filter(F.col("eval_loss_n").isNotNull()).groupBy(*keys).agg(
        F.max_by("eval_loss_n", "ord").alias("last_eval_loss"), F.min("eval_loss_n").alias("best_eval_loss"),
        F.min_by("step", F.struct("eval_loss_n", "ord")).alias("best_eval_step"))
    return a.join(ev, list(keys), "left").select(*keys, *board_columns(lambda c: F.col(f"p.{c}"), F.col("p.loss_n")))


def recent_points(log: DataFrame, n: int = 15, keys=RUN) -> DataFrame:
    """Last n logged points per run (top-k per group; Catalyst adds a
    partial WindowGroupLimit so only n rows per group and map task shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ord").desc())
    return log.withColumn("recent_rank", F.row_number().over(w)).filter(F.col("recent_rank") <= n)


def progress_eta(log: DataFrame, planned_steps: DataFrame | None = None, keys=RUN,
                 effective_batch: int = 32, tokens_per_example: float = 0.0) -> DataFrame:
    """Per logged point elapsed minutes since the run's first point,
    seconds per step, samples and tokens per second, remaining steps and ETA
    minutes (planned = last step of the run unless a plan table is given)."""
    first = log.groupBy(*keys).agg(F.min_by(F.struct("ts", "step"), "ord").alias("f"),
                                   F.max("step").alias("planned"))
    if planned_steps is not None:
        first = first.drop("planned").join(planned_steps, list(keys))
    d = log.join(first, list(keys))
    sec = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("f.ts").cast("timestamp"))) / F.lit(1e6)
    steps = F.col("step") - F.col("f.step")
    sps = F.when(steps > 0, sec / steps)
    samples = F.try_divide(F.lit(float(effective_batch)), sps)
    return d.select(*keys, "ord", "step", F.round(sec / 60.0, 2).alias("elapsed_min"),
                    F.round(sps, 4).alias("sec_per_step"), F.round(samples, 2).alias("samples_per_s"),
                    F.round(samples * F.lit(tokens_per_example), 1).alias("tokens_per_s"),
                    (F.col("planned") - F.col("step")).alias("remaining_steps"),
                    F.round((F.col("planned") - F.col("step")) * sps / 60.0, 1).alias("eta_min"))


def training_costs(log: DataFrame, effective_batch: int = 32, planned_steps: int = 0,
                   mean_src_tokens: float | None = None, keys=RUN) -> DataFrame:
    """P17 + P18: steps, examples and tokens seen, wall minutes / hours,
    sec per step, examples per second, early_stopped = steps < planned."""
    a = log.groupBy(*keys).agg(F.max("step").alias("steps"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    secs = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / F.lit(1e6)
    ex = F.col("steps") * F.lit(effective_batch)
    out = a.select(*keys, "steps", ex.alias("examples_seen"),
                   F.round(secs / 60.0, 1).alias("train_minutes"), F.round(secs / 3600.0, 2).alias("train_hours"),
                   F.round(secs / F.greatest(F.col("steps"), F.lit(1)), 3).alias("sec_per_step"),
                   safe_rate(ex, secs).alias("examples_per_sec"),
                   (F.col("steps") < F.lit(planned_steps)).alias("early_stopped"))
    if mean_src_tokens is not None:
        out = out.withColumn("tokens_seen_approx", (F.col("examples_seen") * F.lit(mean_src_tokens)).cast("long"))
    return out


def pair_run_events(index: DataFrame, label_len: int = 28) -> DataFrame:
    """Per log file the latest 'started' row, completed by the last
    'finished' row logged after it; no such row -> 'running'; finishes before
    any start (orphans) are ignored."""
    st = index.filter(F.col("event") == "started")
    last_start = st.groupBy("log_file").agg(
        F.max_by(F.struct("ord", "ts", "label"), "ord").alias("s"))
    fin = index.filter(F.col("event") == "finished").select(
        "log_file", F.col("ord").alias("f_ord"), "status", "duration_min")
    done = (fin.join(last_start.select("log_file", F.col("s.ord").alias("s_ord")), "log_file")
            .filter(F.col("f_ord") > F.col("s_ord"))
            .groupBy("log_file").agg(F.max_by(F.struct("status", "duration_min"), "f_ord").alias("f")))
    j = last_start.join(done, "log_file", "left")
    return j.select(
        F.col("s.ord").alias("ord"), F.col("s.ts").alias("ts"), "log_file",
        F.substring(F.col("s.label"), 1, label_len).alias("label"),
        F.coalesce(F.nullif(F.col("f.duration_min"), F.lit("")), F.lit("-")).alias("duration_min"),
        F.coalesce(F.nullif(F.col("f.status"), F.lit("")), F.lit("running")).alias("status"))


def run_status(crashed, has_pred, trained, has_metrics, unreadable=None):
    """P12, the first that holds: outputs without metrics -> 'outputs not
    scored yet'; crash -> CRASHED; no outputs -> whether there is a trained
    checkpoint; outputs that cannot be read; ok."""
    base = F.when(has_pred & ~has_metrics, "outputs not scored yet").when(crashed, "CRASHED").when(
        ~has_pred, F.when(trained, "trained, no outputs yet").otherwise("no outputs"))
    if unreadable is not None:
        base = base.when(unreadable, "outputs cannot be read")
    return base.otherwise("ok")


# ---- fixed values: field names and types of a run's training record ------
TRAINING_FIELDS = """mode string, epochs_requested double, epochs_completed double, steps bigint, max_steps_planned bigint,
 early_stopped boolean, extended boolean, n_train bigint, n_dev bigint, effective_batch bigint, mean_src_tokens double,
 examples_seen bigint, tokens_seen_approx bigint, trainable_params_M double, precision string, train_minutes double,
 train_hours double, sec_per_step double, examples_per_sec double, mean_samples_per_s double, mean_tokens_per_s double,
 peak_gpu_mem_gb double, initial_loss double, final_loss double, min_loss double, loss_reduction double,
 loss_variance double, loss_std double, step_to_90pct_reduction bigint, best_eval_loss double, best_eval_step bigint,
 final_eval_loss double, n_evals bigint, train_loss double"""
ENVIRONMENT_FIELDS = ("hostname string, gpus array<struct<name: string, total_mem_gb: double>>, torch string, "
                      "transformers string")
INFERENCE_FIELDS = "translate_minutes double, overall_sentences_per_sec double"
# ---------------------------------------------------------------------------


def training_report(records: DataFrame) -> DataFrame:
    """One row per trained run with every field of its training record; a
    field the run did not record is NULL. ``records``: S6 over TRAINING_FIELDS."""
    names = [f.strip().split(" ")[0] for f in TRAINING_FIELDS.replace("\n", " ").split(",")]
    return records.select(*RUN, *names)


# ---- fixed values: files of a run folder --------------------------------
PREDICTIONS, METRICS, CRASH_LOG, ENVIRONMENT = "predictions.csv", "metrics.json", "error.log", "environment.json"
TRAINING, INFERENCE, DONE = "train_metrics.json", "inference_stats.json", "DONE"
# ---------------------------------------------------------------------------


def run_state(listing: DataFrame) -> DataFrame:
    """One row per run folder: which files it has. ``listing``: model, setting,
    artifact (``sources.io.run_listing``)."""
    has = lambda *names: F.bool_or(F.col("artifact").isin(*names))
    return listing.groupBy(*RUN).agg(
        has(PREDICTIONS).alias("has_pred"), has(METRICS).alias("has_metrics"), has(CRASH_LOG).alias("crashed"),
        has(TRAINING, DONE).alias("trained"))


def run_manifest(runs: DataFrame, outputs: DataFrame, unreadable: DataFrame, environment: DataFrame, training: DataFrame,
                 inference: DataFrame) -> DataFrame:
    """J9 + P12 + P13: one row per run, left-joined with what its records say.

    runs: ``run_state``; outputs: model, setting, n; unreadable: model, setting;
    the others: S6 records. All are one row per run."""
    t = training.select(*RUN, "train_minutes", "epochs_completed", "train_loss", F.col("mode").alias("ft_mode"), "n_train")
    i = inference.select(*RUN, F.col("translate_minutes").alias("infer_minutes"),
                         F.col("overall_sentences_per_sec").alias("sent_per_sec"))
    e = environment.select(*RUN, "hostname", "gpus", "torch", "transformers")
    m = runs.join(outputs, RUN, "left").join(unreadable.select(*RUN, F.lit(True).alias("unreadable")), RUN, "left")
    for side in (e, t, i):
        m = m.join(side, RUN, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    broken = F.coalesce("unreadable", F.lit(False))
    status = run_status(F.col("crashed"), F.col("has_pred"), F.col("trained"), F.col("has_metrics"), broken)
    return m.select(
        *RUN, status.alias("status"),
        F.when(F.col("crashed") | broken, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_predictions"),
        text("hostname"), F.coalesce(F.get("gpus", F.lit(0))["name"], F.lit("")).alias("gpu"), text("torch"), text("transformers"),
        "train_minutes", "epochs_completed", "train_loss", "ft_mode", "n_train", "infer_minutes", "sent_per_sec",
        F.concat_ws("/", *RUN).alias("path"))


def group_timing(pred: DataFrame, seconds_col: str, keys=("model", "setting", "language", "src_lang")) -> DataFrame:
    """Per group items, seconds, rate, sec/item, output words, words/s, empties."""
    from corpuslab.functions.text import fold_failures, safe_pct, word_count
    a = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(seconds_col).alias("seconds"),
        F.sum(word_count("hyp")).alias("output_tokens"),
        F.count_if(fold_failures("hyp") == "").alias("empty_outputs"))
    return a.select(*keys, "n_items", F.round("seconds", 2).alias("seconds"),
                    F.round(F.col("seconds") / 60.0, 2).alias("minutes"),
                    safe_rate("n_items", "seconds").alias("sentences_per_sec"),
                    F.round(F.col("seconds") / F.greatest(F.col("n_items"), F.lit(1)), 4).alias("sec_per_sentence"),
                    "output_tokens", F.round(F.col("output_tokens") / F.greatest(F.col("seconds"), F.lit(1e-6)), 1).alias("output_tokens_per_sec"),
                    "empty_outputs", safe_pct("empty_outputs", "n_items").alias("empty_pct"))


def inference_rollup(timing: DataFrame, keys=("model", "setting")) -> DataFrame:
    """Sum seconds / items over groups, overall rate, minutes."""
    a = timing.groupBy(*keys).agg(F.sum("seconds").alias("seconds"), F.sum("n_items").alias("n_items"),
                                  F.count(F.lit(1)).alias("n_groups"))
    return a.select(*keys, "n_groups", "n_items", F.round("seconds", 2).alias("seconds"),
                    F.round(F.col("seconds") / 60.0, 2).alias("translate_minutes"),
                    safe_rate("n_items", "seconds").alias("overall_sentences_per_sec"))
