"""Run-log semantics (A12, J10, P12) on hand-made rows."""

import itertools

from pyspark.sql import functions as F

from corpuslab.operators import runlog as L


def _log(spark, rows):
    return spark.createDataFrame(
        [("m", "s", i, step, loss, ev, "1.0", "2.0", "3.0") for i, (step, loss, ev) in enumerate(rows)],
        "model string, setting string, ord long, step long, loss string, eval_loss string, "
        "samples_per_s string, tokens_per_s string, gpu_mem_gb string")


def test_single_point_null_variance(spark):
    r = L.loss_curve_stats(_log(spark, [(1, "2.0", "")])).first()
    assert r["loss_variance"] is None and r["step_to_90pct_reduction"] is None and r["n_logged_points"] == 1


def test_loss_rises_no_step(spark):
    r = L.loss_curve_stats(_log(spark, [(1, "1.0", ""), (2, "2.0", "")])).first()
    assert r["loss_reduction"] == -1.0 and r["step_to_90pct_reduction"] is None


def test_first_hit_in_log_order_with_replayed_steps(spark):
    # resumed run appends: step 30 is logged before a replayed step 20
    rows = [(10, "10.0", ""), (30, "1.0", ""), (20, "0.5", ""), (40, "0.0", "")]
    r = L.loss_curve_stats(_log(spark, rows)).first()
    assert r["step_to_90pct_reduction"] == 30


def test_bad_cells_and_eval(spark):
    rows = [(1, "nan", ""), (2, "", "3.0"), (3, "abc", "2.0"), (4, "1.5", "2.0"), (5, "1.0", "")]
    r = L.loss_curve_stats(_log(spark, rows)).first()
    assert r["n_logged_points"] == 2 and r["best_eval_loss"] == 2.0 and r["best_eval_step"] == 3
    assert r["final_eval_loss"] == 2.0 and r["n_evals"] == 3


def _status_py(crash, pred, trained, metrics):
    status = "ok"
    if crash:
        status = "CRASHED"
    elif not pred:
        status = "trained, no outputs yet" if trained else "no outputs"
    if pred and not metrics:
        status = "outputs not scored yet"
    return status


def test_status_case_all_16(spark):
    combos = list(itertools.product([False, True], repeat=4))
    df = spark.createDataFrame(combos, "c boolean, p boolean, t boolean, m boolean")
    got = df.select(L.run_status(F.col("c"), F.col("p"), F.col("t"), F.col("m"))).collect()
    assert [r[0] for r in got] == [_status_py(*c) for c in combos]


def test_pair_run_events(spark):
    rows = [(1, "finished", "orphan", "ok", "1"), (2, "started", "a", "", ""), (3, "finished", "a", "ok", "2.5"),
            (4, "started", "b", "", ""), (5, "started", "a", "", ""), (6, "finished", "a", "FAILED", "0.5"),
            (7, "finished", "a", "ok", "0.7")]
    df = spark.createDataFrame([(o, e, f"L{lf}", "lbl" * 12, st, d) for o, e, lf, st, d in rows],
                               "ord long, event string, log_file string, label string, status string, duration_min string")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r["log_file"]: (r["ord"], r["status"], r["duration_min"], len(r["label"]))
           for r in L.pair_run_events(df).collect()}
    assert got == {"La": (5, "ok", "0.7", 28), "Lb": (4, "running", "-", 28)}


def test_manifest_from_run_folders(spark, tmp_path):
    """Every status, from the files of the folders alone."""
    from corpuslab.sources import io as IO

    files = {"m/ok": ["predictions.csv", "metrics.json"], "m/new": ["predictions.csv"], "m/crash": ["predictions.csv", "metrics.json", "error.log"],
             "m/ckpt": ["DONE"], "m/rec": ["train_metrics.json"], "m/none": ["environment.json"], "m/bad": ["predictions.csv", "metrics.json"],
             "m/crash2": ["error.log"], "n x/both": ["predictions.csv", "error.log"]}
    text = {"predictions.csv": "gid,hyp\n1,a\n2,\n", "metrics.json": "{}", "error.log": "boom\n", "DONE": "",
            "train_metrics.json": '{"train_minutes": 2.5, "mode": "lora"}', "environment.json": '{"hostname": "h", "gpus": [{"name": "g"}]}'}
    for run, names in files.items():
        (tmp_path / run).mkdir(parents=True)
        for n in names:
            (tmp_path / run / n).write_text("gid,output\n1,a\n" if (run, n) == ("m/bad", "predictions.csv") else text[n])
    root = str(tmp_path)
    pred = IO.read_predictions(spark, root, ["gid", "hyp"])
    records = [IO.read_run_json(spark, root, n, f) for n, f in ((L.ENVIRONMENT, L.ENVIRONMENT_FIELDS), (L.TRAINING, L.TRAINING_FIELDS))]
    none = spark.createDataFrame([], f"model string, setting string, {L.INFERENCE_FIELDS}")
    rows = {r["path"]: r for r in L.run_manifest(
        L.run_state(IO.run_listing(spark, root)), pred.groupBy("model", "setting").agg(F.count(F.lit(1)).alias("n")),
        IO.unreadable_runs(spark, root), *records, none).collect()}
    assert {k: (r["status"], r["n_predictions"]) for k, r in rows.items()} == {
        "m/ok": ("ok", 2), "m/new": ("outputs not scored yet", 2), "m/crash": ("CRASHED", 0), "m/ckpt": ("trained, no outputs yet", 0),
        "m/rec": ("trained, no outputs yet", 0), "m/none": ("no outputs", 0), "m/bad": ("outputs cannot be read", 0),
        "m/crash2": ("CRASHED", 0), "n x/both": ("outputs not scored yet", 0)}
    assert rows["m/rec"]["train_minutes"] == 2.5 and rows["m/none"]["gpu"] == "g"


def test_run_folders_are_packed_and_tell_outputs_without_making_them(spark, tmp_path):
    """Outputs of runs are gzip files; scores count the outputs that are there; texts, ids and languages may be null."""
    from corpuslab.plans import fixtures as X
    from corpuslab.plans.runlog_queries import run_folders

    docs = spark.createDataFrame([(i, "en", None if i % 5 == 0 else f"one two, \"three\"\n{i} four") for i in range(90)]
                                 + [(None, None, "a b"), (None, "en", None), (7, None, "")], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    events = [(i, i % 7, k, float(i), "2024-01-01 00:00:00") for i in range(60) for k in ("click", "error", "signup")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/t/events.parquet")
    view = X.predictions(spark, f"{tmp_path}/t", told=True)
    assert view.filter("has_hyp is null or has_hyp <> (hyp is not null)").count() == 0
    plan = view.groupBy("model").agg(F.count_if("has_hyp"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    run_folders(spark, f"{tmp_path}/t", f"{tmp_path}/runs")
    files = [f.name for f in (tmp_path / "runs" / L.PREDICTIONS).rglob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    found = {tuple(r) for r in spark.read.json(f"{tmp_path}/runs/{L.METRICS}").select("model", "setting", "n").collect()}
    assert found == {tuple(r) for r in view.filter("setting <> 'sweep'").groupBy("model", "setting").agg(F.count("hyp")).collect()}
