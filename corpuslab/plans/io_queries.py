"""Registered source/sink round trips (S1-S8, K1-K5) in a fresh scratch folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpuslab.functions.text import blank_trim
from corpuslab.operators import corpus as C
from corpuslab.operators import runlog as L
from corpuslab.plans import fixtures as X
from corpuslab.plans.corpus_queries import LANGS, PAIRS, _pairs, _w
from corpuslab.plans.registry import query
from corpuslab.plans.report_queries import SECONDS, TIMING_SQL
from corpuslab.plans.sqltext import bt
from corpuslab.sources import io as IO
from corpuslab.streaming.live import scratch


@query("io_corpus_roundtrip", sql=_w(PAIRS) + """SELECT language, count(*) AS n_long, count(*) AS n_wide,
 sum(length(english) + length(tribal)) AS chars FROM pairs GROUP BY language""")
def io_corpus_roundtrip(spark, sf):
    """K1 -> S1-S4: the clean corpus written as a long CSV and as one wide CSV
    per language (English, Hindi, <language>), read back with header
    resolution, long/wide detection and NA folding; counts and characters per
    language must survive both round trips."""
    root = scratch(spark, "corpus")
    pairs = C.require_rows(_pairs(spark, sf).select("language", "english", "hindi", "tribal"))
    IO.write_corpus(pairs.select(F.col("language").alias("Language"), F.col("english").alias(" English "),
                                 F.col("hindi").alias("HINDI"), "tribal"), f"{root}/long")
    long = IO.read_pairs(IO.require_columns(IO.read_wide(spark, f"{root}/long"), ["language", "english", "tribal"]), LANGS)
    for i, lang in enumerate(LANGS):   # one file set per configured language, each with columns in its own order
        cells = [F.col("english").alias("English"), F.col("hindi").alias("Hindi"), F.col("tribal").alias(lang)]
        IO.write_corpus(long.filter(F.col("language") == lang).select(*cells[i % 3:], *cells[:i % 3]),
                        f"{root}/wide/{lang}.csv")
    wide = IO.read_corpus_folder(spark, f"{root}/wide", LANGS)
    lc = long.groupBy("language").agg(F.count(F.lit(1)).alias("n_long"),
                                      F.sum(F.length(blank_trim("english")) + F.length(blank_trim("tribal"))).alias("chars"))
    wc = wide.groupBy("language").agg(F.count(F.lit(1)).alias("n_wide"))
    return lc.join(wc, "language", "full")


@query("io_table_roundtrip", sql=X.with_ctes(X.PREDICTIONS_SQL) + """, t AS (SELECT model, setting, language, count(*) AS n, count(hyp) AS n_outputs,
  sum(length(english)) AS chars FROM predictions GROUP BY ALL)
 SELECT kind, model, setting, language, CAST(n AS VARCHAR) AS n, CAST(n_outputs AS VARCHAR) AS n_outputs, CAST(chars AS VARCHAR) AS chars
 FROM t, (VALUES ('csv'), ('tsv')) k(kind)""")
def io_table_roundtrip(spark, sf):
    """K2: a report table written as TSV and as CSV, both read back by name."""
    path = f"{scratch(spark, 'report')}/table"
    table = X.predictions(spark, sf).groupBy("model", "setting", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count("hyp").alias("n_outputs"), F.sum(F.length("english")).alias("chars"))
    IO.write_table(table, path, one_file=True)
    back = [IO.read_by_name(spark, IO.data_files(spark, f"{path}.{kind}"), table.columns, table.columns)
            .drop("__file").withColumn("kind", F.lit(kind)) for kind in ("csv", "tsv")]
    return back[0].unionByName(back[1])


RUNS_SQL = X.with_ctes(X.PREDICTIONS_SQL, X.LOSS_LOG_SQL, X.RUN_INDEX_SQL, TIMING_SQL) + f"""SELECT 'predictions' AS kind, model || '/' || setting AS "key", count(*) AS n,
 count(*) FILTER (WHERE {bt('hyp')} <> '') AS n_nonblank FROM predictions GROUP BY ALL
 UNION ALL SELECT 'groups', model || '/' || setting, count(*), sum(n_items) FROM timing GROUP BY ALL
 UNION ALL SELECT 'loss_log', model || '/' || setting, count(*), count(*) FILTER (WHERE loss <> '') FROM loss_log GROUP BY ALL
 UNION ALL SELECT 'run_index', event, count(*), count(*) FILTER (WHERE status <> '') FROM run_index GROUP BY ALL"""


@query("io_runs_roundtrip", sql=RUNS_SQL)
def io_runs_roundtrip(spark, sf):
    """K2-K5 -> S5-S8: predictions (CSV, model=/setting= partitions), per-run
    inference statistics (nested JSON), training logs (CSV partitions) and the
    invocation index (two CSV appends) written and read back."""
    root = scratch(spark, "runs")
    pred = X.predictions(spark, sf).select("model", "setting", F.col("doc_id").cast("string").alias("gid"),
                                           "language", "english", "hyp", "src_lang")
    IO.packed(IO.csv_writer(pred.write.mode("overwrite").partitionBy("model", "setting"))).csv(f"{root}/pred")
    p = IO.read_predictions(spark, f"{root}/pred", ["gid", "language", "english", "hyp", "src_lang"], layout="hive")
    out = [p.groupBy(F.lit("predictions").alias("kind"), F.concat_ws("/", "model", "setting").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank_trim("hyp") != "").alias("n_nonblank"))]

    t = L.group_timing(X.predictions(spark, sf).withColumn("seconds", F.expr(SECONDS)), "seconds")
    nested = t.groupBy("model", "setting").agg(F.collect_list(F.struct("language", "src_lang", "n_items")).alias("per_group"))
    IO.write_nested(nested, f"{root}/stats", partition_by=("model", "setting"))
    js = IO.read_run_json(spark, f"{root}/stats", "", "per_group array<struct<language: string, src_lang: string, n_items: bigint>>",
                          layout="hive")
    g = js.select("model", "setting", F.explode("per_group").alias("g"))
    out.append(g.groupBy(F.lit("groups").alias("kind"), F.concat_ws("/", "model", "setting").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("g.n_items").alias("n_nonblank")))

    log = X.loss_log(spark, sf).select("model", "setting", F.col("step").cast("string").alias("step"), "loss", "eval_loss")
    IO.csv_writer(log.write.mode("overwrite").partitionBy("model", "setting")).csv(f"{root}/logs")
    lc = IO.read_loss_curves(spark, f"{root}/logs", ["step", "loss", "eval_loss"], layout="hive")
    out.append(lc.groupBy(F.lit("loss_log").alias("kind"), F.concat_ws("/", "model", "setting").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("loss"), F.lit("")) != "").alias("n_nonblank")))

    idx = X.run_index(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event",
                                        F.lit("infer").alias("script"), "label", "duration_min", "status", "log_file",
                                        F.lit("").alias("run_dir"), F.lit("").alias("command"))
    IO.append_events(idx.filter(F.col("event") == "started"), f"{root}/index")
    IO.append_events(idx.filter(F.col("event") == "finished"), f"{root}/index")
    ri = IO.read_run_index(spark, f"{root}/index")
    out.append(ri.groupBy(F.lit("run_index").alias("kind"), F.col("event").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "").alias("n_nonblank")))
    return reduce(lambda a, b: a.unionByName(b), out)
