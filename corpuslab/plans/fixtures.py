"""Stand-in views over the test tables, as Spark DataFrames and DuckDB text.

The reference ships no data, so its inputs are derived from the given tables:

* ``raw_lines``  — raw (english, hindi, tribal) triplets: every document's
  lines, taken three at a time (lines 3k, 3k+1, 3k+2), so every line of every
  document is used. Missing cells are ''.
* ``predictions``— 5 runs x all documents. The reference is the whole document
  (all whitespace tokens); the hypothesis drops every p-th token; some rows are
  'ERROR' or NULL to drive failure rates.
* ``loss_log``   — training logs from ``events`` (blank / 'nan' / numbers mixed).
* ``run_index``  — started / finished invocation events from ``events``.
* ``items_done`` — documents left-joined to labels (NULL quality = not done).
* ``turn_pairs`` — user turn followed by the assistant turn (second corpus).

Every view reads whole tables; nothing is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import WS_CLASS
from corpuslab.operators.layout import spread

# ---- fixed values -------------------------------------------------------
# (model, setting, p): every p-th token is dropped from the reference.
RUNS = [("m1", "zeroshot", 3), ("m1", "ft_a", 7), ("m2", "zeroshot", 4),
        ("m2", "ft_a", 9), ("m1", "sweep", 5)]
# ------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The documents table, spread by doc_id when the file is one narrow split
    (text work per row is heavy; at scale the scan is already wide)."""
    d = table(spark, sf_dir, "documents")
    if cols:
        d = d.select(*cols)
    return spread(d, "doc_id")


# ---------------------------------------------------------------- raw_lines
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "lang", "text").select(
        "doc_id", "lang", F.split("text", "\n").alias("lines"))
    e = d.select("doc_id", "lang", "lines",
                 F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") + 2) / 3) - 1)).alias("part"))
    k = F.col("part") * 3
    return e.select(
        "doc_id", F.col("part").cast("long").alias("part"), "lang",
        F.coalesce(F.get("lines", k), F.lit("")).alias("english"),
        F.coalesce(F.get("lines", k + 1), F.lit("")).alias("hindi"),
        F.coalesce(F.get("lines", k + 2), F.lit("")).alias("tribal"))


RAW_LINES_SQL = """raw_lines AS (
 SELECT doc_id, CAST(part AS BIGINT) AS part, lang,
  coalesce(lines[3*part+1], '') AS english, coalesce(lines[3*part+2], '') AS hindi,
  coalesce(lines[3*part+3], '') AS tribal
 FROM (SELECT doc_id, lang, lines, unnest(range(0, (len(lines) + 2) // 3)) AS part
       FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents)))"""


# -------------------------------------------------------------- predictions
def even_space(text) -> Column:
    """The text's tokens joined by one space. One regex pass in generated code;
    an array of tokens and lambdas over it took some five times as long."""
    return F.trim(F.regexp_replace(text, WS_CLASS + "+", " "))


def drop_tokens(joined, first: Column, p: Column) -> Column:
    """Space-joined tokens without those whose number i has (i + first) % p = 0
    (none is kept where ``first`` is null): the first token dropped, then every
    p-th from where the last one ended (never searched for again, however long a token is).
    The kept tokens stand in the pattern one after another: a counted group took half as long again."""
    def one(kept):
        return F.concat(F.lit("("), F.repeat(F.lit("[^ ]+ "), kept), F.lit(")[^ ]+(?: |$)"))

    pattern = F.concat(F.lit("^"), one(F.pmod(-(first % p), p).cast("int")), F.lit(r"|\G"), one(p - 1))
    kept = F.rtrim(F.regexp_replace(joined, pattern, F.lit("$1$2")))
    return F.when(F.col(joined).isNotNull() & first.isNull(), F.lit("")).otherwise(kept)


def predictions(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, told: bool = False) -> DataFrame:
    """The view; ``told`` adds ``has_hyp``, whether there is a hypothesis, which
    is known without making it (counting hypotheses made them all)."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text") if docs is None else docs
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("setting"), F.lit(p).alias("p"))
                     for m, s, p in RUNS])
    # a document's white space is evened out once, before its runs
    t = docs.select("doc_id", "lang", even_space("text").alias("english"), F.col("text").isNotNull().alias("there")).select(
        "*", F.explode(runs).alias("run"))
    p = F.col("run.p")
    failed, none = (F.col("doc_id") + p) % 37 == 0, (F.col("doc_id") + p) % 41 == 0
    hyp = (F.when(failed, F.lit("ERROR")).when(none, F.lit(None).cast("string"))
           .otherwise(drop_tokens("english", F.col("doc_id"), p)))
    has_hyp = F.when(failed, True).when(none, False).otherwise(F.col("there"))
    return t.select(
        F.col("run.model").alias("model"), F.col("run.setting").alias("setting"),
        F.col("lang").alias("language"), "doc_id",
        "english", hyp.alias("hyp"),
        F.concat("lang", F.lit("_"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("B")).alias("src_lang"),
        *([has_hyp.alias("has_hyp")] if told else []))


def _duck_runs() -> str:
    return ", ".join(f"('{m}','{s}',{p})" for m, s, p in RUNS)


PREDICTIONS_SQL = f"""predictions AS (
 WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '{WS_CLASS}'), lambda x: x <> '') AS r FROM documents),
 s AS (SELECT * FROM (VALUES {_duck_runs()}) v(model, setting, p))
 SELECT model, setting, lang AS language, doc_id, array_to_string(r, ' ') AS english,
  CASE WHEN (doc_id + p) % 37 = 0 THEN 'ERROR' WHEN (doc_id + p) % 41 = 0 THEN NULL
  ELSE array_to_string(list_filter(r, lambda x, i: (i - 1 + doc_id) % p <> 0), ' ') END AS hyp,
  concat(lang, '_', CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'B' END) AS src_lang
 FROM t CROSS JOIN s)"""


# ----------------------------------------------------------------- loss_log
def loss_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events") if events is None else events
    et = F.col("event_type")
    return e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.concat(F.lit("ft_"), (F.col("user_id") % 2).cast("string")).alias("setting"),
        F.col("event_id").alias("ord"), (F.col("event_id") * 25).alias("step"),
        F.when(et.isin("click", "view", "purchase"), F.col("value").cast("string"))
        .when(et == "error", F.lit("nan")).otherwise(F.lit("")).alias("loss"),
        F.when(et == "signup", F.col("value").cast("string")).otherwise(F.lit("")).alias("eval_loss"),
        F.round(F.col("value") * 2, 2).cast("string").alias("samples_per_s"),
        F.round(F.col("value") * 50, 1).cast("string").alias("tokens_per_s"),
        F.round(F.col("value") / 10, 2).cast("string").alias("gpu_mem_gb"),
        F.round(F.col("event_id") / 5000, 2).cast("string").alias("epoch"),
        F.round(F.col("value") / 100, 2).cast("string").alias("lr"),
        F.round(F.col("event_id") / 40, 1).cast("string").alias("elapsed_min"),
        F.round(F.col("value") * 6, 1).cast("string").alias("eta_min"),
        F.col("ts"))


LOSS_LOG_SQL = """loss_log AS (
 SELECT concat('m', (user_id % 4)) AS model, concat('ft_', (user_id % 2)) AS setting, event_id AS ord, event_id * 25 AS step,
  CASE WHEN event_type IN ('click','view','purchase') THEN CAST(value AS VARCHAR) WHEN event_type = 'error' THEN 'nan' ELSE '' END AS loss,
  CASE WHEN event_type = 'signup' THEN CAST(value AS VARCHAR) ELSE '' END AS eval_loss,
  CAST(round(value * 2, 2) AS VARCHAR) AS samples_per_s, CAST(round(value * 50, 1) AS VARCHAR) AS tokens_per_s,
  CAST(round(value / 10, 2) AS VARCHAR) AS gpu_mem_gb, CAST(round(event_id / 5000, 2) AS VARCHAR) AS epoch,
  CAST(round(value / 100, 2) AS VARCHAR) AS lr, CAST(round(event_id / 40, 1) AS VARCHAR) AS elapsed_min,
  CAST(round(value * 6, 1) AS VARCHAR) AS eta_min, ts
 FROM events)"""


# ---------------------------------------------------------------- run_index
def run_index(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every event is a line of the index: sign-ups and views start an
    invocation, errors end one in failure, all others end one well."""
    e = table(spark, sf_dir, "events") if events is None else events
    start, failed = F.col("event_type").isin("signup", "view"), F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("ord"), "ts",
        F.when(start, "started").otherwise("finished").alias("event"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("label"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_"),
                 F.dayofmonth("ts").cast("string")).alias("log_file"),
        F.when(start, "").when(failed, "FAILED").otherwise("ok").alias("status"),
        F.when(start, "").otherwise(F.col("value").cast("string")).alias("duration_min"))


RUN_INDEX_SQL = """run_index AS (
 SELECT event_id AS ord, ts, CASE WHEN event_type IN ('signup','view') THEN 'started' ELSE 'finished' END AS event,
  concat('m', user_id % 4) AS label, concat('run_', user_id, '_', CAST(day(ts) AS VARCHAR)) AS log_file,
  CASE WHEN event_type IN ('signup','view') THEN '' WHEN event_type = 'error' THEN 'FAILED' ELSE 'ok' END AS status,
  CASE WHEN event_type IN ('signup','view') THEN '' ELSE CAST(value AS VARCHAR) END AS duration_min
 FROM events)"""


# ---------------------------------------------------------------- log_lines
def log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The lines of the invocations' log files; an error ends an invocation."""
    e = table(spark, sf_dir, "events") if events is None else events
    return e.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_"), F.dayofmonth("ts").cast("string")).alias("log_file"),
        F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", "props").alias("line"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("label"), (F.col("event_type") == "error").alias("crashed"))


LOG_LINES_SQL = """log_lines AS (
 SELECT concat('run_', user_id, '_', CAST(day(ts) AS VARCHAR)) AS log_file, event_id AS ord, concat_ws(' ', event_type, props) AS line,
  concat('m', user_id % 4) AS label, event_type = 'error' AS crashed FROM events)"""


# --------------------------------------------------------------- items_done
def items_done(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    d = (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "lang")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id", "left")


ITEMS_DONE_SQL = """items_done AS (
 SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# --------------------------------------------------------------- turn_pairs
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return u.join(a, ["conv_id", "turn"])


TURN_PAIRS_SQL = """turn_pairs AS (
 SELECT u.conv_id, u.turn, u.text AS source, a.text AS reference FROM conversations u
 JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant')"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
