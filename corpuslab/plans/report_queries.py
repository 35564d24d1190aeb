"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import ci_label, fold_failures, lang_code, safe_pct, split_group
from corpuslab.operators import metrics as M
from corpuslab.operators import reports as R
from corpuslab.operators import runlog as L
from corpuslab.plans import fixtures as X
from corpuslab.plans.registry import query
from corpuslab.plans import score_queries as SQ
from corpuslab.plans.corpus_queries import LANGS
from corpuslab.plans.score_queries import BOOT_ROUNDS, BOOT_SEED, KEYS, SEG_KEYS, _stats
from corpuslab.plans.sqltext import bt, fold, ws_tokens

RUN = ["model", "setting"]


def _scored(spark, sf, draw_hash="xxhash64"):
    st = M.compact_stats(_stats(spark, sf, rouge=True), [*KEYS, "doc_id", "src_lang"])
    sc = M.score_groups(st, KEYS)
    ci = M.bootstrap_ci(st, KEYS, "doc_id", BOOT_ROUNDS, BOOT_SEED, draw_hash=draw_hash)
    return sc.join(ci, KEYS, "left")


def _explode_sql():
    from corpuslab.plans.registry import ORACLE_SQL
    boot = ORACLE_SQL["bootstrap_ci"]
    mets = ["chrf++", "spBLEU", "ROUGE-L", "BLEU"]
    m_sel = ", ".join(f's."{m}"' for m in mets)
    codes = "coalesce(CASE s.language WHEN 'Bhili' THEN 'bhb' WHEN 'Gondi' THEN 'gon' WHEN 'Mundari' THEN 'unr' " \
            "WHEN 'Santali' THEN 'sat' END, lower(substr(s.language, 1, 3)))"
    label = ("CASE WHEN ci.\"chrf++_ci_lo\" IS NOT NULL AND ci.\"chrf++_ci_hi\" IS NOT NULL THEN '[' || "
             "CAST(ci.\"chrf++_ci_lo\" AS VARCHAR) || ', ' || CAST(ci.\"chrf++_ci_hi\" AS VARCHAR) || ']' ELSE '' END")
    return SQ.scores_sql_prefix() + f""", macro AS ({SQ.MACRO_SQL_BODY}),
 ci AS (SELECT * FROM ({boot}))
 SELECT s.model, s.setting, s.language, {codes} AS code, s.n, s.empty_pct AS "empty_%", {m_sel},
  {label} AS "chrf++_ci", s.src_lang
 FROM scores s LEFT JOIN ci ON s.model = ci.model AND s.setting = ci.setting AND s.language = ci.language
 UNION ALL SELECT model, setting, 'MACRO', 'avg', n_total, empty_pct, {", ".join(f'"{m}"' for m in mets)}, '', ''
 FROM macro"""


@query("explode_scores", sql=_explode_sql())
def explode_scores(spark, sf):
    """R4 + A10: nested per-run scores (map language -> struct) exploded back
    to tidy rows, plus one MACRO row per run (md5 bootstrap draws, so the
    interval labels have a SQL twin)."""
    sc = _scored(spark, sf, draw_hash="md5")
    nested = sc.groupBy(*RUN).agg(F.map_from_entries(F.collect_list(F.struct(
        "language", F.struct(*[c for c in sc.columns if c not in KEYS])))).alias("per_language"))
    flat = nested.select(*RUN, F.explode("per_language").alias("language", "m")).select(*RUN, "language", "m.*")
    return R.tidy_scores(flat, M.macro_average(flat, RUN))


def _plain_scores(spark, sf):
    """Per-language scores without the bootstrap (reports that show no CI)."""
    return M.score_groups(M.compact_stats(_stats(spark, sf, rouge=True), [*KEYS, "doc_id", "src_lang"]), KEYS)


_CODES = sorted(LANGS)   # stand-in languages: no canonical ones, so alphabetical
_MATRIX_SQL = SQ.scores_sql_prefix() + f""", macro AS ({SQ.MACRO_SQL_BODY})
 SELECT s.model, s.setting, {", ".join(f'max(s."{m}") FILTER (WHERE s.language = \'{c}\') AS "{c}_{m}"'
                                      for c in _CODES for m in R.WIDE_METRICS)},
  {", ".join(f'any_value(mc."{m}") AS "MACRO_{m}"' for m in R.WIDE_METRICS)}
 FROM scores s LEFT JOIN macro mc ON s.model = mc.model AND s.setting = mc.setting GROUP BY s.model, s.setting"""


@query("score_matrix", sql=_MATRIX_SQL)
def score_matrix(spark, sf):
    """R3 + J4: wide report, one row per run, <code>_<metric> columns + MACRO_*."""
    sc = _plain_scores(spark, sf)
    return R.score_matrix(sc, M.macro_average(sc, RUN), codes=_CODES)


_TIDY_SQL = """, macro AS ({m}),
 tidy AS (SELECT model, setting, language, "chrf++", "spBLEU", "ROUGE-L" FROM scores
   UNION ALL SELECT model, setting, 'MACRO', "chrf++", "spBLEU", "ROUGE-L" FROM macro)"""


@query("baseline_vs_tuned", sql=SQ.scores_sql_prefix() + _TIDY_SQL.format(m=SQ.MACRO_SQL_BODY) + f"""
 SELECT b.model, b.setting AS ft_setting, b.language,
 {", ".join(f'a."{m}" AS "{m}_zeroshot", b."{m}" AS "{m}_finetuned", round(b."{m}" - a."{m}", 2) AS "{m}_delta"'
            for m in R.DELTA_METRICS)}
 FROM tidy b JOIN tidy a ON a.model = b.model AND a.language = b.language AND a.setting = 'zeroshot'
 WHERE b.setting <> 'zeroshot' AND b.setting NOT LIKE '%sweep%'""")
def baseline_vs_tuned(spark, sf):
    """Zero-shot vs each tuned setting per (model, language) incl. MACRO."""
    sc = _plain_scores(spark, sf)
    return R.baseline_vs_tuned(R.with_macro_rows(sc, M.macro_average(sc, RUN)))


def _candidates(spark, sf):
    p = X.predictions(spark, sf).filter(F.col("setting").contains("sweep"))
    p = p.withColumn("group", F.concat("language", F.lit("__"), "src_lang"))
    lang, tok = split_group("group")
    p = p.withColumn("src_token", tok).filter(lang.isNotNull())
    st = M.segment_stats(p, segment_keys=SEG_KEYS)
    return M.score_groups(st, [*RUN, "language", "src_token"], src_lang=None)


_CAND_SQL = SQ.scores_sql_prefix([*RUN, "language", "src_token"], "setting LIKE '%sweep%'", "src_lang") + """,
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY model, language ORDER BY "chrf++" DESC NULLS LAST, src_token ASC)
   AS BIGINT) AS rank_in_language FROM scores)"""


@query("rank_candidates", sql=_CAND_SQL + "\nSELECT * FROM ranked")
def rank_candidates(spark, sf):
    """W3 + W1: score every (language, source token) group of the sweep run,
    rank by chrF++ desc (nulls last), ties by token name."""
    return R.rank_candidates(_candidates(spark, sf))


@query("best_candidate", sql=_CAND_SQL + "\nSELECT * FROM ranked WHERE rank_in_language = 1")
def best_candidate(spark, sf):
    """Best source token per language."""
    return R.best_candidate(R.rank_candidates(_candidates(spark, sf)))


STACK_SQL = X.with_ctes(X.PREDICTIONS_SQL) + """SELECT model, setting, language, doc_id, hyp, src_lang FROM predictions WHERE setting <> 'sweep'
 UNION ALL SELECT model, setting, language, doc_id, hyp, NULL FROM predictions WHERE setting = 'sweep'"""


@query("stack_translations", sql=STACK_SQL)
def stack_translations(spark, sf):
    """Bag union of every run's predictions; runs may lack columns (here the
    sweep run has no src_lang column) -> unionByName(allowMissingColumns)."""
    p = X.predictions(spark, sf)
    frames = [p.filter(F.col("setting") != "sweep").select(*RUN, "language", "doc_id", "hyp", "src_lang"),
              p.filter(F.col("setting") == "sweep").select(*RUN, "language", "doc_id", "hyp")]
    return R.stack_frames(frames)


# seconds per item are a deterministic function of doc_id (no clock in the data)
SECONDS = "CAST(((doc_id % 7) + 1) * 0.25 AS DOUBLE)"


def _timing(spark, sf):
    p = X.predictions(spark, sf).withColumn("seconds", F.expr(SECONDS))
    return L.group_timing(p, "seconds")


TIMING_SQL = f"""timing AS (SELECT model, setting, language, src_lang, count(*) AS n_items, round(sum({SECONDS}), 2) AS seconds,
  round(sum({SECONDS}) / 60.0, 2) AS minutes, round(count(*) / greatest(sum({SECONDS}), 1e-6), 2) AS sentences_per_sec,
  round(sum({SECONDS}) / greatest(count(*), 1), 4) AS sec_per_sentence,
  sum(len({ws_tokens(bt('hyp'))})) AS output_tokens,
  count(*) FILTER (WHERE {fold('hyp')} = '') AS empty_outputs
  FROM predictions GROUP BY ALL)"""


@query("group_timing", sql=X.with_ctes(X.PREDICTIONS_SQL, TIMING_SQL) + """SELECT model, setting, language, src_lang, n_items, seconds,
 minutes, sentences_per_sec, sec_per_sentence, output_tokens, round(output_tokens / greatest(seconds, 1e-6), 1) AS output_tokens_per_sec,
 empty_outputs, round(100.0 * empty_outputs / greatest(n_items, 1), 2) AS empty_pct FROM timing""")
def group_timing(spark, sf):
    """Per (run, language, source token) items, time, rates, output words, empties."""
    return _timing(spark, sf)


@query("inference_rollup", sql=X.with_ctes(X.PREDICTIONS_SQL, TIMING_SQL) + """SELECT model, setting, count(*) AS n_groups,
 sum(n_items) AS n_items, round(sum(seconds), 2) AS seconds, round(sum(seconds) / 60.0, 2) AS translate_minutes,
 round(sum(n_items) / greatest(sum(seconds), 1e-6), 2) AS overall_sentences_per_sec FROM timing GROUP BY ALL""")
def inference_rollup(spark, sf):
    """Run-level totals over groups."""
    return L.inference_rollup(_timing(spark, sf))


@query("explode_groups", sql=X.with_ctes(X.PREDICTIONS_SQL, TIMING_SQL) + """SELECT model, setting,
 concat(language, '__', src_lang) AS "group", language, src_lang, n_items AS n, minutes, sentences_per_sec, sec_per_sentence,
 round(output_tokens / greatest(seconds, 1e-6), 1) AS output_tokens_per_sec, 32 AS batch_size, 4 AS num_beams,
 CAST(NULL AS DOUBLE) AS peak_gpu_mem_gb, round(100.0 * empty_outputs / greatest(n_items, 1), 2) AS empty_pct FROM timing""")
def explode_groups(spark, sf):
    """R5 + P16: run statistics as JSON with a per_group list of structs,
    parsed back and exploded into rows with all report columns; what a group
    did not record (here: peak memory) is NULL."""
    t = _timing(spark, sf)
    g = F.struct(F.concat("language", F.lit("__"), "src_lang").alias("group"), "language", "src_lang",
                 F.col("n_items").alias("n"), "minutes", "sentences_per_sec", "sec_per_sentence", "output_tokens_per_sec",
                 F.lit(32).alias("batch_size"), F.lit(4).alias("num_beams"), "empty_pct")
    js = t.groupBy(*RUN).agg(F.to_json(F.struct(F.collect_list(g).alias("per_group"))).alias("stats_json"))
    schema = ("struct<per_group: array<struct<group: string, language: string, src_lang: string, n: bigint, "
              "minutes: double, sentences_per_sec: double, sec_per_sentence: double, output_tokens_per_sec: double, "
              "batch_size: int, num_beams: int, peak_gpu_mem_gb: double, empty_pct: double>>>")
    parsed = js.select(*RUN, F.from_json("stats_json", schema).alias("s"))
    return parsed.select(*RUN, F.explode("s.per_group").alias("g")).select(*RUN, "g.*")


@query("report_labels", sql=X.with_ctes(X.PREDICTIONS_SQL) + f"""SELECT model, setting, language,
 coalesce(CASE language WHEN 'Bhili' THEN 'bhb' WHEN 'Gondi' THEN 'gon' WHEN 'Mundari' THEN 'unr' WHEN 'Santali' THEN 'sat' END,
   lower(substr(language, 1, 3))) AS code,
 split_part(grp, '__', 1) AS group_language, substr(grp, length(split_part(grp, '__', 1)) + 3) AS group_token,
 round(100.0 * empty / greatest(n, 1), 2) AS empty_pct,
 round(n / greatest(CAST(n AS DOUBLE) * 0.25, 1e-6), 2) AS items_per_sec,
 CASE WHEN language = 'MACRO' THEN 2 WHEN language IN ('Bhili','Gondi','Mundari','Santali') THEN 0 ELSE 1 END AS order_group
 FROM (SELECT model, setting, language, concat(language, '__', min(src_lang)) AS grp, count(*) AS n,
   count(*) FILTER (WHERE {fold('hyp')} = '') AS empty FROM predictions GROUP BY model, setting, language)""")
def report_labels(spark, sf):
    """Language code, group name split on the first '__',
    safe percentages / rates and the corpus-order group of each row."""
    p = X.predictions(spark, sf)
    a = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"),
                             F.count_if(fold_failures("hyp") == "").alias("empty"),
                             F.concat("language", F.lit("__"), F.min("src_lang")).alias("grp"))
    gl, gt = split_group("grp")
    from corpuslab.functions.text import safe_rate
    return a.select(*KEYS, lang_code("language").alias("code"), gl.alias("group_language"), gt.alias("group_token"),
                    safe_pct("empty", "n").alias("empty_pct"),
                    safe_rate("n", F.col("n") * 0.25).alias("items_per_sec"),
                    R.corpus_order_key("language")["g"].alias("order_group"))


@query("corpus_order", sql=X.with_ctes(X.PREDICTIONS_SQL) + """, report AS (SELECT model, setting, language, count(*) AS n FROM predictions GROUP BY ALL
  UNION ALL SELECT model, setting, 'MACRO', count(*) FROM predictions GROUP BY ALL
  UNION ALL SELECT DISTINCT model, setting, unnest(['Santali', 'Bhili']), 0 FROM predictions)
 SELECT model, setting, language, n, row_number() OVER (PARTITION BY model, setting ORDER BY
  CASE language WHEN 'Bhili' THEN 1 WHEN 'Gondi' THEN 2 WHEN 'Mundari' THEN 3 WHEN 'Santali' THEN 4 WHEN 'MACRO' THEN 6 ELSE 5 END, language) AS position
 FROM report""")
def corpus_order(spark, sf):
    """L1: a report's rows with their place in corpus order: the languages of
    the list first (two rows without segments), others by name, MACRO last."""
    n = X.predictions(spark, sf).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    macro = n.groupBy(*RUN).agg(F.sum("n").alias("n")).withColumn("language", F.lit("MACRO"))
    bare = n.select(*RUN).distinct().select(*RUN, F.explode(F.array(F.lit("Santali"), F.lit("Bhili"))).alias("language"),
                                            F.lit(0).cast("long").alias("n"))
    return R.corpus_order(n.unionByName(macro).unionByName(bare))


def _ci_sql():
    from corpuslab.plans.registry import ORACLE_SQL
    boot = ORACLE_SQL["bootstrap_ci"]
    return f"""SELECT model, setting, language,
 CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN '[' || CAST(lo AS VARCHAR) || ', ' || CAST(hi AS VARCHAR) || ']' ELSE '' END AS "chrf++_ci"
 FROM (SELECT model, setting, language, "chrf++_ci_lo" AS lo, "chrf++_ci_hi" AS hi FROM ({boot}))"""


@query("ci_labels", sql=_ci_sql())
def ci_labels(spark, sf):
    """P7 + L2: '[lo, hi]' interval labels of the bootstrap, sorted by model, setting, language."""
    st = M.compact_stats(_stats(spark, sf, rouge=False, bleu=False), [*KEYS, "doc_id"])
    ci = M.bootstrap_ci(st, KEYS, "doc_id", BOOT_ROUNDS, BOOT_SEED, draw_hash="md5")
    return ci.select(*KEYS, ci_label("`chrf++_ci_lo`", "`chrf++_ci_hi`").alias("chrf++_ci")).orderBy(*KEYS)


@query("needs_attention", sql=X.with_ctes(X.PREDICTIONS_SQL) + f"""SELECT model, setting, language, count(*) AS n,
 round(100.0 * count(*) FILTER (WHERE {fold('hyp')} = '') / greatest(count(*), 1), 2) AS empty_pct
 FROM predictions GROUP BY ALL HAVING round(100.0 * count(*) FILTER (WHERE {fold('hyp')} = '') / greatest(count(*), 1), 2) > 2.0""")
def needs_attention(spark, sf):
    """L4: languages whose failure rate is above 2 %."""
    fr = M.failure_rate(X.predictions(spark, sf), KEYS)
    return R.needs_attention(fr, F.col("flagged")).select(*KEYS, "n", "empty_pct")
