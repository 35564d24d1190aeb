"""Registered inference / resume queries (F1-F4, J1, J2, J5-J7, A9 on a second corpus)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import inference as I
from corpuslab.operators import metrics as M
from corpuslab.operators import reports as R
from corpuslab.plans import fixtures as X
from corpuslab.plans.corpus_queries import GID, PAIRS, SPLITS, _splits, _w
from corpuslab.plans.registry import query
from corpuslab.plans.sqltext import bt, ws_tokens

# ---- fixed values -------------------------------------------------------
SOURCE_TOKEN = {"de": "deu_Latn", "en": "eng_Latn", "es": "spa_Latn", "fr": "fra_Latn"}
CANDIDATES = {"de": ["deu_Latn", "nld_Latn", "de_NoSuch"], "es": ["spa_Latn", "por_Latn", "cat_Latn"],
              "fr": ["fra_Latn", "ita_Latn"]}          # 'en' has none -> its source token
TOKEN_OF = {**SOURCE_TOKEN, "nl": "nld_Latn", "pt": "por_Latn", "ca": "cat_Latn", "it": "ita_Latn"}  # the model's tokens
BATCH = 32
# ------------------------------------------------------------------------


def every_other_word():
    """Stand-in model: keeps words 1, 3, 5, ... (a deterministic, SQL-checkable
    translation function; built once per task)."""
    def fn(texts):
        return [" ".join(t.split()[::2]) for t in texts]
    return fn


def token_dependent():
    """Stand-in model whose output depends on the source token."""
    def fn(texts, toks):
        out = []
        for t, k in zip(texts, toks):
            step = 2 + len(k or "") % 3
            out.append(" ".join(w for i, w in enumerate(t.split()) if i % step != 1))
        return out
    return fn


def _token_case(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_TOKEN.items()) + " END"


def _test_rows(spark, sf):
    return I.attach_source_token(_splits(spark, sf).filter(F.col("split") == "test"),
                                 I.token_table(spark, SOURCE_TOKEN))


@query("predict_batches", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, language,
 trim(array_to_string(list_filter({ws_tokens('tribal')}, lambda x, i: (i - 1) % 2 = 0), ' ')) AS hyp,
 {_token_case('language')} AS src_lang FROM sp WHERE split = 'test'""")
def predict_batches(spark, sf):
    """F1 + J5: the test split through a batch function (mapInPandas, batches of 32)."""
    return I.predict_batches(_test_rows(spark, sf), every_other_word, "tribal", ["gid", "language"],
                             BATCH, token_col="src_lang")


EARLIER = f"""earlier AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'done' WHEN toxic = 1 THEN 'ERROR' ELSE ' ' END AS hyp
 FROM labels)"""


def _earlier(spark, sf):
    l = X.table(spark, sf, "labels")
    return l.select("doc_id", F.when(F.col("quality") == 1, "done").when(F.col("toxic") == 1, "ERROR")
                    .otherwise(" ").alias("hyp"))


@query("pending_items", sql=X.with_ctes(X.ITEMS_DONE_SQL, EARLIER) + f"""SELECT doc_id, lang FROM items_done
 WHERE doc_id NOT IN (SELECT doc_id FROM earlier WHERE {bt('hyp')} <> '')""")
def pending_items(spark, sf):
    """Items whose earlier output is missing or blank ('ERROR' counts as done)."""
    items = X.items_done(spark, sf).select("doc_id", "lang")
    return I.pending_items(items, _earlier(spark, sf), "doc_id")


@query("merge_resumed", sql=X.with_ctes(X.ITEMS_DONE_SQL, EARLIER) + f"""SELECT doc_id, hyp, 'earlier' AS origin FROM earlier WHERE {bt('hyp')} <> ''
 UNION ALL SELECT doc_id, concat('new ', lang) AS hyp, 'new' AS origin FROM items_done
 WHERE doc_id NOT IN (SELECT doc_id FROM earlier WHERE {bt('hyp')} <> '')""")
def merge_resumed(spark, sf):
    """Earlier good rows + freshly produced rows for the pending items."""
    earlier = _earlier(spark, sf).withColumn("origin", F.lit("earlier"))
    pend = I.pending_items(X.items_done(spark, sf).select("doc_id", "lang"), earlier, "doc_id")
    new = pend.select("doc_id", F.concat(F.lit("new "), "lang").alias("hyp"), F.lit("new").alias("origin"))
    return I.merge_resumed(earlier, new)


def _cand_table(spark):
    return spark.createDataFrame(list(CANDIDATES.items()), "language string, candidates array<string>")


def _cand_sql() -> str:
    rows = []
    for lang, tok in SOURCE_TOKEN.items():
        for c in CANDIDATES.get(lang, [tok]):
            rows.append(f"('{lang}', '{c}')")
    return f"cand AS (SELECT * FROM (VALUES {', '.join(rows)}) v(language, src_token))"


@query("expand_candidates", sql=_w(PAIRS, GID, SPLITS, _cand_sql()) + """SELECT sp.gid, sp.language, cand.src_token
 FROM sp JOIN cand ON sp.language = cand.language WHERE sp.split = 'dev'""")
def expand_candidates(spark, sf):
    """Every dev row x each candidate source token of its language."""
    dev = _splits(spark, sf).filter(F.col("split") == "dev")
    return I.expand_candidates(dev, _cand_table(spark), I.token_table(spark, SOURCE_TOKEN)).select(
        "gid", "language", "src_token")


@query("known_candidates", sql=_w(PAIRS) + f""", vocab AS (SELECT DISTINCT lower(t) AS token FROM
 (SELECT unnest({ws_tokens('text')}) AS t FROM benchmark)),
 cands AS (SELECT DISTINCT language, lower(t) AS token FROM (SELECT language, unnest({ws_tokens('tribal')}) AS t FROM pairs))
 SELECT c.language, c.token, v.token IS NOT NULL AS known FROM cands c LEFT JOIN vocab v ON c.token = v.token""")
def known_candidates(spark, sf):
    """Candidate words per language (every word of the tribal sides)
    checked against the vocabulary of the benchmark table."""
    from corpuslab.functions.text import ws_tokens as wt
    from corpuslab.plans.corpus_queries import _pairs
    vocab = X.table(spark, sf, "benchmark").select(F.explode(wt("text")).alias("t")).select(F.lower("t").alias("token"))
    cands = _pairs(spark, sf).select("language", F.explode(wt("tribal")).alias("t")).select(
        "language", F.lower("t").alias("token")).distinct()
    return I.known_candidates(cands, vocab)


def _known_candidates(spark):
    """The configured candidates that the model's vocabulary has, by language;
    every language must keep one."""
    wanted = _cand_table(spark).select("language", F.explode("candidates").alias("token"))
    vocab = I.token_table(spark, TOKEN_OF).select(F.col("src_lang").alias("token"))
    return I.require_known(I.known_candidates(wanted, vocab)).groupBy("language").agg(
        F.sort_array(F.collect_set("token")).alias("candidates"))


@query("sweep_candidates", sql=_w(PAIRS, GID, SPLITS) + f""", cand AS (SELECT * FROM (VALUES {", ".join(
    f"('{x}', '{t}')" for x in SOURCE_TOKEN for t in CANDIDATES.get(x, [SOURCE_TOKEN[x]]) if t in TOKEN_OF.values())}) v(language, src_token))
 SELECT sp.language, cand.src_token, count(*) AS n_rows FROM sp JOIN cand ON sp.language = cand.language WHERE sp.split = 'dev' GROUP BY ALL""")
def sweep_candidates(spark, sf):
    """J6 + J7 of the sweep: dev rows per candidate that the vocabulary knows
    (one of the configured candidates is not in it)."""
    dev = _splits(spark, sf).filter(F.col("split") == "dev")
    rows = I.expand_candidates(dev, _known_candidates(spark), I.token_table(spark, SOURCE_TOKEN))
    return rows.groupBy("language", "src_token").agg(F.count(F.lit(1)).alias("n_rows"))


@query("predict_hooks", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, language, {_token_case('language')} AS src_lang,
 trim(concat(array_to_string(list_filter(list_prepend(concat({_token_case('language')}, ':'), {ws_tokens('tribal')}), lambda x, i: (i - 1) % 2 = 0), ' '), ' .')) AS hyp
 FROM sp WHERE split = 'test'""")
def predict_hooks(spark, sf):
    """hooks around the batch function: one puts the source token before
    the text, one ends the output with a full stop."""
    return I.predict_batches(_test_rows(spark, sf), every_other_word, "tribal", ["gid", "language"], BATCH, token_col="src_lang",
                             pre=lambda text, token: f"{token}: {text}", post=lambda text: f"{text} .")


@query("run_sweep")
def run_sweep(spark, sf):
    """dev split x candidate tokens -> batch function -> per-token scores
    -> rank per language."""
    dev = _splits(spark, sf).filter(F.col("split") == "dev")
    tokens = I.token_table(spark, SOURCE_TOKEN)
    rows = I.expand_candidates(dev, _known_candidates(spark), tokens)
    pred = I.predict_batches(rows, token_dependent, "tribal", ["gid", "language", "english", "src_token"],
                             BATCH, token_col="src_token", fn_takes_token=True)
    st = M.segment_stats(pred.withColumn("model", F.lit("stub")), hyp="hyp", ref="english",
                         segment_keys=("gid",))
    sc = M.score_groups(st, ["model", "language", "src_token"], src_lang=None)
    return R.rank_candidates(sc)


@query("score_pairs")
def score_pairs(spark, sf):
    """A9 on a second corpus: user turns scored against the assistant turns
    that follow them (echo system), all metrics, one corpus-level row."""
    tp = X.turn_pairs(spark, sf).withColumn("corpus", F.lit("turn_pairs"))
    st = M.segment_stats(tp, hyp="source", ref="reference", segment_keys=("conv_id", "turn"))
    return M.score_groups(st, ["corpus"], src_lang=None)


@query("training_set_tokens", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, language, {_token_case('language')} AS src_lang,
 CAST(len(list_slice({ws_tokens('tribal')}, 1, 192)) AS BIGINT) AS length
 FROM sp WHERE split = 'train'""")
def training_set_tokens(spark, sf):
    """F3 + J5: training examples with their source token and clipped length."""
    from corpuslab.operators.corpus import training_set
    tr = I.attach_source_token(_splits(spark, sf).filter(F.col("split") == "train"), I.token_table(spark, SOURCE_TOKEN))
    return training_set(tr).select("gid", "language", "src_lang", F.col("length").cast("long"))
