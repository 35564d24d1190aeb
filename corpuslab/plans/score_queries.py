"""Registered scoring queries over the ``predictions`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import subword
from corpuslab.functions.text import WS_CLASS, fold_failures
from corpuslab.functions.tokenize import CHRF_PUNCT, T13A_PRE, T13A_RULES
from corpuslab.operators import metrics as M
from corpuslab.operators import resample as RS
from corpuslab.plans import fixtures as X
from corpuslab.plans.registry import oracle, query
from corpuslab.plans.sqltext import bt, fold, ws_tokens

# ---- fixed values -------------------------------------------------------
KEYS = ["model", "setting", "language"]
SEG_KEYS = ("doc_id",)   # spread by the reference key: runs of one reference share a task
BOOT_ROUNDS = 1000
BOOT_SEED = 42
# stand-in subword tokens for spBLEU over a caller-supplied token column:
# runs of up to 4 non-space characters.
SUBWORD_CHARS = 4
SUBWORD_RE = "[^" + WS_CLASS[1:-1] + f"]{{1,{SUBWORD_CHARS}}}"
# where such tokens end inside a word (the blank is the only white space in these texts):
# with a blank after each of these, white space parts the tokens
SUBWORD_CUT = "[^ ]{4}(?=[^ ])"
# ------------------------------------------------------------------------


def _stats(spark, sf, rouge=True, sp=False, chrf=True, bleu=True):
    p = X.predictions(spark, sf)
    if sp:
        return M.segment_stats(p, rouge=rouge,
                               sp_hyp_tokens=subword.pieces(SUBWORD_CHARS, fold_failures("hyp")),
                               sp_ref_tokens=subword.pieces(SUBWORD_CHARS, F.col("english")),
                               segment_keys=SEG_KEYS, chrf=chrf, bleu=bleu)
    return M.segment_stats(p, rouge=rouge, segment_keys=SEG_KEYS, chrf=chrf, bleu=bleu)


# ------------------------------------------------------------- SQL twins
def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tok13a(x: str) -> str:
    s = x
    for a, b in T13A_PRE:
        a_sql = "chr(10)" if a == "\n" else ("'-' || chr(10)" if a == "-\n" else _sql_lit(a))
        b_sql = "' '" if b == " " and a == "\n" else _sql_lit(b)
        s = f"replace({s}, {a_sql}, {b_sql})"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in T13A_RULES:
        s = f"regexp_replace({s}, {_sql_lit(pat)}, {_sql_lit(rep.replace('$', chr(92)))}, 'g')"
    return ws_tokens(s)


def sql_chrf_words(x: str) -> str:
    P = _sql_lit(CHRF_PUNCT)
    return (f"flatten(list_transform({ws_tokens(x)}, lambda w: CASE WHEN length(w) = 1 THEN [w] "
            f"WHEN contains({P}, right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)] "
            f"WHEN contains({P}, left(w, 1)) THEN [left(w, 1), substr(w, 2)] ELSE [w] END))")


def sql_ngrams(src: str, keys: str, lst: str, orders: int, sep: str, o_offset: int = 0) -> str:
    """(keys, o, g, c): n-gram counts of a list column, n = 1..orders, o = n - 1 + o_offset.
    Linear: n-grams come from lead() over the unnested tokens."""
    leads = ", ".join(f"lead(t, {k}) OVER w AS t{k}" for k in range(1, orders))
    grams = ", ".join("t0" if n == 1 else " || ".join(["t0"] + [f"'{sep}' || t{k}" if sep else f"t{k}" for k in range(1, n)])
                      for n in range(1, orders + 1))
    return f"""(SELECT {keys}, o, g, count(*) AS c FROM (
   SELECT {keys}, unnest(range({o_offset}, {o_offset + orders})) AS o, unnest([{grams}]) AS g FROM (
    SELECT {keys}, t AS t0{", " + leads if leads else ""} FROM (
     SELECT * FROM (SELECT {keys}, unnest({lst}) AS t, generate_subscripts({lst}, 1) AS i FROM {src}) WHERE t <> '')
    WINDOW w AS (PARTITION BY {keys} ORDER BY i)))
  WHERE g IS NOT NULL GROUP BY ALL)"""


SEG = f"""seg AS MATERIALIZED (
 SELECT model, setting, language, doc_id, src_lang, {fold('hyp')} AS h, {bt('english')} AS r FROM predictions)"""

# per-segment chrF statistics in long form: o = 0..7 (char 1..6, word 1..2)
CHRF_LONG = f"""hs AS MATERIALIZED (SELECT model, setting, language, doc_id, regexp_replace(h, '{WS_CLASS}', '', 'g') AS s,
   {sql_chrf_words('h')} AS w FROM seg),
 rs AS MATERIALIZED (SELECT DISTINCT doc_id, regexp_replace(r, '{WS_CLASS}', '', 'g') AS s, {sql_chrf_words('r')} AS w FROM seg),
 hg AS (SELECT * FROM {sql_ngrams("hs", "model, setting, language, doc_id", "string_split(s, '')", 6, "")}
        UNION ALL SELECT * FROM {sql_ngrams("hs", "model, setting, language, doc_id", "w", 2, " ", 6)}),
 rg AS (SELECT * FROM {sql_ngrams("rs", "doc_id", "string_split(s, '')", 6, "")}
        UNION ALL SELECT * FROM {sql_ngrams("rs", "doc_id", "w", 2, " ", 6)}),
 cm AS (SELECT hg.model, hg.setting, hg.language, hg.doc_id, hg.o, sum(least(hg.c, rg.c)) AS m
        FROM hg JOIN rg ON hg.doc_id = rg.doc_id AND hg.o = rg.o AND hg.g = rg.g GROUP BY ALL),
 clong AS MATERIALIZED (
  SELECT hs.model, hs.setting, hs.language, hs.doc_id, o.o,
   CAST(CASE WHEN o.o < 6 THEN greatest(length(hs.s) - o.o, 0) ELSE greatest(len(hs.w) - (o.o - 6), 0) END AS DOUBLE) AS hh,
   CAST(CASE WHEN o.o < 6 THEN greatest(length(rs.s) - o.o, 0) ELSE greatest(len(rs.w) - (o.o - 6), 0) END AS DOUBLE) AS rr,
   CAST(coalesce(cm.m, 0) AS DOUBLE) AS mm
  FROM hs JOIN rs ON hs.doc_id = rs.doc_id CROSS JOIN (SELECT unnest(range(0, 8)) AS o) o
  LEFT JOIN cm ON cm.model = hs.model AND cm.setting = hs.setting AND cm.doc_id = hs.doc_id AND cm.o = o.o)"""


def sql_chrf_from_long(src: str, keys: str) -> str:
    """chrF++ per group from a long table (keys..., o, H, R, M) of summed stats."""
    ok = "(H > 0 AND R > 0)"
    return f"""(SELECT {keys}, CASE WHEN eff = 0 OR (p + r) = 0 THEN 0.0 ELSE 100.0 * 5.0 * p * r / (4.0 * p + r) END AS score
 FROM (SELECT {keys}, sum(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END) AS eff,
   sum(CASE WHEN {ok} THEN M / H ELSE 0.0 END) / nullif(sum(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END), 0) AS p,
   sum(CASE WHEN {ok} THEN M / R ELSE 0.0 END) / nullif(sum(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END), 0) AS r
  FROM {src} GROUP BY {keys}))"""


BLEU_SEG = f"""bt AS MATERIALIZED (SELECT model, setting, language, doc_id, {sql_tok13a('h')} AS ht FROM seg),
 brt AS MATERIALIZED (SELECT DISTINCT doc_id, {sql_tok13a('r')} AS rt FROM seg),
 bhg AS (SELECT model, setting, language, doc_id, o + 1 AS n, g, c FROM {sql_ngrams("bt", "model, setting, language, doc_id", "ht", 4, " ")}),
 brg AS (SELECT doc_id, o + 1 AS n, g, c FROM {sql_ngrams("brt", "doc_id", "rt", 4, " ")}),
 bm AS (SELECT bhg.model, bhg.setting, bhg.language, bhg.doc_id, bhg.n, sum(least(bhg.c, brg.c)) AS m
        FROM bhg JOIN brg ON bhg.doc_id = brg.doc_id AND bhg.n = brg.n AND bhg.g = brg.g GROUP BY ALL),
 bmw AS (SELECT model, setting, doc_id, {", ".join(f"sum(m) FILTER (WHERE n = {n}) AS m{n}" for n in range(1, 5))} FROM bm GROUP BY ALL),
 bseg AS MATERIALIZED (
  SELECT bt.model, bt.setting, bt.language, bt.doc_id, CAST(len(bt.ht) AS DOUBLE) AS sys_len, CAST(len(brt.rt) AS DOUBLE) AS ref_len,
   {", ".join(f"CAST(coalesce(bmw.m{n}, 0) AS DOUBLE) AS m{n}" for n in range(1, 5))},
   {", ".join(f"CAST(greatest(len(bt.ht) - {n - 1}, 0) AS DOUBLE) AS t{n}" for n in range(1, 5))}
  FROM bt JOIN brt ON bt.doc_id = brt.doc_id
  LEFT JOIN bmw ON bmw.model = bt.model AND bmw.setting = bt.setting AND bmw.doc_id = bt.doc_id)"""


def sql_bleu(prefix_sum: bool = True) -> str:
    """BLEU expression over columns sys_len, ref_len, m1..m4, t1..t4."""
    logs = []
    z = "0"
    for n in range(1, 5):
        z = f"({z} + CASE WHEN m{n} = 0 THEN 1 ELSE 0 END)"
        logs.append(f"ln(CASE WHEN m{n} = 0 THEN 100.0 / (pow(2.0, {z}) * t{n}) ELSE 100.0 * m{n} / t{n} END)")
    mean_log = "(" + " + ".join(logs) + ") / 4"
    bp = "CASE WHEN sys_len < ref_len THEN exp(1.0 - ref_len / sys_len) ELSE 1.0 END"
    return f"CASE WHEN sys_len = 0 OR t4 = 0 OR m1 + m2 + m3 + m4 = 0 THEN 0.0 ELSE {bp} * exp({mean_log}) END"


def _w(*ctes):
    return X.with_ctes(X.PREDICTIONS_SQL, SEG, *ctes)


# ---------------------------------------------------------------- queries
@query("fold_failures", sql=_w() + """SELECT model, setting, language, doc_id, h AS hyp_clean,
 (h = '') AS is_empty FROM seg""")
def fold_failures_q(spark, sf):
    """P4 + P5: hypotheses as text, failure markers folded to ''."""
    p = X.predictions(spark, sf)
    h = fold_failures("hyp")
    return p.select("model", "setting", "language", "doc_id", h.alias("hyp_clean"), (h == "").alias("is_empty"))


@query("failure_rate", sql=_w() + """SELECT model, setting, language, count(*) AS n,
 count(*) FILTER (WHERE h = '') AS empty_outputs,
 round(100.0 * count(*) FILTER (WHERE h = '') / greatest(count(*), 1), 2) AS empty_pct,
 round(100.0 * count(*) FILTER (WHERE h = '') / greatest(count(*), 1), 2) > 2.0 AS flagged
 FROM seg GROUP BY ALL""")
def failure_rate(spark, sf):
    """A3: empty/failed outputs per language, flagged above 2 %."""
    return M.failure_rate(X.predictions(spark, sf), KEYS)


@query("source_tokens_used", sql=_w() + """SELECT model, setting, language,
 array_to_string(list_sort(list_distinct(list(src_lang))), ',') AS src_lang FROM seg GROUP BY ALL""")
def source_tokens_used(spark, sf):
    """A4: sorted distinct source tokens per language."""
    return M.source_tokens_used(X.predictions(spark, sf), KEYS)


@query("chrf_stats", sql=_w(CHRF_LONG) + """SELECT model, setting, language, o AS ord,
 CAST(sum(hh) AS BIGINT) AS hyp_ngrams, CAST(sum(rr) AS BIGINT) AS ref_ngrams, CAST(sum(mm) AS BIGINT) AS matches
 FROM clong GROUP BY ALL""")
def chrf_stats(spark, sf):
    """A5 statistics: summed hyp / ref / clipped-match counts per chrF++ order."""
    st = _stats(spark, sf, rouge=False, bleu=False)
    sums = st.groupBy(*KEYS).agg(*M.stat_sums("chrf_st", M.N_CHRF, "c"))
    o = F.posexplode(F.array(*[F.array(*[F.col(f"c{3 * i + k}") for k in range(3)]) for i in range(8)]))
    return sums.select(*KEYS, o.alias("ord", "v")).select(
        *KEYS, F.col("ord").cast("long").alias("ord"), F.col("v")[0].alias("hyp_ngrams"),
        F.col("v")[1].alias("ref_ngrams"), F.col("v")[2].alias("matches"))


@query("chrf_corpus", sql=_w(CHRF_LONG) + f"""SELECT model, setting, language, round(score, 2) AS "chrf++" FROM
 {sql_chrf_from_long("(SELECT model, setting, language, o, sum(hh) AS H, sum(rr) AS R, sum(mm) AS M FROM clong GROUP BY ALL)", "model, setting, language")}""")
def chrf_corpus(spark, sf):
    """A5: corpus chrF++ per (model, setting, language)."""
    st = _stats(spark, sf, rouge=False, bleu=False)
    g = st.groupBy(*KEYS).agg(*M.stat_sums("chrf_st", M.N_CHRF, "c"))
    return g.select(*KEYS, F.round(M.chrf_score("c"), 2).alias("chrf++"))


@query("bleu_stats", sql=_w(BLEU_SEG) + """SELECT model, setting, language,
 CAST(sum(sys_len) AS BIGINT) AS sys_len, CAST(sum(ref_len) AS BIGINT) AS ref_len,
 """ + ", ".join(f"CAST(sum(m{n}) AS BIGINT) AS match_{n}, CAST(sum(t{n}) AS BIGINT) AS total_{n}" for n in range(1, 5))
       + " FROM bseg GROUP BY ALL")
def bleu_stats(spark, sf):
    """A6 statistics: summed lengths, clipped matches and totals per order (13a)."""
    st = _stats(spark, sf, rouge=False, chrf=False)
    b = F.col("bleu_st")
    return st.groupBy(*KEYS).agg(
        F.sum(b[0]).alias("sys_len"), F.sum(b[1]).alias("ref_len"),
        *[x for n in range(4) for x in (F.sum(b[2 + n]).alias(f"match_{n + 1}"), F.sum(b[6 + n]).alias(f"total_{n + 1}"))])


@query("bleu_corpus", sql=_w(BLEU_SEG) + f"""SELECT model, setting, language, round({sql_bleu()}, 2) AS "BLEU" FROM
 (SELECT model, setting, language, sum(sys_len) AS sys_len, sum(ref_len) AS ref_len,
  {", ".join(f"sum(m{n}) AS m{n}, sum(t{n}) AS t{n}" for n in range(1, 5))} FROM bseg GROUP BY ALL)""")
def bleu_corpus(spark, sf):
    """Corpus BLEU (13a tokeniser) per (model, setting, language)."""
    st = _stats(spark, sf, rouge=False, chrf=False)
    g = st.groupBy(*KEYS).agg(*M.stat_sums("bleu_st", M.N_BLEU, "b"))
    return g.select(*KEYS, F.round(M.bleu_score("b"), 2).alias("BLEU"))


def _sp_sql():
    tok = lambda x: f"regexp_extract_all({x}, '{SUBWORD_RE}')"
    return BLEU_SEG.replace(f"{sql_tok13a('h')} AS ht", f"{tok('h')} AS ht").replace(
        f"{sql_tok13a('r')} AS rt", f"{tok('r')} AS rt")


@query("bleu_tokens", sql=_w(_sp_sql()) + f"""SELECT model, setting, language, round({sql_bleu()}, 2) AS "spBLEU", '4char' AS tokenizer FROM
 (SELECT model, setting, language, sum(sys_len) AS sys_len, sum(ref_len) AS ref_len,
  {", ".join(f"sum(m{n}) AS m{n}, sum(t{n}) AS t{n}" for n in range(1, 5))} FROM bseg GROUP BY ALL)""")
def bleu_tokens(spark, sf):
    """BLEU over a caller-supplied subword token column (stand-in tokens:
    runs of up to 4 characters), labelled with the tokeniser used."""
    st = _stats(spark, sf, rouge=False, sp=True, chrf=False, bleu=False)
    g = st.groupBy(*KEYS).agg(*M.stat_sums("sp_st", M.N_BLEU, "s"))
    return g.select(*KEYS, F.round(M.bleu_score("s"), 2).alias("spBLEU"), F.lit("4char").alias("tokenizer"))


@query("spbleu_subword")
def spbleu_subword(spark, sf):
    """spBLEU over the subword tokens of a sentencepiece model, labelled with
    it (13a tokens, with a warning, where no model is installed). No SQL twin:
    SQL has no subword tokeniser; tests compare with plain counting."""
    try:
        import public_tokenizers
        models = [public_tokenizers.path("piece_bpe_32k.model")]
    except ImportError:
        models = []
    model = subword.usable_model(models)
    st = M.segment_stats(X.predictions(spark, sf), rouge=False, chrf=False, bleu=model is None, sp_model=model, segment_keys=SEG_KEYS)
    column, name = ("bleu_st", "13a") if model is None else ("sp_st", subword.label(model))
    g = st.groupBy(*KEYS).agg(*M.stat_sums(column, M.N_BLEU, "s"))
    return g.select(*KEYS, F.round(M.bleu_score("s"), 2).alias("spBLEU"), F.lit(name).alias("tokenizer"))


@query("rouge_l")
def rouge_l(spark, sf):
    """Mean per-segment ROUGE-L F1 x 100 with Porter stemming. Its SQL twin
    counts tokens, which holds as every hypothesis here is a subsequence of its
    reference; tests check the LCS against a plain DP."""
    p = X.predictions(spark, sf)
    st = M.segment_stats(p, rouge=True, segment_keys=SEG_KEYS, chrf=False, bleu=False)
    return st.groupBy(*KEYS).agg(F.round(F.avg(M.rouge_f()) * 100.0, 2).alias("ROUGE-L"))


def _scores(spark, sf):
    return M.score_groups(_stats(spark, sf, rouge=True), KEYS)


@query("score_runs")
def score_runs(spark, sf):
    """A9 + A11: all metrics per (model, setting, language) with the chrF++
    bootstrap interval; segment statistics computed once and reused."""
    st = M.compact_stats(_stats(spark, sf, rouge=True), [*KEYS, "doc_id", "src_lang"])
    sc = M.score_groups(st, KEYS)
    ci = RS.split_bootstrap_ci(st, KEYS, "doc_id", BOOT_ROUNDS, BOOT_SEED)
    return sc.join(ci, KEYS, "left")


@query("macro_average")
def macro_average(spark, sf):
    """A10: per run, unweighted mean of the rounded per-language metrics; pooled n, empty_pct."""
    return M.macro_average(_scores(spark, sf), ["model", "setting"])


def _mean2(c: str) -> str:
    return f'round(sum(CAST(round("{c}" * 100.0) AS BIGINT)) / count("{c}"), 0) / 100.0'


MACRO_SQL_BODY = f"""SELECT model, setting, {_mean2("chrf++")} AS "chrf++", {_mean2("spBLEU")} AS "spBLEU",
 {_mean2("ROUGE-L")} AS "ROUGE-L", {_mean2("BLEU")} AS "BLEU", sum(n) AS n_total,
 round(100.0 * sum(empty_outputs) / greatest(sum(n), 1), 2) AS empty_pct FROM scores GROUP BY model, setting"""


@query("bootstrap_ci", sql=_w(CHRF_LONG) + f""", pos AS MATERIALIZED (
  SELECT model, setting, language, doc_id, row_number() OVER (PARTITION BY model, setting, language ORDER BY doc_id) - 1 AS pos,
   count(*) OVER (PARTITION BY model, setting, language) AS n FROM seg),
 draws AS (SELECT model, setting, language, b AS round,
   CAST(('0x' || substr(md5(concat_ws(':', '{BOOT_SEED}', b, pos)), 1, 12)) AS BIGINT) % n AS idx
   FROM pos CROSS JOIN (SELECT unnest(range(0, {BOOT_ROUNDS})) AS b) WHERE n >= 2),
 segl AS (SELECT p.model, p.setting, p.language, p.pos, c.o, c.hh, c.rr, c.mm FROM pos p JOIN clong c
   ON p.model = c.model AND p.setting = c.setting AND p.doc_id = c.doc_id),
 per_round AS (SELECT d.model, d.setting, d.language, d.round, s.o, sum(s.hh) AS H, sum(s.rr) AS R, sum(s.mm) AS M
   FROM draws d JOIN segl s ON d.model = s.model AND d.setting = s.setting AND d.language = s.language AND d.idx = s.pos
   GROUP BY ALL),
 sc AS {sql_chrf_from_long("per_round", "model, setting, language, round")}
 SELECT model, setting, language, round(avg(score), 2) AS "chrf++_mean",
  round(quantile_cont(score, 0.025), 2) AS "chrf++_ci_lo", round(quantile_cont(score, 0.975), 2) AS "chrf++_ci_hi"
 FROM sc GROUP BY ALL""")
def bootstrap_ci(spark, sf):
    """1,000-round paired percentile bootstrap of chrF++ per language."""
    st = M.compact_stats(_stats(spark, sf, rouge=False, bleu=False), [*KEYS, "doc_id"])
    return M.bootstrap_ci(st, KEYS, "doc_id", BOOT_ROUNDS, BOOT_SEED, draw_hash="md5")


def _sql_weight(pos: str, b: str) -> str:
    """Poisson(1) weight of a position in a round, as ``metrics.draw_mix``."""
    cuts = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in M.POISSON_CDF)
    return f"""(SELECT *, {cuts} AS w FROM (SELECT *, ((x2 * x2 + {b}) % {M.P31})::DOUBLE / {M.P31} AS u FROM
 (SELECT *, (x1 * 48271 + x0) % {M.P31} AS x2 FROM (SELECT *, (x0 * x0 + 12345) % {M.P31} AS x1 FROM
 (SELECT *, CAST(({pos} % {M.P31} * 48271 + {b} * 69621 + {BOOT_SEED} * 16807) % {M.P31} AS BIGINT) AS x0 FROM
 (SELECT DISTINCT doc_id FROM bseg) CROSS JOIN (SELECT unnest(range(0, {BOOT_ROUNDS})) AS b))))))"""


@query("bootstrap_weights", sql=_w(BLEU_SEG) + f""", wt AS MATERIALIZED {_sql_weight("doc_id", "b")},
 pr AS (SELECT s.model, s.setting, s.language, b, sum(w * sys_len) AS sys_len, sum(w * ref_len) AS ref_len,
   {", ".join(f"sum(w * m{n}) AS m{n}, sum(w * t{n}) AS t{n}" for n in range(1, 5))}
   FROM bseg s JOIN wt ON s.doc_id = wt.doc_id GROUP BY ALL),
 sc AS (SELECT model, setting, language, b, {sql_bleu()} AS score FROM pr)
 SELECT model, setting, language, round(avg(score), 2) AS "BLEU_mean", round(quantile_cont(score, 0.025), 2) AS "BLEU_ci_lo",
  round(quantile_cont(score, 0.975), 2) AS "BLEU_ci_hi" FROM sc GROUP BY ALL""")
def bootstrap_weights(spark, sf):
    """A11 in its weight form: 1,000-round interval of BLEU per language from
    Poisson weights, without draws or joins."""
    st = _stats(spark, sf, rouge=False, chrf=False)
    return M.weight_bootstrap_ci(st, KEYS, "doc_id", BOOT_ROUNDS, BOOT_SEED, "BLEU")


# ------------------------------------------------------- score tables (SQL)
# ROUGE-L twin: every hypothesis of the stand-in runs keeps whole words of
# its reference in order, so its ROUGE tokens are a subsequence of the
# reference's and LCS = |h| (stemming maps tokens one to one). The twin thus
# checks the bit-parallel LCS on whole documents with token counts only.
ROUGE_SEG = """rl AS MATERIALIZED (SELECT model, setting, language, doc_id,
   CAST(len(list_filter(regexp_split_to_array(lower(h), '[^a-z0-9]+'), lambda t: t <> '')) AS DOUBLE) AS nh,
   CAST(len(list_filter(regexp_split_to_array(lower(r), '[^a-z0-9]+'), lambda t: t <> '')) AS DOUBLE) AS nr FROM seg),
 rseg AS MATERIALIZED (SELECT model, setting, language, doc_id,
   CASE WHEN nh = 0 OR nr = 0 THEN 0.0 ELSE 2 * (nh / nh) * (nh / nr) / ((nh / nh) + (nh / nr)) END AS f FROM rl)"""


def sql_scores(keys: list[str], where: str = "TRUE", token_expr: str | None = None) -> str:
    """CTE text ``scores`` with the columns of ``score_groups`` per ``keys``
    (chrF++, spBLEU = BLEU-13a, BLEU, ROUGE-L, empties, tokens)."""
    ks = ", ".join(keys)
    tok = f", {token_expr} AS src_token" if token_expr else ""
    src = ", array_to_string(list_sort(list_distinct(list(src_lang))), ',') AS src_lang" if not token_expr else ""
    return f""" sx AS MATERIALIZED (SELECT s.model, s.setting, s.language, s.doc_id, s.h, s.src_lang{tok}, r.f
   FROM seg s JOIN rseg r ON s.model = r.model AND s.setting = r.setting AND s.doc_id = r.doc_id
   WHERE {where.replace('setting', 's.setting')}),
 g1 AS (SELECT {ks}, count(*) AS n, count(*) FILTER (WHERE h = '') AS empty_outputs, avg(f) AS rouge{src}
   FROM sx GROUP BY {ks}),
 cl2 AS (SELECT c.*{tok.replace('src_lang', 's.src_lang')} FROM clong c JOIN seg s
   ON c.model = s.model AND c.setting = s.setting AND c.doc_id = s.doc_id WHERE {where.replace('setting', 's.setting')}),
 g2 AS {sql_chrf_from_long(f"(SELECT {ks}, o, sum(hh) AS H, sum(rr) AS R, sum(mm) AS M FROM cl2 GROUP BY {ks}, o)", ks)},
 bs2 AS (SELECT b.*{tok.replace('src_lang', 's.src_lang')} FROM bseg b JOIN seg s
   ON b.model = s.model AND b.setting = s.setting AND b.doc_id = s.doc_id WHERE {where.replace('setting', 's.setting')}),
 g3 AS (SELECT {ks}, {sql_bleu()} AS bleu FROM (SELECT {ks}, sum(sys_len) AS sys_len, sum(ref_len) AS ref_len,
   {", ".join(f"sum(m{n}) AS m{n}, sum(t{n}) AS t{n}" for n in range(1, 5))} FROM bs2 GROUP BY {ks})),
 scores AS (SELECT {", ".join(f"g1.{k}" for k in keys)}, g1.n, round(g2.score, 2) AS "chrf++", round(g3.bleu, 2) AS "spBLEU",
   round(g3.bleu, 2) AS "BLEU", round(g1.rouge * 100.0, 2) AS "ROUGE-L", g1.empty_outputs,
   round(100.0 * g1.empty_outputs / greatest(g1.n, 1), 2) AS empty_pct, '13a' AS tokenizer{", g1.src_lang" if not token_expr else ""}
   FROM g1 JOIN g2 ON {" AND ".join(f"g1.{k} = g2.{k}" for k in keys)} JOIN g3 ON {" AND ".join(f"g1.{k} = g3.{k}" for k in keys)})"""


def scores_sql_prefix(keys=None, where="TRUE", token_expr=None) -> str:
    return _w(CHRF_LONG, BLEU_SEG, ROUGE_SEG) + "," + sql_scores(keys or KEYS, where, token_expr)


ORACLE_ROUGE = _w(ROUGE_SEG) + """SELECT model, setting, language, round(avg(f) * 100.0, 2) AS "ROUGE-L"
 FROM rseg GROUP BY ALL"""


oracle("rouge_l", ORACLE_ROUGE)
oracle("macro_average", scores_sql_prefix() + "\n" + MACRO_SQL_BODY)
