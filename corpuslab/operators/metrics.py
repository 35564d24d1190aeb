"""Corpus metrics from additive per-segment statistics.

Plan shape: one map stage computes the statistic vectors of every segment
(``segment_stats``: JVM tokenisers + one Arrow UDF pass, no shuffle); every
score is then a ``sum`` aggregate followed by a scalar formula, so grouping by
(model, setting, language), by candidate token, or by bootstrap round is the
same cheap partial-aggregate + small shuffle.

Formulas (from the papers):
* chrF++ (Popovic 2015/2017): beta=2, char orders 1..6 + word orders 1..2,
  precision/recall averaged over orders that have hyp and ref n-grams.
* BLEU (Papineni 2002; Post 2018): 4-gram, brevity penalty, zero-match orders
  smoothed by halving powers (Chen & Cherry 2014, method 3).
* ROUGE-L (Lin 2004): mean per-segment LCS F1 x 100.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.functions import ngram, subword
from corpuslab.functions.text import as_text, fold_failures, safe_pct
from corpuslab.operators.layout import spread
from corpuslab.session import stored

CHRF_BETA = 2.0
N_CHRF = 3 * (ngram.CHAR_ORDER + ngram.WORD_ORDER)   # 24
N_BLEU = 2 + 2 * ngram.BLEU_ORDER                     # 10
METRICS = ["chrf++", "spBLEU", "ROUGE-L", "BLEU"]


# ----------------------------------------------------------------- stats
def segment_stats(df: DataFrame, hyp: str = "hyp", ref: str = "english",
                  rouge: bool = True, stem: bool = True,
                  sp_hyp_tokens: Column | None = None,
                  sp_ref_tokens: Column | None = None, sp_model: str | None = None,
                  segment_keys: tuple = (), chrf: bool = True, bleu: bool = True) -> DataFrame:
    """Adds ``h`` (folded hyp), ``r`` (reference text), ``chrf_st`` (24),
    ``bleu_st`` (10), optional ``sp_st`` (10, BLEU over the caller's tokens, an
    array or a text that white space parts into tokens, or over those of the
    subword model ``sp_model``) and ``rouge_st`` ([lcs, |h|, |r|]).

    ``segment_keys`` spread a narrowly-split input over the cluster before the
    Arrow pass (no-op when the input is already wide); ``chrf`` / ``bleu`` /
    ``rouge`` switch the statistics that are computed at all."""
    df = spread(df, *segment_keys)
    d = df.withColumn("h", fold_failures(hyp)).withColumn("r", as_text(ref))
    h, r = F.col("h"), F.col("r")
    st = ngram.segment_stats(h, r, rouge, stem, chrf, bleu).alias("__st")
    d = d.select("*", (h == "").alias("h_empty"), *([st] if chrf or bleu or rouge else []))
    cols = ([F.col("__st.chrf").alias("chrf_st")] if chrf else []) + \
        ([F.col("__st.bleu").alias("bleu_st")] if bleu else [])
    if rouge:
        cols.append(F.col("__st.rouge").alias("rouge_st"))
    if sp_hyp_tokens is not None:
        spaced = isinstance(d.select(sp_hyp_tokens).schema[0].dataType, StringType)
        cols.append((ngram.spaced_bleu_stats if spaced else ngram.bleu_stats)(sp_hyp_tokens, sp_ref_tokens).alias("sp_st"))
    elif sp_model is not None:
        cols.append(subword.bleu_stats(sp_model, h, r).alias("sp_st"))
    return d.select(*[c for c in d.columns if c != "__st"], *cols)


def compact_stats(stats: DataFrame, keep: list[str]) -> DataFrame:
    """Only the keys and statistic vectors (no texts), written once: what several
    branches of a plan read and what gets resampled."""
    vec = [c for c in ("h_empty", "chrf_st", "bleu_st", "sp_st", "rouge_st") if c in stats.columns]
    return stored(stats.select(*keep, *vec), "stats")


def stat_sums(col: str, n: int, prefix: str, weight: Column | None = None) -> list[Column]:
    """sum of each element of a statistic vector (optionally weighted)."""
    return [F.sum(F.col(col)[i] * weight if weight is not None else F.col(col)[i]).alias(f"{prefix}{i}")
            for i in range(n)]


def rouge_f(col: str = "rouge_st") -> Column:
    """Per-segment ROUGE-L F1 from [lcs, |h|, |r|]."""
    lcs, lh, lr = (F.col(col)[i].cast("double") for i in range(3))
    p, rc = F.try_divide(lcs, lh), F.try_divide(lcs, lr)
    return F.when((lh == 0) | (lr == 0) | (lcs == 0), F.lit(0.0)).otherwise(F.try_divide(2 * p * rc, p + rc))


# -------------------------------------------------------------- formulas
def chrf_score(prefix: str = "c") -> Column:
    """chrF++ (x100) from summed stats columns prefix0..prefix23."""
    valid, precs, recs = [], [], []
    for i in range(N_CHRF // 3):
        hh, rr, mm = (F.col(f"{prefix}{3 * i + k}").cast("double") for k in range(3))
        ok = (hh > 0) & (rr > 0)
        valid.append(F.when(ok, 1.0).otherwise(0.0))
        precs.append(F.when(ok, F.try_divide(mm, hh)).otherwise(0.0))
        recs.append(F.when(ok, F.try_divide(mm, rr)).otherwise(0.0))
    eff = sum(valid[1:], valid[0])
    p = F.try_divide(sum(precs[1:], precs[0]), eff)
    r = F.try_divide(sum(recs[1:], recs[0]), eff)
    b2 = CHRF_BETA ** 2
    f = F.try_divide(F.lit(100.0) * (1 + b2) * p * r, b2 * p + r)
    return F.when((eff == 0) | ((p + r) == 0), F.lit(0.0)).otherwise(f)


def bleu_score(prefix: str = "b") -> Column:
    """BLEU (x100) from summed stats prefix0..prefix9 =
    [hyp_len, ref_len, match_1..4, total_1..4] with exp smoothing."""
    sys_len, ref_len = F.col(f"{prefix}0").cast("double"), F.col(f"{prefix}1").cast("double")
    k = ngram.BLEU_ORDER
    logs, zeros = [], F.lit(0)
    for n in range(k):
        m = F.col(f"{prefix}{2 + n}").cast("double")
        t = F.col(f"{prefix}{2 + k + n}").cast("double")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        p = F.when(m == 0, F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), zeros) * t)).otherwise(
            F.try_divide(F.lit(100.0) * m, t))
        logs.append(F.log(p))
    mean_log = sum(logs[1:], logs[0]) / k
    bp = F.when(sys_len < ref_len, F.exp(F.lit(1.0) - F.try_divide(ref_len, sys_len))).otherwise(F.lit(1.0))
    last_total = F.col(f"{prefix}{2 + 2 * k - 1}")
    none = sum([F.col(f"{prefix}{2 + n}") for n in range(1, k)], F.col(f"{prefix}2")) == 0  # smoothing needs some match
    return F.when((sys_len == 0) | (last_total == 0) | none, F.lit(0.0)).otherwise(bp * F.exp(mean_log))


# ------------------------------------------------------------ group scores
def score_groups(stats: DataFrame, keys: list[str], rouge: bool = True,
                 src_lang: str | None = "src_lang", sp: str | None = None) -> DataFrame:
    """Per group n, chrF++, spBLEU, BLEU, ROUGE-L, empty outputs,
    empty_pct and the sorted distinct source tokens, all 2-dp. ``sp`` names the
    subword tokeniser behind the ``sp_st`` statistics; without it spBLEU is
    computed with 13a tokens, which a warning and the ``tokenizer`` column say."""
    if sp is None:
        warnings.warn("no subword tokens given: spBLEU uses 13a tokens and equals BLEU", stacklevel=2)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("h_empty")).alias("empty_outputs"),
            *stat_sums("chrf_st", N_CHRF, "c"), *stat_sums("bleu_st", N_BLEU, "b")]
    if sp:
        aggs += stat_sums("sp_st", N_BLEU, "s")
    if rouge:
        aggs.append(F.avg(rouge_f()).alias("__rouge"))
    if src_lang:
        aggs.append(F.array_join(F.array_sort(F.collect_set(F.col(src_lang).cast("string"))), ",").alias("src_lang"))
    g = stats.groupBy(*keys).agg(*aggs)
    bleu = F.round(bleu_score("b"), 2)
    out = [*keys, "n", F.round(chrf_score("c"), 2).alias("chrf++"),
           (F.round(bleu_score("s"), 2) if sp else bleu).alias("spBLEU"), bleu.alias("BLEU")]
    if rouge:
        out.append(F.round(F.col("__rouge") * 100.0, 2).alias("ROUGE-L"))
    out += ["empty_outputs", safe_pct("empty_outputs", "n").alias("empty_pct"), F.lit(sp or "13a").alias("tokenizer")]
    if src_lang:
        out.append("src_lang")
    return g.select(*out)


def macro_average(scores: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """A10: unweighted mean over languages of the already-rounded metrics,
    rounded again; n and empty_pct pooled."""
    present = [m for m in metrics if m in scores.columns]

    def mean2(c):
        # the inputs have 2 decimals: sum them as exact integer hundredths so
        # the result does not depend on the order a distributed sum takes
        cents = F.sum(F.round(c * 100.0).cast("long"))
        return F.round(cents / F.count(c), 0) / 100.0

    return scores.groupBy(*keys).agg(
        *[mean2(F.col(f"`{m}`")).alias(m) for m in present],
        F.sum("n").alias("n_total"),
        F.round(F.lit(100.0) * F.sum("empty_outputs") / F.greatest(F.sum("n"), F.lit(1)), 2).alias("empty_pct"))


def failure_rate(df: DataFrame, keys: list[str], hyp: str = "hyp", threshold: float = 2.0) -> DataFrame:
    """A3: empties after folding, pct of max(n,1), flag when strictly above threshold."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(fold_failures(hyp) == "").alias("empty_outputs"))
            .withColumn("empty_pct", safe_pct("empty_outputs", "n"))
            .withColumn("flagged", F.col("empty_pct") > F.lit(threshold)))


def source_tokens_used(df: DataFrame, keys: list[str], col: str = "src_lang") -> DataFrame:
    """A4: sorted distinct source tokens joined by ','."""
    return df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), ",").alias("src_lang"))


# --------------------------------------------------------------- bootstrap
def broadcast_limit(spark) -> int:
    """Largest side (bytes) we broadcast: 0 where the session has broadcasts
    switched off, else its auto-broadcast threshold, at least 64 MB (the side's
    size is counted, not estimated) and at most 512 MB."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = raw.rstrip("b")
    try:
        v = int(float(digits[:-1]) * mult[digits[-1]]) if digits[-1:] in mult else int(digits)
    except ValueError:
        v = 10 << 20
    return 0 if v <= 0 else min(max(v, 64 << 20), 512 << 20)


def metric_parts(metric: str):
    """(statistics column, its length, column prefix, formula) of a metric."""
    return {"chrf++": ("chrf_st", N_CHRF, "c", chrf_score), "BLEU": ("bleu_st", N_BLEU, "b", bleu_score),
            "spBLEU": ("sp_st", N_BLEU, "s", bleu_score)}[metric]


def bootstrap_ci(stats: DataFrame, keys: list[str], order_col: str, rounds: int = 1000,
                 seed: int = 42, metric: str = "chrf++", draw_hash: str = "xxhash64", cell: int = 4096) -> DataFrame:
    """Percentile interval of a corpus metric over resampled segments.

    Segments of each group are numbered 0..n-1 in ``order_col`` order (exact
    scalable rank). Draw j of round b picks segment ``hash(seed, b, j) mod n``:
    the draws depend on (seed, round, j, n) only, so two systems scored on the
    same rows are resampled identically (paired). They are made once for each
    size n that groups have, packed by the ``cell`` of at most 65,536 positions
    they fall into (two bytes a draw), and met there by the statistics of all groups of that size; a
    cell returns one sum per group and round. Groups with n < 2 or rounds <= 0
    get no interval. ``draw_hash='xxhash64'`` (default) is native and fast; 'md5'
    is slower but reproducible in any SQL engine (used by the oracle check).
    """
    from corpuslab.operators.partition import exact_rank, with_range_bucket
    from corpuslab.operators.resample import cell_sums, md5_numbers, xxhash_numbers

    if rounds <= 0:
        none = F.lit(None).cast("double")
        return stats.select(*keys).distinct().select(
            *keys, none.alias(f"{metric}_mean"), none.alias(f"{metric}_ci_lo"), none.alias(f"{metric}_ci_hi"))
    st_col, n_st, prefix, formula = metric_parts(metric)
    small = stats.select(*keys, order_col, st_col)
    ranked = exact_rank(with_range_bucket(small, order_col), keys, [order_col], F.col("__range"), "pos", "n").drop("__range")
    group = [f"k{i}" for i in range(len(keys))]
    ranked = stored(ranked.filter(F.col("n") >= 2).select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], "n", (F.col("pos") - 1).alias("pos"), F.col(st_col).alias("st")), "ranked")
    sums = [f"{prefix}{i}" for i in range(n_st)]
    per_round = (cell_sums(ranked, group, rounds, seed, md5_numbers if draw_hash == "md5" else xxhash_numbers, sums, cell).groupBy(*group, "round")
                 .agg(*[F.sum(c).alias(c) for c in sums]).select(*group, "round", formula(prefix).alias("score")))
    return per_round.groupBy(*group).agg(
        F.round(F.avg("score"), 2).alias(f"{metric}_mean"),
        F.round(F.percentile("score", 0.025), 2).alias(f"{metric}_ci_lo"),
        F.round(F.percentile("score", 0.975), 2).alias(f"{metric}_ci_hi")).select(
            *[F.col(g).alias(k) for k, g in zip(keys, group)], *[f"{metric}_{x}" for x in ("mean", "ci_lo", "ci_hi")])


#: Poisson(1) distribution function at 0..7; P(k >= 8) < 1e-5 counts as 8.
POISSON_CDF = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
P31 = (1 << 31) - 1


def draw_mix(seed: int, round_, position):
    """A number in 0..P31-1 from (seed, round, position): multiplications
    modulo a prime, the same in numpy and in any SQL engine."""
    x0 = (position % P31 * 48271 + round_ * 69621 + seed * 16807) % P31
    x1 = (x0 * x0 + 12345) % P31
    x2 = (x1 * 48271 + x0) % P31
    return (x2 * x2 + round_) % P31


def weight_bootstrap_ci(stats: DataFrame, keys: list[str], order_col: str, rounds: int = 1000,
                        seed: int = 42, metric: str = "chrf++") -> DataFrame:
    """A11 in its weight form, for groups too large to join draws: in every
    round a segment counts Poisson(1) times, with a weight hashed from (seed,
    round, order key). This approximates the multinomial resampling of
    ``bootstrap_ci``; callers choose it, size never does. No row is exploded
    and nothing is joined: a batch multiplies its rounds x rows weights with
    its rows x counts, a task returns one sum per group and round, and only
    those are exchanged. Systems scored on the same rows share weights."""
    import numpy as np
    import pyarrow as pa

    st_col, n_st, prefix, formula = metric_parts(metric)
    names = [f"k{i}" for i in range(len(keys))]
    rows = stats.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
                        F.col(order_col).cast("long").alias("pos"), F.col(st_col).alias("st"))

    def run(batches):
        every = np.arange(rounds, dtype=np.int64)[:, None]
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            group = list(zip(*[b.column(n).to_pylist() for n in names]))
            pos = b.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            st = b.column("st").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(group), n_st)
            where: dict[tuple, list[int]] = {}
            for i, g in enumerate(group):
                where.setdefault(g, []).append(i)
            for g, own in where.items():
                total = sums.setdefault(g, np.zeros((rounds, n_st + 1)))
                for at in range(0, len(own), 1024):
                    part = own[at:at + 1024]
                    w = np.searchsorted(POISSON_CDF, draw_mix(seed, every, pos[part][None, :]) / P31, side="right")
                    total[:, :n_st] += w @ st[part]
                    total[0, n_st] += len(part)  # rows of the group
        for g, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x] * rounds, pa.string()) for x in g], pa.array(np.arange(rounds), pa.int32()),
                 *[pa.array(total[:, i]) for i in range(n_st + 1)]],
                [*names, "round", *[f"{prefix}{i}" for i in range(n_st)], "rows"])

    cols = [f"{prefix}{i}" for i in range(n_st)]
    schema = ", ".join([*[f"{n} string" for n in names], "round int", *[f"{c} double" for c in cols], "rows double"])
    per_round = (rows.mapInArrow(run, schema).groupBy(*names, "round").agg(*[F.sum(c).alias(c) for c in [*cols, "rows"]])
                 .select(*names, "round", formula(prefix).alias("score"), "rows"))
    return (per_round.groupBy(*names).agg(
        F.round(F.avg("score"), 2).alias(f"{metric}_mean"),
        F.round(F.percentile("score", 0.025), 2).alias(f"{metric}_ci_lo"),
        F.round(F.percentile("score", 0.975), 2).alias(f"{metric}_ci_hi"), F.max("rows").alias("rows"))
        .filter("rows >= 2").drop("rows")
        .select(*[F.col(n).cast(stats.schema[k].dataType).alias(k) for k, n in zip(keys, names)],
                f"{metric}_mean", f"{metric}_ci_lo", f"{metric}_ci_hi"))
