"""Batch inference and resume.

``predict_batches`` runs a user batch function over a DataFrame with
``mapInPandas``: Spark partitions and schedules the work, each task builds the
function once (``fn_factory``) and feeds it fixed-size batches; rows never
pass through the driver. Resume is an anti-join on the row id, so a re-run
only touches missing or blank outputs, and re-running twice equals once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import blank_trim


def _run_batched(fn, texts: list[str], extra: list | None, batch_size: int) -> list[str]:
    """Feed ``texts`` to ``fn`` in batches; on MemoryError halve the batch and
    retry, failing only at batch size 1."""
    out: list[str] = []
    i, bs = 0, batch_size
    while i < len(texts):
        chunk = texts[i: i + bs]
        try:
            res = fn(chunk) if extra is None else fn(chunk, extra[i: i + bs])
        except MemoryError:
            if bs == 1:
                raise
            bs = max(1, bs // 2)
            continue
        out.extend(res)
        i += len(chunk)
    return out


def predict_batches(df: DataFrame, fn_factory: Callable[[], Callable], text_col: str,
                    keys: list[str], batch_size: int = 32, token_col: str | None = None,
                    pre: Callable | None = None, post: Callable | None = None,
                    fn_takes_token: bool = False) -> DataFrame:
    """F1 + F2: apply a user batch function (list[str] -> list[str]) to
    ``text_col``. Output keeps ``keys`` (+ ``token_col`` as src_lang) plus
    ``hyp`` (stripped). ``pre(src, tok)`` / ``post(tgt)`` hooks wrap the call;
    with ``fn_takes_token`` the function is called as fn(texts, tokens)."""
    cols = list(dict.fromkeys([*keys, text_col] + ([token_col] if token_col else [])))
    src = df.select(*cols)
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + ", hyp string"
    if token_col:
        schema += ", src_lang string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = fn_factory()
        for pdf in batches:
            texts = ["" if t is None else str(t) for t in pdf[text_col]]
            toks = list(pdf[token_col]) if token_col else None
            if pre is not None:
                texts = [pre(t, k) for t, k in zip(texts, toks or [None] * len(texts))]
            hyps = _run_batched(fn, texts, toks if fn_takes_token else None, batch_size)
            if post is not None:
                hyps = [post(h) for h in hyps]
            res = pdf[list(keys)].copy()
            res["hyp"] = [("" if h is None else str(h)).strip() for h in hyps]
            if token_col:
                res["src_lang"] = toks
            yield res

    return src.mapInPandas(run, schema)


def pending_items(items: DataFrame, earlier: DataFrame, key: str, hyp: str = "hyp") -> DataFrame:
    """Items without a non-empty earlier output (blank = redo; any
    non-blank text, even 'ERROR', counts as done)."""
    done = earlier.filter(blank_trim(hyp) != "").select(key)
    return items.join(done, key, "left_anti")


def merge_resumed(earlier: DataFrame, new: DataFrame, hyp: str = "hyp") -> DataFrame:
    """Earlier good rows + new rows; earlier blanks are discarded (redone)."""
    return earlier.filter(blank_trim(hyp) != "").unionByName(new, allowMissingColumns=True)


def token_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "language string, src_lang string")


def attach_source_token(df: DataFrame, tokens: DataFrame, lang: str = "language") -> DataFrame:
    """Language -> source token; a language without a token is an error,
    raised inside the same pass (``raise_error``) instead of a pre-pass.
    ``tokens`` is a configuration table (one row per language); Spark broadcasts
    it if its size allows."""
    t = tokens.withColumnRenamed("language", lang)
    j = df.join(t, lang, "left")
    msg = F.concat(F.lit("no source token configured for language "), F.coalesce(F.col(lang), F.lit("NULL")))
    return j.withColumn("src_lang", F.coalesce(F.col("src_lang"), F.raise_error(msg).cast("string")))


def expand_candidates(df: DataFrame, candidates: DataFrame, tokens: DataFrame,
                      lang: str = "language") -> DataFrame:
    """Every row x each candidate token of its language; [source token]
    when the language has no candidates. Both tables are per-language
    configuration; Spark broadcasts them if their size allows."""
    cand = (tokens.join(candidates, "language", "left")
            .select("language", F.explode(F.coalesce(F.col("candidates"), F.array("src_lang"))).alias("src_token")))
    return df.join(cand.withColumnRenamed("language", lang), lang)


def known_candidates(cands: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Candidates flagged known / unknown against a vocabulary table
    (distinct tokens on both sides, then a semi-join marker)."""
    v = vocab.select(F.col(token).alias("__v")).distinct().withColumn("known", F.lit(True))
    return (cands.join(v, cands[token] == v["__v"], "left")
            .select(*cands.columns, F.coalesce(F.col("known"), F.lit(False)).alias("known")))


def require_known(flagged: DataFrame, lang: str = "language") -> DataFrame:
    """J7 error rule: unknown candidates go, and every language must keep at
    least one; a language without one is an error that names it, raised where
    the rows are computed."""
    per = flagged.groupBy(F.col(lang).alias("__l")).agg(F.count_if("known").alias("__n"))
    msg = F.concat(F.lit("no known candidate for language "), F.coalesce(F.col(lang), F.lit("NULL")))
    keep = F.when(F.col("__n") > 0, F.col("known")).otherwise(F.raise_error(msg).cast("boolean"))
    return flagged.join(per, F.col(lang).eqNullSafe(F.col("__l"))).filter(keep).select(*flagged.columns)
