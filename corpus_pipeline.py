"""Documents to training sequences: language ID, near-duplicate removal,
redaction of personal data, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import langid, mixing, packing, pii, simhash
from corpuslab.llm.common import id_fold, materialize, other_columns_aside, table
from corpuslab.session import ship_package


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(docs)

    return run_stage


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


@_stage
@other_columns_aside("doc_id", "text", "lang")
def language_id(docs: DataFrame) -> DataFrame:
    """``lang`` becomes the predicted language; documents without a letter
    (``und``) go. Without any labelled document nothing is predicted and only
    the letterless go."""
    model = langid.fit(docs.filter(id_fold("doc_id", 5) != 0))
    found = langid.identify(docs, model)
    if model.langs:
        found = found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred"))
    else:
        found = found.filter(F.col("text").rlike(r"\p{L}"))
    return found


@_stage
def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


@_stage
def pii_redaction(docs: DataFrame) -> DataFrame:
    """Personal data is replaced by its kind, for example [EMAIL]."""
    return _with_length(pii.redact(docs))


@_stage
def source_mixing(docs: DataFrame) -> DataFrame:
    """Documents are repeated, kept or left out as the mix takes them."""
    return _with_length(mixing.apply_mix(docs))


@_stage
def sequence_packing(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with their place in 1024-token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Fingerprints, fitted filters and trees, and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
