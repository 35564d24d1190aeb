"""Registered corpus queries: cleaning, reshape, audit, ids and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import blank_trim
from corpuslab.operators import corpus as C
from corpuslab.operators import partition as P
from corpuslab.plans import fixtures as X
from corpuslab.plans.registry import query
from corpuslab.plans.sqltext import bt, seeded_key, ws_tokens

# ---- fixed values -------------------------------------------------------
LANGS = ["de", "en", "es", "fr"]          # languages of the stand-in corpus
LISTED_FOR_DIFF = ["de", "en", "fr", "hi"]  # a language list with one absent and one unlisted
SEED = 42
HOLDOUT_RATIO = 0.15
TRAIN, DEV = 0.7, 0.1
EVAL_CAP = 50        # smoke-run cap of eval_slice (head of the seeded order)
HEAD_N = 50          # head_per_language
MAX_SRC = MAX_TGT = 192
# ------------------------------------------------------------------------


def _pairs(spark, sf):
    return C.usable_pairs(X.raw_lines(spark, sf), LANGS)


def _gid_pairs(spark, sf):
    return P.stable_gid(_pairs(spark, sf), "language", ("doc_id", "part"))


def _splits(spark, sf):
    return P.three_way_split(_gid_pairs(spark, sf), "language", "gid", TRAIN, DEV, SEED)


def _held(spark, sf):
    raw = X.raw_lines(spark, sf).select(
        "doc_id", "part", F.col("lang").alias("language"),
        *[blank_trim(c).alias(c) for c in ("english", "hindi", "tribal")])
    raw = raw.withColumn("rowkey", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("part").cast("string")))
    return P.holdout_split(raw, "language", "rowkey", HOLDOUT_RATIO, SEED)


# --- SQL pieces ---------------------------------------------------------
PAIRS = f"""pairs AS (
 SELECT doc_id, part, lang AS language, {bt('english')} AS english, {bt('hindi')} AS hindi, {bt('tribal')} AS tribal
 FROM raw_lines WHERE english IS NOT NULL AND tribal IS NOT NULL
  AND {bt('english')} <> '' AND {bt('tribal')} <> '' AND lang IN ({", ".join(repr(x) for x in LANGS)}))"""

GID = """gidp AS (
 SELECT *, concat(language, '_', CAST(row_number() OVER (PARTITION BY language ORDER BY doc_id, part) - 1 AS VARCHAR)) AS gid
 FROM pairs)"""

SPLITS = f"""sp AS (
 SELECT *, CASE WHEN rank <= round_even(n * CAST({TRAIN} AS DOUBLE), 0) THEN 'train'
   WHEN rank <= round_even(n * CAST({TRAIN} AS DOUBLE), 0) + round_even(n * CAST({DEV} AS DOUBLE), 0) THEN 'dev' ELSE 'test' END AS split,
  rank - CASE WHEN rank <= round_even(n * CAST({TRAIN} AS DOUBLE), 0) THEN 0
   WHEN rank <= round_even(n * CAST({TRAIN} AS DOUBLE), 0) + round_even(n * CAST({DEV} AS DOUBLE), 0) THEN round_even(n * CAST({TRAIN} AS DOUBLE), 0)
   ELSE round_even(n * CAST({TRAIN} AS DOUBLE), 0) + round_even(n * CAST({DEV} AS DOUBLE), 0) END AS split_pos
 FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY h, gid) AS rank, count(*) OVER (PARTITION BY language) AS n
       FROM (SELECT *, {seeded_key(SEED, 'language', 'gid')} AS h FROM gidp)))"""

HELD = f"""held AS (
 SELECT doc_id, part, language, english, hindi, tribal,
  CASE WHEN rank <= floor(n * CAST({1.0 - HOLDOUT_RATIO!r} AS DOUBLE)) THEN 'pretrain' ELSE 'heldout' END AS part_name
 FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY h, rowkey) AS rank, count(*) OVER (PARTITION BY language) AS n
  FROM (SELECT *, {seeded_key(SEED, 'language', 'rowkey')} AS h FROM
   (SELECT doc_id, part, lang AS language, {bt('english')} AS english, {bt('hindi')} AS hindi, {bt('tribal')} AS tribal,
     concat_ws(':', doc_id, part) AS rowkey FROM raw_lines))))"""


def _w(*ctes):
    return X.with_ctes(X.RAW_LINES_SQL, *ctes)


# --- queries -------------------------------------------------------------
@query("pairs_clean", sql=_w(PAIRS) + "SELECT doc_id, part, language, english, hindi, tribal FROM pairs")
def pairs_clean(spark, sf):
    """Usable triplets of the listed languages."""
    return _pairs(spark, sf)


@query("holdout_split", sql=_w(HELD) + """SELECT doc_id, part, language, part_name,
 (part_name = 'heldout' AND english <> '' AND tribal <> '') AS kept FROM held""")
def holdout_split(spark, sf):
    """Seeded per-language pretrain / held-out cut; emptiness filter after the cut."""
    h = _held(spark, sf)
    return h.select("doc_id", "part", "language", F.col("part_name"),
                    ((F.col("part_name") == "heldout") & (F.col("english") != "") & (F.col("tribal") != "")).alias("kept"))


@query("mono_corpus", sql=_w(HELD) + """SELECT doc_id, part, side, language, text FROM (
 SELECT doc_id, part, 'english' AS side, 'English' AS language, english AS text FROM held WHERE part_name = 'pretrain'
 UNION ALL SELECT doc_id, part, 'hindi', 'Hindi', hindi FROM held WHERE part_name = 'pretrain'
 UNION ALL SELECT doc_id, part, 'tribal', language, tribal FROM held WHERE part_name = 'pretrain') WHERE text <> ''""")
def mono_corpus(spark, sf):
    """R2: pretrain part -> (text, language) rows, each side filtered on its own."""
    h = _held(spark, sf).filter(F.col("part_name") == "pretrain")
    return C.triplets_to_mono(h).select("doc_id", "part", "side", "language", "text")


@query("heldout_triplets", sql=_w(HELD) + """SELECT doc_id, part, language, english, hindi, tribal FROM held
 WHERE part_name = 'heldout' AND english <> '' AND tribal <> ''""")
def heldout_triplets(spark, sf):
    """R1 on the held-out part: (language, english, hindi, tribal) kept rows."""
    h = _held(spark, sf).filter(F.col("part_name") == "heldout")
    return C.wide_to_triplets(h, lang="language")


@query("language_counts", sql=_w(HELD) + """SELECT coalesce(language, 'TOTAL') AS language,
 count(*) AS raw_rows, count(*) FILTER (WHERE part_name = 'pretrain') AS pretrain_rows,
 count(*) FILTER (WHERE part_name = 'heldout') AS heldout_rows_raw,
 count(*) FILTER (WHERE part_name = 'heldout' AND english <> '' AND tribal <> '') AS heldout_rows_kept,
 count(*) FILTER (WHERE part_name = 'heldout' AND NOT (english <> '' AND tribal <> '')) AS heldout_dropped,
 count(*) FILTER (WHERE part_name = 'pretrain' AND english <> '') AS mono_english,
 count(*) FILTER (WHERE part_name = 'pretrain' AND hindi <> '') AS mono_hindi,
 count(*) FILTER (WHERE part_name = 'pretrain' AND tribal <> '') AS mono_tribal
 FROM held GROUP BY ROLLUP (language)""")
def language_counts(spark, sf):
    """A1: split statistics per language plus TOTAL."""
    return C.language_counts(_held(spark, sf))


@query("corpus_audit", sql=_w() + f"""SELECT lang AS language, count(*) AS rows,
 count(*) FILTER (WHERE {bt('english')} = '') AS empty_english,
 count(*) FILTER (WHERE {bt('hindi')} = '') AS empty_hindi,
 count(*) FILTER (WHERE {bt('tribal')} = '') AS empty_tribal,
 count(*) FILTER (WHERE {bt('english')} <> '' AND {bt('tribal')} <> '') AS usable_rows,
 lang IN ({", ".join(repr(x) for x in LISTED_FOR_DIFF)}) AS listed
 FROM raw_lines GROUP BY lang""")
def corpus_audit(spark, sf):
    """A2: rows, empty sides and usable rows per language; listed flag."""
    raw = X.raw_lines(spark, sf).withColumnRenamed("lang", "language")
    return C.corpus_audit(raw, LISTED_FOR_DIFF)


@query("language_set_diff", sql=_w() + f"""SELECT language, 'missing' AS status FROM
 (SELECT unnest([{", ".join(repr(x) for x in LISTED_FOR_DIFF)}]) AS language) WHERE language NOT IN (SELECT lang FROM raw_lines)
 UNION ALL SELECT DISTINCT lang, 'unexpected' FROM raw_lines WHERE lang NOT IN ({", ".join(repr(x) for x in LISTED_FOR_DIFF)})""")
def language_set_diff(spark, sf):
    """Listed-but-absent and present-but-unlisted languages."""
    raw = X.raw_lines(spark, sf).withColumnRenamed("lang", "language")
    return C.language_set_diff(spark, raw, LISTED_FOR_DIFF)


@query("stable_gid", sql=_w(PAIRS, GID) + "SELECT doc_id, part, language, gid FROM gidp")
def stable_gid(spark, sf):
    """D1: '<language>_<position>' in file order, exact at any group size."""
    return _gid_pairs(spark, sf).select("doc_id", "part", "language", "gid")


@query("three_way_split", sql=_w(PAIRS, GID, SPLITS) + "SELECT gid, language, split, CAST(rank AS BIGINT) AS rank, CAST(split_pos AS BIGINT) AS split_pos FROM sp")
def three_way_split(spark, sf):
    """D3: seeded 70/10/remainder split per language, half-even sizes."""
    return _splits(spark, sf).select("gid", "language", "split", "rank", "split_pos")


@query("split_sizes", sql=_w(PAIRS, GID, SPLITS) + """SELECT language,
 count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev,
 count(*) FILTER (WHERE split = 'test') AS test FROM sp GROUP BY language""")
def split_sizes(spark, sf):
    """Language x split counts."""
    return C.split_sizes(_splits(spark, sf))


@query("eval_slice", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, language, english, tribal, CAST(split_pos AS BIGINT) AS split_pos
 FROM sp WHERE split = 'test' AND split_pos <= {EVAL_CAP}""")
def eval_slice(spark, sf):
    """Test split, capped per language to the head of the seeded order."""
    return P.eval_slice(_splits(spark, sf), "test", EVAL_CAP).select("gid", "language", "english", "tribal", "split_pos")


@query("head_per_language", sql=_w(PAIRS, GID) + f"""SELECT gid, language FROM
 (SELECT *, row_number() OVER (PARTITION BY language ORDER BY doc_id, part) AS rn FROM gidp) WHERE rn <= {HEAD_N}""")
def head_per_language(spark, sf):
    """First n pairs per language (WindowGroupLimit)."""
    return P.head_per_language(_gid_pairs(spark, sf), HEAD_N, "language", ("doc_id", "part")).select("gid", "language")


@query("overlap_check", sql=_w(PAIRS, GID, SPLITS) + """SELECT count(*) AS n_overlap FROM
 (SELECT gid FROM sp WHERE split = 'train' INTERSECT SELECT gid FROM sp WHERE split = 'test')""")
def overlap_check(spark, sf):
    """Ids in both train and test (0)."""
    return C.overlap_check(_splits(spark, sf))


@query("seeded_order", sql=_w(PAIRS, GID) + f"""SELECT gid, CAST(row_number() OVER (ORDER BY {seeded_key(SEED, 'gid')}, gid) AS BIGINT) AS position FROM gidp""")
def seeded_order(spark, sf):
    """Whole-corpus seeded order as an exact global position (no single-task sort)."""
    return P.seeded_order(_gid_pairs(spark, sf), "gid", SEED).select("gid", "position")


@query("training_set", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, language,
 array_to_string(list_slice({ws_tokens('tribal')}, 1, {MAX_SRC}), ' ') AS source,
 array_to_string(list_slice({ws_tokens('english')}, 1, {MAX_TGT}), ' ') AS target,
 CAST(len(list_slice({ws_tokens('tribal')}, 1, {MAX_SRC})) AS BIGINT) AS length
 FROM sp WHERE split = 'train'""")
def training_set(spark, sf):
    """F3 + P14: train split as clipped source/target tokens and length."""
    tr = _splits(spark, sf).filter(F.col("split") == "train")
    t = C.training_set(tr, MAX_SRC, MAX_TGT)
    return t.select("gid", "language", F.array_join("input_tokens", " ").alias("source"),
                    F.array_join("labels", " ").alias("target"), F.col("length").cast("long").alias("length"))


@query("length_profile", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT coalesce(language, 'ALL') AS language, count(*) AS examples,
 round(avg(len(list_slice({ws_tokens('tribal')}, 1, {MAX_SRC}))), 4) AS mean_src_tokens
 FROM sp WHERE split = 'train' GROUP BY ROLLUP (language)""")
def length_profile(spark, sf):
    """Examples and mean clipped source length per language and overall."""
    tr = _splits(spark, sf).filter(F.col("split") == "train")
    return C.length_profile(C.training_set(tr, MAX_SRC, MAX_TGT))


@query("length_buckets", sql=_w(PAIRS, GID, SPLITS) + f"""SELECT gid, length_bucket,
 CAST(row_number() OVER (PARTITION BY length_bucket ORDER BY {seeded_key(SEED, 'gid')}, gid) AS BIGINT) AS position FROM
 (SELECT gid, CAST(len(list_slice({ws_tokens('tribal')}, 1, {MAX_SRC})) // 16 AS BIGINT) AS length_bucket FROM sp WHERE split = 'train')""")
def length_buckets(spark, sf):
    """The training set's layout by similar length: every example's bucket
    and its place in the bucket."""
    tr = C.training_set(_splits(spark, sf).filter(F.col("split") == "train"), MAX_SRC, MAX_TGT)
    return P.length_buckets(tr, "length", 16, SEED, "gid").select("gid", "length_bucket", "position")


BATCH_TOKENS = 2048      # source tokens of a training batch
_KEY = "md5(concat_ws('|', '{seed}', {cols}))"


def _batches_sql() -> str:
    """The batches of both forms, as windows."""
    key, order = _KEY.format(seed=SEED, cols="gid"), _KEY.format(seed=SEED, cols="batch_set, length_bucket, batch_no")
    return f"""ex AS (SELECT gid, language, CAST(len(list_slice({ws_tokens('tribal')}, 1, {MAX_SRC})) AS BIGINT) AS length FROM sp WHERE split = 'train'),
 sets AS (SELECT *, 'ALL' AS batch_set FROM ex UNION ALL SELECT *, language FROM ex),
 b AS (SELECT *, length // 16 AS length_bucket, CAST((sum(greatest(length, 1)) OVER (PARTITION BY batch_set, length // 16
   ORDER BY {key}, gid ROWS UNBOUNDED PRECEDING) - greatest(length, 1)) // {BATCH_TOKENS} AS BIGINT) AS batch_no FROM sets),
 batches AS (SELECT *, dense_rank() OVER (PARTITION BY batch_set ORDER BY {order}, length_bucket, batch_no) AS visit FROM b)"""


def _batches(spark, sf):
    ex = C.training_set(_splits(spark, sf).filter(F.col("split") == "train"), MAX_SRC, MAX_TGT)
    return C.training_batches(ex, BATCH_TOKENS, 16, SEED).unionByName(
        C.training_batches(ex, BATCH_TOKENS, 16, SEED, per_language=True))


@query("training_batches", sql=_w(PAIRS, GID, SPLITS, _batches_sql()) + """SELECT gid, language, length, batch_set, length_bucket, batch_no,
 visit FROM batches""")
def training_batches(spark, sf):
    """F3 with D6 and D7: every training example's batch, pooled and per language."""
    return _batches(spark, sf).withColumn("length", F.col("length").cast("long"))


@query("batch_padding", sql=_w(PAIRS, GID, SPLITS, _batches_sql()) + """, per AS (SELECT batch_set, visit, count(*) AS n, sum(length) AS t, max(length) AS m
  FROM batches GROUP BY ALL)
 SELECT batch_set, count(*) AS batches, CAST(sum(n) AS BIGINT) AS examples, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(n * m) AS BIGINT) AS padded_tokens,
 round(1 - sum(t) / greatest(sum(n * m), 1), 4) AS padding_share FROM per GROUP BY batch_set""")
def batch_padding(spark, sf):
    """what padding the batches cost."""
    return C.padding_report(_batches(spark, sf))


@query("distinct_languages", sql=_w(PAIRS) + "SELECT DISTINCT language FROM pairs")
def distinct_languages(spark, sf):
    """Languages present in the clean corpus."""
    return C.distinct_languages(_pairs(spark, sf))
