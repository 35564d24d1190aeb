"""Corpus cleaning, reshape and audit.

All operators are lazy DataFrame transformations; counts that the reference
prints come out of ``observe`` or aggregates, never out of a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import blank_trim, ws_tokens
from corpuslab.operators import partition as P


def wide_to_triplets(df: DataFrame, lang: str = "lang", english: str = "english",
                     hindi: str = "hindi", tribal: str = "tribal",
                     keep: tuple = ("doc_id", "part")) -> DataFrame:
    """Raw rows -> (language, english, hindi, tribal); kept only when english
    and tribal are non-empty after trimming; hindi may be empty."""
    out = df.select(*keep, F.col(lang).alias("language"),
                    blank_trim(english).alias("english"), blank_trim(hindi).alias("hindi"),
                    blank_trim(tribal).alias("tribal"))
    return out.filter((F.col("english") != "") & (F.col("tribal") != ""))


def usable_pairs(df: DataFrame, languages: list[str] | None = None,
                 observation: Observation | None = None, lang: str = "lang",
                 keep: tuple = ("doc_id", "part")) -> DataFrame:
    """P2 + P3: drop NULL/blank english or tribal, strip, keep listed languages.

    Pass an ``Observation`` to get the dropped count from the same pass.
    """
    src = df
    if observation is not None:
        src = df.observe(observation, F.count(F.lit(1)).alias("rows_in"))
    out = src.filter(F.col("english").isNotNull() & F.col("tribal").isNotNull())
    out = wide_to_triplets(out, lang=lang, keep=keep)
    if languages is not None:
        out = out.filter(F.col("language").isin(*languages))
    return out


def require_rows(df: DataFrame, what: str = "usable pairs") -> DataFrame:
    """Error when nothing is left (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"No {what} left after filtering")
    return df


def triplets_to_mono(df: DataFrame, english_label: str = "English",
                     hindi_label: str = "Hindi", keep: tuple = ("doc_id", "part")) -> DataFrame:
    """R2: each side becomes a (text, language) row; sides filtered independently."""
    sides = F.array(
        F.struct(F.lit("english").alias("side"), F.lit(english_label).alias("language"),
                 blank_trim("english").alias("text")),
        F.struct(F.lit("hindi").alias("side"), F.lit(hindi_label).alias("language"),
                 blank_trim("hindi").alias("text")),
        F.struct(F.lit("tribal").alias("side"), F.col("language").alias("language"),
                 blank_trim("tribal").alias("text")))
    return (df.select(*keep, F.inline(sides))
            .filter(F.col("text") != ""))


def split_sizes(split_df: DataFrame, lang: str = "language") -> DataFrame:
    """Language x split counts, missing -> 0 (fixed pivot values, no pre-pass)."""
    return (split_df.groupBy(lang).pivot("split", ["train", "dev", "test"]).count()
            .na.fill(0, ["train", "dev", "test"])
            .select(lang, *[F.col(c).cast("long").alias(c) for c in ("train", "dev", "test")]))


def language_counts(held: DataFrame, lang: str = "language") -> DataFrame:
    """A1: per language raw / pretrain / held-out raw / kept / dropped, and mono
    side counts of the pretrain part; TOTAL row by rollup.

    ``held`` is the output of ``holdout_split`` over raw rows with trimmed sides.
    """
    pre = F.col("part_name") == "pretrain"
    ho = F.col("part_name") == "heldout"
    kept = ho & (F.col("english") != "") & (F.col("tribal") != "")
    agg = held.rollup(lang).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(pre).alias("pretrain_rows"),
        F.count_if(ho).alias("heldout_rows_raw"),
        F.count_if(kept).alias("heldout_rows_kept"),
        F.count_if(ho & ~kept).alias("heldout_dropped"),
        F.count_if(pre & (F.col("english") != "")).alias("mono_english"),
        F.count_if(pre & (F.col("hindi") != "")).alias("mono_hindi"),
        F.count_if(pre & (F.col("tribal") != "")).alias("mono_tribal"))
    return agg.withColumn(lang, F.coalesce(F.col(lang), F.lit("TOTAL")))


def corpus_audit(df: DataFrame, languages: list[str], lang: str = "language") -> DataFrame:
    """A2: one pass of conditional aggregates per language: rows, empty sides,
    usable rows, whether the language was listed."""
    e, h, t = (blank_trim(c) for c in ("english", "hindi", "tribal"))
    return (df.groupBy(lang).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(e == "").alias("empty_english"),
        F.count_if(h == "").alias("empty_hindi"),
        F.count_if(t == "").alias("empty_tribal"),
        F.count_if((e != "") & (t != "")).alias("usable_rows"))
        .withColumn("listed", F.col(lang).isin(*languages)))


def language_set_diff(spark: SparkSession, df: DataFrame, languages: list[str],
                      lang: str = "language") -> DataFrame:
    """Listed-but-absent ('missing') and present-but-unlisted
    ('unexpected') languages, by anti-joins against the distinct language set."""
    present = df.select(F.col(lang).alias("language")).distinct()
    listed = spark.createDataFrame([(x,) for x in languages], "language string")
    missing = listed.join(present, "language", "left_anti").withColumn("status", F.lit("missing"))
    unexpected = present.join(listed, "language", "left_anti").withColumn("status", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def overlap_check(split_df: DataFrame, key: str = "gid") -> DataFrame:
    """Ids present in both train and test (must be 0)."""
    per_id = split_df.groupBy(key).agg(F.max(F.col("split") == "train").alias("tr"), F.max(F.col("split") == "test").alias("te"))
    return per_id.agg(F.count_if(F.col("tr") & F.col("te")).alias("n_overlap"))


def length_profile(df: DataFrame, length_col: str = "length", lang: str = "language") -> DataFrame:
    """Examples and mean source length per language and overall (rollup)."""
    return (df.rollup(lang).agg(F.count(F.lit(1)).alias("examples"),
                                F.round(F.avg(length_col), 4).alias("mean_src_tokens"))
            .withColumn(lang, F.coalesce(F.col(lang), F.lit("ALL"))))


def distinct_languages(df: DataFrame, lang: str = "language") -> DataFrame:
    """The languages present."""
    return df.select(lang).distinct()


def training_set(train: DataFrame, max_src: int = 192, max_tgt: int = 192,
                 src_token: str | None = None) -> DataFrame:
    """F3 data side: source/target token arrays, truncation, length."""
    src = F.slice(ws_tokens("tribal"), 1, max_src)
    tgt = F.slice(ws_tokens("english"), 1, max_tgt)
    out = train.select("*", src.alias("input_tokens"), tgt.alias("labels"))
    out = out.withColumn("length", F.size("input_tokens"))
    if src_token is not None:
        out = out.withColumn("src_lang", F.lit(src_token))
    return out


def training_batches(examples: DataFrame, tokens: int = 4096, width: int = 16, seed: int = 42, per_language: bool = False,
                     key: str = "gid", lang: str = "language") -> DataFrame:
    """F3, D6 and D7 together: ``training_set`` examples dealt into batches.

    Examples of similar length (a bucket is ``width`` tokens wide) stand in a
    seeded order; a batch ends when the lengths before an example reach the next
    multiple of ``tokens``, so it holds at most ``tokens`` plus one example.
    ``visit`` is the batch's place in a seeded order of all batches of its set:
    languages and lengths are interleaved, not seen in blocks. The set is the
    pooled corpus ('ALL') or each language by itself. Prefix sums and places are
    exact and no bucket or language is one task's (``operators/partition.py``).
    Returns (key, lang, length, batch_set, length_bucket, batch_no, visit): only
    these narrow rows are dealt; tokens are joined by the key where needed."""
    d = (examples.select(key, lang, "length").withColumn("batch_set", F.col(lang) if per_language else F.lit("ALL"))
         .withColumn("length_bucket", F.floor(F.col("length") / F.lit(width)).cast("long"))
         .withColumn("__cost", F.greatest(F.col("length"), F.lit(1)).cast("long"))
         .withColumn("__h", P.seeded_key(seed, key)))
    d = P.exact_prefix_sum(d, ["batch_set", "length_bucket"], ["__h", key], P.hash_bucket(F.col("__h"), 4096), "__cost", "__before")
    d = d.withColumn("batch_no", F.floor(F.col("__before") / F.lit(tokens)).cast("long")).drop("__h", "__cost", "__before")
    batch = ["batch_set", "length_bucket", "batch_no"]
    order = d.select(*batch).distinct().withColumn("__h", P.seeded_key(seed, *batch))
    order = P.exact_rank(order, ["batch_set"], ["__h", "length_bucket", "batch_no"], P.hash_bucket(F.col("__h"), 4096), "visit", None)
    return d.join(order.drop("__h"), batch)


def padding_report(batches: DataFrame) -> DataFrame:
    """Per set: batches, examples, source tokens, tokens with the padding to
    each batch's longest example, and the share of padding."""
    per = batches.groupBy("batch_set", "visit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("longest"))
    a = per.groupBy("batch_set").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("n").alias("examples"), F.sum("tokens").cast("long").alias("tokens"),
        F.sum(F.col("n") * F.col("longest")).cast("long").alias("padded_tokens"))
    return a.withColumn("padding_share", F.round(1 - F.col("tokens") / F.greatest(F.col("padded_tokens"), F.lit(1)), 4))
