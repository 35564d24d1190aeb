"""Exact per-group ranks, ids and splits without one-task windows.

A plain ``row_number() over (partition by language ...)`` puts a whole
language in one task; with one language holding a third of a corpus that task
is the job. ``exact_rank`` instead

1. gives every row a *bucket* that is monotone in the order key
   (a hash prefix for seeded orders, quantiles of the key for natural orders,
   so buckets hold about equally many rows whatever the keys' values are),
2. deals the rows by (group, bucket) once; both the counts per bucket and the
   numbering inside a bucket read that one exchange,
3. turns the counts into running offsets with a window over at most
   ``HASH_BUCKETS`` rows a group, and adds them.

The result equals the plain window exactly (tested), and the widest task holds
one bucket, not one language. Group sizes ``n`` come out of the same small
table, so split cuts need no extra pass. Building the plan starts no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 16 ** 4   # four hex digits of the md5 key
RANGE_BUCKETS = 1024     # quantiles of a natural order key


def seeded_key(seed: int, *cols) -> Column:
    """Deterministic shuffle key: md5 of seed|group|key (stable across machines)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(h: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Bucket from the leading hex digits of an md5 key (monotone in the key)."""
    digits = max(1, ((buckets - 1).bit_length() + 3) // 4)
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def with_range_bucket(df: DataFrame, key: str, buckets: int = RANGE_BUCKETS, name: str = "__range") -> DataFrame:
    """``df`` with the bucket of a numeric order key by its quantiles (monotone
    in the key) as column ``name``.

    The quantiles are a scalar subquery over the key alone, evaluated when the
    plan runs; a row finds its bucket by binary search. An outlying key widens
    one bucket's range, not its row count."""
    steps = max(1, (buckets - 1).bit_length())
    n = 1 << steps
    cuts = df.select(F.col(key).cast("double").alias("k")).agg(
        F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).scalar()
    k = F.col(key).cast("double")
    # how many of the n - 1 ascending cuts lie below the key
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, h: at + F.when(F.get("__cuts", at + h - 1) < k, h).otherwise(0))
    return df.withColumn("__cuts", cuts).withColumn(name, F.coalesce(found, F.lit(0)).cast("long")).drop("__cuts")


def exact_rank(df: DataFrame, group: list[str], order: list, bucket: Column,
               rank_col: str = "rank", n_col: str | None = "n") -> DataFrame:
    """1-based row_number over (partition by group order by order), exact.

    ``bucket`` must be non-decreasing in ``order`` within a group.
    Adds ``rank_col`` and, when ``n_col`` is given, the group size.
    """
    b = "__bucket"
    d = df.withColumn(b, bucket).repartition(*[F.col(c) for c in group], F.col(b))
    counts = d.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*group).orderBy(b)
    offsets = counts.select(
        *group, b,
        (F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
        F.sum("__cnt").over(Window.partitionBy(*group)).alias("__n"),
    ).fillna(0, subset=["__off"])
    local = Window.partitionBy(*group, b).orderBy(*order)
    out = (d.join(offsets, on=[*group, b], how="inner")
           .withColumn(rank_col, (F.row_number().over(local) + F.col("__off")).cast("long")))
    if n_col:
        out = out.withColumnRenamed("__n", n_col)
    return out.drop(b, "__off", "__n")


def exact_prefix_sum(df: DataFrame, group: list[str], order: list, bucket: Column, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one, over
    (partition by group order by order), exact. As ``exact_rank``, with sums in
    place of counts; ``bucket`` must be non-decreasing in ``order``."""
    b = "__bucket"
    d = df.withColumn(b, bucket).repartition(*[F.col(c) for c in group], F.col(b))
    run = Window.partitionBy(*group).orderBy(b)
    sums = d.groupBy(*group, b).agg(F.sum(value).alias("__in"))
    offsets = sums.select(*group, b, (F.sum("__in").over(run) - F.col("__in")).alias("__off"))
    local = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(offsets, on=[*group, b], how="inner")
            .withColumn(name, (F.sum(value).over(local) - F.col(value) + F.col("__off")).cast("long")).drop(b, "__off"))


def stable_gid(df: DataFrame, lang: str = "language", order: tuple = ("doc_id",),
               buckets: int = RANGE_BUCKETS) -> DataFrame:
    """gid = '<language>_<0-based position in language>' in file order."""
    r = exact_rank(with_range_bucket(df, order[0], buckets), [lang], list(order), F.col("__range"), "__pos", None)
    return r.withColumn("gid", F.concat(F.col(lang), F.lit("_"), (F.col("__pos") - 1).cast("string"))).drop("__pos", "__range")


def seeded_rank(df: DataFrame, lang: str, key: str, seed: int,
                buckets: int = HASH_BUCKETS, rank_col: str = "rank") -> DataFrame:
    """Rank inside each language in a seeded pseudo-random order, plus group size n."""
    h = "__h"
    d = df.withColumn(h, seeded_key(seed, lang, key))
    return exact_rank(d, [lang], [h, key], hash_bucket(F.col(h), buckets), rank_col, "n").drop(h)


def holdout_split(df: DataFrame, lang: str = "language", key: str = "doc_id",
                  ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """First floor(n*(1-ratio)) of the seeded order -> 'pretrain', rest 'heldout'."""
    r = seeded_rank(df, lang, key, seed)
    cut = F.floor(F.col("n").cast("double") * F.lit(1.0 - ratio))
    return r.withColumn("part_name", F.when(F.col("rank") <= cut, "pretrain").otherwise("heldout"))


def three_way_split(df: DataFrame, lang: str = "language", key: str = "doc_id",
                    train: float = 0.7, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """D3: sizes bround(n*train), bround(n*dev); test is the remainder."""
    r = seeded_rank(df, lang, key, seed)
    n = F.col("n").cast("double")
    n_tr = F.bround(n * F.lit(train), 0)
    n_dv = F.bround(n * F.lit(dev), 0)
    return (r.withColumn("split", F.when(F.col("rank") <= n_tr, "train")
                         .when(F.col("rank") <= n_tr + n_dv, "dev").otherwise("test"))
            .withColumn("split_pos", (F.col("rank") - F.when(F.col("split") == "train", 0)
                                      .when(F.col("split") == "dev", n_tr)
                                      .otherwise(n_tr + n_dv)).cast("long")))


def eval_slice(split_df: DataFrame, split: str = "test", cap: int | None = None) -> DataFrame:
    """One split, optionally the head (seeded order) of it per language."""
    out = split_df.filter(F.col("split") == split)
    if cap:
        out = out.filter(F.col("split_pos") <= cap)
    return out


def head_per_language(df: DataFrame, n: int, lang: str = "language",
                      order: tuple = ("doc_id",)) -> DataFrame:
    """First n rows per language by an order key (Catalyst plans a
    WindowGroupLimit, so only n rows per group survive the map side)."""
    w = Window.partitionBy(lang).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Whole-corpus seeded reorder, as an exact 1-based ``position`` (the
    running offsets are over at most HASH_BUCKETS rows)."""
    d = df.withColumn("__h", seeded_key(seed, key)).withColumn("__all", F.lit(0))
    return exact_rank(d, ["__all"], ["__h", key], hash_bucket(F.col("__h")), "position", None).drop("__h", "__all")


def length_buckets(df: DataFrame, length_col: str, width: int = 16, seed: int = 42,
                   key: str = "doc_id") -> DataFrame:
    """Similar-length examples together: ``length_bucket`` = length div
    width, and the example's ``position`` in its bucket in a reproducible seeded
    order. Batches are runs of positions of one bucket."""
    d = (df.withColumn("length_bucket", (F.col(length_col) / F.lit(width)).cast("long"))
         .withColumn("__h", seeded_key(seed, key)))
    return exact_rank(d, ["length_bucket"], ["__h", key], hash_bucket(F.col("__h")), "position", None).drop("__h")
