"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A row's size is its number of words. Each source gets a target number of words:
its weight's part of a budget, stopped at ``max_epochs`` times the source's
size, the excess going to the other sources by weight until no target is above
its stop (the level that fills exactly the budget). Whole epochs come first:
every row of the source is taken floor(target / size) times. What remains of
the target is taken from rows in the order of exponential keys -ln(u) / w, with
u a hash of the row and w its quality weight, up to a prefix sum of sizes. Texts
are never cut: the row that crosses the budget is taken whole or not at all,
whichever comes nearer, so a source's words differ from its target by at most
half of one row.

Rows are ordered through key buckets, quantiles of the keys of all rows: sizes
are summed by (source, bucket), a running sum over the buckets finds the one in
which the budget ends, and only its rows are sorted. A bucket holds about one of
``BUCKETS`` parts of all rows whatever their weights are; no source, however
large, is sorted as a whole, and the texts are read once.

Defined cases: null or blank text has size 0 and nothing is taken of it; a null
source is a source of its own, last in order; a source without words has target
0; equal rows share one key and are ordered among themselves arbitrarily, which
gives the same rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm.common import broadcast_if_short, materialize, other_columns_aside, unit_hash
from corpuslab.operators.partition import with_range_bucket

#: Words: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKETS = 1 << 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: lower for texts whose mean word length is far from
    that of prose, and for texts full of symbols."""
    chars = F.length(text).cast("double")
    symbols = chars - F.length(F.translate(text, "#$%&*!|<>{}[]=~^@_", ""))
    shape = 1 / (1 + F.abs(F.log((chars + 1) / (size + 1) / 6)))
    return F.coalesce(F.greatest(F.lit(0.05), shape * (1 - symbols / (chars + 1))), F.lit(0.05))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """``sources`` (source, size), one row per source, with ``target``."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    base = (sources.withColumn("w", F.get(w, (F.row_number().over(by_name) - 1) % F.lit(len(weights))))
            .withColumn("cap", F.col("size") * F.lit(max_epochs))
            .withColumn("budget", F.least(F.sum("size").over(W.partitionBy()) * F.lit(share),
                                          F.sum("cap").over(W.partitionBy()))))
    # water filling: sources in the order in which a rising level reaches their stops
    rise = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(rise.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(rise.rowsBetween(0, W.unboundedFollowing))
    level = (base.withColumn("level", (F.col("budget") - capped) / rest)
             .withColumn("nth", F.row_number().over(rise)))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("nth", "level"))
    final = F.min(free).over(W.partitionBy())["level"]
    return level.select("source", "size", F.least(F.col("cap"), F.coalesce(F.col("w") * final, F.col("cap"))).alias("target"))


def mix(df: DataFrame, seed: int = 4, weights=WEIGHTS, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """doc_id, row (a hash of the row), size, source, source_size, target and
    taken for every row of ``df`` (doc_id, text, source)."""
    text = F.col("text")
    sized = df.select("doc_id", "source", text, words(text).alias("size"))
    u = unit_hash("doc_id", "source", text, seed=seed)
    keyed = materialize(sized.select(
        "doc_id", "source", "size", row_key(seed).alias("row"),
        (-F.log(u) / quality(text, F.col("size"))).alias("key")), "mix-rows")
    keyed = with_range_bucket(keyed, "key", BUCKETS, "bucket")
    source_rows = keyed.groupBy("source").agg(F.sum("size").cast("long").alias("size"))
    goal = materialize(targets(source_rows, weights, share, max_epochs)
                       .withColumnRenamed("size", "source_size")
                       .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                       .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")
    # the bucket of each source in which its budget ends
    run = W.partitionBy("source").orderBy("bucket")
    ends = (keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
            .withColumn("before", F.sum("in_bucket").over(run) - F.col("in_bucket"))
            .join(goal.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
            .filter("before <= budget and budget < before + in_bucket")
            .select("s", F.col("bucket").alias("last"), F.col("before").alias("filled")))
    per_source = materialize(goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "epochs", "budget", "last", "filled"), "mix-sources")
    rows = keyed.join(broadcast_if_short(per_source), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    in_order = W.partitionBy("source").orderBy("key", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    # in the last bucket rows are taken in order while at least half of them fits; below it all
    edge = rows.filter("bucket = last").withColumn("upto", F.col("filled") + F.sum("size").over(in_order))
    room = F.col("budget") - (F.col("upto") - F.col("size"))
    part = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(0)
    whole = rows.filter("last is null or bucket <> last").withColumn(
        "part", F.when(F.col("last").isNull() | (F.col("bucket") < F.col("last")), F.col("size")).otherwise(0))
    out = [F.col(c) for c in ("doc_id", "row", "size", "source", "source_size", "target")]
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return whole.select(*out, taken).union(edge.withColumn("part", part).select(*out, taken))


def row_key(seed: int = 4) -> Column:
    """Identifies a row by its id, source and text."""
    return F.xxhash64("doc_id", "source", "text", F.lit(seed + 1))


@other_columns_aside("doc_id", "source", "text")
def apply_mix(df: DataFrame, seed: int = 4) -> DataFrame:
    """``df`` as the mix has it: every row, whole, as often as it is taken. Rows
    equal in id, source and text count as one row taken for the sum of what is
    taken of them."""
    names = df.columns
    taken = materialize(
        mix(df.select("doc_id", "source", "text"), seed).groupBy("row").agg(
            F.max("size").alias("__size"), F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows"))
        .filter("__taken > 0").withColumnRenamed("row", "__row"), "mix-taken")
    wide = df.withColumn("__row", row_key(seed))
    rows = wide.join(taken.filter("__rows = 1"), "__row").unionByName(
        wide.join(taken.filter("__rows > 1"), "__row").dropDuplicates(["__row"]))
    copies = F.array_repeat(F.lit(0), F.round(F.col("__taken") / F.col("__size")).cast("int"))
    return rows.withColumn("__copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in names])
