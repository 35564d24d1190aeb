"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node of its
    neighbourhood (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them;
    ``edges`` have the larger node first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long): label is the
    smallest node reachable.

    Alternates large-star and small-star steps until every edge leads from a
    node to its component's smallest. Neither step adds edges, links are never
    lost, and the smallest node reaches its component in a number of rounds that
    grows with the logarithm of the component's size (tested on shuffled chains),
    so there is no limit of rounds. Each round is written to the checkpoint
    folder. An empty edge table gives an empty result."""
    stars = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "edges")
    before = None
    while before != (now := _mark(stars)):
        before = now
        stars = materialize(_small_star(_large_star(stars)), "stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number and sums of two hashes of the (distinct) edges: equal marks, equal edges."""
    wide = "decimal(20,0)"
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast(wide)),
                           F.sum(F.xxhash64("b", "a", F.lit(1)).cast(wide))).first())
