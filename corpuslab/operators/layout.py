"""Partition layout helpers for CPU-heavy map stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def dealt_by(df: DataFrame) -> tuple[list[str], int]:
    """(columns, partitions) of the hash partitioning that the physical plan
    gives the rows; no columns where it gives none. Nothing runs for it."""
    # the plan before shuffles are added for joins and before adaptive execution
    text = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    found = re.fullmatch(r"hashpartitioning\((.*), (\d+)\)", text)
    return (re.sub(r"#\d+L?", "", found[1]).split(", "), int(found[2])) if found else ([], 0)


def spread(df: DataFrame, *keys: str, min_parts: int | None = None) -> DataFrame:
    """Hash-distribute rows by ``keys`` when the input has fewer partitions
    than the cluster has cores (e.g. one large parquet row group feeding an
    Arrow UDF). Inputs at least as wide as the cluster are left alone, so no
    shuffle is added at scale; the decision depends on cores only, not on
    spark.sql.shuffle.partitions. Rows that are dealt by ``keys`` already (the
    runs of a document that was spread before they were made) stay where they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # the optimizer's size estimate of what is scanned: asking for the number
    # of partitions would run the shuffles below it under adaptive execution
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    # a few tasks per core, so rows of very different cost (1-word and
    # 20,000-word documents) even out across cores
    target = min_parts or 8 * cores
    if keys:
        columns, parts = dealt_by(df)
        if parts >= target and columns == list(keys):
            return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
