"""K4 / F1: inference whose results are saved every N batches.

The pending items are written once into files of at most N x batch rows, and a
stream takes one file a core per trigger: a task holds one file, so a task that
is killed repeats at most N batches, and a job that is killed repeats one trigger.
A save is a folder per trigger, which a repeated trigger replaces. Run again with
the same ``work`` folder, the job goes on after the last save; with a new one, it
takes all earlier saves as done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.inference import pending_items
from corpuslab.sources import versions
from corpuslab.streaming.live import foreach_batch_to


def read_saves(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All saved rows, with ``work`` (which job) and ``batch`` (which save)."""
    fs, folder = versions.file_system(spark, out)
    if not fs.exists(folder):
        return spark.createDataFrame([], f"{schema}, work string, batch long")
    return spark.read.schema(f"{schema}, work string, batch long").option("basePath", out).parquet(out)


def predict_with_saves(items: DataFrame, predict: Callable[[DataFrame], DataFrame], key: str, out: str, work: str, schema: str,
                       batch_size: int = 32, save_every: int = 20, files_per_trigger: int | None = None) -> DataFrame:
    """Runs ``predict`` (items -> rows of ``schema``, with ``key`` and ``hyp``)
    over all items without a non-blank saved output and returns the saved rows.
    ``out``: the saves; ``work``: this job's folder."""
    spark, work = items.sparkSession, work.rstrip("/")
    tag = work.rsplit("/", 1)[-1]
    staged = versions.current(spark, f"{work}/pending")
    if staged is None:  # a job that was stopped finds its items here
        todo = pending_items(items, read_saves(spark, out, schema), key)
        staged = versions.publish(todo, f"{work}/pending", lambda w, to: w.option("maxRecordsPerFile", batch_size * save_every).parquet(to))
    stream = (spark.readStream.schema(items.schema)
              .option("maxFilesPerTrigger", files_per_trigger or spark.sparkContext.defaultParallelism).parquet(staged))

    def save(batch: DataFrame, batch_id: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/work={tag}/batch={batch_id}")

    foreach_batch_to(stream, save, f"{work}/checkpoint")
    saved = read_saves(spark, out, schema)
    return saved.filter(F.trim(F.coalesce("hyp", F.lit(""))) != "")
