"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id counts as ''."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(mod)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_short(df: DataFrame, most: int = 4096) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` (short) rows, else
    as it is, to be joined by a shuffle. ``df`` should be materialized."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) from the given columns."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def labelled_sample(df: DataFrame, label: str, per_label: int, seed: int, *ids: str) -> DataFrame:
    """About ``per_label`` rows of every value of ``label`` (all rows of a rarer
    value), chosen by a hash of ``ids``. Only the labels are counted first; the
    sample bounds what a classifier is fitted on."""
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")), "label-counts")
    keep = df.join(broadcast_if_short(counts), label).filter(
        unit_hash(*ids, seed=seed) * F.col("__n") < F.lit(float(per_label)))
    return keep.drop("__n")


def text_slices(texts: Iterable[str | None], max_chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch of texts into runs of at most ``max_chars`` characters (or
    one longer text), yielding (index of the first, texts); null reads as ''.
    Keeps the arrays that a batch is turned into small."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > max_chars:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def plain_names(df: DataFrame, *used: str) -> DataFrame:
    """Only the columns an operator reads, by their exact names; other columns,
    whatever they are called, cannot clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in used])


def append_columns(df: DataFrame, inputs: list[str], added: dict[str, T.DataType], fn) -> DataFrame:
    """``df`` with columns ``added`` computed batch by batch from the Arrow
    columns ``inputs``; all other columns pass through by position, so their
    names may be anything. Columns already called like an added one are replaced."""
    names = list(df.columns)
    at = [names.index(c) for c in inputs]
    src = df.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    fields += [T.StructField(f"a{i}", t) for i, t in enumerate(added.values())]
    labels = [f.name for f in fields]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(*[b.column(i) for i in at])], labels)

    out = src.mapInArrow(run, T.StructType(fields))
    keep = [(f"c{i}", n) for i, n in enumerate(names) if n not in added]
    keep += [(f"a{i}", n) for i, n in enumerate(added)]
    return out.select([F.col(c).alias(n) for c, n in keep])


def other_columns_aside(*used: str):
    """Decorates a function from a DataFrame to one that has all its columns
    (and maybe more): inside, all columns but ``used`` have neutral names, so
    they cannot clash; the result has the input's columns and names again."""
    def deco(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            names = list(df.columns)
            inner = [n if n in used and names.index(n) == i else f"x{i}" for i, n in enumerate(names)]
            return fn(df.toDF(*inner), *args, **kwargs).select(*inner).toDF(*names)

        return run
    return deco
