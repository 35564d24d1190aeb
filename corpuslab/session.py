"""Session helpers.

Libraries take an existing ``SparkSession``; ``get_session`` is only for
tests, the bench and scripts. The checkpoint folder is read from the session
(``spark.checkpoint.dir``), and set here only when the cluster left it unset.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                app: str = "corpuslab") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLAB_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only when it is unset and the master is local (tests) a
    scratch folder is made; off local mode a missing setting is an error,
    since executors could not see a folder of the driver's machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share "
                               f"(master is {master})")
        d = tempfile.mkdtemp(prefix="corpuslab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.
    Branches of one plan that run at the same time all read it; of a persisted
    frame each of them would compute the blocks that its executors do not have yet."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_HELD: contextvars.ContextVar[list | None] = contextvars.ContextVar("held", default=None)


def hold(df: DataFrame) -> DataFrame:
    """``df`` persisted (MEMORY_AND_DISK; a lost block is recomputed). Inside
    ``released_with_result`` it is released with the result, else by the caller."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (held := _HELD.get()) is not None:
        held.append(df)
    return df


def released_with_result(build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, whose held frames are unpersisted when its result is no
    longer referenced (a frame derived from it then computes them again)."""
    frames: list[DataFrame] = []
    token = _HELD.set(frames)
    try:
        result = build()
    finally:
        _HELD.reset(token)
    if frames:
        weakref.finalize(result, _release, frames).atexit = False
    return result


def _release(frames: list[DataFrame]) -> None:
    for df in frames:
        with contextlib.suppress(Exception):  # the session may be gone
            df.unpersist()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpuslab`` importable in Python workers (Arrow UDFs and
    mapInPandas functions are pickled by reference): zip the package once per
    application into a temporary file of the driver and hand it to
    ``addPyFile``, which copies it to every executor. It is code, not data,
    so no shared folder is involved."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    target = os.path.join(tempfile.mkdtemp(prefix="corpuslab-code-"), "corpuslab-code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.join("corpuslab", os.path.relpath(f, pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(key)
