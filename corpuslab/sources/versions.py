"""Tables that are replaced as a whole, by versions and one pointer write.

``path/data-<n>-<tag>/`` holds a version's files; ``path/_versions/<n>`` is a
small file that names the folder. A version counts from the moment its pointer
is complete: writers never touch what a pointer names, so a reader always finds
the last complete version, whatever a writer does or wherever it stops. Nothing
is renamed, so the commit costs the same on an object store. The pointer's number
is claimed by creating it without overwriting; a writer that loses the race takes
the next number. Versions older than the ``keep`` newest are removed after a
commit; a writer that stopped before its pointer leaves a folder that nothing names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


def file_system(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the pointers, newest first."""
    fs, folder = file_system(spark, f"{path.rstrip('/')}/{POINTERS}")
    if not fs.exists(folder):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _folder(spark: SparkSession, path: str, number: int) -> str | None:
    """The folder that a pointer names; None while it is not complete."""
    fs, file = file_system(spark, f"{path.rstrip('/')}/{POINTERS}/{number:010d}")
    try:
        stream = fs.open(file)
    except Exception:  # removed meanwhile
        return None
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    if not text.endswith("\n"):
        return None
    return f"{path.rstrip('/')}/{json.loads(text)['folder']}"


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version; None if there is none."""
    for n in _pointers(spark, path):
        if found := _folder(spark, path, n):
            return found
    return None


def publish(df: DataFrame, path: str, write: Callable[[object, str], None] | None = None, keep: int = 2) -> str:
    """Writes ``df`` as the next version of ``path`` and returns its folder.
    ``write(df.write, folder)`` writes the files (Parquet by default); ``df``
    may read the version it replaces."""
    spark, root = df.sparkSession, path.rstrip("/")
    before = _pointers(spark, root)
    name = f"data-{(before[0] if before else 0) + 1:010d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    write(writer, f"{root}/{name}") if write else writer.parquet(f"{root}/{name}")
    number = (before[0] if before else 0) + 1
    while not _claim(spark, f"{root}/{POINTERS}/{number:010d}", {"folder": name}):
        number += 1
    _remove_old(spark, root, keep)
    return f"{root}/{name}"


def _claim(spark: SparkSession, file: str, content: dict) -> bool:
    fs, target = file_system(spark, file)
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Exception:
        if fs.exists(target):
            return False
        raise
    try:
        out.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        out.close()
    return True


def _remove_old(spark: SparkSession, root: str, keep: int) -> None:
    """Removes what lies behind the ``keep`` newest complete versions, and
    pointers that were never completed before them."""
    complete = 0
    for n in _pointers(spark, root):
        data = _folder(spark, root, n)
        complete += data is not None
        if complete and (data is None or complete > max(1, keep)):
            fs, file = file_system(spark, f"{root}/{POINTERS}/{n:010d}")
            fs.delete(file, False)
            if data:
                fs.delete(file_system(spark, data)[1], True)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version as a Parquet table of ``schema``; empty if there is none."""
    folder = current(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)
