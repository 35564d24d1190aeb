"""Readers and writers.

CSV files are read as rows of cells, header included, by Spark's own parser
(quoted line breaks and compression as usual); the first row of each file says,
in the task that reads the file, which of its columns is which. The driver lists
files but opens none. Run keys come from the path (``model=/setting=`` or a path
pattern on ``_metadata``).
"""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import PANDAS_NA_VALUES, na_to_null
from corpuslab.sources import versions

BOM = "\ufeff"
MAX_COLUMNS = 64
#: A data unit's name in a file path: a file, or a folder that Spark or a versioned write filled.
UNIT = r"([^/]+?)(?:\.csv(?:\.[a-z0-9]+)?|\.tsv)?(?:/data-[0-9]{10}-[0-9a-f]{8})?(?:/part-[^/]*)?$"


def _canon(name: str) -> str:
    return name.replace(BOM, "").strip().lower()


def resolve_columns(df: DataFrame) -> dict[str, str]:
    """lower(strip(header)) -> actual column name (S3 helper)."""
    return {_canon(c): c for c in df.columns}


def data_files(spark: SparkSession, pattern: str) -> list[str]:
    """The data files that a path or glob names: files themselves, or the
    files of a folder (and of the folders that Spark wrote inside it); of a
    versioned folder those of its current version. Hidden and marker files are
    left out. One listing on the driver; callers use it for per-run or
    per-language files, of which there are few."""
    fs, hpath = versions.file_system(spark, pattern)
    todo = list(fs.globStatus(hpath) or [])
    found = []
    while todo:
        st = todo.pop()
        path = st.getPath()
        if path.getName().startswith((".", "_")):
            continue
        if not st.isDirectory():
            found.append(path.toString())
        elif now := versions.current(spark, path.toString()):
            todo += list(fs.listStatus(versions.file_system(spark, now)[1]))
        else:
            todo += list(fs.listStatus(path))
    return sorted(found)


def _cells(spark: SparkSession, files: list[str]) -> DataFrame | None:
    """Every row of the CSV (or TSV) files, headers too, as ``__file`` and
    string cells c0, c1, ...; a file's rows stay together and in order, since a
    file with quoted line breaks is read by one task."""
    out = None
    for sep, own in (("\t", [f for f in files if _is_tsv(f)]), (",", [f for f in files if not _is_tsv(f)])):
        if own:
            cells = [f"c{i}" for i in range(MAX_COLUMNS)]
            r = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", False).option("sep", sep)
                 .option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1)
                 .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("mode", "PERMISSIVE"))
            df = r.csv(own).select(F.col("_metadata.file_path").alias("__file"), *cells)
            out = df if out is None else out.union(df)
    return out


def _is_tsv(file: str) -> bool:
    return ".tsv" in file.rsplit("/", 1)[-1] or ".tsv/" in file


def _by_file(batches):
    """(file, header, columns, first row, end) of every file's data rows in a
    stream of cell batches; a header without rows comes with an empty range."""
    import pyarrow.compute as pc

    file, header = None, []
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0)
        cut = [i + 1 for i in pc.indices_nonzero(pc.not_equal(names[1:], names[:-1])).to_pylist()]
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            if names[lo].as_py() != file:
                file = names[lo].as_py()
                header = [b.column(i + 1)[lo].as_py() for i in range(MAX_COLUMNS)]
                if header[-1] is not None:
                    raise ValueError(f"{file} has {MAX_COLUMNS} columns or more")
                header = [_canon(h or "") for h in header]
                while header and not header[-1]:
                    header.pop()
                lo += 1
            yield file, header, b, lo, hi


def file_headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, header array of canonical names) of every file that has a row."""
    def run(batches):
        import pyarrow as pa

        last = None
        for file, header, _, _, _ in _by_file(batches):
            if file != last:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([header], pa.list_(pa.string()))], ["file", "header"])
                last = file

    cells = _cells(spark, files)
    schema = "file string, header array<string>"
    return spark.createDataFrame([], schema) if cells is None else cells.mapInArrow(run, schema)


def read_by_name(spark: SparkSession, files: list[str], columns: list[str], required: list[str] = (),
                 on_missing: str = "error") -> DataFrame:
    """CSV files of possibly different headers as one table of ``columns``
    (all strings), each cell found by its column's name (the first of equals),
    whatever the order. Short rows keep NULLs in the cells they lack, columns a
    file lacks are NULL, cells beyond the header are dropped. A file without a
    ``required`` column is an error that names it, or with ``on_missing="skip"``
    has no rows (``file_headers`` tells which files these are)."""
    columns, required = list(columns), list(required)
    schema = ", ".join(f"`{c}` string" for c in ["__file", *columns])

    def run(batches):
        import pyarrow as pa

        for file, header, b, lo, hi in _by_file(batches):
            if missing := [c for c in required if c not in header]:
                if on_missing == "error":
                    raise ValueError(f"{file} has no column(s) {missing}; it has {header}")
                continue
            if lo < hi:
                own = [b.column(header.index(c) + 1).slice(lo, hi - lo) if c in header else pa.nulls(hi - lo, pa.string())
                       for c in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *own], ["__file", *columns])

    cells = _cells(spark, files)
    return spark.createDataFrame([], schema) if cells is None else cells.mapInArrow(run, schema)


def match_language_files(spark: SparkSession, path: str, languages: list[str]) -> dict[str, list[str]]:
    """Language -> its files under ``path`` (a file ``<language>.csv``, or
    a folder of that name that Spark wrote), by name without case. A language
    without a file is an error that lists all that are missing."""
    found: dict[str, list[str]] = {}
    for f in data_files(spark, path):
        found.setdefault(re.search(UNIT, f).group(1).lower(), []).append(f)
    missing = [x for x in languages if x.lower() not in found]
    if missing:
        raise ValueError(f"no file for language(s) {missing} under {path}; found {sorted(found)}")
    return {x: found[x.lower()] for x in languages}


def read_corpus_folder(spark: SparkSession, path: str, languages: list[str]) -> DataFrame:
    """S1, S2 and S4 for a folder with one wide CSV per language: each file's
    own header decides which of its columns is which. (language, english,
    hindi, tribal)."""
    out = None
    for lang, files in match_language_files(spark, path, languages).items():  # one per language
        wide = read_by_name(spark, files, ["english", "hindi", lang.lower()], ["english", lang.lower()])
        pairs = wide.select(F.lit(lang).alias("language"), na_to_null(F.col("english")).alias("english"),
                            na_to_null(F.col("hindi")).alias("hindi"), na_to_null(F.col(f"`{lang.lower()}`")).alias("tribal"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def read_wide(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """A CSV, or a folder of CSV files, with ``__lang`` from the file (or
    Spark folder) name. Columns are united by name over all files' own
    headers, so files may order them differently; quoted multi-line cells, a
    BOM and short rows (-> NULL) are tolerated; nothing is inferred."""
    files = data_files(spark, path)
    names = file_headers(spark, files).select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    columns = [r["name"] for r in names.filter("name <> ''").orderBy("at", "name").collect()]  # at most MAX_COLUMNS a file
    df = read_by_name(spark, files, columns)
    df = df.withColumn("__lang", F.regexp_extract("__file", UNIT, 1)).drop("__file")
    if languages is not None:
        want = {x.lower(): x for x in languages}
        m = F.create_map(*[x for k, v in want.items() for x in (F.lit(k), F.lit(v))])
        df = df.withColumn("__lang", m[F.lower("__lang")]).filter(F.col("__lang").isNotNull())
    return df


def require_columns(df: DataFrame, need: list[str], optional: list[str] = ()) -> DataFrame:
    """S3: required names must exist (case-insensitively, BOM-tolerant);
    optional ones are added as '' columns. Returns canonical lower-case names."""
    cols = resolve_columns(df)
    missing = [c for c in need if c.lower() not in cols]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; found {df.columns}")
    out = df.select(*[F.col(f"`{actual}`").alias(canon) for canon, actual in cols.items()])
    for c in optional:
        if c.lower() not in cols:
            out = out.withColumn(c.lower(), F.lit(""))
    return out


def read_pairs(df: DataFrame, languages: list[str]) -> DataFrame:
    """Long if a 'language' column exists, else wide with exactly one
    recognised language column (constant language added). Canonical names:
    language, english, hindi, tribal."""
    cols = resolve_columns(df)
    if "language" in cols:
        sel = [F.col(f"`{cols[k]}`").alias(k) for k in ("language", "english", "tribal", "hindi") if k in cols]
        out = df.select(*sel)
    else:
        lang_cols = [x for x in languages if x.lower() in cols]
        if len(lang_cols) != 1:
            raise ValueError(f"no 'language' column and no single recognised language column in {df.columns}")
        lang = lang_cols[0]
        out = df.select(F.lit(lang).alias("language"), F.col(f"`{cols['english']}`").alias("english"),
                        F.col(f"`{cols[lang.lower()]}`").alias("tribal"),
                        *([F.col(f"`{cols['hindi']}`").alias("hindi")] if "hindi" in cols else []))
    if "hindi" not in out.columns:
        out = out.withColumn("hindi", F.lit(None).cast("string"))
    return out.select(*[na_to_null(c).alias(c) for c in ("language", "english", "hindi", "tribal")])


PREDICTION_COLUMNS = ["gid", "language", "tribal", "english", "hyp", "src_lang"]


def run_files(spark: SparkSession, root: str, name: str, layout: str) -> list[str]:
    """Files ``name`` of all runs: ``dirs`` is <root>/<model>/<setting>/<name>,
    ``hive`` is <root>/model=<m>/setting=<s>/."""
    return data_files(spark, f"{root}/model=*/setting=*" if layout == "hive" else f"{root}/*/*/{name}")


def run_keys(file, name: str, layout: str) -> list:
    """model and setting from a file's path."""
    rx = (r"/model=([^/]+)/setting=([^/]+)/[^/]*$" if layout == "hive"
          else rf"/([^/]+)/([^/]+)/{re.escape(name)}(?:/[^/]*)?$")
    return [F.url_decode(F.regexp_extract(file, rx, i)).alias(k) for i, k in ((1, "model"), (2, "setting"))]


def _runs(spark: SparkSession, root: str, name: str, layout: str, columns: list[str], required: list[str]) -> DataFrame:
    """Per-run CSV files, cells by column name, with model and setting from the
    path; files without a ``required`` column have no rows."""
    df = read_by_name(spark, run_files(spark, root, name, layout), columns, required, "skip")
    return df.select(*run_keys(F.col("__file"), name, layout), *columns)


def unreadable_runs(spark: SparkSession, root: str, name: str = "predictions.csv", required: list[str] = ("hyp",),
                    layout: str = "dirs") -> DataFrame:
    """(model, setting, missing) of runs whose file lacks a required column, or
    has no row at all, not even a header."""
    files = run_files(spark, root, name, layout)
    if not files:
        return spark.createDataFrame([], "model string, setting string, missing array<string>")
    need = F.array(*[F.lit(c) for c in required])
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    seen = file_headers(spark, files).withColumn("file", _plain_path("file")).withColumnRenamed("file", "__seen")
    j = listed.join(seen, _plain_path("file") == F.col("__seen"), "left")
    gone = F.array_except(need, F.coalesce("header", F.array().cast("array<string>")))
    return (j.select(*run_keys(F.col("file"), name, layout), gone.alias("missing"))
            .groupBy("model", "setting").agg(F.max_by("missing", F.size("missing")).alias("missing")).filter(F.size("missing") > 0))


def _plain_path(column: str):
    """A file path without its scheme's slashes: listings and scans write them differently."""
    return F.url_decode(F.regexp_replace(F.col(column), r"^([a-z0-9]+:)/+", "$1/"))


def read_predictions(spark: SparkSession, root: str, columns: list[str] = tuple(PREDICTION_COLUMNS),
                     layout: str = "dirs") -> DataFrame:
    """Every run's predictions. Columns are found by name in each file;
    short rows stay, with NULLs; missing-value spellings read as NULL; a file
    without ``hyp`` has no rows and is listed by ``unreadable_runs``."""
    df = _runs(spark, root, "predictions.csv", layout, list(columns), ["hyp"])
    return df.select("model", "setting", *[na_to_null(F.col(c)).alias(c) for c in columns])


def read_run_json(spark: SparkSession, root: str, name: str, schema: str, layout: str = "dirs") -> DataFrame:
    """JSON documents per run (metrics / environment / training /
    inference); unreadable -> fields NULL (PERMISSIVE)."""
    r = spark.read.schema(schema).option("mode", "PERMISSIVE")
    if layout == "hive":
        return r.option("basePath", root).json(f"{root}/model=*/setting=*")
    df = r.option("multiLine", True).json(f"{root}/*/*/{name}")
    p = F.col("_metadata.file_path")
    rx = rf"/([^/]+)/([^/]+)/{name.replace('.', '[.]')}$"
    return df.select(F.regexp_extract(p, rx, 1).alias("model"), F.regexp_extract(p, rx, 2).alias("setting"), "*")


def run_listing(spark: SparkSession, root: str, layout: str = "dirs") -> DataFrame:
    """(model, setting, artifact) of every file of the run folders under
    ``root``, empty ones too; an artifact is a file, or a folder that Spark
    wrote. ``dirs`` is <root>/<model>/<setting>/<artifact>, ``hive`` is
    <root>/<artifact>/model=<m>/setting=<s>/. Spark lists the folders (in tasks,
    where there are many); no file is opened."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).inputFiles()
    files = spark.createDataFrame([(f,) for f in names], "path string")
    if layout == "hive":
        rx, at = r"/([^/]+)/model=([^/]+)/setting=([^/]+)/[^/]*$", (2, 3, 1)
    else:
        rx, at = r"/([^/]+)/([^/]+)/([^/]+?)(?:/part-[^/]*)?$", (1, 2, 3)
    part = [F.url_decode(F.regexp_extract("path", rx, i)).alias(n) for i, n in zip(at, ("model", "setting", "artifact"))]
    return files.select(*part).filter("artifact <> ''")


LOSS_LOG_COLUMNS = ["step", "epoch", "loss", "eval_loss", "lr", "grad_norm", "samples_per_s",
                    "tokens_per_s", "gpu_mem_gb", "elapsed_min", "eta_min"]


def read_loss_curves(spark: SparkSession, root: str, columns=LOSS_LOG_COLUMNS, layout: str = "dirs") -> DataFrame:
    """All training logs stacked, (model, setting) first, all cells as
    strings found by column name (numeric coercion is P8's job)."""
    return _runs(spark, root, "training_log.csv", layout, list(columns), ["step"])


RUN_INDEX_COLUMNS = ["timestamp", "event", "script", "label", "duration_min", "status", "log_file", "run_dir", "command"]


def read_run_index(spark: SparkSession, path: str, stream: bool = False, watermark: str = "1 day") -> DataFrame:
    """The append-only invocation index. In batch, cells are found by
    column name in every appended file. As a stream, each file has the index's
    own column order, and a line that is appended again within ``watermark`` of
    event time counts once; the state holds the lines of that time only, and a
    line older than the newest by more than it is dropped."""
    if stream:
        schema = ", ".join(f"{c} string" for c in RUN_INDEX_COLUMNS)
        df = spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(path)
    else:
        df = read_by_name(spark, data_files(spark, path), RUN_INDEX_COLUMNS, ["event"]).drop("__file")
    df = df.withColumn("ts", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))
    return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(RUN_INDEX_COLUMNS) if stream else df


def csv_writer(w):
    """CSV options that round-trip text exactly: header, doubled quotes,
    no whitespace trimming (Spark trims on write by default)."""
    return (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def packed(w):
    """Text files as LZ4, which the readers here take as they are: a run's outputs
    repeat every reference, so they are most of what is written. Gzip files are
    smaller but took a third more time to write and read."""
    return w.option("compression", "lz4")


def tight(w):
    """Text files as gzip of its fastest level: 28 % less on disk than LZ4 for the
    outputs of runs, for some half more CPU time to write; the readers here take them as they are."""
    return w.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")


@contextlib.contextmanager
def unsorted_folders(spark: SparkSession, most: int = 64):
    """Writes inside keep a file open for each folder of ``partitionBy`` (up to
    ``most`` a task, then they sort as usual) instead of sorting a task's rows,
    texts and all, which spills them to disk."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_corpus(df: DataFrame, path: str, force: bool = False, fmt: str = "csv") -> str:
    """K1: no-op when a complete target exists unless forced. The result is a
    new version of ``path`` (``sources/versions.py``): a reader finds the old
    one until the new one is complete, and nothing is renamed. A replacement may
    read what it replaces. Returns ``path``; ``data_files`` and the readers here
    go to the current version, other readers to ``versions.current``."""
    spark = df.sparkSession
    if versions.current(spark, path) is None or force:
        versions.publish(df, path, lambda w, to: csv_writer(w).csv(to) if fmt == "csv" else w.parquet(to))
    return path


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """K2: a table as TSV and CSV with headers, in as many parts as the plan
    has. ``one_file`` is for reports of a few rows: one part each."""
    d = df.coalesce(1) if one_file else df
    d = d.persist()
    try:
        csv_writer(d.write.mode("overwrite")).option("sep", "\t").csv(f"{path}.tsv")
        csv_writer(d.write.mode("overwrite")).csv(f"{path}.csv")
    finally:
        d.unpersist()


def write_nested(df: DataFrame, path: str, partition_by: tuple = ()) -> None:
    """K3: nested JSON (maps / structs / arrays as they are), optionally one
    folder per run key."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def append_partial(df: DataFrame, path: str, batch_id: int) -> None:
    """K4: partial results written per batch id. Overwriting that id's folder
    makes a retried batch idempotent, provided ``df`` does not depend on what
    an earlier try of the same batch wrote: see ``read_partials``."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_partials(spark: SparkSession, path: str, schema: str, except_batch: int | None = None) -> DataFrame:
    """All partial results (with ``batch``), or those of all other batches: what
    a batch may take as done, whether or not it was tried before."""
    df = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    return df if except_batch is None else df.filter(F.col("batch") != except_batch)


def append_events(df: DataFrame, path: str) -> None:
    """K5: log rows appended, never rewritten, header in every part file."""
    csv_writer(df.write.mode("append")).csv(path)


__all__ = ["read_wide", "file_headers", "unreadable_runs", "run_listing", "data_files", "read_corpus_folder", "match_language_files", "read_by_name", "read_partials", "require_columns", "read_pairs", "read_predictions", "read_run_json",
           "read_loss_curves", "read_run_index", "packed", "tight", "unsorted_folders", "write_corpus", "write_table", "write_nested",
           "append_partial", "append_events", "PANDAS_NA_VALUES"]
