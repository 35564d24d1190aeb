"""What the two vector searches share: clean vectors, k-means on a sample, and
the evaluation of (query, cell) requests in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm.common import materialize, unit_hash

QUERY_BLOCK = 1024


def usable(df: DataFrame, component=lambda x: x) -> DataFrame:
    """(vec_id, vec array<double>) of rows with an id and a vector of finite
    components, padded with zeros to the longest; ``component`` maps each."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: component(x.cast("double"))).alias("vec"))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: vec and its ``keep`` smallest ids, ascending.
    No search for fewer than ``keep`` neighbours can return another id of that
    vector, since ties go to the smaller. The rank limit applies before the
    shuffle, so a vector that most rows share costs ``keep`` rows a task."""
    rank = F.dense_rank().over(W.partitionBy("vec").orderBy("vec_id"))
    return (rows.withColumn("nth", rank).filter(F.col("nth") <= keep)
            .groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
            .withColumn("first", F.get("ids", F.lit(0))))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, vec): ids divisible by ``every``; of an id with several
    vectors the smallest vector asks."""
    return (rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
            .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")))


def sample_matrix(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """About ``most`` vectors, chosen by hash (all, if there are fewer)."""
    n = vectors.count()
    rows = vectors.filter(unit_hash("first", seed=seed) * F.lit(float(n)) < F.lit(float(most))).select("first", "vec").toPandas()
    rows = rows.sort_values("first")
    return np.array(rows["vec"].tolist(), dtype=float).reshape(len(rows), -1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres of the rows of x."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return np.unique(centres, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, distance) of every row."""
    d = squares(x, centres)
    at = d.argmin(axis=1)
    return at, np.sqrt(np.maximum(0, ((x - centres[at]) ** 2).sum(axis=1)))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def evaluate(members: DataFrame, requests: DataFrame, cells: DataFrame, local, score_type: str,
             block: int = QUERY_BLOCK, counts: bool = False) -> DataFrame:
    """Meets every request with all members of its cell.

    members: cell, sub, vec, ids, first; requests: query_id, qvec, bound, cell;
    cells: cell, subs (members are dealt into 0..subs-1). Requests of a cell are
    dealt into blocks of about ``block``; each (cell, sub, block) is a group of
    bounded size. ``local(qvecs, bounds, vecs, firsts)`` returns, for a block,
    (request index, member index, score) arrays. Result: query_id, score, ids.
    With ``counts``, local returns a number for each request too: these are rows
    with an empty list of ids and the number in a column compared."""
    asked = requests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    plan = materialize(cells.select("cell", "subs").join(asked, "cell"), "cell-plan")
    ask = (requests.join(plan, "cell")
           .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
           .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
           .select("cell", "sub", "block", "query_id", "qvec", "bound"))
    have = (members.join(plan.select("cell", "blocks"), "cell")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cell", "sub", "block", "vec", "ids", "first"))
    arrow_score = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def run(key, q: pa.Table, m: pa.Table) -> pa.Table:
        if not q.num_rows or not m.num_rows:
            i, j, s, n = np.empty(0, int), np.empty(0, int), np.empty(0), [np.zeros(q.num_rows, int)]
        else:
            i, j, s, *n = local(matrix(q["qvec"]), q["bound"].to_numpy(), matrix(m["vec"]), m["first"].to_numpy())
        hits = pa.table([q["query_id"].take(pa.array(i)), pa.array(s).cast(arrow_score), m["ids"].take(pa.array(j))],
                        names=["query_id", "score", "ids"])
        if not counts:
            return hits
        hits = hits.append_column("compared", pa.nulls(len(i), pa.int64()))
        none = pa.array([[]] * q.num_rows, m["ids"].type)
        return pa.concat_tables([hits, pa.table([q["query_id"], pa.nulls(q.num_rows, arrow_score), none, pa.array(n[0])],
                                                schema=hits.schema)])

    keys = ["cell", "sub", "block"]
    return ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(
        run, f"query_id long, score {score_type}, ids array<long>" + (", compared long" if counts else ""))


def ranked(found: DataFrame, k: int, order: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the first k found of each query, ties to
    the smaller id, without the query's own."""
    rows = (found.select("query_id", "score", F.explode("ids").alias("vec_id"))
            .filter(F.col("vec_id") != F.col("query_id")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return (rows.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
