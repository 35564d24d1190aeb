"""Exact top-k by inner product with a pivot-distance index.

Every vector gets one more component that makes all lengths equal, so the
largest inner product is the smallest distance. Vectors are keyed by their
nearest pivot and their distance to it; each pivot's vectors, sorted by
distance, are cut into annuli of about ``cell_rows`` (more, where the table
would have over MOST_CELLS of them; they are then dealt into parts). Of every
annulus the least and largest distance to each pivot is kept, and the largest
without the added component. They bound what a vector of the annulus can score:

* by the triangle inequality it is no nearer to the query than its distances
  are outside d(q, p), for the pivot p where that is most;
* with h the largest distance to p without the added component, its score is at
  most q.p + |q| h, for the pivot where that is least.

A query visits annuli in the order of this ceiling, in ``rounds``: the first,
some more, all others. After each round its bound is the k-th score found, and
it stops where the next annulus' ceiling is below. Within an annulus the same is
done again over thin annuli of THIN vectors, with the bound raised after each.
Nothing left out can reach the bound: the result is exact.

The number of pivots grows with the root of the table's size, to MOST_PIVOTS. Queries
and annuli meet in blocks (see vectors.evaluate): a task holds a part of an
annulus and a block of queries. Data without structure in many dimensions cannot
be pruned by any triangle inequality; ``compared`` tells how much was.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without id, take no part; shorter vectors count as padded with zeros;
equal rows count once; of an id with several vectors all are candidates and the
smallest asks; fewer than k candidates -> all; an empty table -> no rows. Scores
must fit in a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm import vectors as V
from corpuslab.llm.common import materialize

RINGS = 1024  # distance steps from which a pivot's annuli are formed
MOST_PIVOTS = 128
MOST_CELLS = 2048  # annuli beyond one a pivot; with MOST_PIVOTS this bounds what every task knows of the index
THIN = 128
QUERY_BLOCK = 4096


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, V.squares(x, centres)))


def _ceilings(q: np.ndarray, centres: np.ndarray, most: float, low, high, flat) -> np.ndarray:
    """Queries x annuli: no vector of the annulus scores more. low, high, flat:
    annuli x pivots, the least and largest distance, and the largest without
    the added component."""
    q = q.astype(float)
    norm = np.sqrt((q * q).sum(axis=1))
    d = _distances(np.hstack([q, np.zeros((len(q), 1))]), centres)
    dot = q @ centres[:, :-1].T
    gap, ball = np.zeros((len(q), len(low))), np.full((len(q), len(low)), np.inf)
    for p in range(len(centres)):
        at = d[:, p, None]
        np.maximum(gap, np.maximum(at - high[:, p], low[:, p] - at), out=gap)
        np.minimum(ball, dot[:, p, None] + norm[:, None] * flat[:, p], out=ball)
    slack = 1e-6 * (1 + d.max(axis=1))[:, None]  # of the square roots
    gap = np.maximum(0, gap - slack)
    return np.minimum(((norm ** 2)[:, None] + most - gap ** 2) / 2, ball) + slack * (1 + norm[:, None])


def _best(k: int, centres: np.ndarray, most: float):
    """All members of an annulus a query may need: score >= bound, the k + 1
    best of them; and with how many members each query was compared."""
    def local(q, bound, x, first):
        wide = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] >= 2.0 ** 52
        if wide:
            q, x = q.astype(np.int64), x.astype(np.int64)
        d = _distances(_lift(x, most), centres)
        order = np.argsort(d.min(axis=1), kind="stable")
        x, d, flat = x[order], d[order], _distances(x[order].astype(float), centres[:, :-1])
        starts = np.arange(0, len(x), THIN)
        ceiling = _ceilings(q, centres, most, np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts),
                            np.maximum.reduceat(flat, starts))
        bound, compared = bound.copy(), np.zeros(len(q), dtype=np.int64)
        top = np.full((len(q), k + 1), -np.inf)
        found = []
        for ring in np.argsort(-ceiling.mean(axis=0), kind="stable"):
            rows = np.nonzero(ceiling[:, ring] >= bound)[0]
            if not len(rows):
                continue
            part = slice(starts[ring], starts[ring] + THIN)
            s = q[rows] @ x[part].T
            compared[rows] += s.shape[1]
            i, j = np.nonzero(s >= bound[rows, None])
            found.append((rows[i], order[part][j], s[i, j].astype(np.int64)))
            top[rows] = np.partition(np.hstack([top[rows], s]), -(k + 1), axis=1)[:, -(k + 1):]
            # k + 1 members, one of which may be the query's own
            bound[rows] = np.maximum(bound[rows], top[rows].min(axis=1))
        i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int),) * 3
        fine = score >= bound[i]
        i, j, score = i[fine], j[fine], score[fine]
        best = np.lexsort((first[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        return i[nth <= k], j[nth <= k], score[nth <= k], compared
    return local


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int | None = None,
          cell_rows: int = 4096, sample: int = 4096, seed: int = 5, rounds: tuple = (1, 8)) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products among
    floor(scale * x) vectors of ``df`` (vec_id, embedding), for ids divisible by
    ``every``; compared: the number of different vectors that the query was
    multiplied with. The pivots are fitted on a sample of ``sample`` vectors;
    ``rounds`` are the numbers of annuli after which bounds are raised."""
    rows = materialize(V.usable(df, lambda x: F.floor(x * F.lit(scale)).cast("double")), "vectors")
    members = materialize(V.distinct_vectors(rows, k + 1), "distinct-vectors")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, most = members.agg(F.count(F.lit(1)), F.max(norm2)).first()
    if not n:
        return members.select(*[F.lit(0).cast(t).alias(c) for c, t in (
            ("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "long"), ("compared", "long"))]).limit(0)
    pivots = pivots or int(min(MOST_PIVOTS, max(32, np.sqrt(n) / 4)))
    cell_size = max(cell_rows, -(-n // MOST_CELLS))
    sampled = V.sample_matrix(members, sample, seed)
    centres = V.kmeans(_lift(sampled if len(sampled) else np.zeros((1, sampled.shape[1])), most), pivots, 8,
                       np.random.default_rng(seed))  # pivots x dimensions
    reach = 2 * float(np.sqrt(most)) + 1  # no distance is larger

    def assign(batches):
        for b in batches:
            if b.num_rows:
                at, d = V.nearest(_lift(V.matrix(b.column("vec")), most), centres)
                ring = np.minimum(RINGS - 1, (d / reach * RINGS).astype(int))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(at, pa.int32()), pa.array(ring, pa.int32())],
                    [*b.schema.names, "pivot", "ring"])

    placed = materialize(members.mapInArrow(
        assign, "vec array<double>, ids array<long>, first long, pivot int, ring int"), "placed")
    # annuli: neighbouring distance steps joined until they hold about cell_size
    step = placed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("pivot").orderBy("ring")) - F.col("n")
    step = step.withColumn("cell", F.col("pivot").cast("long") * F.lit(1 << 40) + F.floor(before / cell_size))
    step = materialize(step, "steps")  # at most pivots * RINGS rows
    cells = materialize(step.groupBy("cell").agg(F.ceil(F.sum("n") / cell_rows).cast("int").alias("subs")), "cells")
    index = (placed.join(F.broadcast(step.select("pivot", "ring", "cell")), ["pivot", "ring"])
             .join(F.broadcast(cells), "cell")  # no more rows than step
             .withColumn("sub", F.pmod(F.xxhash64("first"), F.col("subs")).cast("int"))
             .select("cell", "sub", "vec", "ids", "first"))
    index = materialize(index, "index")

    def box(key, m):
        x = V.matrix(m["vec"])
        d, flat = _distances(_lift(x, most), centres), _distances(x, centres[:, :-1])
        p = np.arange(d.shape[1])
        return pa.table([pa.array(np.full(len(p), key[0].as_py())), pa.array(p, pa.int32()), pa.array(d.min(axis=0)),
                         pa.array(d.max(axis=0)), pa.array(flat.max(axis=0))], names=["cell", "pivot", "low", "high", "flat"])

    boxes = (index.groupBy("cell", "sub").applyInArrow(box, "cell long, pivot int, low double, high double, flat double")
             .groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("flat").alias("flat"))
             .toPandas().sort_values(["cell", "pivot"]))  # at most (MOST_CELLS + pivots) * pivots rows
    known = boxes["cell"].unique()
    low, high, flat = (boxes[c].to_numpy().reshape(len(known), len(centres)) for c in ("low", "high", "flat"))

    def route(start: int, stop: int | None):
        """Requests for the annuli of these places in a query's order, as far as
        its bound lets it go."""
        def run(batches):
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    part = b.slice(s, 256)
                    q, bound = V.matrix(part.column("qvec")), part.column("bound").to_numpy()
                    ceiling = _ceilings(q, centres, most, low, high, flat)
                    order = np.argsort(-ceiling, axis=1, kind="stable")[:, start:stop]
                    i, j = np.nonzero(np.take_along_axis(ceiling, order, axis=1) >= bound[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(pa.array(i)) for c in part.columns], pa.array(known[order[i, j]], pa.int64())],
                        ["query_id", "qvec", "bound", "cell"])
        return run

    asking = materialize(V.queries_of(rows, every).select("query_id", F.col("vec").alias("qvec")), "queries")
    best, compared = None, None
    for start, stop in zip((0, *rounds), (*rounds, None)):
        if start >= len(known):
            break
        if best is None:
            asked = asking.withColumn("bound", F.lit(float("-inf")))
        else:
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
            asked = asking.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
            asked = materialize(asked, "bounded")
        requests = asked.mapInArrow(route(start, stop), "query_id long, qvec array<double>, bound double, cell long")
        found = materialize(V.evaluate(index, requests, cells, _best(k, centres, float(most)), "long",
                                       block=QUERY_BLOCK, counts=True), "found")
        counted = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
        compared = counted if compared is None else compared.unionByName(counted)
        hits = found.select("query_id", "score", "ids")
        if best is not None:
            hits = hits.unionByName(best.select("query_id", "score", F.array("vec_id").alias("ids")))
        best = materialize(V.ranked(hits, k, F.col("score").desc()), "best")
    return best.join(compared.groupBy("query_id").agg(F.sum("compared").alias("compared")), "query_id")
