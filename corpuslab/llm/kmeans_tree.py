"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the distinct vectors: nodes are split
by k-means into ``branches`` children until a leaf stands for about
``leaf_rows`` vectors of the whole table or for too few of the sample. Every
vector of the table is then sent to its leaf. A leaf that then holds more than
``split_rows`` vectors gets a tree of its own, fitted on a bounded sample of its
vectors by one task a leaf; only the tree of the first sample is known to all
tasks, the trees of leaves meet vectors and queries by shuffles. A query visits leaves in the
order of a priority queue over the distance to the centres not yet opened (best
bin first). How many leaves: for a calibration set of queries the true
neighbours are found by brute force over all rows, and the number of visits is
widened until the leaves visited hold ``recall`` of them. A query goes on until
the leaves it has visited hold enough vectors for k results. Where leaves have
trees, the visits of the first tree are widened to half the permitted loss; the
leaves found below are merged in the order of the distance to their centres, and
the number visited of these is widened to ``recall``.

Queries and leaves meet in blocks (see vectors.evaluate); leaves that hold more
than ``cell_rows`` vectors are dealt into parts. Distances are recomputed from
differences of the original vectors in double precision.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without id, take no part; shorter vectors count as padded
with zeros; equal rows count once; fewer than k candidates -> all; an empty
table -> no rows.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuslab.llm import vectors as V
from corpuslab.llm.common import materialize, unit_hash


LEAVES = 1 << 20  # numbers for the leaves of a leaf's tree


@dataclass
class Tree:
    centres: list[np.ndarray] = field(default_factory=list)  # of each inner node's children
    children: list[list[int]] = field(default_factory=list)  # node >= 0, or -1 - leaf
    leaves: int = 0

    def grow(self, x: np.ndarray, branches: int, least: int, rng: np.random.Generator) -> int:
        """Index of the node that stands for the sample rows x."""
        centres = V.kmeans(x, branches, 6, rng) if len(x) > max(least, branches) else x[:0]
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        near = V.nearest(x, centres)[0]
        # every child keeps at least its centre, so that empty ones are leaves
        self.children[node] = [self.grow(x[near == c], branches, least, rng) for c in range(len(centres))]
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = V.squares(x[rows], self.centres[node]).argmin(axis=1)
            for c, child in enumerate(self.children[node]):
                own = rows[near == c]
                if len(own):
                    if child < 0:
                        out[own] = -1 - child
                    else:
                        todo.append((child, own))
        return out

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        for _, leaf in self.measured(q):
            yield leaf

    def measured(self, q: np.ndarray):
        """(squared distance to its centre, leaf) in best-bin-first order."""
        queue = [(0.0, 0)] if self.centres else []
        if not queue:
            yield 0.0, 0
        while queue:
            own, node = heapq.heappop(queue)
            while node >= 0:  # down to the nearest leaf, queueing its siblings on the way
                d = ((self.centres[node] - q) ** 2).sum(axis=1)
                order = np.argsort(d, kind="stable")
                for c in order[1:]:
                    heapq.heappush(queue, (float(d[c]), self.children[node][c]))
                own, node = float(d[order[0]]), self.children[node][order[0]]
            yield own, -1 - node


def _closest(k: int):
    """The k + 1 nearest members of each query within its bound, by exact
    distance."""
    def local(q, bound, x, first):
        d = V.squares(q, x)
        keep = min(k, len(x) - 1)
        limit = np.minimum(np.partition(d, keep, axis=1)[:, keep], bound * bound)
        slack = 1e-9 * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max())
        i, j = np.nonzero(d <= (limit + slack)[:, None])
        exact = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
        inside = exact <= bound[i]
        i, j, exact = i[inside], j[inside], exact[inside]
        order = np.lexsort((first[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        return i[nth <= k], j[nth <= k], exact[nth <= k]
    return local


def _truth(members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded set of queries: every batch of the index
    returns its nearest for each, then the best of all."""
    known = asked.toPandas().sort_values("query_id")
    q = np.array(known["qvec"].tolist(), dtype=float).reshape(len(known), -1)
    ids = known["query_id"].to_numpy()
    local = _closest(k)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                i, j, s = local(q, np.full(len(q), np.inf), V.matrix(part.column("vec")), part.column("first").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i]), pa.array(s), part.column("ids").take(pa.array(j)), part.column("cell").take(pa.array(j))],
                    ["query_id", "score", "ids", "cell"])

    return members.mapInArrow(run, "query_id long, score double, ids array<long>, cell long")


def search(df: DataFrame, k: int = 10, every: int = 100, recall: float = 0.95, branches: int = 8,
           leaf_rows: int = 256, sample: int = 20_000, calibration: int = 200, cell_rows: int = 4096,
           split_rows: int = 4096, split_sample: int = 4096, seed: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found among the vectors
    of ``df`` (vec_id, embedding) for ids divisible by ``every``. ``sample``
    bounds the vectors the tree is fitted on, ``calibration`` the queries from
    which the number of leaf visits is chosen, ``split_sample`` the vectors that
    the tree of a leaf of more than ``split_rows`` is fitted on; all rows are
    indexed."""
    rows = materialize(V.usable(df).filter(F.exists("vec", lambda x: x != 0)), "vectors")
    distinct = materialize(V.distinct_vectors(rows, k + 1), "distinct-vectors")
    n = distinct.count()
    if not n:
        return distinct.select(*[F.lit(0).cast(t).alias(c) for c, t in (
            ("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "double"))]).limit(0)
    tree, x = Tree(), V.sample_matrix(distinct, sample, seed)
    if len(x):
        tree.grow(x, branches, max(16, round(leaf_rows * len(x) / n)), np.random.default_rng(seed))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf_of(V.matrix(b.column("vec"))))],
                                                 [*b.schema.names, "cell"])

    placed = materialize(distinct.mapInArrow(assign, "vec array<double>, ids array<long>, first long, cell long"), "placed")
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # leaves: bounded by the sample
    asking = materialize(V.queries_of(rows, every), "queries")
    n_asking = asking.count()
    tried = asking.filter(unit_hash("query_id", seed=seed) * F.lit(float(n_asking)) < F.lit(float(calibration)))
    tried = materialize(tried.select("query_id", F.col("vec").alias("qvec"), F.lit(float("inf")).alias("bound")), "calibration")

    def route(most: int, target: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                at, leaf, away = [], [], []
                for i, q in enumerate(V.matrix(b.column("qvec")) if b.num_rows else []):
                    seen = holds = 0
                    for d, own in tree.measured(q):
                        at.append(i)
                        leaf.append(own)
                        away.append(d)
                        seen += 1
                        holds += held.get(own, 0)
                        if seen >= most and holds > k:
                            break
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at, pa.int64())) for c in b.columns], pa.array(leaf, pa.int64()),
                     pa.array(away, pa.float64())], ["query_id", "qvec", "bound", "cell", "away"])
        return target.mapInArrow(run, "query_id long, qvec array<double>, bound double, cell long, away double")

    truth = V.ranked(_truth(placed, tried, k), k, F.col("score").asc()).select("query_id", "vec_id")
    truth = materialize(truth.join(placed.select(F.explode("ids").alias("vec_id"), "cell"), "vec_id"), "truth")
    split = any(size > split_rows for size in held.values())
    visits = _visits_needed(tree, truth, tried, (1 + recall) / 2 if split else recall)
    requests = route
    if split:
        placed, below = _split(placed, held, branches, leaf_rows, cell_rows, split_rows, split_sample, seed)
        tops = visits

        def requests(most: int, target: DataFrame) -> DataFrame:
            return _merged(route(1 if most == 1 else tops, target), below, most, k).join(target, "query_id")

        visits = _merged_visits_needed(route(tops, tried), below, placed, truth, k, recall)
    cells = materialize(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("subs")), "leaves")
    index = materialize(placed.join(cells if split else F.broadcast(cells), "cell")  # one row per leaf
                        .withColumn("sub", F.pmod(F.xxhash64("first"), F.col("subs")).cast("int"))
                        .select("cell", "sub", "vec", "ids", "first"), "index")

    asked = asking.select("query_id", F.col("vec").alias("qvec"), F.lit(float("inf")).alias("bound"))
    # the first leaf bounds what the others need to return
    near = V.ranked(V.evaluate(index, requests(1, asked), cells, _closest(k), "double"),
                    k, F.col("score").asc()).filter(F.col("rank") == k)
    bounded = materialize(asked.drop("bound").join(near.select("query_id", F.col("score").alias("bound")), "query_id", "left")
                          .select("query_id", "qvec", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounded")
    found = V.evaluate(index, requests(visits, bounded), cells, _closest(k), "double")
    return V.ranked(found, k, F.col("score").asc())


def _visits_needed(tree: Tree, truth: DataFrame, tried: DataFrame, recall: float) -> int:
    """Leaf visits at which the calibration queries reach ``recall``."""
    wanted = truth.toPandas()  # at most k rows a calibration query
    vec = {r["query_id"]: np.array(r["qvec"]) for r in tried.collect()}
    need = []
    for query_id, own in wanted.groupby("query_id"):
        rank = {leaf: i + 1 for i, leaf in enumerate(tree.visit(vec[query_id]))}
        need += [rank[c] for c in own["cell"]]
    return _least(np.array(need), recall)


def _least(need: np.ndarray, recall: float) -> int:
    """The smallest number that a share ``recall`` of ``need`` does not exceed."""
    return int(np.sort(need)[int(np.ceil(recall * len(need))) - 1]) if len(need) else 1


def _split(placed: DataFrame, held: dict, branches: int, leaf_rows: int, cell_rows: int, split_rows: int,
           split_sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``placed`` with the leaves of leaves (cell * LEAVES + number), and one row
    a cell: its tree (null: not split) and the sizes of its leaves by number."""
    spark = placed.sparkSession
    sizes = spark.createDataFrame([(int(c), int(n)) for c, n in held.items()], "cell long, n long")
    chosen = placed.join(F.broadcast(sizes.filter(F.col("n") > split_rows)), "cell").filter(
        unit_hash("first", seed=seed + 1) * F.col("n") < F.lit(float(split_sample)))

    def fit(key, m):
        m = m.sort_by("first")
        x, n, tree = V.matrix(m["vec"]), m["n"][0].as_py(), Tree()
        tree.grow(x, branches, max(16, round(leaf_rows * len(x) / n)), np.random.default_rng(seed))
        return pa.table({"cell": pa.array([key[0].as_py()]), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = chosen.select("cell", "n", "first", "vec").groupBy("cell").applyInArrow(fit, "cell long, tree binary")
    trees = materialize(sizes.join(trees, "cell", "left").withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int")), "trees")
    parts = trees.select("cell", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = placed.join(F.broadcast(trees.select("cell", "parts")), "cell").withColumn(
        "part", F.pmod(F.xxhash64("first", F.lit(seed)), F.col("parts")).cast("int"))

    def refine(key, m: pa.Table, t: pa.Table) -> pa.Table:
        tree = _tree_of(t)
        leaf = tree.leaf_of(V.matrix(m["vec"])) if m.num_rows else np.empty(0, np.int64)
        cell = pa.array(key[0].as_py() * LEAVES + leaf, pa.int64())
        return pa.table([m["vec"], m["ids"], m["first"], cell], names=["vec", "ids", "first", "cell"])

    keys = ["cell", "part"]
    fine = materialize(dealt.select(*keys, "vec", "ids", "first").groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(
        refine, "vec array<double>, ids array<long>, first long, cell long"), "refined")
    per = (fine.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
           .groupBy(F.shiftright("cell", 20).alias("cell"))  # leaves of one tree: bounded by split_sample
           .agg(F.map_from_entries(F.collect_list(F.struct(F.col("cell").bitwiseAND(LEAVES - 1), "n"))).alias("sizes")))
    return fine, materialize(trees.select("cell", "tree").join(per, "cell"), "below")


def _tree_of(t: pa.Table) -> Tree:
    raw = t["tree"][0].as_py() if t.num_rows else None
    return pickle.loads(raw) if raw is not None else Tree()


def _merged(tops: DataFrame, below: DataFrame, most: int | None, k: int) -> DataFrame:
    """query_id, cell, nth: of the leaves under the requested cells those with
    the nearest centres, ``most`` (None: all) or as many as hold k others."""
    tops = tops.select("query_id", "qvec", "cell", "away")
    plan = materialize(tops.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / V.QUERY_BLOCK).cast("int").alias("blocks")), "top-plan")
    asked = tops.join(F.broadcast(plan), "cell").withColumn(  # one row a leaf of the first tree
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    known = below.join(F.broadcast(plan), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(key, q: pa.Table, t: pa.Table) -> pa.Table:
        at, leaf, away, n = [], [], [], []
        if q.num_rows and t.num_rows:
            tree, sizes = _tree_of(t), dict(t["sizes"][0].as_py())
            top = q["away"].to_pylist()
            for i, v in enumerate(V.matrix(q["qvec"])):
                seen = holds = 0
                for d, own in tree.measured(v):
                    at.append(i)
                    leaf.append(key[0].as_py() * LEAVES + own)
                    away.append(d if tree.centres else top[i])
                    n.append(sizes.get(own, 0))
                    seen += 1
                    holds += n[-1]
                    if most is not None and seen >= most and holds > k:
                        break
        return pa.table([q["query_id"].take(pa.array(at, pa.int64())), pa.array(leaf, pa.int64()),
                         pa.array(away, pa.float64()), pa.array(n, pa.int64())], names=["query_id", "cell", "away", "n"])

    keys = ["cell", "block"]
    leaves = asked.select(*keys, "query_id", "qvec", "away").groupBy(*keys).cogroup(
        known.select(*keys, "tree", "sizes").groupBy(*keys)).applyInArrow(
        run, "query_id long, cell long, away double, n long")
    order = W.partitionBy("query_id").orderBy("away", "cell")
    leaves = leaves.filter("n > 0").withColumn("nth", F.row_number().over(order)).withColumn(
        "before", F.sum("n").over(order) - F.col("n"))
    if most is not None:
        leaves = leaves.filter((F.col("nth") <= most) | (F.col("before") <= k))
    return leaves.select("query_id", "cell", "nth")


def _merged_visits_needed(tops: DataFrame, below: DataFrame, placed: DataFrame, truth: DataFrame, k: int,
                          recall: float) -> int:
    """As ``_visits_needed``, for the leaves of all trees together."""
    where = placed.select(F.explode("ids").alias("vec_id"), "cell")
    wanted = truth.select("query_id", "vec_id").join(where, "vec_id")
    rank = wanted.join(_merged(tops, below, None, k), ["query_id", "cell"], "left").select("nth").toPandas()["nth"]
    return _least(rank.fillna(2 ** 31).to_numpy(), recall)
