"""Whitening of embeddings: vectors projected on the leading components of
their covariance, every component scaled to variance one.

* Moments. A task folds its batches into (n, sums, scatter): a batch is centred
  by its own mean, and two parts merge by Chan's rule, so nothing is multiplied
  before it is centred and large offsets cost no digits. The parts of all tasks
  are merged in rounds of groups of ``FAN`` until one is left, so no task or
  driver holds more than ``FAN`` matrices of dimension x dimension.
* Components. The covariance (dimension x dimension, one matrix) is brought to
  tridiagonal form by Householder reflections; Sturm counts place the leading
  eigenvalues by bisection; inverse iteration gives their vectors, those of a
  cluster of close eigenvalues being made orthogonal to each other.
* Projection. The matrix of components is broadcast (its size is bounded by the
  dimension) and every vector is projected in one map pass.

The vectors are read three times: for their moments, for the moments of the
result (the measured departure from the identity) and for the result.

Defined cases: rows without a vector, or with null or non-finite entries, are
dropped; shorter vectors are padded with zeros; a null id stays a row, equal
rows are rows each; directions without variance (up to rounding) give no
component, so one vector, or equal vectors only, give no rows, as an empty table
does; other columns are ignored, whatever their names. Entries too large for
64-bit integers after scaling are counted as doubles, and a deviation beyond 64
bits is null.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import materialize, plain_names
from corpuslab.llm.vectors import matrix

FAN = 32
OFFSET = 1_000_000
SCALE = 64
PART = "part long, n long, sums array<string>, means array<double>, scatter array<double>"


# ---- moments ---------------------------------------------------------------

@dataclasses.dataclass
class Moments:
    """Number, exact or double sums, means and centred scatter of some vectors."""

    n: int
    sums: np.ndarray  # of Python integers or doubles
    means: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.means - self.means
        sums = self.sums + other.sums
        means = np.array([float(s / n) for s in sums]) if sums.dtype == object else self.means + apart * (other.n / n)
        return Moments(n, sums, means, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of the rows of ``x``; whole numbers are summed exactly."""
        if x.dtype == object:
            sums = x.sum(axis=0)
            means = np.array([float(s / len(x)) for s in sums])
            y = (x - means).astype(float)
        elif x.dtype == np.int64:
            sums = np.array([int(s) for s in x.sum(axis=0)], dtype=object)
            means = np.array([float(s / len(x)) for s in sums])
            y = x - means
        else:
            sums = x.sum(axis=0)
            means = sums / len(x)
            y = x - means
        return Moments(len(x), sums, means, y.T @ y)


def _part_batch(part: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([m.n], pa.int64()),
         pa.array([[str(s) if isinstance(s, int) else float(s).hex() for s in m.sums]], pa.list_(pa.string())),
         pa.array([m.means.tolist()], pa.list_(pa.float64())),
         pa.array([m.scatter.ravel().tolist()], pa.list_(pa.float64()))],
        ["part", "n", "sums", "means", "scatter"])


def _number(text: str):
    return float.fromhex(text) if "x" in text or "n" in text else int(text)


def _parts(table: pa.Table) -> list[Moments]:
    out = []
    for r in table.to_pylist():
        d = len(r["means"])
        sums = [_number(s) for s in r["sums"]]
        kind = object if all(isinstance(s, int) for s in sums) else float
        out.append(Moments(r["n"], np.array(sums, dtype=kind), np.array(r["means"]), np.array(r["scatter"]).reshape(d, d)))
    return out


def moments(rows: DataFrame, column: str, prepare) -> Moments | None:
    """Moments of the vectors ``prepare(matrix of column)``; None without rows."""
    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                own = Moments.of(prepare(matrix(b.column(0))))
                total = own if total is None else total.merge(own)
        if total is not None:
            yield _part_batch(TaskContext.get().partitionId(), total)

    parts = materialize(rows.select(column).mapInArrow(run, PART), "moments")

    def merge(key, table):
        total, *rest = _parts(table)
        for m in rest:
            total = total.merge(m)
        return pa.Table.from_batches([_part_batch(key[0].as_py(), total)])

    while parts.count() > FAN:
        grouped = parts.groupBy(F.floor(F.col("part") / F.lit(FAN)).alias("group"))
        parts = materialize(grouped.applyInArrow(merge, PART), "moments")
    last = sorted(parts.collect(), key=lambda r: r["part"])  # at most FAN rows
    if not last:
        return None
    table = pa.Table.from_pylist([r.asDict() for r in last])
    total, *rest = _parts(table)
    for m in rest:
        total = total.merge(m)
    return total


# ---- leading eigenvectors of a symmetric matrix ------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): q.T @ a @ q is tridiagonal, by Householder
    reflections."""
    a = a.astype(float).copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), q


def sturm_count(d: np.ndarray, e2: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``: negative pivots of the
    shifted matrix."""
    pivot = d[0] - x
    below = (pivot < 0).astype(int)
    for i in range(1, len(d)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d[i] - x - e2[i - 1] / pivot
        below += pivot < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval."""
    n = len(d)
    reach = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = (d - reach).min(), (d + reach).max()
    tiny = np.finfo(float).tiny / np.finfo(float).eps + np.finfo(float).eps ** 2 * max(abs(low), abs(high))
    nth = n - 1 - np.arange(k)  # rank from below
    lo, hi = np.full(k, low - tiny), np.full(k, high + tiny)
    while True:
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            return mid
        below = sturm_count(d, e * e, mid, tiny) > nth
        hi, lo = np.where(below, mid, hi), np.where(below, lo, mid)


def _solve_shifted(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - x) y = b for tridiagonal T, by elimination with row exchanges."""
    n = len(d)
    main, up, up2, rhs = d - x, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(main[i]):  # exchange rows i and i + 1
            factor = main[i] / low
            main[i], nxt = low, main[i + 1]
            main[i + 1] = up[i] - factor * nxt
            up[i], up2[i] = nxt, up[i + 1]
            up[i + 1] = -factor * up2[i]
            rhs[i], rhs[i + 1] = rhs[i + 1], rhs[i] - factor * rhs[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            factor = low / main[i]
            main[i + 1] -= factor * up[i]
            rhs[i + 1] -= factor * rhs[i]
    main[-1] = main[-1] if abs(main[-1]) > tiny else tiny
    y = np.zeros(n)
    for i in range(n - 1, -1, -1):
        y[i] = rhs[i] - (up[i] * y[i + 1] if i + 1 < n else 0) - (up2[i] * y[i + 2] if i + 2 < n else 0)
        y[i] /= main[i]
    return y


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values``, by inverse iteration.
    Vectors of values closer than 1/1000 of the matrix's size are kept orthogonal."""
    rng = np.random.default_rng(13)
    norm = np.abs(d).max() + 2 * (np.abs(e).max() if len(e) else 0.0)
    eps = np.finfo(float).eps
    tiny = max(eps * norm, np.finfo(float).tiny)
    out = np.zeros((len(d), len(values)))
    first, shift = 0, 0.0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j  # a new cluster
        # equal values are solved a little apart, or they would give one direction
        shift = value if j == first else min(value, shift - 2 * tiny)
        y = rng.standard_normal(len(d))
        for _ in range(rounds):
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
            y = _solve_shifted(d, e, shift, y, tiny)
            y /= np.abs(y).max()
        for _ in range(2):
            y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of symmetric ``v``:
    at most k, those above the rounding of the matrix."""
    v = (v + v.T) / 2
    size = np.abs(v).max(initial=0.0)
    if size == 0:
        return np.empty(0), np.empty((len(v), 0))
    d, e, q = tridiagonal(v / size)
    values = leading_values(d, e, min(k, len(v)))
    values = values[values > len(v) * 8 * np.finfo(float).eps * values.max()]
    vectors = q @ tridiagonal_vectors(d, e, values)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * size, vectors


# ---- the operator ------------------------------------------------------------

def scaled(x: np.ndarray) -> np.ndarray:
    """Entries c as whole numbers floor(64 c) + 1,000,000: int64 where they and
    their sums fit, Python integers else."""
    z = np.floor(SCALE * x)
    if z.size and np.abs(z).max() >= 2.0 ** 40:
        return np.array([[int(c) + OFFSET for c in row] for row in z], dtype=object).reshape(z.shape)
    return z.astype(np.int64) + OFFSET


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of rows with a vector of finite entries,
    padded with zeros to the longest."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = plain_names(df, "vec_id", "embedding").filter(F.col("embedding").isNotNull() & fine).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 for each row, exact; None beyond 64 bits."""
    if x.dtype == np.int64:
        # in doubles first: a safe bound of every sum of squares
        far = np.abs(x.astype(float) * n - np.array([float(s) for s in sums])).max(initial=0.0)
        if x.size and float(n) * np.abs(x).max() < 2.0 ** 62 and far * far * x.shape[1] < 2.0 ** 62:
            y = x * n - np.array([int(s) for s in sums], dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
    whole = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return [w if w < 1 << 63 else None for w in whole]


@dataclasses.dataclass
class Whitening:
    """A fitted whitening: number and sums of the fit list, components as columns."""

    n: int
    sums: list
    means: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        if x.dtype == object:
            y = np.array([[float((self.n * int(c) - int(s)) / self.n) for c, s in zip(r, self.sums)] for r in x]).reshape(x.shape)
        else:
            y = x - self.means
        return y @ (self.components / np.sqrt(self.values))


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """Whitening of ``rows`` (vec array<double>); None without rows."""
    m = moments(rows, "vec", scaled)
    if m is None:
        return None
    v = m.scatter / m.n
    values, vectors = leading_components(v, components)
    trace = v.trace()
    return Whitening(m.n, [int(s) for s in m.sums], m.means, values, vectors, values / trace if trace else values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    m = moments(rows, "vec", lambda x: model.project(scaled(x)))
    return float(np.abs(m.scatter / m.n - np.eye(len(model.values))).max(initial=0.0))


def whiten(df: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, n, deviation, whitened array<double>, explained array<double> and
    identity_error for every usable row of ``df`` (vec_id, embedding array)."""
    rows = usable(df)
    schema = (f"vec_id {df.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, "
              "explained array<double>, identity_error double")
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)

    def run(batches):
        for b in batches:
            x = scaled(matrix(b.column("vec")))
            k = b.num_rows
            flat = model.project(x).ravel() if k else np.empty(0)
            width = len(model.values)
            ends = pa.array(np.arange(k + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(np.full(k, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(flat)),
                 pa.ListArray.from_arrays(ends, pa.array(np.tile(model.explained, k))),
                 pa.array(np.full(k, error))],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component (from 1)."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return whitened.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
