"""Embedding whitening by a compensated covariance.

Entries become integers, whose sums are exact. Centred vectors and their outer products are kept as unevaluated sums of two
doubles (error-free sums and products), tasks tell the high and low parts of a row of the matrix, and those are merged in
the same arithmetic. The matrix is as large as the square of the vectors' length and goes to the driver, where LAPACK's
tridiagonal divide and conquer (numpy's eigh) takes it apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import tidy

#: Components told.
COMPONENTS = 8
#: Tasks whose matrices are merged, at most.
TASKS = 4096
#: Entries of a vector, once multiplied, that are taken; a vector with others counts as damaged.
LARGEST = 2.0**51
#: Products held at once.
_HELD = 1 << 18
_SPLIT = float(2**27 + 1)

Double = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Double:
    """a + b and the error of that sum, which is exact."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _parted(a: np.ndarray) -> Double:
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Double:
    """a * b and the error of that product, which is exact."""
    p = a * b
    (ah, al), (bh, bl) = _parted(a), _parted(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(one: Double, other: Double) -> Double:
    """The sum of two double-doubles."""
    s, e = two_sum(one[0], other[0])
    t, f = two_sum(one[1], other[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _summed(terms: Double) -> Double:
    """The sum over the first axis, halved again and again."""
    high, low = terms
    while len(high) > 1:
        half = len(high) // 2
        odd = high[2 * half :], low[2 * half :]
        high, low = added((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = np.concatenate((high, odd[0])), np.concatenate((low, odd[1]))
    return high[0], low[0]


@dataclass
class Whitening:
    """n vectors with sums per dimension; their mean as a double-double; components as columns, by falling eigenvalue;
    the covariance's trace; the greatest entry of the whitened covariance less the identity."""

    n: int
    sums: list[int]
    mean: Double
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float | None = None

    def centred(self, x: np.ndarray) -> Double:
        """Vectors less the mean."""
        high, low = two_sum(x, -self.mean[0])
        return two_sum(high, low - self.mean[1])

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding leaves of none."""
        return self.values > 4 * np.finfo(float).eps * len(self.sums) * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components over the roots of their eigenvalues; NaN for those without variance."""
        high, low = self.centred(x)
        root = np.where(self.usable(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (high @ self.components + low @ self.components) / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n*x-S)^2, exact; null where that is beyond a long."""
        most = max([abs(s) for s in self.sums] + [int(np.abs(x).max(initial=0)) * self.n])
        whole = x.astype(np.int64)
        if len(self.sums) * (2 * most) ** 2 < 2**63:
            return ((self.n * whole - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in whole.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _vectors(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of whole vectors and these as integers (held as doubles), by length or of one length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(lengths.astype(float), nan=-1).astype(np.int64)
    for k in [length] if length is not None else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == k)
        entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)  # null entries become NaN
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(1024 * entries) + 100_000
            whole = (np.abs(x) < LARGEST).all(axis=1)
        yield rows[whole], x[whole]


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many whole vectors of the commonest length there are (of equals the greater one), and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if len(x):
                    k = x.shape[1]
                    n[k] = n.get(k, 0) + len(x)
                    parts = [x[at : at + 2048].astype(np.int64).sum(axis=0).tolist() for at in range(0, len(x), 2048)]
                    sums[k] = [sum(v) for v in zip(sums.get(k, [0] * k), *parts)]
        for k, own in sums.items():
            columns = [pa.array([k] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n[k]] * k, pa.int64()), pa.array([str(v) for v in own])]
            yield pa.RecordBatch.from_arrays(columns, ["length", "dim", "n", "total"])

    each = vectors.mapInArrow(tidy(run), "length int, dim int, n long, total string")
    exact = each.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    best = exact.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return 0, []
    rows = exact.where(F.col("length") == best["length"]).orderBy("dim").collect()  # one a dimension
    return best["n"], [int(r["total"]) for r in rows]


def _covariance(vectors: DataFrame, model: Whitening) -> np.ndarray:
    """The covariance, rounded from double-doubles at the end."""
    d = len(model.sums)
    rows, columns = np.triu_indices(d)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    together = max(1, _HELD // rows.size)
    schema = "row int, high array<double>, low array<double>"

    def told(numbers: list[int], parts: list[Double]) -> pa.RecordBatch:
        lists = [pa.array([p[k] for p in parts], pa.list_(pa.float64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *lists], ["row", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows.size), np.zeros(rows.size)
        for batch in batches:
            for _, x in _vectors(batch.column(0), d):
                high, low = model.centred(x)
                for at in range(0, len(x), together):
                    h, r = high[at : at + together], low[at : at + together]
                    left, right = h[:, rows], h[:, columns]
                    p, e = two_product(left, right)
                    total = added(total, _summed(two_sum(p, e + (left * r[:, columns] + r[:, rows] * right))))
        ends = [*starts[1:], rows.size]
        yield told(list(range(d)), [(total[0][a:b], total[1][a:b]) for a, b in zip(starts, ends)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, *part in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                if k == at:
                    total = added(total, tuple(part))
                    continue
                if at is not None:
                    yield told([at], [total])
                at, total = int(k), tuple(part)
        if at is not None:
            yield told([at], [total])

    each = vectors.coalesce(TASKS).mapInArrow(tidy(run), schema).repartition(F.col("row")).sortWithinPartitions("row")
    out = np.zeros((d, d))
    for r in each.mapInArrow(tidy(merged), schema).collect():  # one row a dimension
        high, low = np.array(r["high"]), np.array(r["low"])
        quotient = high / model.n
        p, e = two_product(quotient, np.full_like(quotient, float(model.n)))
        out[r["row"], r["row"] :] = quotient + ((high - p) - e + low) / model.n
    return out + np.triu(out, 1).T


def _error(vectors: DataFrame, model: Whitening) -> float | None:
    """The greatest entry of the whitened vectors' covariance less the identity, over components with variance."""
    d, some = len(model.sums), model.usable()
    k = int(some.sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in _vectors(batch.column(0), d):
                w = model.whitened(x)[:, some]
                products += w.T @ w
                sums += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k, dtype=np.int32)), pa.array(np.r_[products.ravel(), sums])], ["at", "total"])

    made = vectors.coalesce(TASKS).mapInArrow(tidy(run), "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros(k * k + k)
    for r in made.collect():  # as many as there are entries of the small matrix
        total[r["at"]] = r["total"]
    mean = total[k * k :] / model.n
    return float(np.abs(total[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a column of vectors by all of them that are whole; None if none is.

    Whole: not null, without null or non-finite entries or any of 2^51 / 1024 and more, and of the commonest length.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("vector"))
    n, sums = _sums(vectors)
    if not n:
        return None
    mean = [Fraction(s, n) for s in sums]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high.tolist())])
    model = Whitening(n, sums, (high, low), np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    matrix = _covariance(vectors, model)
    values, columns = np.linalg.eigh(matrix)
    model.values, model.components = values[::-1][:components].copy(), np.ascontiguousarray(columns[:, ::-1][:, :components])
    model.trace = float(np.trace(matrix))
    model.error = _error(vectors, model)
    return model


def transformed(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each whole vector (see fit()) and
    component, of which there are as many as dimensions at most.

    Repeated and null ids are rows as others. A component without variance has a null `whitened` and an `explained` of 0
    (null, if no component has any); identity_error is over the others, null if there are none. An empty table gives none.
    """
    kind = df.schema[id_].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k, d = len(model.values), len(model.sums)
    share = [float(max(v, 0.0) / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(1), d):
                each = lambda own, t: pa.array(own, t).take(pa.array(np.repeat(np.arange(len(x)), k)))
                turn = lambda own, t: pa.array(own, t).take(pa.array(np.tile(np.arange(k), len(x))))
                w = model.whitened(x).ravel()
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))), turn(range(1, k + 1), pa.int32()), pa.array([model.n] * w.size, pa.int64()),
                    each(model.deviations(x), pa.int64()), pa.array(w, mask=np.isnan(w)), turn(share, pa.float64()), pa.array([model.error] * w.size, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return df.select(F.col(id_).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(tidy(run), schema)
