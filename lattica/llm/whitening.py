"""Embedding whitening: streaming covariance in partition iterators, merged in parallel, and a symmetric QR eigen-solve.

Entries become whole numbers, and the covariance is that of the distinct vectors (the fit list). Each task reads its
part of the list once and updates count, mean and squared deviations by one rank-one step a vector (Welford); the
parts' summaries are merged by the parallel form of that update, FAN_IN at a time in tasks, the last few on the driver.
A summary has the size of one covariance matrix whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import integer_vectors, largest, lengths, matrix, shared_table

SCALE = 256
COMPONENTS = 4
#: Summaries that one task, or the driver, merges.
FAN_IN = 16
SUMMARY = "part long, n long, mean array<double>, m2 array<double>, sums array<decimal(38,0)>"
_ARROW_SUMMARY = pa.schema([
    ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64())),
    ("sums", pa.list_(pa.decimal128(38, 0))),
])


@dataclass
class Moments:
    """Count, mean, summed outer products of the deviations, and exact sums of whole numbers."""

    n: int
    mean: np.ndarray
    m2: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)), [0] * width)

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update a row: the deviation from the mean before it times that from the mean after it."""
        step = np.empty_like(self.m2)
        for row in rows:
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, before * ((self.n - 1) / self.n), out=step)
            self.m2 += step

    def add_sums(self, rows: np.ndarray) -> None:
        if len(rows):
            exact = rows if largest(rows) * len(rows) < 2**62 else rows.astype(object)
            self.sums = [a + int(b) for a, b in zip(self.sums, exact.sum(axis=0), strict=True)]

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        m2 = self.m2 + other.m2 + np.multiply.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, mean, m2, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)


def _merged(rows: pd.DataFrame, width: int) -> Moments:
    out = Moments.empty(width)
    for row in rows.sort_values("part").itertuples():
        m2 = np.asarray(row.m2, dtype=np.float64).reshape(width, width)
        out = out.merge(Moments(int(row.n), np.asarray(row.mean, dtype=np.float64), m2, [int(s) for s in row.sums]))
    return out


def moments(vectors: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """The moments of the vectors ``x``, all of ``width`` whole numbers, or of what ``change`` makes of each matrix of them.

    ``change`` gives rows of any width; then there are no exact sums.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), width)
                rows = change(x) if change else x.astype(np.float64)
                held = held or Moments.empty(rows.shape[1])
                held.add(rows)
                if not change:
                    held.add_sums(x)
        if held:
            sums = [Decimal(s) for s in held.sums]
            columns = [[TaskContext.get().partitionId()], [held.n], [held.mean], [held.m2.ravel()], [sums]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW_SUMMARY, strict=True)], schema=_ARROW_SUMMARY
            )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        of = _merged(rows, len(rows["mean"].iloc[0]))
        part, sums = rows["part"].min() // FAN_IN, [Decimal(s) for s in of.sums]
        return pd.DataFrame({"part": [part], "n": [of.n], "mean": [of.mean], "m2": [of.m2.ravel()], "sums": [sums]})

    parts = shared_table(vectors.select("x").mapInArrow(summarise, SUMMARY), "whitening-parts")
    while parts.count() > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(merge, SUMMARY)
        parts = shared_table(parts, "whitening-parts")
    last = parts.toPandas()  # FAN_IN summaries at most
    return _merged(last, len(last["mean"].iloc[0])) if len(last) else Moments.empty(width)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the rows q with q.T @ T @ q = a, by Householder reflections."""
    t, n = a.astype(np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        length = math.sqrt(float(v @ v))
        if not length:
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(float(v @ v))
        t[k + 1 :] -= 2 * np.outer(v, v @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows: implicit QR steps with Wilkinson's shift on the tridiagonal form.

    The largest entry of each eigenvector is positive.
    """
    d, e, q = tridiagonal(a)
    eps, high = np.finfo(np.float64).eps, len(d) - 1
    while high > 0:
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if not e[high - 1]:
            high -= 1
            continue
        low = high - 1
        while low and e[low - 1]:
            low -= 1
        half, off = (d[high - 1] - d[high]) / 2, e[high - 1]
        shift = d[high] - off * off / (half + math.copysign(math.hypot(half, off), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge down by rotations of rows k and k + 1
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    vectors = q[order]
    signs = np.sign(vectors[np.arange(len(d)), np.abs(vectors).argmax(axis=1)]) if len(d) else np.ones(0)
    return d[order], vectors * signs[:, None]


@dataclass
class Whitening:
    """What a fit list gives: count, exact sums, and per component its eigenvalue, direction and explained share."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of a matrix of longs, exact; of Python ints where longs could overflow."""
        if self.n * largest(x) + max(map(abs, self.sums), default=0) < 2**62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN on components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (centred.astype(np.float64) / self.n) @ self.directions.T * scale


def fit(fit_list: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a list of distinct vectors ``x`` of ``width`` whole numbers."""
    of = moments(fit_list, width)
    values, vectors = symmetric_qr(of.covariance())
    values = np.where(values > width * np.finfo(np.float64).eps * max(1e-300, values[0]), values, 0.0)
    total = float(np.trace(of.covariance()))
    explained = values / total if total > 0 else np.full(len(values), np.nan)
    return Whitening(of.n, of.sums, values[:components], vectors[:components], explained[:components])


def identity_error(fit_list: DataFrame, width: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    held = model.values > 0
    of = moments(fit_list, width, lambda x: model.project(model.centred(x))[:, held])
    return float(np.abs(of.covariance() - np.eye(int(held.sum()))).max()) if held.any() else 0.0


def squared_lengths(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where they exceed a long."""
    rough = (centred.astype(np.float64) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(rough)
    whole = (centred * centred).sum(axis=1)  # longs wrap around, which doesn't matter where the sum fits
    for k in np.flatnonzero(rough < 9.3e18):
        total = int(whole[k]) if rough[k] < 9.2e18 else sum(int(v) ** 2 for v in centred[k])
        out[k] = total if total < 2**63 else None
    return out


RESULT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """One row per vector and component up to ``components``: the columns of RESULT.

    Vectors that are null or hold null or non-finite entries are left out. Entries become floor(``scale`` * entry).
    Vectors of another length are a space of their own, with their own fit list, and the identity error is the largest
    of all; a vector of fewer entries than ``components`` has as many components as entries, an empty one none. Ids
    may be null or repeat: each row gets its results. Repeated vectors count once in the fit. A component without
    variance has null whitened and explained 0 (null if no component has any). A deviation beyond a long is null.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    rows = shared_table(integer_vectors(table, scale, vector_col, vec_id=id_col), "whitening-vectors")
    models = {}
    worst = 0.0
    for width in lengths(rows):
        if width:
            fit_list = shared_table(rows.filter(F.size("x") == width).select("x").distinct(), "whitening-fit")
            models[width] = fit(fit_list, width, components)
            worst = max(worst, identity_error(fit_list, width, models[width]))

    def whiten(batches: Iterator[pa.RecordBatch], width: int, model: Whitening) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        shares = [None if np.isnan(v) else v for v in model.explained]
        for batch in batches:
            rows = batch.num_rows
            centred = model.centred(matrix(batch.column("x"), width))
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = {
                "vec_id": batch.column("vec_id").take(each),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, model.n)),
                "deviation": pa.array(squared_lengths(centred), pa.int64()).take(each),
                "whitened": pa.array(model.project(centred).ravel(), from_pandas=True),
                "explained": pa.array(shares, pa.float64()).take(pa.array(np.tile(np.arange(k), rows))),
                "identity_error": pa.array(np.full(rows * k, worst)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = RESULT.format(id=id_type)
    out = spark.createDataFrame([], schema)
    for width, model in models.items():
        part = rows.filter(F.size("x") == width)
        out = out.unionByName(part.mapInArrow(lambda b, w=width, m=model: whiten(b, w, m), schema))
    return out
