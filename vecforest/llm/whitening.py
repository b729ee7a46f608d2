"""Whitening components of vectors by shifted CholeskyQR.

The centred rows are taken as one tall matrix. Each round is one pass: tasks centre
their rows, solve the triangular systems of the rounds before, and sum up the Gram
matrix of what results; only d (d + 1) / 2 sums of each task are shuffled. The driver
holds d x d matrices: it factors the Gram matrix by Cholesky, with a shift of the
size of the rounding error where the matrix is not safely positive, and the triangular
factors multiply up to R. Rounds end when the rows are orthonormal. The singular
vectors of R are the components, and its singular values give their variances.

Components are found so without forming the covariance of the rows, whose condition
is the square of theirs.

Defined results: vectors that are null, or hold null or non-finite components, or are
of another length than most, and rows with a null id take no part; zero vectors and
repeated rows do. The largest entry of a component is positive. Of equal variances any
orthonormal components are right. A component without variance cannot be scaled: its
`whitened` is null, and it does not count in `identity_error`. With fewer dimensions
than components there are as many as dimensions. An empty table gives an empty result.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforest.llm.vectors import Whole, matrix, moments, whole_vectors

SCALE, OFFSET, COMPONENTS, ROUNDS, STEP = 1024, 100_000, 8, 12, 4096
UNIT = np.finfo(np.float64).eps / 2


def gram(rows: DataFrame, width: int, prepare) -> np.ndarray:
    """The Gram matrix of prepared rows: prepare(x) gives a block of doubles. A task sends its upper triangle once."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch)
            for s in range(0, len(x), STEP):
                y = prepare(x[s : s + STEP])
                total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["pos", "value"])

    out = np.zeros(len(upper[0]))
    for r in rows.select("x").mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():  # d (d + 1) / 2 rows
        out[r.pos] = r.value
    full = np.zeros((width, width))
    full[upper] = out
    return full + np.triu(full, 1).T


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n, exact but for the last rounding: n * x - total is a whole number."""
    return (n * x.astype(np.int64) - total) / n


def solved(x: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, one triangular solve after another."""
    y = x.T
    for r in factors:
        y = np.linalg.solve(r.T, y)
    return y.T


def triangular_factor(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R with R'R equal to the Gram matrix of the centred rows, composed from rounds of shifted CholeskyQR."""
    width, factors, r = len(total), [], np.eye(len(total))
    for _ in range(ROUNDS):
        g = gram(rows, width, lambda x: solved(centred(x, n, total), factors))  # noqa: B023
        value, vector = np.linalg.eigh(g)
        close = np.abs(value - 1) <= 1e-12 * width
        if not value[-1] or np.all(close | (value <= 1e-8)) and factors:  # orthonormal, but for directions without any variance
            break
        safe = 11 * (n * width + width * (width + 1)) * UNIT * value[-1]
        shift = 0.0 if value[0] > 100 * safe else safe
        factor = np.linalg.cholesky(g + shift * np.eye(width)).T
        factors.append(factor)
        r = factor @ r
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T  # what the last pass found left of an orthonormal matrix
    return root @ r


def components_of(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit components as columns, from the singular values and vectors of R."""
    _, s, vt = np.linalg.svd(r)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    return s * s / n, (vt * sign[:, None]).T


def whitening(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row and component: vec_id, component, n, deviation (exact, decimal), whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    whole: Whole = whole_vectors(df, scale, offset, id_col, vector_col)
    if not whole.n:
        return df.sparkSession.createDataFrame([], schema)
    n, rows = whole.n, whole.rows
    if n * whole.largest >= 1 << 62:
        raise ValueError("the sum of a component does not fit in a long")
    total, _ = moments(rows, whole.width)
    variance, vectors = components_of(triangular_factor(rows, n, total), n)
    k = min(components, whole.width)
    scaled = np.flatnonzero(variance[:k] > variance[0] * whole.width * UNIT * 8) if variance[0] > 0 else np.zeros(0, int)
    project = vectors[:, scaled] / np.sqrt(variance[scaled])
    explained = (variance[:k] / variance.sum() if variance[0] > 0 else np.zeros(k)).tolist()
    error = float(np.abs(gram(rows, len(scaled), lambda x: centred(x, n, total) @ project) / n - np.eye(len(scaled))).max()) if len(scaled) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = decimal.Context(prec=38)
        for batch in batches:
            for s in range(0, len(batch), STEP):
                part = batch.slice(s, STEP)
                x = matrix(part).astype(np.int64)
                off = n * x - total
                if float(np.abs(off).max()) ** 2 * x.shape[1] < 1 << 62:
                    deviation = (off * off).sum(1).tolist()
                else:
                    deviation = [sum(v * v for v in row) for row in off.tolist()]
                white = np.full((len(part), k), np.nan)
                white[:, scaled] = (off / n) @ project
                again = pa.array(np.repeat(np.arange(len(part)), k))
                flat = white.ravel()
                columns = [part["vec_id"].take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(flat), n)), pa.array([exact.create_decimal(v) for v in deviation], pa.decimal128(38, 0)).take(again)]
                columns += [pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(flat), error))]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
