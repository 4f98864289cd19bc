"""Embedding whitening by shifted CholeskyQR.

The centred rows A are never factorised as a whole. A distributed pass sums the Gram matrix of A inv(R) (each row by a
triangular solve with the R found so far), the driver factorises that small matrix by Cholesky, with a shift in the first pass
and wherever it is not positive, and multiplies the factor onto R. After a few passes the rows are orthonormal and A = Q R; the
singular values and right vectors of R are those of A, and give the components of the covariance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import in_batches

#: Vector components become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components beyond have no such number that a double holds exactly.
LARGEST = 2.0**40
#: Gram passes at most, the first one shifted; three do for a matrix of full rank.
PASSES = 4
#: Passes end when the Gram matrix is so close to the identity; what is left is taken in exactly.
ORTHONORMAL = 1e-10
#: Dimensions at most: a Gram matrix of so many is 128 MB on the driver and in each task.
DIMENSIONS = 4096
#: Components whose variance is below this share of the largest one are those of a matrix without full rank.
RANK = 1e-12


@dataclass
class Whitening:
    """n, the sums per dimension, and the components as columns with their variances."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the difference is exact before the division."""
        return (x * self.n - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - sums) ** 2."""
        d = x * self.n - self.sums
        if float((d.astype(float) ** 2).sum(1).max(initial=0)) < 2.0**62:
            return (d * d).sum(1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in d]


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is there and holds finite numbers only."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) * SCALE).astype(np.int64) + SHIFT


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """X of X r = a, r upper triangular: a column after the other, all rows at once."""
    x = np.empty_like(a)
    for j in range(r.shape[0]):
        x[:, j] = (a[:, j] - x[:, :j] @ r[:j, j]) / r[j, j]
    return x


def summed(rows: DataFrame, step, width: int) -> np.ndarray:
    """Sum of step(x) (width x width) over all rows' numbers: partial sums in the tasks, added up by entry in Spark."""

    def partial(batches):
        total = np.zeros((width, width))
        seen = False
        for batch in batches:
            if batch.num_rows:
                total += step(_numbers(batch))
                seen = True
        if seen:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    parts = in_batches(rows.select("v"), partial, "i int, j int, s double")
    out = np.zeros((width, width))
    # At most width * (width + 1) / 2 rows.
    found = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    out[i, j] = out[j, i] = found.column("s").to_numpy()
    return out


def column_sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Rows, and exact sums of their numbers per dimension."""

    def partial(batches):
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                total += _numbers(batch).sum(0)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["i", "s"])

    parts = in_batches(rows.select("v"), partial, "i int, s long")
    found = dict(parts.groupBy("i").agg(F.sum("s").alias("s")).collect())
    return found[width], np.array([found[i] for i in range(width)], np.int64)


def triangle(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper factor of a Gram matrix; a shift of rounding size makes any one positive."""
    width = len(gram)
    shift = 11 * (rows * width + width * (width + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shifted * shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift, shifted = (shift * 100 if shifted else max(shift, 1e-300)), True


def fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    """Components of the covariance of all rows (divisor n), largest variance first; None where nothing varies."""
    n, sums = column_sums(rows, width)
    context = rows.sparkSession.sparkContext
    centre = Whitening(n, sums, np.eye(width), np.ones(width), 1.0)
    r = np.eye(width)
    for k in range(PASSES):
        sent = context.broadcast((centre, r))

        def gram_of(x, sent=sent, k=k):
            centre, r = sent.value
            a = centre.centred(x)
            q = solve_rows(a, r) if k else a
            return q.T @ q

        gram = summed(rows, gram_of, width)
        if k == 0:
            trace = float(np.trace(gram)) / n
            if trace <= 0:
                return None
        elif np.abs(gram - np.eye(width)).max() < ORTHONORMAL:
            break
        if k < PASSES - 1:
            # The last Gram matrix always belongs to the last R.
            r = triangle(gram, n, k == 0) @ r
    # A'A = R' G R: what is left between G and the identity (directions without variance) goes onto R.
    e, u = np.linalg.eigh(gram)
    _, s, w = np.linalg.svd(np.sqrt(np.maximum(e, 0))[:, None] * (u.T @ r))
    variances = s**2 / n
    keep = int((variances > RANK * variances[0]).sum())
    keep = min(keep, components)
    return Whitening(n, sums, w[:keep].T.copy(), variances[:keep], trace)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row and component: id, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Vectors that are NULL or hold NULL or non-finite numbers take no part; nor do those of another length than the most
    frequent one (of those, the smallest), empty ones, and those with a number of 2 ** 40 or more, which has no exact whole
    number here. Components without variance are not returned: constant vectors, a single one and an empty table give no rows. `deviation` is
    NULL where it does not fit a long. NULL ids are carried; equal rows give equal rows; other columns are not read. Equal
    variances leave the choice of their components open.
    """
    spark = vectors.sparkSession
    fields = [T.StructField(id_col, vectors.schema[id_col].dataType), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields]
    schema = T.StructType(fields)
    rows = valid_vectors(vectors, id_col, vec_col).where(F.size("v") > 0)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width = sizes[0]["d"]
    if width > DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions; {DIMENSIONS} at most")
    rows = rows.where(F.size("v") == width)
    model = fit(rows, width, components)
    if model is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)
    k = len(model.variances)

    def moments(x):
        # Products and, in the last row and column, sums.
        z = np.column_stack([sent.value.whitened(x), np.ones(len(x))])
        return z.T @ z

    total = summed(rows, moments, k + 1)
    mean = total[:k, k] / model.n
    error = float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches):
        model = sent.value
        for batch in batches:
            x = _numbers(batch) if batch.num_rows else np.zeros((0, width), np.int64)
            m = len(x)
            deviation = [d if d < 1 << 63 else None for d in model.deviations(x)]
            of = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(deviation, pa.int64()).take(of), pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.variances / model.trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_batches(rows, project, schema)
