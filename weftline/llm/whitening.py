"""Embedding whitening by LOBPCG: leading eigenvectors of the covariance from distributed block products.

Vectors become integers, x = floor(scale * c) + shift, and each distinct x counts once. The covariance is never formed: a step
multiplies it with a block of directions, S -> (1/n) sum y (y . S) over the centred rows y = (n x - sum) / n, on Spark. The
directions are the iterate X, its residuals R = V X - X theta, and the last step's direction P, orthonormal; Rayleigh-Ritz
on them gives the next X. It ends when the residual of every wanted component, taken from a fresh product, is at most ``tol``
times the largest eigenvalue (or rounding keeps it from falling further, below a thousand times that). Then every row is centred, projected and divided by the square root of its eigenvalue,
and a last pass measures how far the whitened fit list is from the identity.

How it scales: a step is one scan of the fit list, which is written once; a task sends one block (dimensions by three times
the block's width), these are summed in ``FAN`` tasks and then on the driver, whatever the number of rows. Exact copies meet in
partial sums before they are exchanged. The driver holds blocks only.

Defined results: a null vector, one with a null or non-finite entry, and an empty one are dropped; vectors of several lengths raise,
and so do entries too large for exact sums; repeated rows each get their rows; equal eigenvalues have any basis of their space, the same for all rows;
directions without variance (at most 1e-12 of the trace) can't be whitened and give no component, so an empty table, a single or an only distinct vector give no rows; other
columns are not read, so their names cannot clash; an id column with the name of a result column raises. A component's largest
entry is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.llm.common import check_id, written

FAN = 32
RESULTS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # exact, of the fit list
    vectors: np.ndarray  # dimensions by components
    values: np.ndarray
    trace: float
    residuals: np.ndarray  # norm of V v - e v of each component
    steps: int


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """id and x, of the vectors that are whole: no null, no infinite or missing number."""
    c = F.col(vector_col)
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(v.cast("double") * scale) + shift).alias("x"))


def _matrix(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, work, length: int) -> np.ndarray:
    """The sum of ``work(x)``, a vector of ``length`` numbers, over all batches x of the rows."""
    schema = "v array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    one = lambda v: pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64()))], schema=arrow)

    def part(batches):
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += work(_matrix(batch.column(0)))
        yield one(total)

    def join(batches):
        total = np.zeros(length)
        for batch in batches:
            total += _matrix(batch.column(0)).sum(axis=0) if batch.num_rows else 0
        yield one(total)

    parts = rows.mapInArrow(part, schema)
    found = parts.repartition(FAN).mapInArrow(join, schema).collect()
    return np.sum([r.v for r in found], axis=0) if found else np.zeros(length)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x.astype(np.int64) - sums) / n


def exact_sums(fit: DataFrame, d: int) -> np.ndarray:
    """Sums by dimension as whole numbers."""
    return np.array([int(v) for v in fit.agg(F.array(*(F.sum(F.get("x", F.lit(j)).cast("decimal(38,0)")) for j in range(d)))).first()[0]], object)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part outside ``against`` (orthonormal); dependent directions drop out."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    return block


def fit_components(fit: DataFrame, n: int, sums: np.ndarray, most: int = 16, guard: int = 8, tol: float = 1e-13, steps: int = 500, seed: int = 0) -> Whitening:
    """The leading eigenvectors of the covariance of ``fit`` (x, a written table of ``n`` distinct rows)."""
    d = len(sums)
    own = sums.astype(np.int64)
    trace = summed(fit.select("x"), lambda x: np.array([(_centred(x, n, own) ** 2).sum()]), 1)[0] / n

    def product(block: np.ndarray) -> np.ndarray:
        w = block.shape[1]

        def work(x):
            y = _centred(x, n, own)
            return (y.T @ (y @ block)).ravel()

        return summed(fit.select("x"), work, d * w).reshape(d, w) / n

    k, m = min(most, d), min(d, most + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    last = np.zeros((d, 0))
    residual = np.zeros((d, 0))
    best, since = np.inf, 0
    for step in range(1, steps + 1):
        basis = x
        for more in (residual, last):
            basis = np.hstack([basis, _orthonormal(more, basis)]) if more.shape[1] and basis.shape[1] < d else basis
        image = product(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:m], mix[:, ::-1][:, :m]
        new, image = basis @ mix, image @ mix
        residual = image - new * values
        norms = np.linalg.norm(residual, axis=0)
        # the part of the step that does not come from the old iterate
        last = basis[:, x.shape[1] :] @ mix[x.shape[1] :]
        x = np.linalg.qr(new)[0]
        x = x * np.where((x * new).sum(axis=0) < 0, -1.0, 1.0)
        worst = norms[:k].max()
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst <= tol * values[0] or since >= 10 and worst <= 1000 * tol * values[0]:
            break
    else:
        raise ArithmeticError(f"residuals of {norms[:k].max()} after {steps} steps")
    keep = values[:k] > 1e-12 * trace
    signs = np.sign(x[np.abs(x).argmax(axis=0), range(m)])
    return Whitening(n, sums, (x * signs)[:, :k][:, keep], values[:k][keep], trace, norms[:k][keep], step)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    d = n * x.astype(np.int64) - sums.astype(np.int64)
    if len(d) == 0 or int(np.abs(d).max()) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, own = len(model.values), model.sums.astype(np.int64)
    project = lambda x: _centred(x, model.n, own) @ model.vectors / np.sqrt(model.values)
    mean = summed(fit.select("x"), lambda x: project(x).sum(axis=0), k) / model.n

    def work(x):
        z = project(x) - mean
        return (z.T @ z).ravel()

    cov = summed(fit.select("x"), work, k * k).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, scale: float = 64.0, shift: int = 1_000_000, **options) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error, residual: a row for each whole vector and component."""
    check_id(id_col, RESULTS + ", residual double")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows = whole_numbers(vectors, id_col, vector_col, scale, shift)
    fit = written(rows.select("x").distinct())
    n, short, long, top = fit.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if n and short != long:
        raise ValueError(f"vectors have {short} to {long} entries")
    if n and top * n >= 2**62:
        raise ValueError("entries are too large for exact sums; use a smaller scale")
    model = fit_components(fit, n, exact_sums(fit, long), most, **options) if n > 1 else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, k, own = identity_error(fit, model), len(model.values), model.sums.astype(np.int64)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            z = _centred(x, n, own) @ model.vectors / np.sqrt(model.values)
            many, each = len(x), np.repeat(np.arange(len(x)), k)
            repeat = lambda v: np.tile(v, many)
            data = [batch.column(0).take(pa.array(each)), repeat(np.arange(1, k + 1, dtype=np.int32)), np.full(many * k, n), np.repeat(np.array(deviations(x, n, model.sums), np.int64), k), z.ravel(), repeat(model.values / model.trace), np.full(many * k, error), repeat(model.residuals / model.values[0])]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, np.ndarray) else v for v, f in zip(data, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
