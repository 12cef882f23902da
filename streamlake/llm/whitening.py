"""Whitening of embeddings: principal components found by FEAST contour integration.

Every usable vector is quantised to whole numbers ``x = floor(64 c) + 1000000``. The fit list holds each
distinct x vector once; its count ``n``, per-dimension sums ``S`` and centred covariance ``V`` (divisor
``n``) are Spark aggregates: the sums are exact, the covariance is summed per task from exactly centred
values ``(n x - S) / n`` and the partial matrices are added by a shuffle of ``d * d`` cells per task.
Only this ``d * d`` matrix reaches the driver, whatever the number of rows.

The eigenvectors of ``V`` for its ``COMPONENTS`` largest eigenvalues are found by FEAST: the spectral
projector onto an interval is the contour integral of the resolvent ``(z I - V)^-1`` around it,
approximated by Gauss-Legendre quadrature over shifted complex solves; applied to a block of vectors it
yields a basis of the wanted eigenspace, from which Rayleigh-Ritz extracts the components. Iteration
stops when every Ritz pair's residual is at rounding level. The interval's lower end is placed between
the wanted and the next eigenvalue by inertia counts (Sylvester: the negative pivots of an ``L D L^T``
factorisation of ``V - s I`` count the eigenvalues below ``s``); the same counts verify afterwards
that no eigenvalue of the interval was missed.

Defined cases: a row is dropped when its vector is null, empty, holds a null or non-finite entry, or an
entry whose ``64 c`` lies beyond +-2^62 (its x is no long), or when its length differs from the table's
dimension (the most common length of the usable rows, the larger on a tie). Repeated rows and rows of
one id each get their own output rows; a null ``vec_id`` stays null. Components whose eigenvalue is not
positive (at most ``1e-12`` of the trace, as with a single distinct vector) cannot be whitened and are
not returned; an empty table, or one of a single distinct vector, returns no rows. Other input columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamlake.llm.common import fetched, keep_table

# Fixed values of the contract.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16

QUADRATURE_NODES = 16  # Gauss-Legendre nodes on the upper half of the contour
MAX_ITERATIONS = 30
RESIDUAL = 1e-13  # of the largest eigenvalue's bound: a Ritz pair converged
TINY = 1e-12  # of the trace: an eigenvalue this small is taken for zero
SEED = 20240611


def quantised(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: the usable rows with their whole-number vectors, all of the table's dimension."""
    vector = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c)
                     & (F.abs(c.cast("double") * SCALE) < float(2 ** 62)))
    usable = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
              .where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
              .where(F.coalesce(sound, F.lit(False))))
    dimension = (usable.groupBy(F.size("embedding").alias("d")).count()
                 .orderBy(F.desc("count"), F.desc("d")).limit(1))
    fitting = usable.join(F.broadcast(dimension), F.size("embedding") == F.col("d"), "left_semi")
    return fitting.select("vec_id", F.transform(vector, lambda v: v + F.lit(OFFSET)).alias("x"))


def _gram(batches, d: int, n: int, sums: np.ndarray, basis: np.ndarray | None):
    """One partial matrix per task: the sum of ``y y^T`` over the task's rows, with ``y`` the exactly
    centred vector ``(n x - S) / n``, or its coordinates in ``basis`` when one is given; also ``sum y``."""
    width = d if basis is None else basis.shape[1]
    gram, total = np.zeros((width, width)), np.zeros(width)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy().reshape(-1, d)
        y = (x * n - sums) / n
        if basis is not None:
            y = y @ basis
        gram += y.T @ y
        total += y.sum(axis=0)
    cells = np.arange(width * width)
    yield pa.RecordBatch.from_pydict({
        "i": pa.array(np.concatenate([cells // width, np.full(width, -1)]), pa.int32()),
        "j": pa.array(np.concatenate([cells % width, np.arange(width)]), pa.int32()),
        "v": pa.array(np.concatenate([gram.ravel(), total]), pa.float64())})


def _summed(fit: DataFrame, d: int, n: int, sums: np.ndarray, basis=None) -> tuple[np.ndarray, np.ndarray]:
    cells = fit.mapInArrow(lambda b: _gram(b, d, n, sums, basis), "i int, j int, v double")
    table = fetched(cells.groupBy("i", "j").agg(F.sum("v").alias("v")))
    width = d if basis is None else basis.shape[1]
    gram, total = np.zeros((width, width)), np.zeros(width)
    square = table[table.i >= 0]
    gram[square.i.to_numpy(), square.j.to_numpy()] = square.v.to_numpy()
    line = table[table.i < 0]
    total[line.j.to_numpy()] = line.v.to_numpy()
    return gram, total


def moments(fit: DataFrame) -> tuple[int, int, np.ndarray]:
    """``d, n, S`` of the fit list, exact."""
    sums = fetched(fit.select(F.posexplode("x").alias("at", "value"))
                   .groupBy("at").agg(F.sum("value").alias("s"), F.count("*").alias("n")))
    if not len(sums):
        return 0, 0, np.zeros(0, np.int64)
    d = int(sums["at"].max()) + 1
    total = np.zeros(d, np.int64)
    total[sums["at"].to_numpy()] = sums["s"].to_numpy()
    return d, int(sums["n"].iloc[0]), total


def count_below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below ``shift``: the negative pivots of ``L D L^T`` of
    ``matrix - shift I`` (Sylvester's law of inertia). A zero pivot is nudged by rounding size."""
    a = matrix - shift * np.eye(len(matrix))
    scale = max(np.abs(matrix).max(), abs(shift), 1e-300)
    negative = 0
    for k in range(len(a)):
        pivot = a[k, k]
        if abs(pivot) < 1e-15 * scale:
            pivot = -1e-15 * scale
        negative += pivot < 0
        row = a[k, k + 1:] / pivot
        a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], row)
    return int(negative)


def _kth_largest(matrix: np.ndarray, k: int, low: float, high: float) -> float:
    """The ``k``-th largest eigenvalue, bracketed by bisection on inertia counts."""
    d = len(matrix)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if d - count_below(matrix, middle) >= k:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def feast(matrix: np.ndarray, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors
    (columns), by contour integration over an interval found and verified by inertia counts."""
    d = len(matrix)
    wanted = min(wanted, d)
    if wanted == 0:
        return np.zeros(0), np.zeros((d, 0))
    bound = float(np.abs(matrix).sum(axis=1).max())  # Gershgorin: no eigenvalue lies above
    top = bound * (1 + 1e-3) + 1e-300
    floor = -top
    last = _kth_largest(matrix, wanted, floor, top)
    following = _kth_largest(matrix, wanted + 1, floor, top) if wanted < d else floor
    lower = (last + following) / 2 if last > following else last - 1e-3 * (bound + 1e-300)
    inside = d - count_below(matrix, lower)  # eigenvalues in [lower, top]
    width = min(d, max(inside + 4, int(1.5 * inside)))
    centre, radius = (lower + top) / 2, (top - lower) / 2
    nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE_NODES)
    angles = np.pi * (1 + nodes) / 2
    block = np.random.default_rng(seed).standard_normal((d, width))
    identity = np.eye(d)
    for _ in range(MAX_ITERATIONS):
        projected = np.zeros((d, width))
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((centre + turn) * identity - matrix, block)
            projected += (weight / 2) * (turn * solved).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        within = (values >= lower) & (values <= top)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        block = vectors
        if within.sum() >= inside and residual[within].max(initial=0) <= RESIDUAL * max(bound, 1e-300):
            break
    if within.sum() != inside:
        raise ArithmeticError(f"contour found {within.sum()} eigenvalues, inertia counts {inside}")
    order = np.argsort(-values[within], kind="stable")[:wanted]
    values, vectors = values[within][order], vectors[:, within][:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, eigenvalue, identity_error``: one row per
    usable row and component (numbered from 1 by falling eigenvalue, at most ``components``)."""
    spark = rows.sparkSession
    usable = keep_table(quantised(rows), "whitening-rows")
    fit = keep_table(usable.select("x").distinct(), "whitening-fit")
    d, n, sums = moments(fit)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "eigenvalue double, identity_error double")
    if n == 0:
        return spark.createDataFrame([], schema)
    gram, _ = _summed(fit, d, n, sums)
    covariance = gram / n
    trace = float(np.trace(covariance))
    values, vectors = feast(covariance, components)
    positive = values > TINY * trace
    values, vectors = values[positive], vectors[:, positive]
    if not len(values):
        return spark.createDataFrame([], schema)
    scaled = vectors / np.sqrt(values)
    check, mean = _summed(fit, d, n, sums, scaled)
    mean = mean / n
    identity_error = float(np.abs(check / n - np.outer(mean, mean) - np.eye(len(values))).max())

    centred = F.zip_with("x", F.array(*[F.lit(int(s)) for s in sums]),
                         lambda x, s: (x * F.lit(n) - s).cast("decimal(38,0)"))
    deviation = F.aggregate(F.transform(centred, lambda v: v * v), F.lit(0).cast("decimal(38,0)"),
                            lambda acc, v: acc + v).cast("long")
    values_lit = F.array(*[F.lit(float(v)) for v in values])
    return (usable.select("vec_id", "x", deviation.alias("deviation"))
            .mapInArrow(lambda b: _project_kept(b, d, n, sums, scaled), "vec_id long, deviation long, "
                        "whitened array<double>")
            .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"),
                    F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    (values_lit[F.col("at")] / F.lit(trace)).alias("explained"),
                    values_lit[F.col("at")].alias("eigenvalue"),
                    F.lit(identity_error).alias("identity_error")))


def _project_kept(batches, d: int, n: int, sums: np.ndarray, scaled: np.ndarray):
    """The whitened coordinates of each row, with the row's id and deviation passed through."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        whitened = ((x * n - sums) / n) @ scaled
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id"), "deviation": batch.column("deviation"),
            "whitened": pa.FixedSizeListArray.from_arrays(pa.array(whitened.ravel()), scaled.shape[1])
            .cast(pa.list_(pa.float64()))})
