"""Whitening of embeddings: principal components by contour integration over slices of the spectrum (FEAST).

The covariance of the distinct vectors is summed over the cluster, two passes, centred before it is multiplied. Counts of
eigenvalues above a shift (inertia, by Sylvester's law) cut the upper end of the spectrum into slices that hold a few
eigenvalues each. Every slice is a task: solves of the covariance shifted to complex points on a circle around the slice,
weighted by a quadrature, filter a subspace; Rayleigh-Ritz extracts its components, again until they are exact. A slice
must yield as many as the inertia counts say, so that none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut

#: Entries of the integer vectors: floor(64 c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on are no exact doubles.
HUGE = 1 << 53
#: Eigenvalues in a slice where they can be told apart.
SLICE = 4
#: Points of the quadrature on the upper half of a slice's circle, and rounds of filtering.
POINTS, ROUNDS = 8, 40
#: Eigenvalues below this part of the largest one are no variance but rounding.
NO_VARIANCE = 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and the one beside it of a tridiagonal matrix congruent (by reflections) to the symmetric one."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size > 0:
            x /= size
            p = a[k + 1 :, k + 1 :] @ x
            w = p - (x @ p) * x
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
            a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the shifted tridiagonal form."""
    diagonal, beside = form
    tiny = np.finfo(float).eps * (np.abs(diagonal).max(initial=0) + np.abs(beside).max(initial=0)) + np.finfo(float).tiny
    above, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def slices(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues in it) over the ``k`` largest eigenvalues with variance, at least."""
    form = tridiagonal(matrix)
    top = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    floor = NO_VARIANCE * top
    width = 1e-10 * top  # eigenvalues closer than this stay in one slice
    k = min(k, count_above(form, floor)) if top > 0 else 0
    low, high = floor, top
    if k == 0:
        return []
    while high - low > width and count_above(form, low) > k + SLICE:  # a low end with k eigenvalues above it, or few more
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(form, middle) >= k else (low, middle)
    done, todo = [], [(low, top, count_above(form, low))]
    while todo:
        a, b, n = todo.pop()
        if n <= SLICE or b - a <= width:
            done += [(a, b, n)] if n else []
            continue
        middle = (a + b) / 2
        above = count_above(form, middle)
        todo += [(a, middle, n - (above - (count_above(form, b)))), (middle, b, above - count_above(form, b))]
    return sorted(done, reverse=True)


def contour_components(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their unit vectors (columns); ValueError if they are not found."""
    n = len(matrix)
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-10 * abs(high))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (nodes + 1)
    points = centre + radius * np.exp(1j * angles)
    solvers = [np.linalg.inv(z * np.eye(n) - matrix) for z in points]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, 2 * count + 8))))[0]
    size = np.abs(matrix).sum(axis=1).max(initial=0)
    for _ in range(ROUNDS):
        filtered = sum(w / 2 * (radius * np.exp(1j * t) * (inverse @ basis)).real for w, t, inverse in zip(weights, angles, solvers, strict=True))
        basis, _ = np.linalg.qr(filtered)
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turn
        near = np.argsort(np.abs(values - centre))[:count]
        vectors = basis[:, near]
        left = np.abs(matrix @ vectors - vectors * values[near]).max(initial=0)
        inside = int(((values > low) & (values <= high)).sum())
        if left <= 64 * np.finfo(float).eps * size and inside == count:
            return values[near], vectors
    slack = 1e-9 * size
    if left <= 1e-10 * size and ((values[near] > low - slack) & (values[near] < high + slack)).all():
        return values[near], vectors
    raise ValueError(f"{inside} of {count} eigenvalues found between {low} and {high}")


def _slice_task(matrix: np.ndarray) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in zip(frame["low"], frame["high"], frame["count"], strict=True):
                values, vectors = contour_components(matrix, low, high, int(count))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    return run


def components(vectors: DataFrame, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``matrix``, falling, and their unit vectors (columns); fewer where variance ends.

    One task for each slice of the spectrum, on the cluster of ``vectors``; the union goes through Rayleigh-Ritz once more.
    """
    if not (cuts := slices(matrix, k)):
        return np.zeros(0), np.zeros((len(matrix), 0))
    spark = vectors.sparkSession
    todo = spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in cuts], "low double, high double, count int")
    found = todo.repartition(len(cuts)).mapInPandas(_slice_task(matrix), "value double, vector array<double>").toPandas()
    if len(found) != sum(n for _, _, n in cuts):
        raise ValueError("the slices hold other numbers of eigenvalues than their inertia counts")
    basis, _ = np.linalg.qr(np.stack(found["vector"].to_numpy()).T)
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:k]
    best = basis @ turn[:, order]
    return values[order], best * np.where(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])] < 0, -1.0, 1.0)


def _integers(batch: pa.RecordBatch, dims: int, name: str = "x") -> np.ndarray:
    at = batch.schema.get_field_index(name)
    return np.asarray(batch.column(at).flatten()).reshape(-1, dims)


def _gram(project: Callable[[np.ndarray], np.ndarray], dims: int, width: int) -> Callable:
    """Sums of outer products of what ``project`` makes of the vectors, a row (i, j, part) each, and of the values (j = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                y = project(_integers(batch, dims))
                total += y.T @ y
                ones += y.sum(axis=0)
        i, j = np.triu_indices(width)
        i, j = np.concatenate([i, np.arange(width)]), np.concatenate([j, np.full(width, -1)])
        part = np.concatenate([total[np.triu_indices(width)], ones])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(part)], names=["i", "j", "part"])

    return run


def _covariance(fit: DataFrame, n: int, dims: int, width: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance, divisor ``n``, of the projected vectors of ``fit``; what is left of their means is taken out."""
    sums = fit.select("x").mapInArrow(_gram(project, dims, width), "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).toPandas()
    out, means = np.zeros((width, width)), np.zeros(width)
    i, j, part = (sums[c].to_numpy() for c in ("i", "j", "part"))
    pair = j >= 0
    out[i[pair], j[pair]] = out[j[pair], i[pair]] = part[pair] / n
    means[i[~pair]] = part[~pair] / n
    return out - np.outer(means, means)


def whiten(vectors: DataFrame, k: int = 16) -> DataFrame:
    """For every row of ``vectors`` (vec_id, embedding) and component up to ``k``: vec_id, component (from 1, by falling
    eigenvalue), n (distinct integer vectors), deviation (exact squared distance from the mean, times n squared), whitened,
    explained (share of all variance) and identity_error (largest entry of the whitened covariance minus the identity).

    Left out are rows whose vector is null, empty, holds a null, a non-finite entry or one of 2**53 / 64 or more, or has
    another number of dimensions than most distinct vectors (ties: the greater number). Other columns are ignored; rows that
    repeat, and rows without vec_id, each give rows of their own. Components end where variance does: equal vectors, one
    vector or none give no row. A deviation that no long holds is null. Only the covariance and the components, dims x dims
    numbers, pass through the driver.
    """
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < HUGE / SCALE, F.lit(False)))
    x = F.transform("embedding", lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + SHIFT))
    rows = vectors.filter(fine).select(F.col("vec_id"), x.alias("x"))
    every = cut(rows.select("x").distinct())
    shape = every.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).head()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n = shape["dims"], shape["n"]
    fit, rows = every.filter(F.size("x") == dims), rows.filter(F.size("x") == dims)
    totals = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    s = np.array([int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])], dtype=object)
    largest = max(abs(int(v)) for v in s)
    nearest = np.array([round(int(v) / n) for v in s], dtype=np.int64)
    rest = np.array([(int(v) - n * int(m)) / n for v, m in zip(s, nearest, strict=True)])  # S/n without its whole part

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - nearest).astype(float) - rest

    covariance = _covariance(fit, n, dims, dims, centred)
    values, found = components(vectors, covariance, k)
    scaled = found / np.sqrt(values)
    explained = values / np.trace(covariance) if len(values) else values
    width = len(values)
    whitened = _covariance(fit, n, dims, width, lambda x: centred(x) @ scaled) if width else np.zeros((0, 0))
    error = float(np.abs(whitened - np.eye(width)).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch, dims)
            if n * float(np.abs(x).max(initial=0)) + float(largest) < 1 << 62 and (n * float(np.abs(x - nearest).max(initial=0)) + n) ** 2 * dims < 1 << 62:
                deviation = ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * v - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
                deviation = [v if v < 1 << 63 else None for v in exact]
            z, m = centred(x) @ scaled, len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(np.repeat(np.arange(m), width)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, n)),
                 pa.array(deviation, pa.int64()).take(np.repeat(np.arange(m), width)), pa.array(z.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
