"""Whitening embeddings by spectrum slicing.

The covariance of the distinct vectors is summed in tasks and by rows of the matrix; the driver gets one square matrix
of the vectors' dimension. There, the number of positive pivots of LDL' of the matrix less a shift is the number of
eigenvalues above the shift (Sylvester). Counts at bisected shifts isolate each leading eigenvalue, Rayleigh quotient
iteration, which converges cubically, takes it and its vector to double precision, and two more counts, just below and
just above, certify its number. Every vector is then projected on the components in tasks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Entries at which 64 * c leaves the range where doubles hold every whole number.
MOST = float(1 << 46)


#: (1 + sqrt 17) / 8, the bound of Bunch and Kaufman between the two kinds of pivot.
PIVOT = (1 + 17**0.5) / 8


def positives(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric ``a`` above ``shift``: positive pivots of LDL' with 1 x 1 and 2 x 2 pivots (Bunch and Kaufman)."""
    a = a - shift * np.eye(len(a))
    n, k, found = len(a), 0, 0
    while k < n:
        column = np.abs(a[k + 1 :, k])
        most, here = column.max(initial=0.0), abs(a[k, k])
        step, pivot = 1, k
        if here < PIVOT * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if here * row.max() < PIVOT * most * most:
                step, pivot = (1, r) if abs(a[r, r]) >= PIVOT * row.max() else (2, r)
        at = k + step - 1
        if at != pivot:
            a[[at, pivot]] = a[[pivot, at]]
            a[:, [at, pivot]] = a[:, [pivot, at]]
        rest = slice(k + step, n)
        column = a[rest, k : k + step].copy()
        if step == 2:  # such a block has one positive and one negative eigenvalue
            found += 1
            a[rest, rest] -= column @ np.linalg.solve(a[k : k + 2, k : k + 2], column.T)
        elif a[k, k] != 0:
            found += bool(a[k, k] > 0)
            a[rest, rest] -= column @ column.T / a[k, k]
        k += step
    return found


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues (falling) of symmetric positive ``a`` and their unit vectors as rows.

    Values below 1e-12 of the trace count as zero and are left out. Values that doubles cannot tell apart share their
    space: each next vector is kept orthogonal to those before.
    """
    size = len(a)
    scale = float(np.trace(a))
    values, vectors = [], np.zeros((0, size))
    if not size or not scale > 0:
        return np.array(values), vectors
    top = float(np.abs(a).sum(1).max()) * (1 + 1e-9)
    tie = 64 * np.finfo(float).eps * top
    floor = 1e-12 * scale
    rank = positives(a, floor)
    counts = {floor: rank, top: 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = positives(a, shift)
        return counts[shift]

    for k in range(1, min(most, rank) + 1):
        start = np.random.default_rng(k).standard_normal(size)
        while True:
            low = max(s for s, c in counts.items() if c >= k)
            high = min(s for s, c in counts.items() if c < k)
            alone = above(low) == k and above(high) == k - 1
            if high - low > tie and not (alone and high - low <= 0.25 * high):
                above((low + high) / 2)
                continue
            value, vector = rayleigh(a, (low + high) / 2, start, vectors, tie)
            near = max(16 * tie, 1e-13 * value)
            if above(value - near) >= k and above(value + near) < k:
                break
            if high - low <= tie:
                raise ArithmeticError(f"eigenvalue {k} could not be certified")
            above((low + high) / 2)
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


def rayleigh(a: np.ndarray, shift: float, start: np.ndarray, others: np.ndarray, tie: float) -> tuple[float, np.ndarray]:
    """Two steps of inverse iteration at the shift, then shifts by the Rayleigh quotient; orthogonal to ``others``."""

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - others.T @ (others @ v)
        return v / np.linalg.norm(v)

    def solved(at: float, v: np.ndarray) -> np.ndarray:
        for nudge in (0.0, tie, -tie):
            try:
                out = np.linalg.solve(a - (at + nudge) * np.eye(len(a)), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all():
                return out / np.abs(out).max()
        return v

    v = clean(start)
    for _ in range(2):
        v = clean(solved(shift, v))
    value = float(v @ a @ v)
    for _ in range(12):
        before = value
        v = clean(solved(value, v))
        value = float(v @ a @ v)
        if abs(value - before) <= tie / 64:
            break
    return value, v


def _added(width: int):
    """(key, vals) rows: vals of equal keys added, at most ``width`` keys."""

    def run(batches):
        total = {}
        for b in batches:
            for key, vals in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                vals = vals.values.to_numpy()
                total[key] = total[key] + vals if key in total else vals.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["key", "vals"])

    return run


def matrix(batch, i: int, width: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy().reshape(-1, width)


def _sums(width: int):
    def run(batches):
        total = np.zeros(width, object)
        for b in batches:
            x = matrix(b, 0, width)
            total += x.sum(0) if len(x) * float(np.abs(x).max(initial=0)) < 2.0**62 else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["dim", "s"])

    return run


def products(vectors: DataFrame, width: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sums of project(x) and of its outer products over all rows; ``width``: of the result. Rows of the matrix are added in tasks."""

    def run(batches):
        sums = np.zeros((width + 1, width))
        for b in batches:
            if b.num_rows:
                for at in range(0, b.num_rows, 1 << 14):
                    y = project(b.slice(at, 1 << 14))
                    sums[:width] += y.T @ y
                    sums[width] += y.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], names=["key", "vals"])

    rows = vectors.mapInArrow(run, "key int, vals array<double>").repartition("key").mapInArrow(_added(width), "key int, vals array<double>").collect()
    out = np.zeros((width + 1, width))
    for r in rows:  # width + 1 rows, whatever the table
        out[r.key] = r.vals
    return out[width], out[:width]


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component.

    An entry c is taken as the whole number x = floor(64 c) + 1000000. Mean and covariance are those of the distinct x
    vectors (n of them). deviation: the exact sum of (n x - S)^2, S the sums of the dimensions; null where it does not
    fit a long. whitened: x less the mean, on the component, over the root of its eigenvalue. explained: the
    eigenvalue's share of the trace. identity_error: the largest entry of the whitened vectors' covariance less the
    identity, measured over the distinct vectors.

    Rows whose vector is null, empty, holds null, non-finite or huge (2^46 and more) entries, or has another length than
    most usable vectors (ties: the longer) take no part. Components without variance are left out, so one distinct
    vector, or an empty table, gives no rows. Repeated rows and null ids are returned as often as they occur; other
    columns are not read.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)
    wide = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    lengths = wide.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    width = lengths["width"]
    whole = wide.filter(F.size("v") == width).select("vec_id", F.transform("v", lambda c: F.floor(c * 64) + F.lit(1_000_000)).alias("x"))
    fit = stored(whole.select("x").distinct(), "distinct")
    n = fit.count()
    total = fit.mapInArrow(_sums(width), "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()  # a row a dimension
    sums = [int(r.s) for r in sorted(total, key=lambda r: r.dim)]
    middle = np.array([s // n for s in sums], np.int64)

    first, second = products(fit, width, lambda b: (matrix(b, 0, width) - middle).astype(float))
    covariance = (second - np.outer(first, first) / n) / n
    values, vectors = leading(covariance, components)
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    scaled = vectors / np.sqrt(values)[:, None]

    def apart(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if n * float(np.abs(x).max(initial=0)) < 2.0**61 and max(map(abs, sums)) < 2**61:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)

    def projected(b, i: int = 0) -> np.ndarray:
        return (apart(matrix(b, i, width)).astype(float) / n) @ scaled.T

    m1, m2 = products(fit, len(values), projected)
    error = float(np.abs((m2 - np.outer(m1, m1) / n) / n - np.eye(len(values))).max())
    explained = values / np.trace(covariance)

    def rows(batches):
        k = len(values)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1 << 13):
                b = whole_batch.slice(at, 1 << 13)
                far = apart(matrix(b, 1, width))
                if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * width < 2.0**62:
                    deviation = pa.array((far * far).sum(1))
                else:
                    exact = (far.astype(object) ** 2).sum(1)
                    deviation = pa.array([int(d) if d < 2**63 else None for d in exact], pa.int64())
                pick = pa.array(np.repeat(np.arange(b.num_rows), k))
                out = projected(b, 1)
                count = b.num_rows * k
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(count, n)), deviation.take(pick), pa.array(out.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(count, error))],
                    names=[c.split()[0] for c in WHITENED.split(", ")],
                )

    return whole.mapInArrow(rows, WHITENED)
