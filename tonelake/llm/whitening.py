"""Whitening directions of embeddings by a bidiagonal qd solver.

Vectors become whole numbers; their count and sums are exact.  Every task
reduces its centred rows, block by block, to one triangular factor, and factors
are reduced by groups until one is left (QR of the whole table, of which no task
holds more than a block).  That factor is made bidiagonal by Householder
reflections, the dqds iteration finds its singular values to high relative
accuracy, and a twisted factorisation at each gives its direction.  The
covariance matrix itself is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this size, scaled, are read as this size; they leave sums exact.
MOST = 2.0**52
BLOCK_ROWS = 4096
#: Triangular factors that one task reduces to one.
FACTORS = 32
_EPS = np.finfo(float).eps
#: Singular values within this relative distance of the next share a space, in which their directions are made orthogonal.
CLUSTER = 1e-3


def usable(vectors: DataFrame, vector: str = "embedding") -> Column:
    """Whether a vector is there and has no null and no non-finite entry."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers of a batch of vectors, one row each; short vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64) + OFFSET
    if len(lengths) and (lengths == dims).all():
        return whole.reshape(-1, dims)
    out = np.full((len(lengths), dims), OFFSET, np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = whole
    return out


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, len(b), BLOCK_ROWS):
            part = b.slice(start, BLOCK_ROWS)
            # A slice is copied so that its offsets count from its own first value.
            column = pa.concat_arrays([part.column(part.schema.get_field_index(name))])
            yield part, _matrix(column, dims)


def moments(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Exact number and sums of the whole-number vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _blocks(batches, "v", dims):
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    # One row a dimension comes back.
    sums = rows.select("v").mapInArrow(run, "dim long, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("dim").collect()
    return (sums[0]["n"], [(r["high"] << 26) + r["low"] for r in sums]) if sums else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact ``n * x - sums``, as 64-bit numbers where they fit, else as Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null where it is no 64-bit number."""
    about = (d.astype(np.float64) ** 2).sum(1)
    if (about < 2.0**62).all():
        d = d.astype(np.int64)
        return (d * d).sum(1).tolist()
    out = []
    for row, size in zip(d, about):
        exact = sum(int(v) ** 2 for v in row) if size < 2.0**63 * 1.001 else None
        out.append(exact if exact is not None and exact < 1 << 63 else None)
    return out


def _reduced(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows."""
    dims = len(sums)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for _, x in _blocks(batches, "v", dims):
            r = _reduced(r, (deviations(x, n, sums) / n).astype(np.float64))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merged(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r = None
        for data in p.sort_values("part")["r"]:
            r = _reduced(r, np.frombuffer(data).reshape(-1, dims))
        return pd.DataFrame({"part": [key[0]], "r": [r.tobytes()]})

    factors = materialize(rows.select("v").mapInArrow(first, "part long, r binary"), "factors")
    while factors.count() > 1:
        fewer = materialize(factors.groupBy(F.expr(f"part div {FACTORS}").alias("group")).applyInPandas(merged, "part long, r binary"), "factors")
        discard(factors)
        factors = fewer
    r = np.frombuffer(factors.first()["r"]).reshape(-1, dims)
    discard(factors)
    return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit ``v`` (or zeros) whose reflection turns ``x`` into ``(alpha, 0, ...)``."""
    norm = np.linalg.norm(x)
    v = x.copy()
    alpha = -norm if x[0] >= 0 else norm
    v[0] -= alpha
    size = np.linalg.norm(v)
    return (v / size, alpha) if size and np.any(x[1:]) else (np.zeros_like(x), float(x[0]))


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, above, right)``: ``a @ right`` has the singular values of the bidiagonal matrix, by Householder reflections from both sides."""
    a, n = a.copy(), a.shape[1]
    right = np.eye(n)
    for k in range(n):
        v, a[k, k] = _reflector(a[k:, k])
        a[k + 1 :, k] = 0
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k < n - 1:
            w, a[k, k + 1] = _reflector(a[k, k + 1 :])
            a[k, k + 2 :] = 0
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the differential qd algorithm; the least of its differences tells whether the shift was too large."""
    m = len(q)
    qs, es = np.empty(m), np.empty(m - 1)
    d = least = q[0] - shift
    for i in range(m - 1):
        qs[i] = d + e[i]
        ratio = q[i + 1] / qs[i] if qs[i] else 0.0
        es[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    qs[-1] = d
    return qs, es, least


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of a bidiagonal matrix, falling, by dqds with splitting and shifts that are taken back where they overshoot."""
    tolerance = (10 * _EPS) ** 2
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not size:
        return np.zeros(len(diagonal))
    todo, found = [((diagonal / size) ** 2, (above / size) ** 2, 0.0, True)], []
    while todo:
        q, e, total, fresh = todo.pop()
        m = len(q)
        if m == 1:
            found.append(max(0.0, q[0] + total))
            continue
        small = np.flatnonzero(e <= tolerance * (total + np.minimum(q[:-1], q[1:])))
        if len(small):
            at = int(small[0]) + 1
            todo += [(q[:at], e[: at - 1], total, True), (q[at:], e[at:], total, True)]
            continue
        if fresh and q[0] < q[-1]:  # graded the other way round
            q, e = _flipped(q, e)
        if fresh:
            q, e, _ = _dqds(q, e, 0.0)
            todo.append((np.maximum(q, 0), e, total, False))
            continue
        # The shift tried first is just below the smaller eigenvalue of the last two rows.
        most = _least_of_two(q[-2], e[-1], q[-1])
        for factor in (1 - 1e-12, 0.98, 0.75, 0.3, 0.0):
            shift = most * factor
            qs, es, least = _dqds(q, e, shift)
            if least >= 0 or not shift:
                break
        todo.append((np.maximum(qs, 0), es, total + shift, False))
    return size * np.sqrt(np.sort(found)[::-1])


def _least_of_two(q0: float, e0: float, q1: float) -> float:
    """The smaller eigenvalue of the product of the last two rows' factors."""
    trace, det = q0 + e0 + q1, q0 * q1
    root = np.sqrt(max(0.0, trace * trace / 4 - det))
    return det / (trace / 2 + root) if trace else 0.0


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same matrix with rows and columns in reverse order: as squares of the transposed, reversed bidiagonal."""
    return q[::-1].copy(), e[::-1].copy()


@np.errstate(over="ignore", invalid="ignore")
def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit direction of ``B'B`` at ``value`` (a squared singular value): forward and backward qd transforms meet where their residual is least."""
    n, tiny = len(diagonal), np.finfo(float).tiny / _EPS
    q, l = diagonal**2, np.zeros(n)  # noqa: E741
    q = np.where(q > tiny, q, tiny)
    l[:-1] = diagonal[:-1] * above / q[:-1]
    plus, down, s = np.empty(n), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        plus[i] = q[i] + s[i]
        plus[i] = plus[i] if abs(plus[i]) > tiny else -tiny
        if i < n - 1:
            down[i] = q[i] * l[i] / plus[i]
            s[i + 1] = down[i] * l[i] * s[i] - value
    up, p = np.empty(n), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        minus = q[i] * l[i] * l[i] + p[i + 1]
        minus = minus if abs(minus) > tiny else -tiny
        ratio = q[i] / minus
        up[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    residual = np.abs(s + p + value)
    residual[~np.isfinite(residual)] = np.inf
    r = int(residual.argmin())
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.abs(z).max()
    if not np.isfinite(size):
        return np.zeros(n)
    z /= size
    return z / np.linalg.norm(z)


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns are right singular vectors for the falling ``values``.

    Where values lie close together their twisted vectors need not be
    orthogonal: each is freed from those before it, and one that is lost that
    way is found anew by inverse iteration beside them.
    """
    n, rng = len(diagonal), np.random.default_rng(5)
    b = np.diag(diagonal) + np.diag(above, 1)
    gram, out, start = b.T @ b, np.zeros((n, len(values))), 0
    for k, v in enumerate(values):
        if k and values[k - 1] - v > CLUSTER * values[k - 1]:
            start = k
        z, near = _twisted(diagonal, above, v * v), out[:, start:k]
        rest = z - near @ (near.T @ z)
        if np.linalg.norm(rest) < 0.5 or np.linalg.norm(gram @ z - v * v * z) > 1e3 * n * _EPS * max(values[0] ** 2, np.finfo(float).tiny):
            moved = gram - (v * v * (1 + 4 * _EPS) + _EPS * values[0] ** 2 * 1e-3) * np.eye(n)
            rest = rng.normal(size=n)
            for _ in range(4):
                rest = rest - near @ (near.T @ rest)
                rest = np.linalg.lstsq(moved, rest / np.linalg.norm(rest), rcond=None)[0] if np.linalg.cond(moved) > 1e300 else np.linalg.solve(moved, rest / np.linalg.norm(rest))
                rest /= np.linalg.norm(rest)
        for _ in range(2):
            rest = rest - near @ (near.T @ rest)
            rest /= np.linalg.norm(rest)
        out[:, k] = rest
    return out


def solve(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, vectors, total)``: falling squared singular values of ``r`` that are not nil, at most so many, their unit directions as columns, and the sum of all."""
    diagonal, above, right = bidiagonal(r)
    values = singular_values(diagonal, above)
    kept = values[:components]
    kept = kept[kept > len(values) * _EPS * values[0]] if len(values) and values[0] > 0 else kept[:0]
    vectors = right @ directions(diagonal, above, kept)
    return kept**2, vectors, float((r * r).sum())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component.

    Vectors that are null or hold a null or non-finite entry are left out.
    Vectors shorter than the longest are read as filled up with zeros; entries
    beyond ``2**52 / 1024`` count as that.  Repeated rows count, and are
    returned, as often as they occur; null ids stay null and ids stay exact.
    Directions along which nothing varies (to rounding) are no components, so
    a table of one or of equal vectors, as an empty one, gives no rows; of
    equal eigenvalues the directions are any orthogonal ones.  ``deviation`` is
    null where it is no 64-bit number.  Other columns are not read.
    """
    rows = vectors.where(usable(vectors, vector)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    n, sums = moments(rows, dims) if dims else (0, [])
    values, found, total = solve(triangle(rows, n, sums), components) if n else (np.zeros(0), None, 0.0)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    eigen = values / n
    project = found / np.sqrt(eigen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "v", dims):
            d = deviations(x, n, sums)
            z = (d / n).astype(np.float64) @ project
            lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(square_sums(d), pa.int64()), lists], names=["vec_id", "deviation", "z"])

    white = materialize(rows.mapInArrow(run, "vec_id long, deviation long, z array<double>"), "whitened")
    k = len(eigen)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    seen = white.agg(*[F.covar_pop(F.col("z")[i], F.col("z")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(x * n / total)) for x in eigen])
    return white.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
