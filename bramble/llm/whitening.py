"""Embedding whitening: distributed centred covariance, leading eigenpairs of the tridiagonal form, broadcast projection.

The tasks add up integer sums, then, centred by them, the covariance of the distinct vectors. The d x d matrix is brought
to tridiagonal form by Householder reflections; the leading eigenvalues are bisected by Sturm counts, their vectors come
from inverse iteration, orthogonalised again within clusters of close eigenvalues; the projection is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm.common import stage

SCALE, SHIFT = 64, 1_000_000
#: Vectors of a batch that a task holds at once, and components that a row can have at most.
BATCH_ROWS, COMPONENTS = 2_048, 16
#: Eigenvalues up to this share of the largest are taken as 0: the fit list has no spread there.
FLAT = 1e-12


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q @ T @ q.T = v, by one Householder reflection a column."""
    a, n = v.astype(float).copy(), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues of the tridiagonal matrix below each of x: negative pivots of T - x."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot, count = np.ones_like(x), np.zeros(len(x), dtype=int)
    for i, d in enumerate(diagonal):
        pivot = d - x - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of the Gershgorin interval down to the spacing of doubles."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    span = max(np.abs(diagonal + around).max(), np.abs(diagonal - around).max(), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - around).min() - 1e-12 * span), np.full(k, (diagonal + around).max() + 1e-12 * span)
    rank = n - 1 - np.arange(k)
    for _ in range(120):
        mid = (low + high) / 2
        above = sturm_count(diagonal, off, mid) <= rank
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges."""
    n = len(diagonal)
    d, e, f, u, x = diagonal - shift, off.copy(), np.zeros(max(n - 2, 0)), off.copy(), b.copy()
    for i in range(n - 1):
        if abs(u[i]) > abs(d[i]):  # exchange rows i and i + 1
            d[i], u[i] = u[i], d[i]
            e[i], d[i + 1] = d[i + 1], e[i]
            if i + 1 < n - 1:
                f[i], e[i + 1] = e[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if d[i] == 0:
            d[i] = tiny
        m = u[i] / d[i]
        d[i + 1] -= m * e[i]
        if i + 1 < n - 1:
            e[i + 1] -= m * f[i]
        x[i + 1] -= m * x[i]
    for i in range(n - 1, -1, -1):
        x[i] -= (e[i] * x[i + 1] if i + 1 < n else 0.0) + (f[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i] or 1.0)
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues by inverse iteration; within a cluster of close eigenvalues each
    one is made orthogonal to those before it in every step."""
    n = len(diagonal)
    scale = max(np.abs(values).max(initial=0.0), np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0)) or 1.0
    tiny, rng, out, start = np.finfo(float).eps * scale, np.random.default_rng(7), np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * scale:
            start = j
        x = rng.standard_normal(n)
        for _ in range(6):
            # equal eigenvalues are told apart by a few roundings
            x = _solve(diagonal, off, value - (j - start) * 2 * tiny, x / np.linalg.norm(x), tiny)
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the k largest eigenvalues of a symmetric matrix, falling; values that are 0 but for
    rounding are left out."""
    diagonal, off, q = tridiagonal(v)
    values = leading_values(diagonal, off, min(k, len(v)))
    values = values[values > FLAT * max(values.max(initial=0.0), 0.0)] if values.max(initial=0.0) > 0 else values[:0]
    vectors = q @ leading_vectors(diagonal, off, values)
    # sign: the largest entry is positive
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def _matrix(batch: pa.RecordBatch, d: int, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_length(batches):
    """(length, integer vectors) of the batches, cut to a bounded number of rows."""
    for batch in batches:
        sizes = batch.column("d").to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            some = batch.filter(pa.array(sizes == d))
            for at in range(0, some.num_rows, BATCH_ROWS):
                yield int(d), some.slice(at, BATCH_ROWS)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums per place, by length: halves of 32 bits are summed apart."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for d, part in _by_length(batches):
            x = _matrix(part, d)
            own = np.stack([np.full(d, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            total[d] = total.get(d, 0) + own
        for d, t in total.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d, d, dtype=np.int32), "i": np.arange(d, dtype=np.int32), "n": t[0], "high": t[1], "low": t[2]})

    rows = fit.mapInArrow(add, "d int, i int, n long, high long, low long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows.orderBy("d", "i").collect():
        out.setdefault(r["d"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])
    return out


def _times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they fit, else as Python integers."""
    bound = max(int(np.abs(x.astype(float)).max(initial=0.0)) + 1, 1) * n * 2
    if bound < 1 << 62:
        return x * np.int64(n) - np.asarray(sums, dtype=np.int64)
    return x.astype(object) * n - np.asarray(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _times_n(x, n, sums).astype(float) / n


def _moments(fit: DataFrame, sums: dict[int, tuple[int, list[int]]], project=None) -> dict[int, np.ndarray]:
    """Covariance by length, divisor n, of centred vectors or of their projections: each task adds up outer products of its
    vectors and hands on d * d numbers, whatever its rows."""
    shared = fit.sparkSession.sparkContext.broadcast((sums, project))

    def add(batches):
        sums, project = shared.value
        total: dict[int, np.ndarray] = {}
        for d, part in _by_length(batches):
            c = _centred(_matrix(part, d), *sums[d])
            c = c if project is None else c @ project[d]
            total[d] = total.get(d, 0) + c.T @ c
        for d, t in total.items():
            i, j = np.triu_indices(len(t))
            yield pa.RecordBatch.from_pydict({"d": np.full(len(i), d, dtype=np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": t[i, j]})

    rows = fit.mapInArrow(add, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    shared.unpersist()
    out = {}
    for d, own in rows.groupby("d"):
        v = np.zeros((own.i.max() + 1, own.i.max() + 1))
        v[own.i, own.j] = v[own.j, own.i] = own.s / sums[d][0]
        out[int(d)] = v
    return out


def integer_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, d, x): the long vectors floor(64 c) + 1000000 of the rows whose vector is not null and all of whose entries
    are finite; beyond the range of a long an entry is its end."""
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(1 << 62)
    x = F.transform(vector_col, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(most)), F.lit(-most))) + SHIFT)
    return embeddings.where(F.col(vector_col).isNotNull() & ~bad & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), F.size(vector_col).alias("d"), x.alias("x"))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every valid vector and component.

    A row for each of the leading components, at most `components`, the vector's length, or the directions in which the fit
    list spreads at all (eigenvalues above FLAT of the largest); where it spreads in none (all vectors equal) a row has one
    component with whitened and explained 0. Vectors of different lengths are whitened apart, each length with its own fit
    list. Empty vectors have no components and give no rows. Repeated rows and repeated ids give repeated rows, a null id
    is passed on; other columns, whatever their names, are ignored. A deviation beyond a long is the largest long.
    An empty table gives no rows. The driver gathers d * d numbers for each length.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings, id_col, vector_col)
    fit = stage(rows.select("d", "x").distinct(), "fit")
    sums = _sums(fit)
    model, project = {}, {}
    for d, v in _moments(fit, sums).items():
        values, vectors = leading_pairs(v, components)
        project[d] = vectors / np.sqrt(values) if len(values) else np.zeros((d, 1))
        model[d] = (values / np.trace(v)) if len(values) else np.zeros(1)
    errors = {d: float(np.abs(v - np.eye(len(v))).max()) if model[d].any() else 0.0 for d, v in _moments(fit, sums, project).items()}
    shared = spark.sparkContext.broadcast((sums, project, model, errors))

    def put(batches):
        sums, project, model, errors = shared.value
        for d, part in _by_length(batches):
            n, total = sums[d]
            x = _matrix(part, d)
            far = _times_n(x, n, total)
            if float(np.abs(far).max(initial=0)) ** 2 * d < 2.0**62:
                deviation = (far * far).sum(axis=1)
            else:
                deviation = np.asarray([min(sum(int(c) ** 2 for c in row), (1 << 63) - 1) for row in far], dtype=np.int64)
            w, k = (far.astype(float) / n) @ project[d], project[d].shape[1]
            take = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(take), n)), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(w.ravel()), pa.array(np.tile(model[d], len(x))), pa.array(np.full(len(take), errors[d]))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(put, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
