"""Embedding whitening from singular values of the centred rows, without forming their covariance.

Entries become integers, so sums over the distinct vectors are exact. Tasks reduce their centred rows block by block
to one triangle each by QR, triangles are merged a few dozen at a time in tasks, and the last ones on the driver: what is left is
as wide and as high as a vector is long, whatever the number of rows. Householder reflections make it bidiagonal; the
dqds recurrence, with shifts from below by the trace of the inverse, finds the squared singular values to high relative
accuracy; twisted factorisations of the shifted tridiagonal give the directions, which the reflections take back.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.llm.common import cut

_EPS = np.finfo(float).eps
#: Rows of one QR step, triangles merged in one task, and triangles that may reach the driver.
BLOCK, FAN = 4_096, 32


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right) of a square r: right is orthogonal, and r @ right = left @ bidiagonal for some
    orthogonal left. By Householder reflections."""
    r, n = np.array(r, float), len(r)
    right = np.eye(n)

    def reflector(x):
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(r[k:, k])
        if v is not None:
            r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        if k < n - 2:
            v = reflector(r[k, k + 1 :])
            if v is not None:
                r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), right


def _dqds_step(q: np.ndarray, e: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One transform by shift s: new q, new e and the pivots d; None if s passes the smallest value."""
    n = len(q)
    new_q, new_e, d = np.empty(n), np.empty(n - 1), np.empty(n)
    d[0] = q[0] - s
    for i in range(n - 1):
        if d[i] < 0:
            return None
        new_q[i] = d[i] + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
        new_e[i] = e[i] * ratio
        d[i + 1] = d[i] * ratio - s if new_q[i] > 0 else -s
    if d[-1] < 0:
        return None
    new_q[-1] = d[-1]
    return new_q, new_e, d


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    found: list[float] = []
    todo = [(np.asarray(diagonal, float) ** 2, np.asarray(above, float) ** 2, 0.0)]
    while todo:
        q, e, base = todo.pop()
        shift = 0.0
        while len(q) > 1:
            small = np.flatnonzero(e <= _EPS**2 * (base + np.minimum(q[:-1], q[1:])))
            if len(small):
                at = int(small[-1]) + 1
                todo.append((q[:at], e[: at - 1], base))
                q, e, shift = q[at:], e[at:], 0.0
                continue
            step = _dqds_step(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > _EPS * base else 0.0
                step = _dqds_step(q, e, shift)
            q, e, d = step
            base += shift
            # the pivots are the inverse's diagonal, inverted: the smallest value is at least 1 / trace
            shift = 0.0 if (d <= 0).any() else (1 - 4 * _EPS * len(d)) / float((1 / d).sum())
        found.append(base + float(q[0]))
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """A unit eigenvector of the tridiagonal B'B, B of diagonal a and superdiagonal b, from the twisted factorisation
    of B'B - value whose twist is smallest (the skip-th smallest, for another start)."""
    n, q, e, off = len(a), a * a, b * b, a[:-1] * b
    if n == 1:
        return np.ones(1)
    # B'B has the diagonal q + the e before, and off its diagonal a b
    tiny = _EPS**2 * max(float(q.max()), value)
    top, s = np.empty(n), np.empty(n)  # stationary: pivots from the top, and what they leave over
    s[0] = -value
    for i in range(n - 1):
        top[i] = q[i] + s[i]
        if abs(top[i]) < tiny:
            top[i] = -tiny
        s[i + 1] = e[i] * s[i] / top[i] - value
    top[-1] = q[-1] + s[-1]
    low, p = np.empty(n), np.empty(n)  # progressive: pivots from the end
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        low[i + 1] = e[i] + p[i + 1]
        if abs(low[i + 1]) < tiny:
            low[i + 1] = -tiny
        p[i] = p[i + 1] * q[i] / low[i + 1] - value
    twist = s + p + value
    at = int(np.argsort(np.abs(twist), kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -z[i + 1] * off[i] / top[i]
    for i in range(at, n - 1):
        z[i + 1] = -z[i] * off[i] / low[i + 1]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, columns, trace): the k largest eigenvalues of r'r, falling, as far as they differ from 0, their unit
    eigenvectors, and r'r's trace."""
    scale = float(np.abs(r).max(initial=0))
    if scale == 0:
        return np.empty(0), np.empty((len(r), 0)), 0.0
    a, b, right = bidiagonal(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0))
    b[np.abs(b) <= _EPS * _EPS * norm] = 0.0
    cuts = [0, *(np.flatnonzero(b == 0) + 1), len(a)]
    parts = [(lo, hi, v) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for v in dqds(a[lo:hi], b[lo : hi - 1])]
    parts.sort(key=lambda x: -x[2])
    noise = (len(a) * _EPS * norm) ** 2 * len(a)
    values, vectors = [], []
    for lo, hi, v in parts[:k]:
        if v <= noise:
            break
        for skip in range(hi - lo):
            z = np.zeros(len(a))
            z[lo:hi] = _twisted(a[lo:hi], b[lo : hi - 1], v, skip)
            for _ in range(2):  # close values: what earlier directions take is taken out
                for w, u in zip(vectors, values, strict=True):
                    if u - v <= 1e-3 * u:
                        z -= (w @ z) * w
            if np.linalg.norm(z) > 0.5:
                break
        vectors.append(z / np.linalg.norm(z))
        values.append(v)
    turned = right @ np.array(vectors).T if vectors else np.empty((len(a), 0))
    return np.array(values) * scale**2, turned, float((r * r).sum())


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, x array<long>) of floor(scale * c). Rows whose vector is null or empty or holds
    null or non-finite entries, or is not as long as most are (ties: the longer ones), are left out."""
    e = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0))
    fine = e.where(F.forall("e", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    long = fine.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size("e") == (long.d if long else 0)).select("vec_id", F.transform("e", lambda c: F.floor(c * scale)).alias("x"))


def _rows(column) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _triangle(blocks, dim: int) -> np.ndarray:
    r = np.zeros((0, dim))
    for x in blocks:
        r = np.linalg.qr(np.concatenate([r, x]), mode="r")
    return np.concatenate([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


@dataclass
class Whitening:
    """n distinct vectors with sums `total`; columns of `axes` are the directions, of eigenvalues `values`."""

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total])

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.axes / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - total) squared."""
        total = np.array(self.total, object)
        most = max(self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total)), 1)
        if most**2 * x.shape[1] < 2**63:
            return ((self.n * x - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - total) ** 2).sum(axis=1).tolist()


def fit(x: DataFrame, k: int = 4) -> Whitening | None:
    """x (x array<long>) -> the whitening of its distinct vectors by their first k components; None without rows.
    Equal vectors count once; directions in which the vectors don't differ are left out, so there may be fewer than k."""
    once = cut(x.select("x").distinct(), "distinct-vectors")
    one = once.select(F.size("x").alias("d")).first()
    if one is None:
        return None
    dim = one.d

    def sums(batches):
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            rows = _rows(batch.column(0))
            n, total = n + len(rows), total + (rows.sum(axis=0) if np.abs(rows).max(initial=0) < 2**40 else rows.astype(object).sum(axis=0))
        yield _batch(n=pa.array([n], pa.int64()), total=pa.array([[str(t) for t in total]], pa.list_(pa.string())))

    parts = once.mapInArrow(sums, "n long, total array<string>")
    each = F.posexplode(F.transform("total", lambda t: t.cast("decimal(38,0)"))).alias("i", "t")
    total = parts.select(each).groupBy("i").agg(F.sum("t").alias("t")).orderBy("i").collect()  # one row a dimension
    n = once.count()
    found = Whitening(n, [int(r.t) for r in total], np.empty(0), np.empty((dim, 0)), 0.0)
    mean = found.mean

    def reduced(batches):
        blocks = (_rows(b.column(0).slice(at, BLOCK)) - mean for b in batches for at in range(0, b.num_rows, BLOCK))
        yield _batch(r=pa.array([_triangle(blocks, dim).tobytes()], pa.binary()))

    def merged(pdf):
        r = _triangle((np.frombuffer(b).reshape(-1, dim) for b in pdf["r"].to_pylist()), dim)
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    triangles = cut(once.mapInArrow(reduced, "r binary"), "triangles")
    while (m := triangles.count()) > FAN:
        groups = -(-m // FAN)
        triangles = cut(triangles.groupBy(F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g")).applyInArrow(merged, "r binary"), "triangles")
    r = _triangle((np.frombuffer(row.r).reshape(-1, dim) for row in triangles.collect()), dim)  # FAN triangles at most
    values, found.axes, trace = directions(r, k)
    found.values, found.trace = values / n, trace / n
    if len(values):
        found.error = _identity_error(once, found)
    return found


def _identity_error(once: DataFrame, w: Whitening) -> float:
    """How far the whitened distinct vectors' covariance is from the identity at most, measured on all of them."""
    k = len(w.values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = w.projected(_rows(batch.column(0)))
            first, second = first + y.sum(axis=0), second + y.T @ y
        yield _batch(m=pa.array([[*first, *second.ravel()]], pa.list_(pa.float64())))

    rows = once.mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    m = np.array([r.v for r in rows.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]) / w.n
    return float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained,
    identity_error: k rows, or as many as there are components, for each row that takes part (see `quantised`).

    Repeated rows and vectors are given each but fitted once; null ids stay; a table whose vectors don't differ, like an
    empty one, gives an empty result. Entries of any finite size are summed exactly; beyond 64 bits once scaled they count as the
    largest long. Other columns are ignored."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    x = quantised(vectors, scale).withColumn("vec_id", F.col("vec_id").cast("long"))
    w = fit(x, k)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema)
    m, explained = len(w.values), w.values / w.trace

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = _rows(part.column(1))
                size = len(rows)
                deviation = [Decimal(d) for d in w.deviation(rows)]
                yield _batch(
                    vec_id=part.column(0).take(pa.array(np.repeat(np.arange(size), m))), component=pa.array(np.tile(np.arange(1, m + 1), size), pa.int32()),
                    n=pa.array(np.full(size * m, w.n), pa.int64()), deviation=pa.array([d for d in deviation for _ in range(m)], pa.decimal128(38, 0)),
                    whitened=pa.array(w.projected(rows).ravel(), pa.float64()), explained=pa.array(np.tile(explained, size), pa.float64()), identity_error=pa.array(np.full(size * m, w.error), pa.float64()),
                )

    return x.select("vec_id", "x").mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """`whiten` with deviation as a long; null where it passes 64 bits."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
