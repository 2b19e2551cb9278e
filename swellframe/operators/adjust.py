"""Adjustment of a second camera's pose and of all points to their matches, by damped least squares over DataFrames.

Points stay in tables. A round sums each task's reduced normal equations (a point's own 3 x 3 block is eliminated where
the point is), so that 43 numbers a batch leave the tasks; six unknowns are solved on the driver, and one pass over the
table moves the points. Moved points are written, so that lost executors repeat one round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.functions import geometry as g
from swellframe.tables import cut, discard


def _cross(v: np.ndarray) -> np.ndarray:
    z = np.zeros(len(v))
    return np.stack([np.stack([z, -v[:, 2], v[:, 1]], 1), np.stack([v[:, 2], z, -v[:, 0]], 1), np.stack([-v[:, 1], v[:, 0], z], 1)], axis=1)


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation by the vector w."""
    angle = np.linalg.norm(w)
    if angle < 1e-15:
        return np.eye(3)
    k = _cross((w / angle)[None])[0]
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _seen(p: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of projections (n, 2) and their derivatives by the points (n, 2, 3)."""
    z = p[:, 2]
    d = np.zeros((len(p), 2, 3))
    d[:, 0, 0] = d[:, 1, 1] = 1 / z
    d[:, :, 2] = -p[:, :2] / (z * z)[:, None]
    return p[:, :2] / z[:, None] - want, d


def _equations(pdf: pd.DataFrame, r: np.ndarray, t: np.ndarray, damping: float):
    """Of each point: block and gradient of its own unknowns, its coupling, and the camera's block and gradient; cost."""
    p = pdf[["x", "y", "z"]].to_numpy(float)
    q = p @ r.T
    e0, d0 = _seen(p, pdf[["ax", "ay"]].to_numpy(float))
    e1, dq = _seen(q + t, pdf[["bx", "by"]].to_numpy(float))
    d1, dc = dq @ r, np.concatenate([dq @ -_cross(q), dq], axis=2)
    tr = lambda m: np.swapaxes(m, 1, 2)
    v = tr(d0) @ d0 + tr(d1) @ d1
    v[:, range(3), range(3)] *= 1 + damping
    gp = (tr(d0) @ e0[:, :, None] + tr(d1) @ e1[:, :, None])[:, :, 0]
    return v, gp, tr(dc) @ d1, tr(dc) @ dc, (tr(dc) @ e1[:, :, None])[:, :, 0], float((e0**2).sum() + (e1**2).sum())


def _sums(points: DataFrame, r: np.ndarray, t: np.ndarray, damping: float) -> tuple[np.ndarray, np.ndarray, float]:
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v, gp, w, u, gc, cost = _equations(pdf, r, t, damping)
            wv = w @ np.linalg.inv(v)
            s = (u - wv @ np.swapaxes(w, 1, 2)).sum(axis=0)
            b = (gc - (wv @ gp[:, :, None])[:, :, 0]).sum(axis=0)
            yield pd.DataFrame([[*s.ravel(), *b, cost]], columns=[f"s{k}" for k in range(43)])

    rows = points.mapInPandas(run, ", ".join(f"s{k} double" for k in range(43)))
    total = rows.agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(43)]).first()
    x = np.array([v or 0.0 for v in total])
    return x[:36].reshape(6, 6), x[36:42], float(x[42])


def _moved(points: DataFrame, r: np.ndarray, t: np.ndarray, damping: float, step: np.ndarray) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                v, gp, w, _, _, _ = _equations(pdf, r, t, damping)
                d = np.linalg.solve(v, -(gp + np.swapaxes(w, 1, 2) @ step)[:, :, None])[:, :, 0]
                yield pdf.assign(**{c: pdf[c] + d[:, k] for k, c in enumerate("xyz")})

    return cut(points.mapInPandas(run, points.schema), "points")


def adjusted(matches: DataFrame, r: np.ndarray, t: np.ndarray, rounds: int = 20, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Normalised matches (m, ax, ay, bx, by) and a first pose -> r, t of unit length, and points (m, x, y, z, ...).

    Matches whose first point lies behind a camera, or can't be triangulated, are left out. A round whose cost doesn't
    fall is damped more and tried again; rounds end when it falls by less than the tolerance's share."""
    r, t = np.array(r, float), np.array(t, float)
    first = g.triangulated(*[F.col(c) for c in ("ax", "ay", "bx", "by")], r.tolist(), t.tolist())
    points = matches.select("m", "ax", "ay", "bx", "by", *[v.alias(c) for v, c in zip(first, "xyz", strict=True)])
    ahead = r[2, 0] * F.col("x") + r[2, 1] * F.col("y") + r[2, 2] * F.col("z") + float(t[2]) > 0
    points, damping = cut(points.where((F.col("z") > 0) & ahead), "points"), 1e-3
    s, b, cost = _sums(points, r, t, damping)
    for _ in range(rounds):
        a = s + damping * np.diag(np.diag(s)) + 1e-12 * np.eye(6)
        step = np.linalg.solve(a, -b)
        new_r, new_t = turn(step[:3]) @ r, t + step[3:]
        new = _moved(points, r, t, damping, step)
        new_s, new_b, new_cost = _sums(new, new_r, new_t, damping / 5)
        if new_cost < cost:
            discard(points)
            done = cost - new_cost <= tolerance * cost
            points, r, t, damping, s, b, cost = new, new_r, new_t, damping / 5, new_s, new_b, new_cost
            if done:
                break
        else:
            discard(new)
            damping *= 10
            if damping > 1e6:
                break
            s, b, _ = _sums(points, r, t, damping)
    size = float(np.linalg.norm(t))
    return r, t / size, points.withColumns({c: F.col(c) / size for c in "xyz"})
