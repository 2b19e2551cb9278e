"""Surfaces seen by cameras: sampled radiance, polarisation of visible cells, poses from matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.functions import geometry as g
from swellframe.functions.epipolar import consensus, design, sampson
from swellframe.operators import temporal
from swellframe.operators.image import sampled_sharp
from swellframe.operators.match import centred
from swellframe.operators.raster import sampled

_CELL = 1 << 20


def radiance(cells: DataFrame, images: DataFrame, camera: Sequence[Sequence[float]], top: float = 255.0, sharp: int = 0) -> DataFrame:
    """cells (t, i, j, x, y, z) and images (t, i, j, z: rows, columns, values) -> t, i, j, radiance: the image where
    each cell is seen, from 0 to 1; null outside the image. Sampled by Lanczos weights of 2 * sharp pixels a side, as
    published radiance products are with 4, or linearly by default."""
    u, v = g.projected(F.col("x"), F.col("y"), F.col("z"), camera)
    places = cells.select("t", (F.col("i").cast("long") * _CELL + F.col("j")).alias("id"), v.alias("fi"), u.alias("fj"))
    places = places.where(F.abs("fi") < 1e9).where(F.abs("fj") < 1e9)
    got = sampled_sharp(images, places, sharp) if sharp else sampled(images, places)
    return got.select("t", F.floor(F.col("id") / _CELL).cast("int").alias("i"), (F.col("id") % _CELL).cast("int").alias("j"), (F.col("z") / top).alias("radiance"))


def mean_polarisation(cells: DataFrame) -> DataFrame:
    """cells (t, i, j, s0, s1, s2, visible) -> i, j, frames seen, mean Stokes parameters over them, degree and angle."""
    seen = cells.where("visible").groupBy("i", "j").agg(F.count("*").alias("frames"), *[F.avg(f"s{k}").alias(f"s{k}") for k in range(3)])
    s0, s1, s2 = (F.col(f"s{k}") for k in range(3))
    return seen.select("i", "j", "frames", "s0", "s1", "s2", g.polarisation_degree(s0, s1, s2).alias("dolp"), g.polarisation_angle(s1, s2).alias("aolp"))


def mean_surface(cells: DataFrame) -> DataFrame:
    """cells (t, i, j, z, nx, ny, nz) -> i, j, mean height, and the mean normal scaled to unit length again."""
    m = cells.groupBy("i", "j").agg(F.avg("z").alias("z"), *[F.avg(f"n{k}").alias(f"n{k}") for k in "xyz"])
    n = F.nullif(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(0.0))
    return m.select("i", "j", "z", *[(F.col(f"n{k}") / n).alias(f"n{k}") for k in "xyz"])


def polarimetry(cube: DataFrame, images: DataFrame, rows: int, cols: int, camera: Sequence[Sequence[float]], eye: tuple[float, float, float], most: float = 85.0) -> DataFrame:
    """cube (t, i, j, z) and images (t, i, j, s0, s1, s2) -> t, i, j, z, normal, angle, visible, s0, s1, s2: each cell's
    Stokes parameters where the camera sees it. Cells turned from the eye by `most` degrees, or hidden, aren't visible;
    what the image doesn't hold is null. mean_polarisation() and mean_surface() average the result."""
    seen = temporal.visibility(cube, rows, cols, eye, most)
    cells = temporal.slopes(cube).select("t", "i", "j", "z", "nx", "ny", "nz").join(seen, ["t", "i", "j"])
    u, v = g.projected(F.col("j").cast("double"), F.col("i").cast("double"), F.col("z"), camera)
    places = cells.select("t", (F.col("i").cast("long") * _CELL + F.col("j")).alias("id"), v.alias("fi"), u.alias("fj")).where((F.abs("fi") < 1e9) & (F.abs("fj") < 1e9))
    out = cells.withColumn("id", F.col("i").cast("long") * _CELL + F.col("j"))
    for k in ("s0", "s1", "s2"):
        out = out.join(sampled(images.select("t", "i", "j", F.col(k).alias("z")), places).withColumnRenamed("z", k), ["t", "id"], "left")
    return out.select("t", "i", "j", "z", "nx", "ny", "nz", "angle", (F.col("visible") & F.col("s0").isNotNull()).alias("visible"), "s0", "s1", "s2")


def _poses(e: np.ndarray) -> list[tuple[list[float], list[float]]]:
    """The four poses of an essential matrix."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [((u @ m @ v).ravel().tolist(), (s * u[:, 2]).tolist()) for m in (w, w.T) for s in (1.0, -1.0)]


def _essential(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least squares over eight matches or more, in coordinates moved and scaled to unit spread, with the two
    equal singular values that an essential matrix has."""

    def scaling(p):
        m, s = p.mean(axis=0), max(np.sqrt(p.var(axis=0).sum()), 1e-12)
        return np.array([[1 / s, 0, -m[0] / s], [0, 1 / s, -m[1] / s], [0, 0, 1]])

    ta, tb = scaling(a), scaling(b)
    d = design(a * ta[0, 0] + ta[:2, 2], b * tb[0, 0] + tb[:2, 2]) * np.sqrt(weight)[:, None]
    u, s, v = np.linalg.svd(tb.T @ np.linalg.eigh(d.T @ d)[1][:, 0].reshape(3, 3) @ ta)
    return u @ np.diag([1.0, 1.0, 0.0]) @ v


def depths(a: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depths of matches in both cameras, from the rays' least-squares crossing."""
    x, y = np.c_[a, np.ones(len(a))] @ r.T, np.c_[b, np.ones(len(b))]
    # z1 * y - z0 * x = t, solved for both depths
    xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
    det = np.where(np.abs(d := xx * yy - xy * xy) > 1e-15, d, np.nan)
    tx, ty = x @ t, y @ t
    return (xy * ty - yy * tx) / det, (xx * ty - xy * tx) / det


def _inliers(pdf: pd.DataFrame, threshold: float, rounds: int, seed: int, confidence: float) -> pd.DataFrame:
    """One frame of epipolar_inliers() in pandas."""
    return _frame_inliers(pa.Table.from_pandas(pdf, preserve_index=False), threshold, rounds, seed, confidence).to_pandas()


def _frame_inliers(table: pa.Table, threshold: float, rounds: int, seed: int, confidence: float) -> pa.Table:
    keys = [table.column(c).to_numpy() for c in ("m", "ax", "ay", "bx", "by")]
    order = np.lexsort(keys[::-1])
    a, b = (np.stack([keys[k][order], keys[k + 1][order]], axis=1).astype(float) for k in (1, 3))
    n = len(a)
    rng = np.random.default_rng([seed, (table.column("frame")[0].as_py() or 0) & (2**63 - 1)])
    best, good, made = consensus(a, b, threshold, rng, rounds, confidence)

    def rows(inlier, ahead, r, t):
        each = lambda v: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(v), np.tile(v, n))
        return pa.table({"frame": table.column("frame"), "m": table.column("m").take(pa.array(order)), "draws": np.full(n, made), "inlier": inlier, "ahead": ahead, "r": each(r), "t": each(t)})

    if best is None:
        return rows(good, good, np.empty(0), np.empty(0))
    cost = np.minimum(sampson(best, a, b) / threshold, 1).sum()
    for _ in range(20):  # settle on all inliers; those far beyond most, as chance ones are, hardly count (Cauchy weights)
        if good.sum() < 8:
            break
        off = sampson(best, a[good], b[good])
        e = _essential(a[good], b[good], 1 / (1 + (off / max(3 * np.median(off), 1e-14)) ** 2))
        e /= np.linalg.norm(e) * (np.sign((e * best).sum()) or 1.0)
        away = sampson(e, a, b)
        near, left = away < threshold, np.minimum(away / threshold, 1).sum()
        if near.sum() < good.sum() and left >= cost:  # a chance inlier less is no loss if the others lie nearer
            break
        best, same, good, cost = e, (near == good).all() and np.abs(e - best / np.linalg.norm(best)).max() < 1e-12, near, left
        if same:
            break
    votes = []
    for r, t in _poses(best):
        r, t = np.array(r).reshape(3, 3), np.array(t)
        z0, z1 = depths(a, b, r, t)
        votes.append((((z0 > 0) & (z1 > 0) & good).sum(), r[0, 0], r, t, (z0 > 0) & (z1 > 0)))
    _, _, r, t, ahead = max(votes, key=lambda v: v[:2])
    return rows(good, ahead & good, r.ravel(), t)


def epipolar_inliers(matches: DataFrame, threshold: float, rounds: int = 1000, seed: int = 1, confidence: float = 0.9999) -> DataFrame:
    """Normalised matches (frame, m, ax, ay, bx, by) -> frame, m, draws, inlier, ahead, r, t: matches within `threshold`
    (a pixel's share of the focal length) of the epipolar geometry of the least sum of distances, cut off there, those of them in front of both
    cameras, and the pose that puts most there (ties to the larger first element of r). Geometries come from draws of
    five matches, seeded by frame, until `rounds` or until the inliers found make more draws needless at the given
    confidence; the best one is refitted to its inliers, by weights that fall with distance, while it keeps them or the sum of distances, each cut off
    at the threshold, falls. Frames of fewer than six matches have no
    inliers. A frame's matches, some thousands at most, meet in one task."""
    rows = matches.select(F.col("frame").cast("long").alias("frame"), F.col("m").cast("long").alias("m"), *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    return rows.groupBy("frame").applyInArrow(lambda table: _frame_inliers(table, threshold, rounds, seed, confidence), "frame long, m long, draws long, inlier boolean, ahead boolean, r array<double>, t array<double>")


def essential_matrices(matches: DataFrame) -> DataFrame:
    """Normalised matches (frame, ax, ay, bx, by) -> frame, pose 0..3, r (nine), t (three of unit length): candidates of
    the essential matrix of least squares. Only 45 sums a frame leave the executors' aggregation."""
    x = centred(matches)
    a = [F.col("ax"), F.col("ay"), F.lit(1.0)]
    b = [F.col("bx"), F.col("by"), F.lit(1.0)]
    row = [y * x for y in b for x in a]
    sums = x.groupBy("frame").agg(F.any_value("ma").alias("ma"), F.any_value("mb").alias("mb"), *[F.sum(row[i] * row[j]).alias(f"n{i}{j}") for i in range(9) for j in range(i, 9)])

    def scaling(m):
        return np.array([[1 / m[2], 0, -m[0] / m[2]], [0, 1 / m[2], -m[1] / m[2]], [0, 0, 1]])

    def solve(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                m = np.zeros((9, 9))
                for i in range(9):
                    for j in range(i, 9):
                        m[i, j] = m[j, i] = getattr(x, f"n{i}{j}")
                e = scaling(x.mb).T @ np.linalg.eigh(m)[1][:, 0].reshape(3, 3) @ scaling(x.ma)
                out += [(x.frame, k, r, t) for k, (r, t) in enumerate(_poses(e))]
            yield pd.DataFrame(out, columns=["frame", "pose", "r", "t"])

    return sums.mapInPandas(solve, "frame long, pose int, r array<double>, t array<double>")


def poses(matches: DataFrame) -> DataFrame:
    """The candidate with most points in front of both cameras in each frame: frame, r, t, votes; of equal ones the one
    of larger first rotation element."""
    cand = essential_matrices(matches)
    x = matches.join(cand, "frame")
    r = [[F.element_at("r", 3 * i + j + 1) for j in range(3)] for i in range(3)]
    t = [F.element_at("t", k + 1) for k in range(3)]
    p = g.triangulated(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), r, t)
    ahead = (p[2] > 0) & (r[2][0] * p[0] + r[2][1] * p[1] + r[2][2] * p[2] + t[2] > 0)
    votes = x.groupBy("frame", "pose").agg(F.count_if(ahead).alias("votes"))
    best = votes.join(cand, ["frame", "pose"]).groupBy("frame").agg(F.max_by(F.struct("r", "t", "votes"), F.struct("votes", F.element_at("r", 1))).alias("m"))
    return best.select("frame", "m.*")
