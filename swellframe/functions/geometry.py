"""Column expressions for planes, cameras, matches, polarisation and disparities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column


def plane_rotation(a: float, b: float, c: float) -> list[list[float]]:
    """Rotation that takes the unit normal (a, b, c) to the z axis; a vertical normal gives the identity."""
    flat = a * a + b * b
    if flat == 0:
        return [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    q = (1 - c) / flat
    return [[1 - a * a * q, -a * b * q, -a], [-a * b * q, 1 - b * b * q, -b], [a, b, c]]


def plane_axes(a: Column, b: Column, c: Column) -> list[list[Column]]:
    """As plane_rotation, over columns."""
    flat = a * a + b * b
    q = F.coalesce((1 - c) / F.nullif(flat, F.lit(0.0)), F.lit(0.0))
    return [[1 - a * a * q, -a * b * q, -a], [-a * b * q, 1 - b * b * q, -b], [a, b, c]]


def aligned(x: Column, y: Column, z: Column, plane: Sequence[Number], baseline: float = 1.0) -> list[Column]:
    """A point in the plane's axes, its height above the plane upwards, in units of the baseline."""
    r = plane_axes(*[F.lit(p) if not isinstance(p, Column) else p for p in plane[:3]])
    out = [r[k][0] * x + r[k][1] * y + r[k][2] * z for k in range(3)]
    return [out[0] * baseline, out[1] * baseline, -(out[2] + plane[3]) * baseline]


def elevation(x: Column, y: Column, z: Column, plane: Sequence[Number], baseline: float = 1.0) -> Column:
    return -(x * plane[0] + y * plane[1] + z * plane[2] + plane[3]) * baseline


def normalised(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    return (u - cx) / fx, (v - cy) / fy


def projected(x: Column, y: Column, z: Column, p: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Image place of a point under a 3 x 4 matrix; null where the third coordinate is 0."""
    h = [r[0] * x + r[1] * y + r[2] * z + r[3] for r in p]
    w = F.nullif(h[2], F.lit(0.0))
    return h[0] / w, h[1] / w


def unwarped(u: Column, v: Column, back: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A rectified pixel back in the camera's image by the inverse of a given homography."""
    w = F.nullif(back[2][0] * u + back[2][1] * v + back[2][2], F.lit(0.0))
    return (back[0][0] * u + back[0][1] * v + back[0][2]) / w, (back[1][0] * u + back[1][1] * v + back[1][2]) / w


def unrectified(u: Column, v: Column, f: float, c: tuple[float, float], r: Sequence[Sequence[float]], k: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """A rectified pixel back in the camera's image: by the inverse of rotation r, then fx, fy, cx, cy in k."""
    x, y = (u - c[0]) / f, (v - c[1]) / f
    h = [r[0][i] * x + r[1][i] * y + r[2][i] for i in range(3)]
    w = F.nullif(h[2], F.lit(0.0))
    return k[0] * (h[0] / w) + k[2], k[1] * (h[1] / w) + k[3]


def triangulated(px: Column, py: Column, qx: Column, qy: Column, r: Sequence[Sequence[float]], t: Sequence[float]) -> list[Column]:
    """Least-squares point of two normalised views, the second camera at (r, t): normal equations by Cramer's rule;
    null where they are singular."""
    rows = [
        ([F.lit(1.0), F.lit(0.0), -px], F.lit(0.0)),
        ([F.lit(0.0), F.lit(1.0), -py], F.lit(0.0)),
        ([F.lit(r[0][k]) - qx * r[2][k] for k in range(3)], qx * t[2] - t[0]),
        ([F.lit(r[1][k]) - qy * r[2][k] for k in range(3)], qy * t[2] - t[1]),
    ]
    n = [[sum((a[i] * a[j] for a, _ in rows[1:]), rows[0][0][i] * rows[0][0][j]) for j in range(3)] for i in range(3)]
    b = [sum((a[i] * y for a, y in rows[1:]), rows[0][0][i] * rows[0][1]) for i in range(3)]

    def det(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = F.nullif(det(n), F.lit(0.0))
    return [det([[b[i] if j == k else n[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]


def distance(p: Sequence[Column], q: Sequence[Column], scale: float = 1.0) -> Column:
    """Distance of two points, in units of the baseline times `scale`."""
    d = [a - b for a, b in zip(p, q, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * scale


def disparity(raw: Column, low: float, count: float, offset: float = 0.0, scale: float = 1.0) -> Column:
    """Disparity from sixteenths: null unless low < d <= count."""
    d = raw / 16.0
    return F.when((d > low) & (d <= count), (d + offset) / scale)


def left_column(xr: Column, d: Column, roi_right: float, roi_left: float, shift: float = 0.0) -> Column:
    return xr - roi_right + roi_left - d + shift


def wrapped(angle: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def similarity(sx: Column, sy: Column, sa: Column, ss: Column, tx: Column, ty: Column, ta: Column, ts: Column) -> dict[str, Column]:
    """Rotation, scale and shift of a match from a source to a target feature."""
    turn, scale = wrapped(sa - ta), ts / F.nullif(ss, F.lit(0.0))
    sin, cos = F.sin(turn), F.cos(turn)
    return {"sin": sin, "cos": cos, "dx": tx - scale * (cos * sx - sin * sy), "dy": ty - scale * (sin * sx + cos * sy), "ds": scale}


def epipolar_error(x0: Column, y0: Column, x1: Column, y1: Column, f: Sequence[Sequence[float]]) -> Column:
    """Mean distance of two matched places to each other's epipolar lines."""
    line1 = [f[k][0] * x0 + f[k][1] * y0 + f[k][2] for k in range(3)]
    line0 = [f[0][k] * x1 + f[1][k] * y1 + f[2][k] for k in range(3)]

    def distance(line, x, y):
        return F.abs(line[0] * x + line[1] * y + line[2]) / F.nullif(F.sqrt(line[0] * line[0] + line[1] * line[1]), F.lit(0.0))

    return (distance(line1, x1, y1) + distance(line0, x0, y0)) / 2


def incidence(nx: Column, ny: Column, nz: Column, x: Column, y: Column, z: Column, eye: Sequence[float]) -> Column:
    """Angle in degrees between a normal and the direction to the eye."""
    d = [x - eye[0], y - eye[1], z - eye[2]]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    cosine = -(nx * d[0] + ny * d[1] + nz * d[2]) / F.nullif(n, F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def stokes(i0: Column, i45: Column, i90: Column, i135: Column) -> tuple[Column, Column, Column]:
    """Stokes parameters after mixing each channel with what the other three imply for it."""
    own, rest = 0.75, 0.25
    a, b = i0 * own + (i45 + i135 - i90) * rest, i45 * own + (i0 + i90 - i135) * rest
    c, d = i90 * own + (i45 + i135 - i0) * rest, i135 * own + (i0 + i90 - i45) * rest
    return (a + b + c + d) * 0.5, a - c, b - d


def polarisation_degree(s0: Column, s1: Column, s2: Column) -> Column:
    return F.sqrt(s1 * s1 + s2 * s2) / F.nullif(s0, F.lit(0.0))


def polarisation_angle(s1: Column, s2: Column) -> Column:
    """Half of atan2(s1, s2), taken to [0, 2 pi), less 3.1415 (fixed value)."""
    return (F.pmod(F.atan2(s1, s2), F.lit(2 * math.pi)) - 3.1415) / 2


def fused(channels: Sequence[Column], centre: float = 0.5, sigma: float = 0.3) -> Column:
    """Weighted mean of channels, each weighted by a Gaussian around a well exposed value."""
    weights = [F.exp(-((c - centre) * (c - centre)) / (2 * sigma * sigma)) for c in channels]
    total = sum(weights[1:], weights[0])
    return sum((w * c for w, c in zip(weights[1:], channels[1:], strict=True)), weights[0] * channels[0]) / total


def to_byte(x: Column, gain: float = 127.0) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(x * gain))).cast("int")


def determinant(m: Sequence[Sequence[Column]]) -> Column:
    """Of a 3 x 3 matrix of columns."""
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """Of a 3 x 3 matrix of columns; null where it is singular."""
    whole = F.nullif(determinant(m), F.lit(0.0))

    def cofactor(i, j):
        a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return (m[a[0]][b[0]] * m[a[1]][b[1]] - m[a[0]][b[1]] * m[a[1]][b[0]]) * (-1 if (i + j) % 2 else 1)

    return [[cofactor(j, i) / whole for j in range(3)] for i in range(3)]
