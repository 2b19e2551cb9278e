"""Matrices of one rig: projections, inverses, swaps, fundamental matrices and plane views. Small and driver-side; the
results go into column expressions as literals."""

from __future__ import annotations

import numpy as np

from swellframe.functions.geometry import plane_rotation


def projection(k: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return k @ np.c_[r, t]


def inverse_pose(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return r.T, -r.T @ t


def swapped(left: dict, right: dict, r: np.ndarray, t: np.ndarray) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """The rig with its cameras exchanged if the second stands left of the first."""
    return (left, right, r, t) if t[0] < 0 else (right, left, *inverse_pose(r, t))


def rescaled(k: np.ndarray, scale: float) -> np.ndarray:
    out = k * scale
    out[2, 2] = 1.0
    return out


def fundamental(k0: np.ndarray, k1: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of pixels: x1' F x0 = 0."""
    cross = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    return np.linalg.inv(k1).T @ cross @ r @ np.linalg.inv(k0)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of four points or more, (n, 2) each, by least squares; the last element is 1."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2]


def plane_pose(plane: tuple[float, float, float, float]) -> np.ndarray:
    """4 x 4 matrix into the plane's axes."""
    out = np.eye(4)
    out[:3, :3] = plane_rotation(*plane[:3])
    out[2, 3] = plane[3]
    return out


def plane_camera(p: np.ndarray, plane: tuple[float, float, float, float], baseline: float) -> np.ndarray:
    """3 x 4 projection of metric points of the plane's axes, heights upwards, given one of camera axes."""
    metric = np.diag([1 / baseline, 1 / baseline, -1 / baseline, 1.0])
    return p @ np.linalg.inv(plane_pose(plane)) @ metric


def grid_matrices(p: np.ndarray, plane: tuple[float, float, float, float], baseline: float, k: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """3 x 4 projection of metric points of the plane's axes to places from -1 to 1 in an image of `size`, and the
    4 x 4 matrix that takes camera points to the metric grid."""
    w, h = size
    unit = np.array([[2 / w, 0, -1], [0, 2 / h, -1], [0, 0, 1.0]])
    metric = np.diag([baseline, baseline, -baseline, 1.0])
    pose = np.eye(4)
    pose[:3] = np.linalg.inv(k) @ p
    return unit @ plane_camera(p, plane, baseline), metric @ plane_pose(plane) @ np.linalg.inv(pose)


def corner_homography(p: np.ndarray, corners: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Homography from the image places of four grid corners (4, 3) to the target places (4, 2)."""
    seen = np.c_[corners, np.ones(len(corners))] @ p.T
    return homography(seen[:, :2] / seen[:, 2:], target)


def rotation_quaternion(r: np.ndarray) -> np.ndarray:
    """Unit quaternion (w, x, y, z), w not negative, of a rotation."""
    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], np.trace(r)]])
    x, y, z, w = np.linalg.eigh(k)[1][:, -1]
    return np.array([w, x, y, z]) * (1 if w >= 0 else -1)


def quaternion_rotation(q: np.ndarray) -> np.ndarray:
    w, v = q[0], q[1:]
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def quaternion_product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.r_[p[0] * q[0] - p[1:] @ q[1:], p[0] * q[1:] + q[0] * p[1:] + np.cross(p[1:], q[1:])]


def _distortion(h: np.ndarray, size: tuple[int, int]) -> float:
    """How much a homography's scale differs over the image: the ratio of the corners' largest and smallest depth."""
    w, hh = size
    depth = np.array([[0, 0, 1], [w, 0, 1], [w, hh, 1], [0, hh, 1.0]]) @ h[2]
    return np.inf if (depth <= 0).any() else float(depth.max() / depth.min())


def rectification(k0: np.ndarray, k1: np.ndarray, r: np.ndarray, t: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float, float]]:
    """Homographies of both images that lay matching points on equal rows, and the box (left, top, right, bottom) that
    the middle two of the first image's warped corners span. Both cameras turn so that their rows run along the
    baseline; the turn about the baseline is the one of least perspective distortion, found by golden sections. Each
    homography has determinant 1. Rigs one above the other are refused."""
    base = -r.T @ t
    base = base / np.linalg.norm(base)
    if abs(base[0]) < abs(base[1]):
        raise ValueError("the cameras stand one above the other")
    x = base * np.sign(base[0])
    k = (k0 + k1) / 2
    ahead = np.cross(np.cross(x, [0, 0, 1.0]), x)
    ahead, side = ahead / np.linalg.norm(ahead), np.cross(x, ahead / np.linalg.norm(ahead))

    def both(angle):
        z = np.cos(angle) * ahead + np.sin(angle) * side
        turn = np.stack([x, np.cross(z, x), z])
        out = [k @ turn @ np.linalg.inv(k0), k @ turn @ r.T @ np.linalg.inv(k1)]
        return [h / np.cbrt(np.linalg.det(h)) for h in out]

    cost = lambda angle: max(_distortion(h, size) for h in both(angle))
    tries = np.linspace(-0.8, 0.8, 33)
    best = tries[int(np.argmin([cost(a) for a in tries]))]
    low, high, golden = best - 0.05, best + 0.05, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if cost(a) < cost(b) else (a, high)
    h0, h1 = both((low + high) / 2)
    w, h = size
    corners = np.array([[0, 0, 1], [w, 0, 1], [w, h, 1], [0, h, 1.0]]) @ h0.T
    u, v = np.sort(corners[:, 0] / corners[:, 2]), np.sort(corners[:, 1] / corners[:, 2])
    return h0, h1, (float(u[1]), float(v[1]), float(u[2]), float(v[2]))
