"""Epipolar geometry from five matches, many draws at a time, and the number of draws that a confidence asks for."""

from __future__ import annotations

import itertools

import numpy as np

#: Monomials of degree 3 in x, y, z, then those of degree 2 and less: the order of the columns of the equations.
_CUBIC = [(3, 0, 0), (2, 1, 0), (1, 2, 0), (0, 3, 0), (2, 0, 1), (1, 1, 1), (0, 2, 1), (1, 0, 2), (0, 1, 2), (0, 0, 3)]
_LOWER = [(2, 0, 0), (1, 1, 0), (0, 2, 0), (1, 0, 1), (0, 1, 1), (0, 0, 2), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]
_PLACE = {m: k for k, m in enumerate(_CUBIC + _LOWER)}


def _monomials() -> np.ndarray:
    """(4 * 4 * 4, 20): which monomial a product of three of x, y, z, 1 is."""
    out = np.zeros((64, 20))
    for k, factors in enumerate(itertools.product(range(4), repeat=3)):
        out[k, _PLACE[tuple(factors.count(v) for v in range(3))]] = 1.0
    return out


_TO_MONOMIALS = _monomials()


def design(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of the equations b' E a = 0 of normalised places (..., n, 2)."""
    one = np.ones((*a.shape[:-1], 1))
    a, b = np.concatenate([a, one], axis=-1), np.concatenate([b, one], axis=-1)
    return (b[..., :, None] * a[..., None, :]).reshape(*a.shape[:-1], 9)


def five_point(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws of five matches (m, 5, 2) -> (draw, essential matrix of unit size), up to ten a draw.

    Five equations leave a space of four matrices; what singles out the essential ones in it are ten cubic equations,
    det E = 0 and 2 E E'E = tr(E E') E, in the three free weights x, y, z. Solved for the ten cubic monomials, they say
    what multiplying the ten lower ones by x gives; that map's eigenvectors are the solutions."""
    _, _, v = np.linalg.svd(design(a, b), full_matrices=True)
    e = np.moveaxis(v[:, 5:].reshape(-1, 4, 3, 3), 1, -1)  # (m, 3, 3, weights x, y, z, 1)
    count = len(e)
    square = (e.transpose(0, 1, 3, 2).reshape(count, 12, 3) @ e.transpose(0, 2, 1, 3).reshape(count, 3, 12)).reshape(count, 3, 4, 3, 4)
    both = 2 * square.transpose(0, 1, 2, 4, 3)  # (m, i, a, b, k) of 2 E E' less its trace
    both[:, range(3), :, :, range(3)] -= np.trace(square, axis1=1, axis2=3)
    nine = (both.reshape(count, 48, 3) @ e.reshape(count, 3, 12)).reshape(count, 3, 4, 4, 3, 4).transpose(0, 1, 4, 2, 3, 5)
    up, down = [1, 2, 0], [2, 0, 1]
    cross = e[:, 1, up, :, None] * e[:, 2, down, None, :] - e[:, 1, down, :, None] * e[:, 2, up, None, :]
    det = e[:, 0].transpose(0, 2, 1) @ cross.reshape(count, 3, 16)
    equations = np.concatenate([nine.reshape(count, 9, 64), det.reshape(count, 1, 64)], axis=1) @ _TO_MONOMIALS
    good = np.linalg.cond(equations[:, :, :10]) < 1e12
    which = np.flatnonzero(good)
    if not len(which):
        return np.empty(0, int), np.empty((0, 3, 3))
    reduced = np.linalg.solve(equations[good, :, :10], equations[good, :, 10:])
    action = np.zeros((len(which), 10, 10))
    for k, (x, y, z) in enumerate(_LOWER):
        to = _PLACE[(x + 1, y, z)]
        if to < 10:
            action[:, k] = -reduced[:, to]
        else:
            action[:, k, to - 10] = 1.0
    values, vectors = np.linalg.eig(action)
    last = vectors[:, 9, :]
    real = (np.abs(values.imag) < 1e-9 * np.maximum(1.0, np.abs(values))) & (np.abs(last) > 1e-12)
    draw, k = np.nonzero(real)
    weights = (vectors[draw, 6:9, k] / last[draw, k][:, None]).real
    found = np.einsum("sija,sa->sij", e[which[draw]], np.c_[weights, np.ones(len(draw))])
    return which[draw], found / np.linalg.norm(found, axis=(1, 2))[:, None, None]


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First-order distances of matches (n, 2) to their epipolar lines; of one matrix, or of many at once."""
    a, b = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    la, lb = a @ np.swapaxes(e, -1, -2), b @ e
    return np.abs((b * la).sum(axis=-1)) / np.sqrt(np.maximum((la[..., :2] ** 2).sum(axis=-1) + (lb[..., :2] ** 2).sum(axis=-1), 1e-300))


def draws_needed(share: float, confidence: float, size: int = 5) -> float:
    """Draws of `size` matches after which one without an outlier was among them with the given confidence."""
    clean = share**size
    if clean <= 0:
        return np.inf
    return 0.0 if clean >= 1 else np.log1p(-confidence) / np.log1p(-clean)


def consensus(a: np.ndarray, b: np.ndarray, threshold: float, rng: np.random.Generator, rounds: int = 1000, confidence: float = 0.9999, batch: int = 32) -> tuple[np.ndarray | None, np.ndarray, int]:
    """(essential matrix, its inliers, draws made): the matrix of the least sum of distances among five-match draws, each cut off at the
    threshold, so that a match within it counts the more the nearer it lies. Draws stop at `rounds`, or as soon as the best one's share of inliers makes another clean draw
    needless at the given confidence."""
    n = len(a)
    best, good, made = None, np.zeros(n, bool), 0
    if n < 6:  # five matches always fit
        return best, good, made
    pa, pb, rows = np.c_[a, np.ones(n)].T, np.c_[b, np.ones(n)].T, design(a, b).T
    step = max(1, 2_000_000 // n)  # matrices measured together

    def squares(e, to):
        """Squares of the distances that sampson() gives the first `to` matches."""
        x, y = (e[:, :2].reshape(-1, 3) @ pa[:, :to]).reshape(len(e), 2, -1), (e[:, :, :2].swapaxes(1, 2).reshape(-1, 3) @ pb[:, :to]).reshape(len(e), 2, -1)
        lines = x[:, 0] * x[:, 0] + x[:, 1] * x[:, 1] + y[:, 0] * y[:, 0] + y[:, 1] * y[:, 1]
        return (e.reshape(-1, 9) @ rows[:, :to]) ** 2 / np.maximum(lines, 1e-300)

    least, needed = n, np.inf
    while made < min(rounds, needed):
        size = int(min(batch if best is None else 4 * batch, rounds - made, np.ceil(needed) - made))
        pick = rng.random((size, n)).argpartition(4, axis=1)[:, :5]
        draw, e = five_point(a[pick], b[pick])
        first = min(n, int(least) + 16)
        if first < n and len(e):  # those that already miss more matches than the best one's sum
            may = np.concatenate([(squares(e[k : k + step], first) >= threshold**2).sum(axis=1) for k in range(0, len(e), step)]) <= least
            draw, e = draw[may], e[may]
        sums = np.concatenate([np.minimum(np.sqrt(squares(e[k : k + step], n)) / threshold, 1).sum(axis=1) for k in range(0, len(e), step)]) if len(e) else np.empty(0)
        top = np.full(size, np.inf)
        np.minimum.at(top, draw, sums)
        for d, reached in enumerate(top.tolist()):  # draws count one by one, so that the batch makes no difference
            if made >= needed:
                break
            made += 1
            if reached < least:
                k = np.flatnonzero((draw == d) & (sums == reached))[0]
                best, good, least = e[k], squares(e[k : k + 1], n)[0] < threshold**2, reached
                needed = draws_needed(good.sum() / n, confidence)
    return best, good, made
