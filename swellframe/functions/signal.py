"""Numpy helpers for filters, spectra and surfaces; each works on one series or one surface."""

from __future__ import annotations

import numpy as np

GRAVITY = 9.81


def butterworth(order: int, cutoff: float, rate: float, high: bool = False) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth filter of even order, by the bilinear
    transform with pre-warping."""
    if order % 2 or not 0 < cutoff < rate / 2:
        raise ValueError("needs an even order and a cutoff between 0 and half the rate")
    w = np.tan(np.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        c = 2 * np.cos(np.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + c * w + w * w
        b = np.array([1, -2, 1]) if high else w * w * np.array([1, 2, 1])
        out.append([*(b / a0), 1.0, 2 * (w * w - 1) / a0, (1 - c * w + w * w) / a0])
    return np.array(out)


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass along the last axis that starts as if the first value had lasted for ever; all rows together."""
    y = x
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        first = y[..., 0]
        z1, z2 = first * (gain - b0), first * (b2 - a2 * gain)
        out = np.empty_like(y)
        for n in range(y.shape[-1]):
            v = y[..., n]
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            out[..., n] = o
        y = out
    return y


def cascade(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(a, b, c, d) of second-order sections in a row: state' = a state + b x, y = c state + d x."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        own, gain = slice(2 * k, 2 * k + 2), np.array([b1 - a1 * b0, b2 - a2 * b0])
        a[own] = np.outer(gain, c)
        a[own, own] = [[-a1, 1.0], [-a2, 0.0]]
        b[own] = gain * d
        c, d = b0 * c, b0 * d
        c[2 * k] += 1.0
    return a, b, c, d


class Recursive:
    """A recursive filter that works on parts of a series: what a part gives from rest, and what the state before it
    adds, are known apart. Within a part, rows of `width` samples are filtered together, too."""

    def __init__(self, sections: np.ndarray, width: int = 256):
        self.a, b, c, d = cascade(sections)
        self.width, n = width, len(b)
        powers = np.empty((width + 1, n, n))
        powers[0] = np.eye(n)
        for k in range(width):
            powers[k + 1] = powers[k] @ self.a
        self.powers = powers
        self.seen = c @ powers[:width]  # (width, n): what the state adds to each sample of a row
        answer = np.r_[d, self.seen[: width - 1] @ b]
        lag = np.arange(width)[:, None] - np.arange(width)
        self.rest = np.where(lag >= 0, answer[np.abs(lag)], 0.0).T  # from rest: row @ this
        self.left = powers[width - 1 :: -1] @ b  # (width, n): what each sample of a row leaves in the state
        self.steady = np.linalg.solve(np.eye(n) - self.a, b)
        self.jumps: dict[int, np.ndarray] = {}

    def jump(self, n: int) -> np.ndarray:
        """What n samples make of a state; parts are mostly of one length."""
        if n not in self.jumps:
            self.jumps[n] = np.linalg.matrix_power(self.a, n)
        return self.jumps[n]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(y, state after) of a part that begins in a state, at rest by default."""
        w, n = self.width, len(x)
        state = np.zeros(len(self.a)) if state is None else state
        rows = n // w
        part = x[: rows * w].reshape(rows, w)
        y, ends, begins = part @ self.rest, part @ self.left, np.empty((rows, len(self.a)))
        for k in range(rows):
            begins[k] = state
            state = self.powers[w] @ state + ends[k]
        y = [(y + begins @ self.seen.T).ravel()]
        if m := n - rows * w:
            tail = x[rows * w :]
            y.append(tail @ self.rest[:m, :m] + self.seen[:m] @ state)
            state = self.powers[m] @ state + tail @ self.left[w - m :]
        return np.concatenate(y), state


def zero_phase(sections: np.ndarray, x: np.ndarray, pad: int = 27) -> np.ndarray:
    """Forward and backward filtering along the last axis, with odd extensions of `pad` samples at both ends."""
    if x.shape[-1] <= pad:
        raise ValueError(f"a series needs more than {pad} samples, got {x.shape[-1]}")
    head = 2 * x[..., :1] - x[..., pad:0:-1]
    tail = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = _run(sections, np.concatenate([head, x, tail], axis=-1))
    return _run(sections, y[..., ::-1])[..., ::-1][..., pad:-pad]


def zero_phase_rows(sections: np.ndarray, rows: list[np.ndarray], pad: int = 27) -> list[np.ndarray]:
    """zero_phase() of series of any lengths, all together: shorter ones are followed by their last value, which the
    backward pass, that begins at each one's own end, never sees."""
    sizes = np.array([len(r) for r in rows])
    if (sizes <= pad).any():
        raise ValueError(f"a series needs more than {pad} samples, got {sizes.min()}")
    wide = np.empty((len(rows), sizes.max() + 2 * pad))
    for out, x in zip(wide, rows, strict=True):
        n = len(x) + 2 * pad
        out[:n] = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        out[n:] = out[n - 1]
    back = np.maximum((sizes + 2 * pad - 1)[:, None] - np.arange(wide.shape[1])[None], 0)
    y = _run(sections, np.take_along_axis(_run(sections, wide), back, axis=1))
    return [r[pad : n + pad][::-1] for r, n in zip(y, sizes, strict=True)]


def welch_rows(rows: list[np.ndarray], rate: float, length: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """welch() of series of any lengths; all segments of one length are transformed together."""
    out: list = [None] * len(rows)
    sizes = np.array([min(length, len(r)) for r in rows])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        hop, window = max(1, size - size // 2), hann_periodic(size)
        parts = [np.lib.stride_tricks.sliding_window_view(rows[k], size)[::hop] for k in own]
        counts = np.array([len(p) for p in parts])
        x = np.concatenate(parts)
        power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (rate * (window**2).sum())
        power[:, 1 : -1 if size % 2 == 0 else None] *= 2
        mean = np.add.reduceat(power, np.cumsum(counts) - counts, axis=0) / counts[:, None]
        f = np.fft.rfftfreq(size, 1 / rate)
        for k, s in zip(own, mean, strict=True):
            out[k] = (f, s)
    return out


def hann_periodic(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, rate: float, length: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Density of segments of `length` with half overlap, a periodic Hann window and the mean taken off each."""
    return welch_rows([x], rate, length)[0]


def low_pass_gain(rows: int, cols: int, step: float, cutoff: float, order: int = 4) -> np.ndarray:
    """Gain over the 2-D spectrum that passes waves longer than those of frequency `cutoff` in deep water."""
    k = 2 * np.pi * cutoff**2 / GRAVITY
    r = np.hypot(np.fft.fftfreq(rows, step)[:, None], np.fft.fftfreq(cols, step)[None])
    return 1 / np.sqrt(1 + (r / k) ** (2 * order))


def centre_window(rows: int, cols: int, shift: int = -20) -> tuple[int, int, int]:
    """First row, first column and odd side of the square of about two thirds of the rows in the middle of a grid,
    its first row moved by `shift` as far as the grid allows."""
    side = min(2 * (rows * 2 // 3 // 2) + 1, cols - (cols % 2 == 0), rows - (rows % 2 == 0))
    r = min(max(rows // 2 - side // 2 + shift, 0), rows - side)
    return r, min(max(cols // 2 - side // 2, 0), cols - side), side


def segment_length(frames: int, segments: int = 10) -> int:
    """Even length of one of `segments` segments."""
    n = frames // segments
    return n + n % 2


def spectrum_scale(nt: int, side: int, rate: float, step: float) -> float:
    """What |fft|^2 of a windowed cube (nt, side, side) is multiplied by for a density over f, ky and kx."""
    dk, df = 2 * np.pi / (step * (side // 2 * 2)), rate / (nt // 2 * 2)
    size = nt * side * side
    correction = 1 / (np.mean(np.hanning(side) ** 2) ** 2 * np.mean(np.hanning(nt) ** 2))
    return float(correction / (size * size * size * dk * dk * df))  # an orthonormal transform, divided by the size, squared


def shadowed(z: np.ndarray, eye: tuple[float, float, float], step: float = 1.0) -> np.ndarray:
    """Cells from which the eye (row, column, height) is hidden: a ray goes one cell at a time along its longer side
    to the nearest samples and is blocked where the surface reaches it; it ends at the border or above all heights."""
    rows, cols = z.shape
    i, j = np.mgrid[0:rows, 0:cols].astype(float)
    di, dj, dz = eye[0] - i, eye[1] - j, eye[2] - z
    longest = np.maximum(np.maximum(np.abs(di), np.abs(dj)), 1e-12)
    di, dj, dz = di / longest, dj / longest, dz / longest
    top, hidden, live = np.nanmax(z, initial=-np.inf), np.zeros(z.shape, bool), ~np.isnan(z)
    for n in range(1, int(max(rows, cols, longest.max())) + 1):
        p, q, height = i + n * di, j + n * dj, z + n * dz
        live &= (n < longest) & (p > -0.5) & (p < rows - 0.5) & (q > -0.5) & (q < cols - 0.5) & (height <= top)
        if not live.any():
            break
        a, b = np.rint(p[live]).astype(int), np.rint(q[live]).astype(int)
        hit = z[a, b] >= height[live]
        where = np.argwhere(live)[hit]
        hidden[where[:, 0], where[:, 1]] = True
        live[where[:, 0], where[:, 1]] = False
    return hidden


def cosine_fill(z: np.ndarray, frequencies: int = 24, sparsity: float = 8e-7, rounds: int = 500, tolerance: float = 1e-4) -> np.ndarray:
    """A dense surface of few cosines through the samples of z (missing ones are NaN): least masked squares plus a
    penalty on the coefficients' sizes, by sign-driven steps that grow while a coefficient keeps its direction."""
    mask = ~np.isnan(z)
    if not mask.any():
        return np.full(z.shape, np.nan)
    centre = z[mask].mean()

    def basis(n):
        k = min(frequencies, n)
        b = np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(k)[None] / n) * np.sqrt(2 / n)
        b[:, 0] /= np.sqrt(2)
        return b

    left, right, want = basis(z.shape[0]), basis(z.shape[1]), np.where(mask, z - centre, 0)
    c = np.zeros((left.shape[1], right.shape[1]))
    step, last = np.full(c.shape, 0.1 * max(want.std(), 1e-9)), np.zeros(c.shape)
    before = c.copy()
    for n in range(1, rounds + 1):
        g = left.T @ (np.where(mask, left @ c @ right.T - want, 0)) @ right * (2 / mask.sum()) + sparsity * np.sign(c)
        turn = g * last
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-9, 50)
        g = np.where(turn < 0, 0, g)
        c = c - np.sign(g) * step
        last = g
        if n % 50 == 0:
            if np.abs(c - before).max() < tolerance:
                break
            before = c.copy()
    return left @ c @ right.T + centre
