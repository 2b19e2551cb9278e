"""Shadow casting over surfaces of any size: rays cross tiles as rows, and skip what a pyramid of maxima lets them skip.

A ray goes from a cell towards the eye one cell at a time. Where the largest height of a tile, or of a block of tiles,
is below all that the ray has there, none of its samples can block it, and it goes on behind at once. Rays that can't
skip a tile meet its heights in a task, and come out hidden, done, or at the next tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.tables import bounded, cut, discard

#: Tiles to a side of a block of the next level; tiles whose maxima tasks are sent at once; rays that meet a tile together.
SIDE, MAXIMA, RAYS = 4, 1_000_000, 1 << 18
_RAY = "t int, i int, j int, z double, n long"


def _slopes(i, j, z, eye):
    """Steps along i, j and z, the longer of the first two of one cell, and how many lead to the eye."""
    d = [eye[0] - i, eye[1] - j, eye[2] - z]
    longest = np.maximum(np.maximum(np.abs(d[0]), np.abs(d[1])), 1e-12)
    return [x / longest for x in d], longest


def pyramid(tiles: list[tuple[int, int, float]], rows: int, cols: int, tile: int) -> list[np.ndarray]:
    """Largest heights of one frame's tiles, then of blocks of SIDE x SIDE of those, and so on to one block."""
    level = np.full((-(-rows // tile), -(-cols // tile)), -np.inf)
    for a, b, top in tiles:
        level[a, b] = top
    out = [level]
    while level.size > 1:
        wide = np.full([-(-s // SIDE) * SIDE for s in level.shape], -np.inf)
        wide[: level.shape[0], : level.shape[1]] = level
        level = wide.reshape(wide.shape[0] // SIDE, SIDE, wide.shape[1] // SIDE, SIDE).max(axis=(1, 3))
        out.append(level)
    return out


def skipped(i, j, z, n, eye, rows: int, cols: int, tile: int, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, ti, tj) of rays at step n: the first step whose tile they can't skip, and the tile; -1 for rays that see the eye."""
    (di, dj, dz), longest = _slopes(i, j, z, eye)
    n, top = n.copy(), levels[-1].max()
    ti, tj = np.full(len(n), -1), np.full(len(n), -1)
    open_ = np.arange(len(n))
    while len(open_):
        k = n[open_]
        p, q, h = i[open_] + k * di[open_], j[open_] + k * dj[open_], z[open_] + k * dz[open_]
        live = (k < longest[open_]) & (p > -0.5) & (p < rows - 0.5) & (q > -0.5) & (q < cols - 0.5) & (h <= top)
        open_, k, p, q, h = open_[live], k[live], p[live], q[live], h[live]
        a, b = np.rint(p).astype(int), np.rint(q).astype(int)
        stuck, to = np.ones(len(k), bool), k.copy()
        for level in range(len(levels) - 1, -1, -1):
            size = tile * SIDE**level
            steps = np.full(len(k), np.inf)
            for x, at, d in ((p, a, di[open_]), (q, b, dj[open_])):
                edge = np.where(d > 0, (at // size + 1) * size - 0.5, at // size * size - 0.5)
                with np.errstate(divide="ignore", invalid="ignore"):
                    steps = np.minimum(steps, np.where(d == 0, np.inf, np.floor((edge - x) / d) - 1))
            last = k + np.clip(steps, 0, rows + cols).astype(np.int64)  # still inside the block, for certain
            free = np.minimum(h, z[open_] + last * dz[open_]) > levels[level][a // size, b // size]
            to = np.where(stuck & free, last + 1, to)
            stuck &= ~free
        ti[open_[stuck]], tj[open_[stuck]] = a[stuck] // tile, b[stuck] // tile
        n[open_] = to
        open_ = open_[~stuck]
    return n, ti, tj


def _tested(eye, rows: int, cols: int, tile: int):
    def run(key, rays: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(rays):
            return pd.DataFrame(columns=["t", "i", "j", "z", "n", "hidden"])
        ti, tj = int(rays.ti.iloc[0]), int(rays.tj.iloc[0])
        heights = np.full((tile, tile), np.nan)
        heights[cells.i.to_numpy() - ti * tile, cells.j.to_numpy() - tj * tile] = cells.z.to_numpy()
        i, j, z, n = (rays[c].to_numpy() for c in ("i", "j", "z", "n"))
        (di, dj, dz), longest = _slopes(i, j, z, eye)
        n, hidden, here = n.copy(), np.zeros(len(n), bool), np.arange(len(n))
        while len(here):
            k = n[here]
            p, q = i[here] + k * di[here], j[here] + k * dj[here]
            a, b = np.rint(p).astype(int) - ti * tile, np.rint(q).astype(int) - tj * tile
            inside = (k < longest[here]) & (a >= 0) & (a < tile) & (b >= 0) & (b < tile)
            here, k, a, b = here[inside], k[inside], a[inside], b[inside]
            hit = heights[a, b] >= z[here] + k * dz[here]
            hidden[here[hit]] = True
            n[here[~hit]] += 1
            here = here[~hit]
        return rays[["t", "i", "j", "z"]].assign(n=n, hidden=hidden)

    return run


def occluded(cube: DataFrame, rows: int, cols: int, eye: tuple[float, float, float], tile: int = 256) -> DataFrame:
    """cube (t, i, j, z), i and j from 0 -> t, i, j, z: 1 where the eye (row, column, height) is hidden, else 0, for every
    cell with a height; no task holds a frame.

    A ray goes to the nearest samples, one cell at a time along its longer side, and is blocked where the surface reaches
    it; it ends at the eye, at the border, or above all heights. Missing cells block nothing. The maxima that tasks are
    sent are bounded: frames go in as many blocks as that takes. An empty table gives an empty result."""
    at = {"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")}
    cells = cut(cube.where("z is not null and not isnan(z)").select(F.col("t").cast("int").alias("t"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("z").cast("double").alias("z")).withColumns(at), "surface")
    maxima = cut(cells.groupBy("t", "ti", "tj").agg(F.max("z").alias("z")), "maxima")
    blocks = max(1, -(-maxima.count() // MAXIMA))
    found = None
    for k in range(blocks):
        of = lambda df: df.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)  # noqa: E731, B023  used at once
        got = _hidden(of(cells), of(maxima).collect(), rows, cols, eye, tile)
        found = got if found is None else found.union(got)
    return cells.select("t", "i", "j").join(found.withColumn("z", F.lit(1.0)), ["t", "i", "j"], "left").select("t", "i", "j", F.coalesce("z", F.lit(0.0)).alias("z"))


def _hidden(cells: DataFrame, maxima: list, rows: int, cols: int, eye, tile: int) -> DataFrame:
    by_frame: dict[int, list] = {}
    for r in maxima:
        by_frame.setdefault(r.t, []).append((r.ti, r.tj, r.z))

    def skip(batches):
        levels: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            t, i, j, z, n = (batch.column(k).to_numpy() for k in range(5))
            for frame in np.unique(t):
                if frame not in levels:
                    levels = {frame: pyramid(by_frame[frame], rows, cols, tile)}
                own = np.flatnonzero(t == frame)
                step, ti, tj = skipped(i[own], j[own], z[own], n[own], eye, rows, cols, tile, levels[frame])
                stay = np.flatnonzero(ti >= 0)
                kept = batch.take(pa.array(own[stay]))
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], pa.array(step[stay], pa.int64()), pa.array(ti[stay], pa.int32()), pa.array(tj[stay], pa.int32())], names=["t", "i", "j", "z", "n", "ti", "tj"])

    rays, found, names = cells.select("t", "i", "j", "z", F.lit(1).cast("long").alias("n")), None, ["t", "ti", "tj"]
    while True:
        here = cut(rays.mapInArrow(skip, f"{_RAY}, ti int, tj int"), "rays")
        load = bounded(cut(here.groupBy(*names).agg(F.ceil(F.count("*") / RAYS).cast("int").alias("parts")), "loads"))
        sent = here.join(load, names).withColumn("part", F.pmod(F.xxhash64("i", "j"), F.col("parts")).cast("int"))
        held = cells.join(load, names).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = sent.groupBy(*names, "part").cogroup(held.select(F.col("t").alias("ot"), F.col("ti").alias("oi"), F.col("tj").alias("oj"), F.col("part").alias("op"), "i", "j", "z").groupBy("ot", "oi", "oj", "op"))
        got = cut(met.applyInPandas(_tested(eye, rows, cols, tile), f"{_RAY}, hidden boolean"), "tested")
        discard(here)
        hidden = got.where("hidden").select("t", "i", "j")
        found = hidden if found is None else found.union(hidden)
        rays = got.where("not hidden").select("t", "i", "j", "z", "n")
        if rays.isEmpty():
            return found
