"""Linear interpolation of scattered points at grid nodes, over Delaunay triangles.

Nodes are dealt into square tiles, smaller where points are dense. The points of a tile with nodes are triangulated in
one task with those of the cells around it, and a triangle counts only if points still farther away can't change it;
nodes that get none are asked again in tiles twice as wide, so the result is that of one triangulation of all points.
Points far from every node are met by the hull alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.tables import bounded, cut


def circumcircles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of triangles t (m, 3) of points p."""
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    d = np.where(d == 0, 1e-300, d)
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    at = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d], axis=1)
    return a + at, (at * at).sum(axis=1)


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (m, 3) of distinct points (n, 2), counter-clockwise. Points are put in one after another along x: the
    triangles whose circle holds a new point give way to new ones around it, and those whose circle lies behind it are
    finished."""
    n = len(p)
    if n < 3:
        return np.empty((0, 3), int)
    low, high = p.min(axis=0), p.max(axis=0)
    mid, size = (low + high) / 2, max((high - low).max(), 1e-9)
    q = np.concatenate([p, mid + size * 1e4 * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.5]])])
    live = np.array([[n, n + 1, n + 2]])
    centre, radius = circumcircles(q, live)
    done = []
    for k in np.lexsort((p[:, 1], p[:, 0])):
        away = q[k] - centre
        behind = (away[:, 0] > 0) & (away[:, 0] ** 2 > radius * (1 + 1e-12))
        if behind.any():
            done.append(live[behind])
            live, centre, radius, away = live[~behind], centre[~behind], radius[~behind], away[~behind]
        inside = (away * away).sum(axis=1) < radius * (1 + 1e-12)
        old = live[inside]
        edges = np.concatenate([old[:, [0, 1]], old[:, [1, 2]], old[:, [2, 0]]])
        key = np.sort(edges, axis=1)
        _, first, count = np.unique(key[:, 0] * (n + 3) + key[:, 1], return_index=True, return_counts=True)
        rim = edges[first[count == 1]]
        new = np.column_stack([rim, np.full(len(rim), k)])
        c, r = circumcircles(q, new)
        live, centre, radius = np.concatenate([live[~inside], new]), np.concatenate([centre[~inside], c]), np.concatenate([radius[~inside], r])
    t = np.concatenate([*done, live])
    return t[(t < n).all(axis=1)]


def certain(p: np.ndarray, t: np.ndarray, known: tuple[float, float, float, float], box: tuple[float, float, float, float]) -> np.ndarray:
    """Which triangles t of points p no point can take away that lies in `box` but outside `known` (x from, y from, x
    to, y to): those of whose circles the part in the box lies in the known rectangle."""
    c, r2 = circumcircles(p, t)
    r2 = r2 * (1 + 1e-9)
    out = np.ones(len(t), bool)
    for k in (0, 1):
        other = 1 - k
        gap = np.maximum(np.maximum(box[other] - c[:, other], c[:, other] - box[2 + other]), 0.0)
        half = np.sqrt(np.maximum(r2 - gap * gap, 0.0))
        out &= (np.maximum(c[:, k] - half, box[k]) >= known[k]) & (np.minimum(c[:, k] + half, box[2 + k]) <= known[2 + k])
    return out


_COMPASS = np.stack([f(np.arange(16) * np.pi / 8) for f in (np.cos, np.sin)])


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counter-clockwise; fewer than three if they lie in a line."""
    if len(p) > 64:  # those well inside the extremes of sixteen directions go first
        some = p[(p @ _COMPASS).argmax(axis=0)]
        to = np.roll(some, -1, axis=0)
        side = (to[:, 0] - some[:, 0]) * (p[:, 1, None] - some[:, 1]) - (to[:, 1] - some[:, 1]) * (p[:, 0, None] - some[:, 0])
        p = p[~((side > 1e-9 * np.abs(p).max() ** 2) | (some == to).all(axis=1)).all(axis=1) | (some == some[0]).all()]
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low, high = chain(p), chain(p[::-1])
    return np.array(low[:-1] + high[:-1])


def within(corners: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places lie in a convex polygon or on its rim."""
    if len(corners) < 3:
        return np.zeros(len(at), bool)
    a, b = corners, np.roll(corners, -1, axis=0)
    side = (b[:, 0] - a[:, 0]) * (at[:, 1, None] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (at[:, 0, None] - a[:, 0])
    return (side >= -1e-12 * np.abs(corners).max() ** 2).all(axis=1)


def interpolated(p: np.ndarray, z: np.ndarray, at: np.ndarray, sure=None) -> np.ndarray:
    """Heights at places (m, 2), NaN outside the points' hull; of points at one place the mean counts. Given `sure`
    (points, triangles -> which count), NaN as well where only other triangles are."""
    p, which = np.unique(p, axis=0, return_inverse=True)
    z = np.bincount(which.ravel(), z) / np.maximum(np.bincount(which.ravel()), 1)
    out = np.full(len(at), np.nan)
    order = np.argsort(at[:, 0], kind="stable")
    xs = at[order, 0]
    triangles = delaunay(p)
    for tri in triangles if sure is None else triangles[sure(p, triangles)]:
        a, b, c = p[tri]
        part = order[np.searchsorted(xs, min(a[0], b[0], c[0]) - 1e-9) : np.searchsorted(xs, max(a[0], b[0], c[0]) + 1e-9)]
        d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if not len(part) or d == 0:
            continue
        q = at[part] - a
        v = (q[:, 0] * (c[1] - a[1]) - q[:, 1] * (c[0] - a[0])) / d
        w = ((b[0] - a[0]) * q[:, 1] - (b[1] - a[1]) * q[:, 0]) / d
        hit = (v >= -1e-9) & (w >= -1e-9) & (v + w <= 1 + 1e-9)
        out[part[hit]] = ((1 - v - w) * z[tri[0]] + v * z[tri[1]] + w * z[tri[2]])[hit]
    return out


def _hulls(points: DataFrame) -> DataFrame:
    """points (frame, x, y) -> frame, hull (x and y in turn) and the box x0, y0, x1, y1: corners of tasks' points first, then of those."""

    def rows(held):
        sizes = [len(h) for h in held.values()]
        p = np.concatenate(list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(held), sizes), pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["frame", "x", "y"])

    def corners(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            frame, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(frame, kind="stable")
            starts = np.flatnonzero(np.diff(frame[order], prepend=frame[order][:1] - 1)) if len(order) else order
            for part in np.split(order, starts[1:]) if len(order) else []:
                f, p = int(frame[part[0]]), np.stack([x[part], y[part]], axis=1)
                held[f] = hull(np.concatenate([held[f], p]) if f in held else p)
            if sum(map(len, held.values())) > 1 << 16:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def whole(pdf):
        p = pdf[["x", "y"]].to_numpy(float)
        return pd.DataFrame({"frame": [pdf.frame.iloc[0]], "hull": [hull(p).ravel().tolist()], "x0": [p[:, 0].min()], "y0": [p[:, 1].min()], "x1": [p[:, 0].max()], "y1": [p[:, 1].max()]})

    rim = points.select("frame", "x", "y").mapInArrow(corners, "frame int, x double, y double")
    return rim.groupBy("frame").applyInPandas(whole, "frame int, hull array<double>, x0 double, y0 double, x1 double, y1 double")


#: Cells to a side of a tile: points around a tile are taken by cells, one on each side. Points that a tile should hold.
CELLS, FEW = 4, 32


def linear(points: DataFrame, nodes: DataFrame, tile: float, margin: float | None = None) -> DataFrame:
    """points (frame, x, y, z) and nodes (i, j, x, y) -> frame, i, j, z at every node inside the frame's hull, linear
    over the triangles of all its points' Delaunay triangulation.

    Nodes are asked tile by tile. A square of side `tile` that holds more than FEW points is halved until its parts
    hold about as many, clusters further. A tile's points and those up to a quarter of a tile around it are triangulated in one task; a
    triangle counts if no point farther away can lie in its circle. Nodes in no such triangle, as in gaps or on the
    hull's rim, are asked again in tiles twice as wide, and no others are; once a tile sees the whole frame, all its
    triangles count. So the tile, and a `margin` below which no quarter of a tile falls, decide about time alone.
    Points of null or non-finite places or heights are left out, of points at one place the mean
    counts, and of equal circles either triangulation is as good. Frames of points in a line have no nodes; nor have slivers on the
    rim ten thousand times longer than high. Empty tables give an empty result."""
    side = tile * F.pow(F.lit(2.0), -F.col("level"))
    fine = F.lit(True)
    for c in ("x", "y", "z"):
        fine = fine & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    own = cut(points.where(fine).select(F.col("frame").cast("int").alias("frame"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).where("frame is not null"), "scattered")
    frames = cut(_hulls(own), "hulls")
    most = 40 if not margin else math.floor(math.log2(tile / CELLS / margin))
    square = [F.floor(F.col(c) / tile).cast("long").alias(k) for c, k in (("x", "a"), ("y", "b"))]
    wanted = nodes.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).select("*", *square)
    over = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}0") / tile).cast("long"), F.floor(F.col(f"{c}1") / tile).cast("long")))
    tiles = frames.select("frame", "x0", "y0", "x1", "y1", over("x").alias("a")).select("*", over("y").alias("b"))
    open_ = wanted.join(tiles, ["a", "b"]).where("x between x0 and x1 and y between y0 and y1")
    places = F.approx_count_distinct(F.struct("x", "y")).alias("n")  # a guess will do, levels decide about time alone
    finer = F.greatest(F.lit(0), F.ceil(F.log2(F.coalesce("n", F.lit(1)) / FEW) / 2))
    held = own.groupBy("frame", *square).agg(places)
    open_ = cut(open_.join(held, ["frame", "a", "b"], "left").select("frame", "i", "j", "x", "y", F.least(F.lit(most), finer).cast("int").alias("level")), "asked")

    def dealt(levels: list[int], to: tuple[str, str], parts: int) -> DataFrame:
        rows = own.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
        return rows.withColumns({k: F.floor(F.col(c) / (side / parts)).cast("long") for c, k in zip("xy", to, strict=True)})

    def levels_of(rows: DataFrame) -> list[int]:
        return sorted(r.level for r in rows.select("level").distinct().collect())  # some dozens at most

    while True:  # clusters inside a tile
        at = open_.withColumns({k: F.floor(F.col(c) / side).cast("long") for c, k in (("x", "a"), ("y", "b"))})
        own_tiles = at.where(F.col("level") < most).select("frame", "level", "a", "b").distinct()
        n = dealt(levels_of(own_tiles) or [0], ("a", "b"), 1).join(bounded(own_tiles), ["frame", "level", "a", "b"]).groupBy("frame", "level", "a", "b").agg(places)
        n = cut(n.where(F.col("n") > 64 * FEW), "crowded")
        if n.isEmpty():
            break
        at = at.join(bounded(n), ["frame", "level", "a", "b"], "left")
        open_ = cut(at.select("frame", "i", "j", "x", "y", F.least(F.lit(most), F.col("level") + finer).cast("int").alias("level")), "asked")

    def around(levels: list[int]) -> tuple[DataFrame, DataFrame]:
        """The open nodes' tiles (level, a, b) with their nodes and hulls, and with the points around them."""
        there = open_.withColumns({k: F.floor(F.col(c) / side).cast("long") for c, k in (("x", "a"), ("y", "b"))})
        there = there.groupBy("frame", "level", "a", "b").agg(F.collect_list(F.struct("i", "j", "x", "y")).alias("nodes"))
        near = there.select("frame", "level", "a", "b")
        for to, c in (("ca", "a"), ("cb", "b")):
            near = near.withColumn(to, F.explode(F.sequence(F.col(c) * CELLS - 1, F.col(c) * CELLS + CELLS)))
        here = dealt(levels, ("ca", "cb"), CELLS).join(bounded(cut(near, "near"), 300_000), ["frame", "level", "ca", "cb"])
        here = here.groupBy("frame", "level", "a", "b", "x", "y").agg(F.avg("z").alias("z"))
        there = there.join(frames, "frame").select(*[F.col(c).alias(f"own_{c}") for c in ("frame", "level", "a", "b")], "nodes", "hull", "x0", "y0", "x1", "y1")
        return here, there

    def asked(key, some: pd.DataFrame, tile_: pd.DataFrame) -> pd.DataFrame:
        row = tile_.iloc[0]
        at = pd.DataFrame.from_records(list(row["nodes"]))
        places, box = at[["x", "y"]].to_numpy(float), (row.x0, row.y0, row.x1, row.y1)
        inside = within(np.array(row.hull).reshape(-1, 2), places)
        size = tile * 2.0 ** -row.own_level / CELLS
        known = [(CELLS * k - 1) * size for k in (row.own_a, row.own_b)] + [(CELLS * (k + 1) + 1) * size for k in (row.own_a, row.own_b)]
        all_seen = known[0] <= box[0] and known[1] <= box[1] and known[2] > box[2] and known[3] > box[3]
        z = np.full(len(at), np.nan)
        if len(some) and inside.any():
            z[inside] = interpolated(some[["x", "y"]].to_numpy(float), some.z.to_numpy(float), places[inside], None if all_seen else lambda p, t: certain(p, t, known, box))
        left = inside & np.isnan(z) & (not all_seen)
        rows = at.assign(frame=int(row.own_frame), level=int(row.own_level), z=np.where(np.isnan(z), None, z), open=left)
        return rows[left | ~np.isnan(z)][["frame", "level", "i", "j", "x", "y", "z", "open"]]

    found = None
    while True:
        here, there = around(levels_of(open_) or [0])
        keys = ["frame", "level", "a", "b"]
        got = here.groupBy(*keys).cogroup(there.groupBy(*[f"own_{k}" for k in keys])).applyInPandas(asked, "frame int, level int, i int, j int, x double, y double, z double, open boolean")
        got = cut(got, "interpolated")
        done = got.where("not open").select("frame", "i", "j", "z")
        found = done if found is None else found.union(done)
        open_ = got.where("open").select("frame", "i", "j", "x", "y", (F.col("level") - 1).alias("level"))
        if open_.isEmpty():
            return found
