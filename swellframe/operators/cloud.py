"""Point clouds: gates, crops, statistics, planes and the connected part of a mesh."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellframe.operators.graph import components, forest
from swellframe.operators.grid import quantiles, selected
from swellframe.tables import cut

#: Gates of a triangulated pixel, in the order in which they are tried.
GATES = ("disparity", "left", "right", "box", "left mask", "right mask", "burned", "angle", "near", "far")


def triangulation_gates(size: tuple[int, int], box: tuple[float, float, float, float], distance: float, least_angle: float, brightest: float = 254.0) -> list[tuple[str, Column]]:
    """Tests of rows (d, xl, u0, v0, u1, v1, mask0, mask1, value, angle, x, y, z), for rejected(): the disparity, the
    left pixel's column, both unrectified pixels, the first one's box, both masks, burned pixels, the angle of the
    rays, and distances from a tenth to 200 times `distance`."""
    w, h = size
    inside_image = lambda u, v: (F.col(u) >= 1) & (F.col(u) < w - 1) & (F.col(v) >= 1) & (F.col(v) < h - 1)
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    tests = [
        F.col("d") > 1,
        (F.col("xl") >= 0) & (F.col("xl") < w) & inside_image("u0", "v0"),
        inside_image("u1", "v1"),
        (F.col("u0") > box[0]) & (F.col("u0") < box[2]) & (F.col("v0") > box[1]) & (F.col("v0") < box[3]),
        F.col("mask0") != 0,
        F.col("mask1") != 0,
        F.col("value") <= brightest,
        F.col("angle") >= least_angle,
        (r >= distance / 10) & (F.col("z") >= 1),
        (r <= 200 * distance) & (F.col("z") <= 1e30),
    ]
    return list(zip(GATES, tests, strict=True))


def with_masks(points: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """points (frame, u0, v0, u1, v1, ...) and masks (frame, u, v, z) -> points with mask0 and mask1, the masks' values
    at the pixels that hold both places; null where a mask has none."""
    for k, mask in enumerate((left, right)):
        pixel = mask.select("frame", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("z").alias(f"mask{k}"))
        x = points.withColumns({"_u": F.floor(f"u{k}").cast("int"), "_v": F.floor(f"v{k}").cast("int")})
        points = x.join(pixel, ["frame", "_u", "_v"], "left").drop("_u", "_v")
    return points


def central(mesh: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells in the middle of the image, where planes are refined: columns from a quarter to three quarters, rows from
    a quarter to two thirds."""
    return mesh.where((F.col("j") >= cols // 4) & (F.col("j") <= 3 * cols // 4) & (F.col("i") >= rows // 4) & (F.col("i") <= 2 * rows // 3))


def rejected(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that fails (null counts as failing), or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(tests):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def distance_to(plane) -> Column:
    """Signed distance of x, y, z to a plane (a, b, c, d)."""
    return F.col("x") * plane[0] + F.col("y") * plane[1] + F.col("z") * plane[2] + plane[3]


def near_plane(points: DataFrame, plane, threshold: float) -> DataFrame:
    return points.where(F.abs(distance_to(plane)) < threshold)


def inside(points: DataFrame, box: dict[str, tuple[float, float]], reach: float | None = None) -> DataFrame:
    """Points strictly inside ranges of columns and closer to the origin than `reach`."""
    for name, (low, high) in box.items():
        points = points.where((F.col(name) > low) & (F.col(name) < high))
    return points if reach is None else points.where(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 < reach * reach)


def bounds(points: DataFrame) -> DataFrame:
    """Count, centroid and bounding box of each frame."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max, F.avg)]
    return points.groupBy("frame").agg(F.count("*").alias("n"), *ends)


def moments(points: DataFrame, weighted: bool = True) -> DataFrame:
    """Weight, weighted sums and weighted second moments of each frame; the weight is the distance to the origin or 1."""
    w = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) if weighted else F.lit(1.0)
    x = points.withColumn("w", w)
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return x.groupBy("frame").agg(F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col("w") * F.col(p[0]) * F.col(p[1])).alias(f"s{p}") for p in pairs])


def _normal(pdf):
    out = []
    for r in pdf.itertuples(index=False):
        if not r.sw or r.sw != r.sw:
            out.append((r.frame, None, None, None, None))
            continue
        c = np.array([r.sx, r.sy, r.sz]) / r.sw
        m = np.array([[r.sxx, r.sxy, r.sxz], [r.sxy, r.syy, r.syz], [r.sxz, r.syz, r.szz]]) / r.sw - np.outer(c, c)
        n = np.linalg.eigh(m)[1][:, 0]
        n = n if n[2] >= 0 else -n
        out.append((r.frame, *map(float, n), float(-n @ (c + [r.mx, r.my, r.mz]))))
    return type(pdf)(out, columns=["frame", "a", "b", "c", "d"])


def fit_planes(points: DataFrame, weighted: bool = True) -> DataFrame:
    """Plane of least weighted squares of each frame, normal upwards. Moments are taken about the frame's mean, so that
    clouds far from the origin lose no digits; one row of them per frame reaches Python."""
    at = points.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    w = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) if weighted else F.lit(1.0)
    near = points.join(at, "frame").withColumn("w", w).select("frame", "w", "mx", "my", "mz", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = near.groupBy("frame").agg(F.sum("w").alias("sw"), *[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(F.col("w") * F.col(p[0]) * F.col(p[1])).alias(f"s{p}") for p in pairs], *[F.first(f"m{c}").alias(f"m{c}") for c in "xyz"])
    return sums.mapInPandas(lambda it: map(_normal, it), "frame int, a double, b double, c double, d double")


#: Hypotheses that one row of a point is tried with.
CHUNK = 16


def inlier_counts(points: DataFrame, planes: DataFrame, threshold: float) -> DataFrame:
    """points (frame, x, y, z) and planes (frame, h, a, b, c, d): inliers of each hypothesis of the point's frame, and
    its points. CHUNK hypotheses go along with a point at once and are counted by as many sums."""
    own = planes.groupBy("frame", F.floor(F.col("h") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("h", "a", "b", "c", "d"))).alias("p"))
    x = points.join(own, "frame")

    def near(k):
        p = F.try_element_at("p", F.lit(k + 1))
        return F.abs(F.col("x") * p["a"] + F.col("y") * p["b"] + F.col("z") * p["c"] + p["d"]) < threshold

    sums = x.groupBy("frame", "chunk").agg(F.count("*").alias("points"), *[F.count_if(near(k)).alias(f"n{k}") for k in range(CHUNK)])
    named = sums.join(own, ["frame", "chunk"]).select("frame", "points", F.explode(F.zip_with("p", F.array(*[f"n{k}" for k in range(CHUNK)]), lambda h, n: F.struct(h["h"].alias("h"), n.alias("inliers")))).alias("r"))
    return named.where("r.h is not null").select("frame", "r.h", "r.inliers", "points")


def hypotheses(points: DataFrame, rounds: int = 64, order: Column | None = None, least_gap: float = 0.0) -> DataFrame:
    """Planes through three points of the frame: those that come first in a hashed order, three a round. Rounds whose
    points lie in a line, or nearer than `least_gap` to each other, give none. The rank filter keeps 3 * rounds points
    of a frame in every task before the shuffle."""
    by = Window.partitionBy("frame").orderBy(F.xxhash64("pid", "x", "y", "z") if order is None else order, "pid", "x", "y", "z")
    drawn = points.withColumn("r", F.row_number().over(by)).where(F.col("r") <= 3 * rounds)
    role = (F.col("r") - 1) % 3
    three = drawn.groupBy("frame", F.floor((F.col("r") - 1) / 3).cast("int").alias("h")).agg(*[F.max(F.when(role == k, F.struct("x", "y", "z"))).alias(c) for k, c in enumerate("poq")])
    u = [F.col(f"o.{k}") - F.col(f"p.{k}") for k in "xyz"]
    v = [F.col(f"q.{k}") - F.col(f"p.{k}") for k in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    w = [a - b for a, b in zip(u, v, strict=True)]
    apart = F.least(dot(u, u), dot(v, v), dot(w, w)) >= least_gap * least_gap
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    length = F.nullif(F.sqrt(dot(n, n)), F.lit(0.0)) * F.when(n[2] < 0, -1).otherwise(1)
    planes = three.where(apart).select("frame", "h", "p", *[(k / length).alias(c) for k, c in zip(n, "abc", strict=True)]).where("a is not null")
    return planes.select("frame", "h", "a", "b", "c", (-(F.col("a") * F.col("p.x") + F.col("b") * F.col("p.y") + F.col("c") * F.col("p.z"))).alias("d"))


def ransac_planes(points: DataFrame, rounds: int = 64, threshold: float = 1.0, least_share: float = 0.1, cells: int | None = None, order: Column | None = None, least_gap: float = 0.0) -> DataFrame:
    """The hypothesis of most inliers in each frame; of equal ones the first round. ok: inliers reach the share of the
    grid's cells, or of the points where no grid is given."""
    planes = hypotheses(points, rounds, order, least_gap)
    counts = inlier_counts(points, planes, threshold)
    best = counts.groupBy("frame").agg(F.max_by(F.struct("h", "inliers", "points"), F.struct("inliers", (-F.col("h")).alias("first"))).alias("m"))
    got = best.select("frame", "m.*").join(planes, ["frame", "h"])
    enough = F.floor(F.lit(cells) * least_share) if cells else F.col("points") * least_share
    return got.select("frame", "h", "inliers", "points", "a", "b", "c", "d", (F.col("inliers") >= enough).alias("ok"))


def neighbour_gaps(mesh: DataFrame) -> DataFrame:
    """mesh (t, i, j, z): height differences to the cells above and to the left."""
    up = Window.partitionBy("t", "j").orderBy("i")
    left = Window.partitionBy("t", "i").orderBy("j")
    x = mesh.withColumns({"iu": F.lag("i").over(up), "zu": F.lag("z").over(up), "jl": F.lag("j").over(left), "zl": F.lag("z").over(left)})
    above = F.when(F.col("iu") == F.col("i") - 1, F.abs(F.col("z") - F.col("zu")))
    beside = F.when(F.col("jl") == F.col("j") - 1, F.abs(F.col("z") - F.col("zl")))
    return x.select("t", "i", "j", "z", above.alias("up"), beside.alias("left"))


def upper_gaps(mesh: DataFrame, cols: int) -> DataFrame:
    """mesh (t, i, j, z) -> t, i, j, gap: height differences of every cell, but those of the outer columns, to the
    existing ones of the three cells above it."""
    above = mesh.select("t", (F.col("i") + 1).alias("i"), F.explode(F.sequence(F.col("j") - 1, F.col("j") + 1)).alias("j"), F.col("z").alias("zu"))
    return mesh.where((F.col("j") >= 1) & (F.col("j") < cols - 1)).join(above, ["t", "i", "j"]).select("t", "i", "j", F.abs(F.col("z") - F.col("zu")).alias("gap"))


def index_percentile(df: DataFrame, by: str, value: str, percent: float) -> DataFrame:
    """sorted[floor(percent / 100 * n)] of each group, the last value at most; nulls are left out."""
    place = F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1)
    return selected(df, value, [place], [by]).select(by, F.col("v0").alias("value"))


def _labelled(mesh: pd.DataFrame, gap: float, diagonal: bool) -> np.ndarray:
    """Component of each row of one frame's mesh (i, j, z), named by its smallest cell number."""
    i, j, z = mesh.i.to_numpy(np.int64), mesh.j.to_numpy(np.int64), mesh.z.to_numpy(float)
    wide = int(j.max()) + 2
    place = i * wide + j
    order = np.argsort(place)
    place, z = place[order], z[order]
    a, b = [], []
    for step in (1, wide, wide - 1, wide + 1) if diagonal else (1, wide):
        at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        near = (place[at] == place + step) & (np.abs(z[at] - z) < gap)
        a.append(at[near])
        b.append(np.flatnonzero(near))
    label = np.arange(len(place))
    nodes, roots = forest(np.concatenate(a), np.concatenate(b))
    label[nodes] = roots
    out = np.empty(len(place), np.int64)
    out[order] = place[label] // wide * _WIDE + place[label] % wide
    return out


_WIDE = 1 << 20


def connected(mesh: DataFrame, gap: float, diagonal: bool = False, tile: int = 512) -> DataFrame:
    """mesh (t, i, j, z) -> t, i, j, component: cells joined to neighbours, of four or of eight, whose height differs by
    less than gap. A component is named by its smallest cell number. Null heights are left out.

    Square tiles of a frame are labelled in tasks of their own. Cells on a tile's rim meet their neighbours across it
    by place, and the labels that meet there are joined as a link table, however far a component reaches; only rims and labels are shuffled
    again. The result is read from a table in the shared folder."""

    def run(pdf):
        return pdf[["t", "i", "j", "z"]].assign(label=pdf.t.astype("int64") * _WIDE * _WIDE + _labelled(pdf, gap, diagonal))

    at = [F.floor(F.col(c) / tile) for c in "ij"]
    parts = cut(mesh.where("z is not null").select("t", "i", "j", "z").groupBy("t", *at).applyInPandas(run, "t int, i int, j int, z double, label long"), "labelled")
    rim = F.lit(False)
    for c in "ij":
        rim = rim | F.pmod(c, F.lit(tile)).isin(0, tile - 1)
    edge = parts.where(rim)
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    onto = edge.select("t", "z", F.col("label").alias("a"), F.col("i").alias("pi"), F.col("j").alias("pj"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("d"))
    onto = onto.select("t", "a", F.col("z").alias("pz"), "pi", "pj", (F.col("pi") + F.col("d.x")).alias("i"), (F.col("pj") + F.col("d.y")).alias("j"))
    across = onto.where((F.floor(F.col("pi") / tile) != at[0]) | (F.floor(F.col("pj") / tile) != at[1]))
    links = cut(across.join(edge, ["t", "i", "j"]).where(F.abs(F.col("z") - F.col("pz")) < gap).select("a", F.col("label").alias("b")).distinct(), "label-links")
    out = parts.select("t", "i", "j", F.col("label").alias("component"))
    if links.isEmpty():  # each component lies in one tile
        return out
    return out.join(components(links).withColumnRenamed("node", "component"), "component", "left").select("t", "i", "j", F.coalesce("comp", "component").alias("component"))


def biggest(mesh: DataFrame, gap: float, diagonal: bool = False, tile: int = 512) -> DataFrame:
    """Size and name of each frame's largest component; of equal ones the smallest name."""
    sizes = connected(mesh, gap, diagonal, tile).groupBy("t", "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy("t").agg(F.max_by(F.struct("component", "size"), F.struct("size", (-F.col("component")).alias("c"))).alias("m"), F.count("*").alias("components"))
    return best.select("t", "m.size", "m.component", "components")


def plane_outliers(points: DataFrame, radius: float, residual: float, least: int = 8) -> DataFrame:
    """points (frame, pid, x, y, z) -> points with `outlier`: farther than `residual` from the height that the points
    of its square of side `radius` have by a plane of least squares, level where they lie in a line. Squares of fewer
    points judge nobody."""
    x = points.withColumns({"bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    m = x.groupBy("frame", "bx", "by").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "z").alias("sxz"), F.covar_pop("y", "z").alias("syz"), ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("wide"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    det = F.when(F.col("wide") & (det > 1e-12 * F.col("sxx") * F.col("syy")), det)  # merged sums of points in a line are noise, not 0
    slopes = m.select("frame", "bx", "by", "n", "mx", "my", "mz", F.coalesce((F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / det, F.lit(0.0)).alias("p"), F.coalesce((F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / det, F.lit(0.0)).alias("q"))
    away = F.abs(F.col("z") - F.col("mz") - F.col("p") * (F.col("x") - F.col("mx")) - F.col("q") * (F.col("y") - F.col("my")))
    return x.join(slopes, ["frame", "bx", "by"]).select("frame", "pid", "x", "y", "z", ((F.col("n") >= least) & (away > residual)).alias("outlier"))


def radius_neighbours(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """points (frame, pid, x, y, z) and centres (frame, cid, x, y) -> frame, cid, pid, x, y, z of the points within the
    radius of each centre in x and y. Centres go to the nine squares around them; the join is by square."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = centres.select("frame", "cid", F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("bx"), cell("y").alias("b"))
    near = near.select("frame", "cid", "cx", "cy", "bx", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("by"))
    x = points.withColumns({"bx": cell("x"), "by": cell("y")}).join(near, ["frame", "bx", "by"])
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return x.where(d2 <= radius * radius).select("frame", "cid", "pid", "x", "y", "z")


def scan_centres(points: DataFrame, n: int = 15) -> DataFrame:
    """frame, cid, x, y: n x n places spread over each frame's box in x and y."""
    box = points.groupBy("frame").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    at = lambda c, k: F.col(f"min_{c}") + k * (F.col(f"max_{c}") - F.col(f"min_{c}")) / (n - 1)
    rows = box.withColumn("cid", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return rows.select("frame", "cid", at("x", F.floor(F.col("cid") / n)).alias("x"), at("y", F.col("cid") % n).alias("y"))


def voted_outliers(points: DataFrame, radius: float = 0.5, threshold: float = 1.0, rounds: int = 100, n: int = 15, order: Column | None = None) -> DataFrame:
    """points (frame, pid, x, y, z) -> frame, pid, votes: around n x n places of a frame, the plane of most inliers
    among `rounds` hypotheses is found, and every point of the neighbourhood beyond the threshold gets a vote. Points
    without a vote are left out."""
    around = radius_neighbours(points, scan_centres(points, n), radius)
    local = around.select((F.col("frame").cast("long") * (n * n) + F.col("cid")).alias("frame"), "pid", "x", "y", "z")
    best = ransac_planes(local, rounds, threshold, 0.0, order=order).select("frame", "a", "b", "c", "d")
    far = local.join(best, "frame").where(F.abs(F.col("x") * F.col("a") + F.col("y") * F.col("b") + F.col("z") * F.col("c") + F.col("d")) >= threshold)
    return far.groupBy(F.floor(F.col("frame") / (n * n)).cast("int").alias("frame"), "pid").agg(F.count("*").alias("votes"))


def turned(points: DataFrame, planes: DataFrame) -> DataFrame:
    """points and planes (frame, a, b, c, d) -> points about their frame's centroid, in the plane's axes."""
    from swellframe.functions.geometry import plane_axes

    at = points.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    p = points.join(at, "frame").join(planes, "frame")
    r = plane_axes(F.col("a"), F.col("b"), F.col("c"))
    d = [F.col(c) - F.col(f"m{c}") for c in "xyz"]
    return p.select("frame", "pid", *[(r[k][0] * d[0] + r[k][1] * d[1] + r[k][2] * d[2]).alias(c) for k, c in enumerate("xyz")])


def mesh_triangles(mesh: DataFrame, gap: float) -> DataFrame:
    """mesh (t, i, j, z) -> t, k, i, j (the cell's upper left corner), a, b, c: two triangles at most a square of four
    cells, whose corners' heights differ by less than gap. Corners are numbered row by row from 0 in each frame."""
    v = mesh.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy("i", "j")) - 1).select("t", "i", "j", "z", "n")
    corner = lambda di, dj, name: v.select("t", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("z", "n").alias(name))
    at = ["t", "i", "j"]
    x = corner(0, 0, "p").join(corner(0, 1, "q"), at, "left").join(corner(1, 0, "r"), at, "left").join(corner(1, 1, "s"), at, "left")
    close = lambda *c: F.greatest(*[F.abs(F.col(f"{m}.z") - F.col(f"{n}.z")) for m, n in ((c[0], c[1]), (c[1], c[2]), (c[2], c[0]))]) < gap
    whole = lambda *c: F.when(F.expr(" and ".join(f"{m} is not null" for m in c)) & close(*c), F.struct(*[F.col(f"{m}.n").alias(n) for m, n in zip(c, "abc", strict=True)]))
    two = x.select("t", "i", "j", F.posexplode(F.array(whole("p", "q", "r"), whole("q", "s", "r"))).alias("k", "f")).where("f is not null")
    return two.select("t", "i", "j", "k", "f.a", "f.b", "f.c")


def mean_abs_error(points: DataFrame, truth: DataFrame, keep: float = 0.999) -> DataFrame:
    """points and truth (frame, pid, z) -> frame, n, mae, worst: mean absolute height error of the points below the
    `keep` quantile of their frame's errors."""
    e = points.select("frame", "pid", "z").join(truth.select("frame", "pid", F.col("z").alias("want")), ["frame", "pid"]).select("frame", F.abs(F.col("z") - F.col("want")).alias("err"))
    q = quantiles(e, "err", [keep], ["frame"]).select("frame", F.col("q0").alias("q"))
    return e.join(q, "frame").where("err < q").groupBy("frame").agg(F.count("*").alias("n"), F.avg("err").alias("mae"), F.max("err").alias("worst"))
