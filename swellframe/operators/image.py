"""Images as tables of pixels (t, i, j, z): masks, lens distortion, scaling, warping, contrast and sharp sampling. Every
pixel gives its value to the places that need it; images are never gathered."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellframe.operators.raster import gradient_squared, sampled, weighted

_CELL = 1 << 20


def mask(image: DataFrame, level: float = 0.0) -> DataFrame:
    """t, i, j, on: whether the value exceeds the level."""
    return image.select("t", "i", "j", (F.col("z") > level).alias("on"))


def masks_product(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two masks (t, i, j, on) -> t, i, j, on: set where both are; pixels that only one has are not set."""
    x = one.join(two.withColumnRenamed("on", "also"), ["t", "i", "j"], "full")
    return x.select("t", "i", "j", (F.coalesce("on", F.lit(False)) & F.coalesce("also", F.lit(False))).alias("on"))


def user_mask(nodes: DataFrame, image: DataFrame | None) -> DataFrame:
    """nodes (i, j) -> i, j, mask: 1 where the image (i, j, z) is above 0, everywhere without one."""
    if image is None:
        return nodes.select("i", "j", F.lit(1.0).alias("mask"))
    on = image.select("i", "j", F.when(F.col("z") > 0, 1.0).otherwise(0.0).alias("mask"))
    return nodes.select("i", "j").join(on, ["i", "j"], "left").select("i", "j", F.coalesce("mask", F.lit(0.0)).alias("mask"))


def overlap(one: Sequence[Column], two: Sequence[Column]) -> list[Column]:
    """Common part of two boxes (left, top, right, bottom); null sides where there is none."""
    box = [F.greatest(one[0], two[0]), F.greatest(one[1], two[1]), F.least(one[2], two[2]), F.least(one[3], two[3])]
    some = (box[0] < box[2]) & (box[1] < box[3])
    return [F.when(some, side) for side in box]


def middle_box(corners: DataFrame, by: str = "frame") -> DataFrame:
    """Four corners (by, x, y) of a warped image -> by, left, right, top, bottom: the second and third of the ordered
    coordinates."""
    rows = corners.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"), F.array_sort(F.collect_list("y")).alias("y"))
    return rows.select(by, F.col("x")[1].alias("left"), F.col("x")[2].alias("right"), F.col("y")[1].alias("top"), F.col("y")[2].alias("bottom"))


def value_range(image: DataFrame) -> DataFrame:
    return image.groupBy("t").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.count("z").alias("pixels"))


def without_edges(image: DataFrame, most: float) -> DataFrame:
    """Pixels whose squared Sobel gradient is at most `most`; those at the border, which have none, stay."""
    steep = gradient_squared(image).where(F.col("g2") > most)
    return image.join(steep.select("t", "i", "j"), ["t", "i", "j"], "left_anti")


def distorted(u: Column, v: Column, camera: Sequence[float], lens: Sequence[float]) -> tuple[Column, Column]:
    """Where the lens puts the pixel that an ideal camera (fx, fy, cx, cy) puts at u, v; lens: k1, k2, p1, p2, k3."""
    fx, fy, cx, cy = camera
    k1, k2, p1, p2, k3 = lens
    x, y = (u - cx) / fx, (v - cy) / fy
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return xd * fx + cx, yd * fy + cy


def _placed(frames: DataFrame, rows: int, cols: int, fi, fj) -> DataFrame:
    """Places (t, id, fi, fj) for every pixel of a rows x cols image of each frame; fi, fj: functions of (i, j)."""
    pixels = frames.select("t", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i")).select("t", "i", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"))
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    return pixels.select("t", (F.col("i").cast("long") * _CELL + F.col("j")).alias("id"), fi(i, j).alias("fi"), fj(i, j).alias("fj"))


def _image(got: DataFrame) -> DataFrame:
    return got.select("t", F.floor(F.col("id") / _CELL).cast("int").alias("i"), (F.col("id") % _CELL).cast("int").alias("j"), "z").where("z is not null")


def remapped(image: DataFrame, rows: int, cols: int, fi, fj) -> DataFrame:
    """A rows x cols image whose pixel (i, j) is the old one at (fi(i, j), fj(i, j)), bilinear; pixels that need a
    missing one are missing."""
    return _image(sampled(image, _placed(image.select("t").distinct(), rows, cols, fi, fj)))


def undistorted(image: DataFrame, rows: int, cols: int, camera: Sequence[float], lens: Sequence[float]) -> DataFrame:
    return remapped(image, rows, cols, lambda i, j: distorted(j, i, camera, lens)[1], lambda i, j: distorted(j, i, camera, lens)[0])


def warped(image: DataFrame, rows: int, cols: int, back: Sequence[Sequence[float]]) -> DataFrame:
    """The image seen through a homography; `back` takes new pixels (j, i, 1) to old ones."""

    def at(k):
        return lambda i, j: (back[k][0] * j + back[k][1] * i + back[k][2]) / F.nullif(back[2][0] * j + back[2][1] * i + back[2][2], F.lit(0.0))

    return remapped(image, rows, cols, at(1), at(0))


def resized(image: DataFrame, old: tuple[int, int], new: tuple[int, int], kind: str = "linear") -> DataFrame:
    """The image with new rows and columns, "nearest" or "linear" between pixel centres; beyond the outer centres the
    border's values go on."""
    si, sj = old[0] / new[0], old[1] / new[1]
    if kind == "nearest":
        target = _placed(image.select("t").distinct(), *new, lambda i, j: F.floor(i * si).cast("double"), lambda i, j: F.floor(j * sj).cast("double"))
        x = target.select("t", "id", F.col("fi").cast("int").alias("i"), F.col("fj").cast("int").alias("j")).join(image, ["t", "i", "j"])
        return _image(x.select("t", "id", "z"))
    if kind != "linear":
        raise ValueError(f"unknown kind {kind}")

    def at(x, scale, n):  # a place just before the last centre keeps its four neighbours inside
        return F.least(F.greatest((x + 0.5) * scale - 0.5, F.lit(0.0)), F.lit(n - 1 - 1e-9))

    return remapped(image, *new, lambda i, j: at(i, si, old[0]), lambda i, j: at(j, sj, old[1]))


def doubled(image: DataFrame, rows: int, cols: int) -> DataFrame:
    """One pyramid level up: twice the rows and columns, smoothed by 1 4 6 4 1 along both axes; at the border by the
    part of it that lies inside."""
    taps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(math.comb(4, a + 2) * math.comb(4, b + 2))).alias("w")) for a in range(-2, 3) for b in range(-2, 3)])
    x = image.select("t", "i", "j", "z", F.explode(taps).alias("o"))
    x = x.select("t", (2 * F.col("i") + F.col("o.a")).alias("i"), (2 * F.col("j") + F.col("o.b")).alias("j"), "z", "o.w")
    x = x.where(f"i >= 0 and i < {2 * rows} and j >= 0 and j < {2 * cols}")
    return x.groupBy("t", "i", "j").agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"))


def lanczos(x: Column, a: int = 4) -> Column:
    """sinc(x) sinc(x / a) within a, else 0."""
    p = x * math.pi
    return F.when(F.abs(x) < 1e-12, 1.0).when(F.abs(x) >= a, 0.0).otherwise(a * F.sin(p) * F.sin(p / a) / (p * p))


def sampled_sharp(image: DataFrame, places: DataFrame, a: int = 4) -> DataFrame:
    """places (t, id, fi, fj) -> t, id, z by Lanczos weights of the 2a x 2a pixels around, scaled to a sum of 1; null if
    one of them is missing."""
    return weighted(image, places, range(1 - a, a + 1), lambda part, k: lanczos(part - k, a))


def equalised(image: DataFrame, rows: int, cols: int, tiles: int = 8, limit: float = 2.0, levels: int = 256) -> DataFrame:
    """Contrast-limited adaptive equalisation of whole values 0..levels-1: each of tiles x tiles tiles has a histogram,
    clipped at `limit` times its mean count with the excess spread over all levels, whose sums are its curve; a
    pixel is the bilinear mix of the curves of the four nearest tiles' middles."""
    th, tw = rows / tiles, cols / tiles
    tile = lambda x, size: F.least(F.floor(x / size), F.lit(tiles - 1)).cast("int")
    x = image.select("t", "i", "j", F.col("z").cast("int").alias("v"))
    n = x.groupBy("t", tile(F.col("i"), th).alias("a"), tile(F.col("j"), tw).alias("b"), "v").agg(F.count("*").alias("n"))
    total = n.groupBy("t", "a", "b").agg(F.sum("n").alias("total"))
    total = total.withColumn("most", F.greatest(F.floor(F.col("total") * limit / levels), F.lit(1)))
    over = n.join(total, ["t", "a", "b"]).groupBy("t", "a", "b", "total", "most").agg(F.sum(F.greatest(F.col("n") - F.col("most"), F.lit(0))).alias("over"))
    full = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("v")).join(n, ["t", "a", "b", "v"], "left")
    count = F.least(F.coalesce("n", F.lit(0)), F.col("most")) + F.col("over") / levels
    curve = full.withColumn("c", count).withColumn("c", F.sum("c").over(Window.partitionBy("t", "a", "b").orderBy("v")) * (levels - 1) / F.col("total")).select("t", "a", "b", "v", "c")
    fi, fj = (F.col("i") + 0.5) / th - 0.5, (F.col("j") + 0.5) / tw - 0.5
    corners = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1)])
    y = x.select("t", "i", "j", "v", fi.alias("fi"), fj.alias("fj"), F.explode(corners).alias("o"))
    share = lambda f, k: F.when(F.col(f"o.{k}") == 1, F.col(f) - F.floor(f)).otherwise(1 - (F.col(f) - F.floor(f)))
    inside = lambda f, k: F.greatest(F.lit(0), F.least(F.lit(tiles - 1), F.floor(f) + F.col(f"o.{k}"))).cast("int")
    y = y.select("t", "i", "j", "v", inside("fi", "p").alias("a"), inside("fj", "q").alias("b"), (share("fi", "p") * share("fj", "q")).alias("w"))
    return y.join(curve, ["t", "a", "b", "v"]).groupBy("t", "i", "j").agg(F.sum(F.col("w") * F.col("c")).alias("z"))
