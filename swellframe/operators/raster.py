"""Neighbourhoods of cells: every cell gives its value to its neighbours, and one grouping collects them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swellframe.tables import cut, discard

Taps = Sequence[tuple[int, int, float]]
NINE: Taps = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
EIGHT: Taps = [x for x in NINE if x[:2] != (0, 0)]


def scatter(grid: DataFrame, taps: Taps) -> DataFrame:
    """grid (t, i, j, z) -> t, i, j (of the receiving cell), z, w: cell (i, j) receives z of (i + di, j + dj) with the
    tap's weight. One shuffle, by (t, i, j), follows when the caller groups."""
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(float(w)).alias("w")) for a, b, w in taps])
    x = grid.select("t", "i", "j", "z", F.explode(offsets).alias("o"))
    return x.select("t", (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"), "z", "o.w", ((F.col("o.di") == 0) & (F.col("o.dj") == 0)).alias("own"))


def inside(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    return cells.where(f"i >= 0 and i < {rows} and j >= 0 and j < {cols}")


def eroded_borders(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells all of whose neighbours inside the image exist."""
    near = inside(scatter(grid, NINE), rows, cols).groupBy("t", "i", "j").agg(F.count("*").alias("n"), F.max(F.when(F.col("own"), F.col("z"))).alias("z"))
    want = (3 - ((F.col("i") == 0) | (F.col("i") == rows - 1)).cast("int")) * (3 - ((F.col("j") == 0) | (F.col("j") == cols - 1)).cast("int"))
    return near.where(F.col("z").isNotNull() & (F.col("n") == want)).select("t", "i", "j", "z")


def zero_dilated(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Missing cells get the mean of their positive neighbours where there are at least two."""
    near = inside(scatter(grid, NINE), rows, cols).groupBy("t", "i", "j").agg(F.max(F.when(F.col("own"), F.col("z"))).alias("own"), F.count_if(~F.col("own") & (F.col("z") > 0)).alias("n"), F.avg(F.when(~F.col("own") & (F.col("z") > 0), F.col("z"))).alias("mean"))
    return near.select("t", "i", "j", F.coalesce("own", F.when(F.col("n") > 1, F.col("mean"))).alias("z")).where("z is not null")


def zero_eroded(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells whose whole 3 x 3 neighbourhood exists; the border goes."""
    near = scatter(grid, NINE).groupBy("t", "i", "j").agg(F.count("*").alias("n"), F.max(F.when(F.col("own"), F.col("z"))).alias("z"))
    return near.where(f"n = 9 and i > 0 and j > 0 and i < {rows - 1} and j < {cols - 1}").select("t", "i", "j", "z")


def median_blurred(grid: DataFrame, size: int = 3) -> DataFrame:
    """Median of the existing cells of each existing cell's neighbourhood."""
    r = size // 2
    taps = [(a, b, 1.0) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    near = scatter(grid, taps).groupBy("t", "i", "j").agg(F.median("z").alias("z"), F.max("own").alias("own"))
    return near.where("own").select("t", "i", "j", "z")


def distance_taps(size: int = 5, power: float = 2.4) -> Taps:
    """Weights 1 / r^power, 0 in the middle."""
    r = size // 2
    return [(a, b, (a * a + b * b) ** (-power / 2)) for a in range(-r, r + 1) for b in range(-r, r + 1) if a or b]


def filled(grid: DataFrame, rows: int, cols: int, taps: Taps | None = None) -> DataFrame:
    """One pass of inverse-distance filling: missing cells get the weighted mean of their neighbours; originals stay."""
    near = scatter(grid, [(0, 0, 0.0), *(taps or distance_taps())])
    got = inside(near, rows, cols).groupBy("t", "i", "j").agg(F.max(F.when(F.col("own"), F.col("z"))).alias("own"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum("w").alias("ws"))
    return got.select("t", "i", "j", F.coalesce("own", F.col("wz") / F.nullif(F.col("ws"), F.lit(0.0))).alias("z"), F.col("own").isNull().alias("filled")).where("z is not null")


def closed(grid: DataFrame, rows: int, cols: int, size: int = 3, rounds: int = 1) -> DataFrame:
    """Cells of the morphological closing of the existing ones by a square of odd `size`, dilated `rounds` times and
    eroded as often; what lies outside the image neither sets nor clears a cell. Squares add up to one square, whose rows
    and columns are gone through one after another."""
    r = size // 2 * rounds
    line = [[(0, k, 1.0) for k in range(-r, r + 1)], [(k, 0, 1.0) for k in range(-r, r + 1)]]
    wide = grid.select("t", "i", "j", F.lit(1.0).alias("z"))
    for taps in line:
        wide = inside(scatter(wide, taps), rows, cols).select("t", "i", "j").distinct().withColumn("z", F.lit(1.0))
    n = wide
    for taps in line:
        n = inside(scatter(n, taps), rows, cols).groupBy("t", "i", "j").agg(F.sum("z").alias("z"))
    span = lambda c, most: F.least(F.col(c) + r, F.lit(most - 1)) - F.greatest(F.col(c) - r, F.lit(0)) + 1
    return n.where(F.col("z") == span("i", rows) * span("j", cols)).select("t", "i", "j")


def filled_inside(grid: DataFrame, rows: int, cols: int, taps: Taps | None = None, size: int = 5, rounds: int = 3) -> DataFrame:
    """Inverse-distance filling inside the closing of the existing cells by a square of `size`, `rounds` times: every
    pass gives each cell that wasn't there at first the weighted mean of the neighbours that the pass before knew.
    Cells of the closing that no pass reaches stay missing. Each pass is written, so that lost executors repeat one pass only."""
    now = cut(grid.where("z is not null").select("t", "i", "j", "z", F.lit(True).alias("first")))
    for _ in range(rounds):
        near = inside(scatter(now.where("first"), [(0, 0, 0.0)]).union(scatter(now, taps or distance_taps(size))), rows, cols)
        got = near.groupBy("t", "i", "j").agg(F.max(F.when(F.col("own"), F.col("z"))).alias("own"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum("w").alias("ws"))
        new = cut(got.select("t", "i", "j", F.coalesce("own", F.col("wz") / F.nullif(F.col("ws"), F.lit(0.0))).alias("z"), F.col("own").isNotNull().alias("first")))
        discard(now)
        now = new
    return now.select("t", "i", "j", "z").join(closed(grid.where("z is not null"), rows, cols, size, rounds), ["t", "i", "j"], "left_semi")


def convolved(grid: DataFrame, taps: Taps) -> DataFrame:
    """Weighted sums over the existing cells; every tap must be there."""
    near = scatter(grid, taps).groupBy("t", "i", "j").agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count("*").alias("n"))
    return near.where(F.col("n") == len(taps)).select("t", "i", "j", "z")


SOBEL_I: Taps = [(-1, -1, -1.0), (-1, 0, -2.0), (-1, 1, -1.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)]
SOBEL_J: Taps = [(b, a, w) for a, b, w in SOBEL_I]


def gradient_squared(grid: DataFrame) -> DataFrame:
    a, b = convolved(grid, SOBEL_I), convolved(grid, SOBEL_J).withColumnRenamed("z", "zj")
    return a.join(b, ["t", "i", "j"]).select("t", "i", "j", (F.col("z") * F.col("z") + F.col("zj") * F.col("zj")).alias("g2"))


def smoothed(grid: DataFrame, rounds: int = 1) -> DataFrame:
    """Laplacian smoothing: the displacement after rounds of 3 x 3 means where more than three cells exist."""
    now = grid
    for _ in range(rounds):
        near = scatter(now, NINE).groupBy("t", "i", "j").agg(F.avg("z").alias("m"), F.count("*").alias("n"), F.max(F.when(F.col("own"), F.col("z"))).alias("z"))
        now = near.where("z is not null").select("t", "i", "j", F.when(F.col("n") > 3, F.col("m")).otherwise(F.col("z")).alias("z"))
    return now.join(grid.withColumnRenamed("z", "z0"), ["t", "i", "j"]).select("t", "i", "j", (F.col("z") - F.col("z0")).alias("dz"))


def weighted(grid: DataFrame, places: DataFrame, span: Sequence[int], weights: Callable[[Column, int], Column]) -> DataFrame:
    """places (t, id, fi, fj) -> t, id, z: the mean of the cells at the offsets `span` in i and j from the one that holds the
    place, by the product of weights(part of a cell, offset) in i and in j; null if one of them is missing. Each place meets
    the cells around it as one row, so that nothing is grouped by place; few cells are broadcast."""
    grid, taps = cut(grid.where("z is not null").select("t", "i", "j", "z")), [(a, b) for a in span for b in span]
    x = grid.select("t", "i", "j", "z", F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in taps])).alias("k", "o"))
    near = x.groupBy("t", (F.col("i") - F.col("o.a")).cast("long").alias("i0"), (F.col("j") - F.col("o.b")).cast("long").alias("j0")).agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("s"))
    near = near.where(F.size("s") == len(taps)).select("t", "i0", "j0", F.col("s.z").alias("s"))
    most = min(100_000, 1_600_000 // len(taps))
    if grid.limit(most + 1).count() <= most:
        near = F.broadcast(near)
    at = places.select("t", "id", "fi", "fj", F.floor("fi").alias("i0"), F.floor("fj").alias("j0")).join(near, ["t", "i0", "j0"], "left")
    wi, wj = (F.array(*[weights(F.col(f) - F.col(k), a) for a in span]) for f, k in (("fi", "i0"), ("fj", "j0")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    at = at.select("t", "id", "s", wi.alias("wi"), wj.alias("wj"))
    w = F.flatten(F.transform("wi", lambda a: F.transform("wj", lambda b: a * b)))
    return at.select("t", "id", F.when(F.col("s").isNotNull(), total(F.zip_with("s", w, lambda z, k: z * k)) / (total(F.col("wi")) * total(F.col("wj")))).alias("z"))


def sampled(grid: DataFrame, places: DataFrame) -> DataFrame:
    """places (t, id, fi, fj) -> t, id, z by bilinear weights of four cells; null if one of them is missing."""
    return weighted(grid, places, (0, 1), lambda part, a: part if a else 1 - part)
