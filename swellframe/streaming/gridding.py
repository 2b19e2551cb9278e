"""Gridding of points as they arrive (an extension): event-time windows and idempotent frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.operators.grid import bin_of


def windowed_cells(points: DataFrame, xs: tuple[float, float, int], ys: tuple[float, float, int], every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """A stream (ts, x, y, z) -> window, i, j, n, zmean, zmin, zmax of each cell; rows later than `late` are dropped."""
    cells = points.withWatermark("ts", late).select("ts", bin_of(F.col("x"), *xs).alias("i"), bin_of(F.col("y"), *ys).alias("j"), "z")
    cells = cells.where((F.col("i") >= 0) & (F.col("i") < xs[2]) & (F.col("j") >= 0) & (F.col("j") < ys[2]))
    return cells.groupBy(F.window("ts", every), "i", "j").agg(F.count("*").alias("n"), F.avg("z").alias("zmean"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))
