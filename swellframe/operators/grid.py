"""Gridding of aligned clouds and statistics of elevation cubes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swellframe.tables import bounded, cut, discard


def bin_of(x: Column, low: float, high: float, n: int) -> Column:
    """Nearest of n grid lines from low to high, as a whole number that may lie outside."""
    return F.floor((x - low) / (high - low) * (n - 1) + 0.5).cast("int")


def binned(points: DataFrame, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """points (frame, x, y, z) -> t, i, j, z, n: the median height of the points of each cell of the grid."""
    x = points.select(F.col("frame").alias("t"), bin_of(F.col("x"), *xs).alias("i"), bin_of(F.col("y"), *ys).alias("j"), "z")
    x = x.where((F.col("i") >= 0) & (F.col("i") < xs[2]) & (F.col("j") >= 0) & (F.col("j") < ys[2]))
    return x.groupBy("t", "i", "j").agg(F.median("z").alias("z"), F.count("*").alias("n"))


def frame_stats(cube: DataFrame) -> DataFrame:
    z = F.nanvl("z", F.lit(None).cast("double"))
    return cube.groupBy("t").agg(F.avg(z).alias("zmean"), F.min(z).alias("zmin"), F.max(z).alias("zmax"), F.count(z).alias("cells"))


def cube_stats(cube: DataFrame) -> DataFrame:
    """Extremes, and the mean of the frames' means."""
    return frame_stats(cube).agg(F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"), F.avg("zmean").alias("zmean"), F.count("*").alias("frames"))


def cell_means(cube: DataFrame) -> DataFrame:
    """Mean over time of each cell, null if a value of it is null."""
    return cube.groupBy("i", "j").agg(F.when(F.count("*") == F.count("z"), F.avg("z")).alias("zmean"), F.count("*").alias("frames"))


def zero_mean(cube: DataFrame) -> DataFrame:
    """The cube less each cell's mean over time."""
    means = cell_means(cube)
    return cube.join(means, ["i", "j"]).select("t", "i", "j", (F.col("z") - F.col("zmean")).alias("z"))


def clipped(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.withColumn(value, F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))))


#: Bits by which a selection narrows in a round, and values of one place that are at last put in order in one group.
BITS, FEW = 16, 65_536


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles: NaN last, both zeros alike."""
    bits = (np.where(np.isnan(v), np.nan, v) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _doubles(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _mapped(df: DataFrame, of: str, to: str, kind: str, f) -> DataFrame:
    """df with the column `of` turned into `to` by a numpy function."""
    names = [c for c in df.columns if c != of]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(to, T._parse_datatype_string(kind))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f(b.column(len(names)).to_numpy(zero_copy_only=False)))], names=schema.names)

    return df.select(*names, of).mapInArrow(run, schema)


def selected(df: DataFrame, value: str, places: list[Column], by: list[str] | None = None) -> DataFrame:
    """by..., n, v0, v1, ...: of each group the values at the given places, from 0, of its order; a place is a column of n, the
    group's size. Nulls are left out, NaN comes last, null groups are groups.

    Values become whole numbers in the same order, whose leading bits are counted in tasks before the shuffle. The bin
    of a place is known from the counts, and only its values are counted by the next bits, until a place's bin holds
    FEW values or a single one. So nothing but counts of bins is ever put in order, whatever the group's size."""
    by = by or []
    named = {c: f"_g{k}" for k, c in enumerate(by)}
    group = [F.col(c).alias(n) for c, n in named.items()] or [F.lit(0).alias("_g0")]
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    keys, own = cut(_mapped(rows, "v", "key", "long", _ordered), "ordered"), list(named.values()) or ["_g0"]
    bin_of_ = lambda bits: F.shiftright("key", 64 - bits)

    def narrowed(counts: DataFrame) -> DataFrame:
        """counts (own, p, want, bin, m) -> the bin of each place, its count, and the place within it."""
        w = Window.partitionBy(*own, "p").orderBy("bin")  # at most 2 ** BITS bins
        upto = counts.withColumn("upto", F.sum("m").over(w))
        return upto.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("m") <= F.col("want"))).select(*own, "p", "n", "bin", "m", (F.col("want") - F.col("upto") + F.col("m")).alias("want"))

    def met(open_: DataFrame, bits: int) -> DataFrame:
        here = keys.withColumn("bin", bin_of_(bits))
        left, right = here.alias("l"), bounded(open_).alias("r")
        same = F.col("l.bin") == F.col("r.bin")
        for c in own:
            same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        return left.join(right, same).select(*[F.col(f"l.{c}") for c in own], "p", "n", "want", "key")

    first = cut(keys.groupBy(*own, bin_of_(BITS).alias("bin")).agg(F.count("*").alias("m")), "bins")
    sizes = first.groupBy(*own).agg(F.sum("m").alias("n"))
    asked = sizes.select(*own, "n", F.posexplode(F.array(*[p.cast("long") for p in places])).alias("p", "want"))
    same = F.lit(True)
    for c in own:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}"))
    open_ = cut(narrowed(first.alias("f").join(asked.alias("a"), same).select(*[F.col(f"f.{c}") for c in own], "p", "n", "want", "bin", "m")), "places")
    bits = BITS
    while bits < 64 and (open_.agg(F.max("m").alias("m")).first().m or 0) > FEW:
        counts = met(open_, bits).groupBy(*own, "p", "n", "want", bin_of_(bits + BITS).alias("bin")).agg(F.count("*").alias("m"))
        new, bits = cut(narrowed(counts), "places"), bits + BITS
        discard(open_)
        open_ = new
    if bits == 64:
        found = open_.select(*own, "p", "n", F.col("bin").alias("key"))
    else:
        found = met(open_, bits).groupBy(*own, "p", "n", "want").agg(F.array_sort(F.collect_list("key")).alias("k")).select(*own, "p", "n", F.element_at("k", (F.col("want") + 1).cast("int")).alias("key"))
    found = _mapped(found, "key", "v", "double", _doubles)
    wide = found.groupBy(*own, "n").agg(*[F.max(F.when(F.col("p") == k, F.col("v"))).alias(f"v{k}") for k in range(len(places))])
    return wide.select(*[F.col(n).alias(c) for c, n in named.items()], "n", *[f"v{k}" for k in range(len(places))])


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., q0, q1, ...: exact quantiles, linear between neighbours; nulls are left out."""
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    both = [p for a in at for p in (F.floor(a), F.ceil(a))]
    x = selected(df, value, both, by)
    part = lambda k: F.col(f"v{2 * k}") + F.when(F.floor(at[k]) == F.ceil(at[k]), 0.0).otherwise((F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}")) * (at[k] - F.floor(at[k])))
    return x.select(*(by or []), *[part(k).alias(f"q{k}") for k in range(len(shares))])


def symmetric_limits(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, factor: float = 1.5) -> DataFrame:
    """Limits -m and m, where m is factor times the larger quantile's size."""
    m = F.greatest(F.abs("q0"), F.abs("q1")) * factor
    return quantiles(df, value, [low, high]).select((-m).alias("zmin"), m.alias("zmax"))


def axis(n: Column, count: int, low: float, high: float) -> Column:
    """Place of grid line n of `count` from low to high."""
    return F.lit(low) + n * ((high - low) / (count - 1))


def wavenumber(n: Column, count: int, step: float) -> Column:
    """Angular wavenumber of line n of a centred spectrum; count is even."""
    if count % 2:
        raise ValueError("a wavenumber axis needs an even number of lines")
    return (n - count // 2) * (2 * math.pi / (count * step))


def mean_plane(planes: DataFrame) -> DataFrame:
    """Mean of the planes' columns over the frames that have one."""
    return planes.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in "abcd"], F.count("a").alias("frames"))
