"""Operators along time, and on whole surfaces. Series and surfaces are gathered by cell or frame, whose size the
acquisition bounds; windows and sums stay native."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swellframe.functions import signal
from swellframe.tables import bounded, cut


def gathered(series: DataFrame) -> DataFrame:
    """series (cell, t, v) -> cell, t array, v array in the order of t: one row a series."""
    rows = series.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
    return rows.select("cell", F.col("r.t").alias("t"), F.col("r.v").cast("array<double>").alias("v"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy())[:-1])


def by_series(series: DataFrame, kernel, width: int) -> DataFrame:
    """cell, t array, o0, o1, ... arrays: the `width` arrays that kernel(list of series) gives for each series. Many
    series reach Python together, and are worked on in slices."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = kernel(_lists(part.column(2)))
                out = [pa.array([g[k] for g in got], pa.list_(pa.float64())) for k in range(width)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out], names=["cell", "t", *[f"o{k}" for k in range(width)]])

    return gathered(series).mapInArrow(run, "cell long, t array<long>, " + ", ".join(f"o{k} array<double>" for k in range(width)))


def filtered(series: DataFrame, rate: float, cutoff: float, high: bool = False, order: int = 8, level: bool | None = None) -> DataFrame:
    """series (cell, t, v) -> cell, t, v: zero-phase Butterworth filter of each series. `level` takes each one's mean
    off first; by default a high pass does. Series of 27 samples or fewer raise an error."""
    sections = signal.butterworth(order, cutoff, rate, high)
    level = high if level is None else level

    def kernel(rows):
        return [(y,) for y in signal.zero_phase_rows(sections, [x - x.mean() if level else x for x in rows])]

    got = by_series(series.select(F.col("cell").cast("long"), F.col("t").cast("long"), "v"), kernel, 1)
    return got.select("cell", F.explode(F.arrays_zip("t", "o0")).alias("r")).select("cell", F.col("r.t").alias("t"), F.col("r.o0").alias("v"))


def _parts(series: DataFrame, size: int, ranges: int | None) -> DataFrame:
    """series (cell, t, v) -> cell, part, n, t array, v array: runs of at most `size` samples in order, written once. A
    cell's samples may lie in many ranges; parts of a cell are numbered from 0 by the runs' metadata alone."""

    def run(batches):
        from pyspark import TaskContext

        at, k, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            out, held = _runs(held, size, False)
            for cell, t, v in out:
                yield _part(cell, at, k, t, v)
                k += 1
        if held is not None:
            for cell, t, v in _runs(held, size, True)[0]:
                yield _part(cell, at, k, t, v)
                k += 1

    rows = series.select(F.col("cell").cast("long"), F.col("t").cast("long"), F.col("v").cast("double"))
    ranged = rows.repartitionByRange(ranges, "cell", "t") if ranges else rows.repartitionByRange("cell", "t")
    parts = cut(ranged.sortWithinPartitions("cell", "t").mapInArrow(run, "cell long, range int, k long, n long, t array<long>, v array<double>"), "series-parts")
    number = (F.row_number().over(Window.partitionBy("cell").orderBy("range", "k")) - 1).cast("long")
    numbers = parts.select("cell", "range", "k", number.alias("part"))
    return parts.join(bounded(numbers), ["cell", "range", "k"]).select("cell", "part", "n", "t", "v")


def _runs(held: pa.Table, size: int, last: bool) -> tuple[list, pa.Table | None]:
    """The runs of one cell and of `size` samples that a sorted table holds, and what may still go on."""
    cell, t, v = (held.column(k).to_numpy() for k in range(3))
    starts = np.flatnonzero(np.r_[len(cell) > 0, cell[1:] != cell[:-1]])
    out, done = [], 0
    for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
        for at in range(a, b, size):
            end = min(at + size, b)
            if end - at < size and end == len(cell) and not last:
                break
            out.append((cell[at], t[at:end], v[at:end]))
            done = end
    return out, held.slice(done) if done < len(cell) else None


def _part(cell, at, k, t, v) -> pa.RecordBatch:
    own = [pa.array([cell], pa.int64()), pa.array([at], pa.int32()), pa.array([k], pa.int64()), pa.array([len(t)], pa.int64())]
    return pa.RecordBatch.from_arrays([*own, *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (t, v)]], names=["cell", "range", "k", "n", "t", "v"])


def _rows_of(batch: pa.RecordBatch):
    """A batch's rows: lists as arrays, other columns as plain values."""
    columns = []
    for c in batch.columns:
        if pa.types.is_list(c.type):
            columns.append(np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy())[:-1]))
        else:
            columns.append(c.to_pylist())
    return zip(*columns)  # noqa: B905  an empty batch has one empty list


def _row(**values) -> pa.RecordBatch:
    arrays = [pa.array([v], pa.int64() if isinstance(v, int) else pa.list_(pa.from_numpy_dtype(v.dtype))) for v in values.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(values))


def long_filtered(series: DataFrame, rate: float, cutoff: float, high: bool = False, order: int = 8, level: bool | None = None, size: int = 1 << 14, ranges: int | None = None) -> DataFrame:
    """filtered() for series of any length, none of which any task holds: cell, t, v.

    Series are cut into parts of at most `size` samples by a range partitioning. A part is filtered from rest; its last
    state, a few numbers, is all that the parts behind it need: they add it through powers of the filter's matrix. The
    states of a cell's parts, one short row each, are carried along in one small group, once forward and once back. Both
    ends are extended by 27 samples as in filtered(). Null samples are left out; series of 27 samples or fewer raise an
    error; `t` must differ within a cell. An empty table gives an empty result."""
    pad, sections = 27, signal.butterworth(order, cutoff, rate, high)
    level = high if level is None else level
    parts = _parts(series.where("v is not null"), size, ranges)
    whole = parts.groupBy("cell").agg(F.sum("n").alias("all"), F.max("part").alias("last"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("sum"))
    before = Window.partitionBy("cell").orderBy("part")
    meta = parts.select("cell", "part", "n").withColumn("upto", F.sum("n").over(before)).join(whole, "cell").withColumn("left", F.col("all") - F.col("upto") + F.col("n"))
    # the first and the last 28 samples of each cell, from the few parts that hold them
    ends = parts.join(meta.where(f"upto - n <= {pad} or left - n <= {pad}").select("cell", "part", "all", "sum"), ["cell", "part"])
    head, tail = F.slice("v", 1, pad + 1), F.slice(F.reverse("v"), 1, pad + 1)
    ends = ends.groupBy("cell").agg(F.first("all").alias("all"), F.first("sum").alias("sum"), F.array_sort(F.collect_list(F.struct("part", head.alias("head"), tail.alias("tail")))).alias("e"))
    ends = ends.select("cell", "all", (F.col("sum") / F.col("all") if level else F.lit(0.0)).alias("mean"), F.slice(F.flatten("e.head"), 1, pad + 1).alias("head"), F.slice(F.flatten(F.reverse("e.tail")), 1, pad + 1).alias("tail"))
    stop = F.raise_error(F.format_string(f"a series needs more than {pad} samples, got %d", "all")).cast("boolean")
    ends = cut(ends.where(F.when(F.col("all") > pad, True).otherwise(stop)), "series-ends")
    known = bounded(ends.select("cell", "mean"))

    def states(batches):
        """The state that each part leaves from rest."""
        f = signal.Recursive(sections)
        for b in batches:
            for cell, part, n, v, mean in _rows_of(b):
                yield _row(cell=cell, part=part, n=n, s=f.run(v - mean)[1])

    def carried(forward: bool):
        def run(key, rows, edge):
            f = signal.Recursive(sections)
            rows = rows.sort_values("part", ascending=forward)
            if forward:
                h = np.array(edge["head"].iloc[0]) - edge["mean"].iloc[0]
                x = 2 * h[0] - h[pad:0:-1]
                state = f.run(x, f.steady * x[0])[1]
            else:
                y = np.array(edge["y"].iloc[0])[::-1]
                state = f.run(y, f.steady * y[0])[1]
            begins = []
            for n, s in zip(rows["n"], rows["s"], strict=True):
                begins.append(state)
                state = f.jump(int(n)) @ state + np.array(s)
            out = {"cell": rows["cell"].to_numpy(), "part": rows["part"].to_numpy(), "s": [b.tolist() for b in begins]}
            if forward:
                t = np.array(edge["tail"].iloc[0]) - edge["mean"].iloc[0]
                y = f.run(2 * t[0] - t[1:], state)[0]
                out["y"] = [y.tolist()] * len(rows)
            return pd.DataFrame(out)

        return run

    def ahead(batches):
        f = signal.Recursive(sections)
        for b in batches:
            for cell, part, n, t, v, mean, s in _rows_of(b):
                y = f.run(v - mean, s)[0]
                yield _row(cell=cell, part=part, n=n, t=t, v=y, b=f.run(y[::-1])[1])

    def back(batches):
        f = signal.Recursive(sections)
        for b in batches:
            for cell, t, v, s in _rows_of(b):
                y = f.run(v[::-1], s)[0][::-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), cell)), pa.array(t), pa.array(y)], names=["cell", "t", "v"])

    level_ = parts.join(known, "cell")
    rest = level_.select("cell", "part", "n", "v", "mean").mapInArrow(states, "cell long, part long, n long, s array<double>")
    begin = rest.groupBy("cell").cogroup(ends.groupBy("cell")).applyInPandas(carried(True), "cell long, part long, s array<double>, y array<double>")
    begin = cut(begin, "series-states")
    x = level_.join(bounded(begin.select("cell", "part", "s")), ["cell", "part"]).select("cell", "part", "n", "t", "v", "mean", "s")
    once = cut(x.mapInArrow(ahead, "cell long, part long, n long, t array<long>, v array<double>, b array<double>"), "series-once")
    edge = begin.groupBy("cell").agg(F.first("y").alias("y"))
    again = once.select("cell", "part", "n", F.col("b").alias("s")).groupBy("cell").cogroup(edge.groupBy("cell")).applyInPandas(carried(False), "cell long, part long, s array<double>")
    return once.join(bounded(again), ["cell", "part"]).select("cell", "t", "v", "s").mapInArrow(back, "cell long, t long, v double")


def fast_filtered(series: DataFrame, rate: float, cutoff: float, high: bool = False) -> DataFrame:
    """As filtered(), with the rate as a whole number and no mean taken off."""
    return filtered(series, float(max(1, round(rate))), cutoff, high, level=False)


def longer_than(series: DataFrame, least: int) -> DataFrame:
    """The series of more than `least` samples."""
    return series.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where(F.col("n") > least).drop("n")


def guarded(df: DataFrame, least: int, what: str, by: str) -> DataFrame:
    """df as it is; reading it fails if a group has `least` rows or fewer."""
    n = F.count("*").over(Window.partitionBy(by))
    stop = F.raise_error(F.format_string(f"more than {least} {what} are needed, got %d", "_n")).cast("boolean")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > least, True).otherwise(stop)).drop("_n")


def welch_spectra(series: DataFrame, rate: float, length: int = 512) -> DataFrame:
    """series (cell, t, v) -> cell, f, s."""
    got = by_series(series.select(F.col("cell").cast("long"), F.col("t").cast("long"), "v"), lambda rows: signal.welch_rows(rows, rate, length), 2)
    return got.select("cell", F.explode(F.arrays_zip("o0", "o1")).alias("r")).select("cell", F.col("r.o0").alias("f"), F.col("r.o1").alias("s"))


def centre_spectrum(cube: DataFrame, rows: int, cols: int, rate: float, length: int = 512, reach: int = 5, scale: float = 1e-3) -> DataFrame:
    """cube (t, i, j, z) -> f, s: Welch spectra of the cells within `reach` of the middle, averaged; the middle one
    counts twice. Every series has its mean taken off; heights are scaled (millimetres to metres)."""
    i0, j0 = rows // 2, cols // 2
    near = cube.where((F.abs(F.col("i") - i0) <= reach) & (F.abs(F.col("j") - j0) <= reach))
    wide = near.select((F.col("i").cast("long") * cols + F.col("j")).alias("cell"), F.col("t").cast("long").alias("t"), (F.col("z") * scale).alias("v"))
    spectra = welch_spectra(wide, rate, length)
    weight = F.when(F.col("cell") == i0 * cols + j0, 2.0).otherwise(1.0)
    return spectra.groupBy("f").agg((F.sum(F.col("s") * weight) / F.sum(weight)).alias("s"))


def time_step(df: DataFrame, time: str = "time") -> DataFrame:
    """dt: the second time less the first; null for fewer than two."""
    two = df.select(F.col(time).alias("x")).distinct().orderBy("x").limit(2)
    return two.agg(F.when(F.count("*") == 2, F.max("x") - F.min("x")).alias("dt"))


def clip_extremes(cube: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """The cube clipped to low..high, and one row with the extremes before and after."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("z")))
    ends = cube.agg(F.min("z").alias("before_min"), F.max("z").alias("before_max"), F.min(clipped).alias("zmin"), F.max(clipped).alias("zmax"))
    return cube.withColumn("z", clipped), ends


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """f, s: the mean over cells."""
    return spectra.groupBy("f").agg(F.avg("s").alias("s"))


def spectral_moments(spectrum: DataFrame, by: str = "cell") -> DataFrame:
    """(by, f, s) -> m0, m1, significant height, mean period, peak; frequency steps are gradients."""
    w = Window.partitionBy(by).orderBy("f")
    before, after = F.lag("f").over(w), F.lead("f").over(w)
    df = (F.coalesce(after, F.col("f")) - F.coalesce(before, F.col("f"))) / F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
    m = spectrum.withColumn("df", df).groupBy(by).agg(F.sum(F.col("s") * F.col("df")).alias("m0"), F.sum(F.col("s") * F.col("f") * F.col("df")).alias("m1"), F.max(F.struct("s", (-F.col("f")).alias("g"))).alias("p"))
    peak = -F.col("p.g")
    return m.select(by, "m0", "m1", (4 * F.sqrt("m0")).alias("hm0"), (F.col("m0") / F.nullif("m1", F.lit(0.0))).alias("tm01"), peak.alias("peak_freq"), (1 / F.nullif(peak, F.lit(0.0))).alias("peak_period"))


def moving_mean(series: DataFrame, size: int) -> DataFrame:
    """Moving mean of `size` samples along t with mirrored ends; an even size reaches one sample further back."""
    w = Window.partitionBy("cell")
    n = F.max("t").over(w)
    first = series.where(F.col("t") < size // 2).select("cell", (-1 - F.col("t")).alias("t"), "v", F.lit(False).alias("own"))
    last = series.withColumn("n", n).where(F.col("t") > F.col("n") - size // 2).select("cell", (2 * F.col("n") + 1 - F.col("t")).alias("t"), "v", F.lit(False).alias("own"))
    every = series.select("cell", "t", "v", F.lit(True).alias("own")).union(first).union(last)
    frame = w.orderBy("t").rowsBetween(-(size // 2), size - size // 2 - 1)
    return every.select("cell", "t", "v", "own", F.avg("v").over(frame).alias("bg")).where("own").select("cell", "t", "v", "bg")


def long_moving_mean(series: DataFrame, size: int, part: int = 1 << 14, ranges: int | None = None) -> DataFrame:
    """moving_mean() for series of any length, none of which any task holds: cell, t, v, bg.

    A range partitioning gives every run of samples its place in the series; blocks of `part` samples, `size` at least, then get the
    samples up to half a window before and behind them, and no others. Null and NaN samples don't count in a mean and
    stay in the result. `t` must differ within a cell; an empty table gives an empty result."""
    half, part = size // 2, max(part, size)
    parts = _parts(series, part, ranges)
    w = Window.partitionBy("cell")
    meta = parts.select("cell", "part", "n", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("at"), F.sum("n").over(w).alias("all"))
    placed = parts.select("cell", "part", "t", "v").join(bounded(meta), ["cell", "part"]).select("cell", "at", "n", "all", "t", "v")

    def dealt(batches):
        for b in batches:
            for cell, at, n, whole, t, v in _rows_of(b):
                for block in range(max(0, (at - half) // part), (at + n - 1 + half) // part + 1):
                    a, z = max(block * part - half - at, 0), min((block + 1) * part + half - at, n)
                    if a < z:
                        yield _row(cell=cell, block=block, at=at + a, all=whole, t=t[a:z], v=v[a:z])

    def means(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "all")), range(table.num_rows), strict=True))
        cell, block, whole = table.column("cell")[0].as_py(), table.column("block")[0].as_py(), rows[0][1]
        t, v = (np.concatenate([table.column(c)[k].values.to_numpy(zero_copy_only=False) for _, _, k in rows]) for c in "tv")
        first, last = rows[0][0], rows[0][0] + len(v)
        own, end = block * part, min((block + 1) * part, whole)
        if own >= end:  # only what lies around a block that isn't there
            return pa.table({"cell": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "v": pa.array([], pa.float64()), "bg": pa.array([], pa.float64())})
        x, begin = v, first
        if first == 0:
            head = v[: min(half, whole)][::-1]
            x, begin = np.concatenate([head, x]), -len(head)
        if last == whole:
            x = np.concatenate([x, v[max(len(v) - half, 0) :][::-1]])
        counts = np.r_[0, np.cumsum(~np.isnan(x))]
        level = np.nanmean(x) if counts[-1] else 0.0  # keeps the sums small
        sums = np.r_[0.0, np.cumsum(np.where(np.isnan(x), 0.0, x - level))]
        at = np.arange(own, end) - begin
        a, z = np.maximum(at - half, 0), np.minimum(at + size - half, len(x))
        n = counts[z] - counts[a]
        bg = np.where(n > 0, (sums[z] - sums[a]) / np.maximum(n, 1) + level, np.nan)
        here = slice(own - first, end - first)
        return pa.table({"cell": pa.array(np.full(end - own, cell)), "t": pa.array(t[here]), "v": pa.array(v[here], from_pandas=True), "bg": pa.array(bg, from_pandas=True)})

    pieces = placed.mapInArrow(dealt, "cell long, block long, at long, all long, t array<long>, v array<double>")
    return pieces.groupBy("cell", "block").applyInArrow(means, "cell long, t long, v double, bg double")


def over_background(df: DataFrame, threshold: float, by: str = "cell") -> DataFrame:
    """(by, v, bg) with `over`: whether v exceeds the background, less its smallest value, by more than threshold."""
    least = F.min("bg").over(Window.partitionBy(by))
    return df.withColumn("over", (F.col("v") - (F.col("bg") - least)) > threshold)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n, density; every bin has a row, the last one is closed."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("total"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col(value) - F.col("a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    rows = F.broadcast(ends).select("a", width.alias("w"), "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return rows.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), n.alias("n"), (n / F.nullif(F.col("total") * F.col("w"), F.lit(0.0))).alias("density"))


def automatic_threshold(bins: DataFrame) -> DataFrame:
    """The right edge of the bin farthest from the line between the peak and the last bin; one row."""
    one = bins.agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("p"), F.max(F.struct("bin", "n")).alias("e"))
    x0, y0, x1, y1 = -F.col("p.b"), F.col("p.n"), F.col("e.bin"), F.col("e.n")
    away = F.abs((y1 - y0) * F.col("bin") - (x1 - x0) * F.col("n") + x1 * y0 - y1 * x0)
    x = bins.crossJoin(F.broadcast(one)).where(F.col("bin") >= x0).withColumn("away", away.cast("double"))
    return x.agg(F.max(F.struct("away", (-F.col("bin")).alias("b"), "high")).alias("m")).select((-F.col("m.b")).alias("bin"), F.col("m.high").alias("threshold"))


def segments(series: DataFrame, length: int) -> DataFrame:
    """cell, t, v, segment, place: samples dealt to segments of `length` (even) with half overlap; incomplete last
    segments are left out."""
    hop = length // 2
    n = F.count("*").over(Window.partitionBy("cell"))
    k = F.floor(F.col("t") / hop)
    x = series.withColumn("n", n).withColumn("segment", F.explode(F.array(k - 1, k)))
    x = x.where((F.col("segment") >= 0) & (F.col("segment") * hop + length <= F.col("n")))
    return x.select("cell", "t", "v", F.col("segment").cast("long").alias("segment"), (F.col("t") - F.col("segment") * hop).alias("place"))


def slopes(cube: DataFrame) -> DataFrame:
    """cube (t, i, j, z) -> sx, sy and the unit normal: central differences between existing neighbours, one-sided at
    the ends of a row or column."""

    def along(line, at):
        w = Window.partitionBy("t", line).orderBy(at)
        zb, za, kb, ka = F.lag("z").over(w), F.lead("z").over(w), F.lag(at).over(w), F.lead(at).over(w)
        return (F.coalesce(za, F.col("z")) - F.coalesce(zb, F.col("z"))) / F.nullif(F.coalesce(ka, F.col(at)) - F.coalesce(kb, F.col(at)), F.lit(0))

    x = cube.withColumn("sy", along("j", "i")).withColumn("sx", along("i", "j"))
    n = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + 1)
    return x.select("t", "i", "j", "z", "sx", "sy", (-F.col("sx") / n).alias("nx"), (-F.col("sy") / n).alias("ny"), (1 / n).alias("nz"))


def _surface(pdf: pd.DataFrame, rows: int, cols: int) -> np.ndarray:
    out = np.full((rows, cols), np.nan)
    out[pdf.i.to_numpy(), pdf.j.to_numpy()] = pdf.z.to_numpy(float)
    return out


def by_surface(cube: DataFrame, rows: int, cols: int, kernel) -> DataFrame:
    """t, i, j, z of kernel(surface), frame by frame; NaN results are left out."""

    def run(pdf):
        z = kernel(_surface(pdf, rows, cols))
        i, j = np.nonzero(~np.isnan(z))
        return pd.DataFrame({"t": pdf.t.iloc[0], "i": i, "j": j, "z": z[i, j]})

    return cube.groupBy("t").applyInPandas(run, "t int, i int, j int, z double")


def low_passed(cube: DataFrame, rows: int, cols: int, step: float, cutoff: float) -> DataFrame:
    """Spatial low pass; missing cells count as the surface's mean and stay missing."""
    gain = signal.low_pass_gain(rows, cols, step, cutoff)

    def kernel(z):
        full = np.where(np.isnan(z), np.nanmean(z), z)
        return np.where(np.isnan(z), np.nan, np.fft.ifft2(np.fft.fft2(full) * gain).real)

    return by_surface(cube, rows, cols, kernel)


def cosine_filled(cube: DataFrame, rows: int, cols: int, frequencies: int = 16) -> DataFrame:
    return by_surface(cube, rows, cols, lambda z: signal.cosine_fill(z, frequencies))


def occluded(cube: DataFrame, rows: int, cols: int, eye: tuple[float, float, float]) -> DataFrame:
    """z is 1 where the eye is hidden, else 0."""
    return by_surface(cube, rows, cols, lambda z: np.where(np.isnan(z), np.nan, signal.shadowed(z, eye)))


def spectrum3d(cube: DataFrame, rows: int, cols: int, frames: int, rate: float, step: float, segments_: int = 10, shift: int = -20) -> DataFrame:
    """cube (t, i, j, z), t from 0 to frames - 1 -> fi, ki, kj, s: density over frequency and wavenumbers by Welch's
    method over segments with half overlap, of the square that centre_window() gives.

    Missing cells become their mean over the segment, or else the segment's mean, which is taken off, and symmetric Hann windows are
    laid along all three axes. The transform is split: over space frame by frame, then over time row by row."""
    r0, c0, side = signal.centre_window(rows, cols, shift)
    nt = signal.segment_length(frames, segments_)
    hop, scale = nt // 2, signal.spectrum_scale(nt, side, rate, step)
    window, window_t = np.outer(np.hanning(side), np.hanning(side)), np.hanning(nt)
    places = F.sequence(F.lit(0), F.lit(side - 1))
    x = cube.where((F.col("i") >= r0) & (F.col("i") < r0 + side) & (F.col("j") >= c0) & (F.col("j") < c0 + side))
    x = x.select(F.col("t").cast("int").alias("t"), (F.col("i") - r0).cast("int").alias("i"), (F.col("j") - c0).cast("int").alias("j"), F.nanvl("z", F.lit(None).cast("double")).alias("z"))
    grid_ = cube.sparkSession.range(frames).select(F.col("id").cast("int").alias("t"), F.explode(places).alias("i")).select("t", "i", F.explode(places).alias("j"))
    k = F.floor(F.col("t") / hop).cast("int")
    x = grid_.join(x, ["t", "i", "j"], "left").withColumn("segment", F.explode(F.array(k - 1, k)))
    x = x.where((F.col("segment") >= 0) & (F.col("segment") * hop + nt <= frames) & (F.col("segment") < 2 * segments_))
    x = x.withColumn("z", F.coalesce("z", F.avg("z").over(Window.partitionBy("segment", "i", "j"))))
    means = x.groupBy("segment").agg(F.avg("z").alias("m"))
    x = x.join(F.broadcast(means), "segment").select("segment", (F.col("t") - F.col("segment") * hop).alias("place"), "i", "j", F.coalesce(F.col("z") - F.col("m"), F.lit(0.0)).alias("z"))  # 2 * segments rows at most

    def space(pdf):
        z = np.zeros((side, side))
        z[pdf.i.to_numpy(), pdf.j.to_numpy()] = pdf.z.to_numpy(float)
        h = np.fft.fftshift(np.fft.fft2(z * window))
        return pd.DataFrame({"segment": pdf.segment.iloc[0], "place": pdf.place.iloc[0], "ki": np.arange(side) - side // 2, "re": list(h.real), "im": list(h.imag)})

    def time(pdf):
        pdf = pdf.sort_values("place")
        h = (np.stack(pdf.re.tolist()) + 1j * np.stack(pdf.im.tolist())) * window_t[:, None]
        s = np.abs(np.fft.fftshift(np.fft.fft(h, axis=0), axes=0)) ** 2 * scale
        a, b = np.mgrid[0:nt, 0:side]
        return pd.DataFrame({"fi": (a - nt // 2).ravel(), "ki": pdf.ki.iloc[0], "kj": (b - side // 2).ravel(), "s": s.ravel()})

    wide = x.groupBy("segment", "place").applyInPandas(space, "segment int, place int, ki int, re array<double>, im array<double>")
    return wide.groupBy("segment", "ki").applyInPandas(time, "fi int, ki int, kj int, s double").groupBy("fi", "ki", "kj").agg(F.avg("s").alias("s"))


def force_zero_mean(cube: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cube less each cell's mean over time, and one row with its limits: zmean 0 and zmax = -zmin, the larger of
    both extremes' sizes."""
    w = Window.partitionBy("i", "j")
    out = cube.withColumn("z", F.col("z") - F.avg("z").over(w)).select("t", "i", "j", "z")
    m = F.greatest(F.abs(F.min("z")), F.abs(F.max("z")))
    return out, out.agg((-m).alias("zmin"), m.alias("zmax"), F.lit(0.0).alias("zmean"))


def visibility(cube: DataFrame, rows: int, cols: int, eye: tuple[float, float, float], most: float = 88.0) -> DataFrame:
    """cube -> t, i, j, angle (of incidence at the eye), visible: cells whose normal is turned from the eye by less
    than `most` degrees and that no part of the surface hides."""
    from swellframe.functions import geometry as g

    hidden = occluded(cube, rows, cols, eye).withColumnRenamed("z", "hidden")
    s = slopes(cube)
    angle = g.incidence(F.col("nx"), F.col("ny"), F.col("nz"), F.col("j").cast("double"), F.col("i").cast("double"), F.col("z"), (eye[1], eye[0], eye[2]))
    x = s.select("t", "i", "j", angle.alias("angle")).join(hidden, ["t", "i", "j"])
    return x.select("t", "i", "j", "angle", ((F.col("hidden") == 0) & F.coalesce(F.col("angle") < most, F.lit(False))).alias("visible"))


def nan_replaced(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """NaN and null become the mean of the group's other values."""
    clean = F.nanvl(value, F.lit(None).cast("double"))
    return df.withColumn(value, F.coalesce(clean, F.avg(clean).over(Window.partitionBy(*by))))


def hidden_share(mask: DataFrame) -> DataFrame:
    return mask.groupBy("t").agg((F.avg("z") * 100).alias("hidden_percent"), F.count("*").alias("cells"))


def timestamped(df: DataFrame, rate: float, index: Column | None = None) -> DataFrame:
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return df.withColumn("time", (F.col("t") if index is None else index) / rate)
