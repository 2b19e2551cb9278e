"""Nearest points in the plane, and heights interpolated from them, by growing rings of square cells.

A query meets the points of the cells around its own. Its k nearest are certain once the kth is nearer than the rim of
what it has met; queries that aren't certain yet go again with twice the reach, and no others do. Points at one place are one place with
the k smallest ids, so copies cost nothing; cells and the queries around them are split into parts of bounded size, and small ones are worked on
many at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swellframe.tables import bounded, cut

#: Places of a cell, and queries around it, that meet at once.
PART = 4_096
#: Rows, places and queries together, that a call of the tasks' function gets, on average.
LOT = 32_768


def _met(k: int, others: bool):
    def run(key, places: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"frame": [], "qid": [], "d2": [], "ids": [], "zs": []}
        cells = places.groupby(["frame", "a", "b", "part", "block"], sort=False).indices
        x, y, ids, zs = (places[c].to_numpy() for c in ("x", "y", "ids", "zs"))
        own, qid, qx, qy = (asked[c].to_numpy() for c in ("own", "qid", "qx", "qy"))
        for cell, ask in asked.groupby(["own", "qa", "qb", "qpart", "qblock"], sort=False).indices.items():
            here = cells.get(cell, ())
            for at in range(0, len(ask) if len(here) else 0, 512):
                q = ask[at : at + 512]
                d2 = (qx[q][:, None] - x[here]) ** 2 + (qy[q][:, None] - y[here]) ** 2
                if others:
                    d2[d2 == 0] = np.inf
                if d2.shape[1] > k:  # all places at the kth distance stay, for ties
                    most = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
                    row, col = np.nonzero((d2 <= most) & (d2 < np.inf))
                else:
                    row, col = np.nonzero(d2 < np.inf)
                out["frame"].append(own[q[row]])
                out["qid"].append(qid[q[row]])
                out["d2"].append(d2[row, col])
                out["ids"] += ids[here[col]].tolist()
                out["zs"] += zs[here[col]].tolist()
        for c in ("frame", "qid", "d2"):
            out[c] = np.concatenate(out[c]) if out[c] else []
        return pd.DataFrame(out).astype({"ids": object, "zs": object})  # also if there are none

    return run


def nearest_points(points: DataFrame, queries: DataFrame, k: int, cell: float, others: bool = False) -> DataFrame:
    """points (frame, pid, x, y, z) and queries (frame, qid, x, y) -> frame, qid, rank from 1, pid, d2, z: the k nearest
    points of the frame, ties to the smaller pid; all if there are fewer. `others` leaves out points at the query's own place.

    The cell's size decides about time alone; some hundred points a cell are best. Rows with a null key or place, or one that isn't
    finite, are left out; repeated points are points of their own; ids of queries differ within a frame. Frames without points
    find nothing; empty tables give an empty result."""
    fine = lambda df, *keys: df.where(" and ".join([*(f"{c} is not null" for c in keys), "abs(x) < double('inf')", "abs(y) < double('inf')"]))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    rows = fine(points, "frame", "pid").select(F.col("frame").cast("long").alias("frame"), F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("frame", "x", "y").orderBy("pid", "z"))).where(F.col("r") <= k)
    places = few.groupBy("frame", "x", "y").agg(F.array_sort(F.collect_list(F.struct("pid", "z"))).alias("p"))  # k at most
    places = cut(places.select("frame", "x", "y", F.col("p.pid").alias("ids"), F.col("p.z").alias("zs"), at("x").alias("a"), at("y").alias("b")), "places")
    cells = cut(places.groupBy("frame", "a", "b").agg(F.count("*").alias("size"), F.ceil(F.count("*") / PART).cast("int").alias("parts")), "cells")
    dealt = places.join(bounded(cells.drop("size")), ["frame", "a", "b"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).drop("parts")
    box = cells.groupBy("frame").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    asked = fine(queries, "frame", "qid").select(F.col("frame").cast("long").alias("frame"), F.col("qid").cast("long").alias("qid"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    open_ = cut(asked.join(box, "frame").withColumns({"qa": at("qx"), "qb": at("qy")}), "queries")
    reach, found = 1, None
    while True:
        near = open_.select("frame", "qid", "qx", "qy", "qa", "qb")
        for to, c in (("a", "qa"), ("b", "qb")):
            near = near.withColumn(to, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
        near = near.join(bounded(cells), ["frame", "a", "b"])
        load = near.groupBy("frame", "a", "b", "size", "parts").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"), F.count("*").alias("asks"))
        load = bounded(cut(load.withColumn("rows", F.col("size") * F.col("blocks") + F.col("asks") * F.col("parts")).drop("size", "parts", "asks"), "loads"))
        lots = max(1, (load.agg(F.sum("rows")).first()[0] or 0) // LOT)  # small cells share a call, large ones don't
        lot = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(lots))
        load = load.drop("rows")
        asks = near.join(load, ["frame", "a", "b"]).select(F.col("frame").alias("own"), F.col("a").alias("qa"), F.col("b").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qpart"), F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("qblock"), "qid", "qx", "qy")
        here = dealt.join(load, ["frame", "a", "b"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = here.groupBy(lot("frame", "a", "b", "part", "block").alias("lot")).cogroup(asks.groupBy(lot("own", "qa", "qb", "qpart", "qblock").alias("lot"))).applyInPandas(_met(k, others), "frame long, qid long, d2 double, ids array<long>, zs array<double>")
        each = met.select("frame", "qid", "d2", F.explode(F.arrays_zip(F.col("ids").alias("pid"), F.col("zs").alias("z"))).alias("p")).select("frame", "qid", "d2", "p.pid", "p.z")
        best = each.withColumn("rank", F.row_number().over(Window.partitionBy("frame", "qid").orderBy("d2", "pid", "z"))).where(F.col("rank") <= k)
        best = cut(best.select("frame", "qid", "rank", "pid", "d2", "z"), "nearest")
        kth = best.where(F.col("rank") == k).select("frame", "qid", F.col("d2").alias("kth"))
        rim = F.least(*[f for q, c in (("qx", "qa"), ("qy", "qb")) for f in (F.col(q) - (F.col(c) - reach) * cell, (F.col(c) + reach + 1) * cell - F.col(q))])
        whole = (F.col("qa") - reach <= F.col("a0")) & (F.col("qa") + reach >= F.col("a1")) & (F.col("qb") - reach <= F.col("b0")) & (F.col("qb") + reach >= F.col("b1"))
        state = open_.join(kth, ["frame", "qid"], "left").withColumn("sure", whole | F.coalesce(F.col("kth") < rim * rim, F.lit(False)))
        again = cut(state.where(~F.col("sure")).drop("kth", "sure"), "queries")
        sure = best.join(again.select("frame", "qid"), ["frame", "qid"], "left_anti")
        found = sure if found is None else found.union(sure)
        if again.isEmpty():
            return found
        open_, reach = again, reach * 2


def inverse_distance(points: DataFrame, queries: DataFrame, cell: float, k: int = 9, power: float = 2.4) -> DataFrame:
    """points (frame, pid, x, y, z) and queries (frame, qid, x, y) -> frame, qid, z: the mean of the k nearest points' heights, weighted by
    distance to the -power; at a point's own place its height, of several there their mean. Points without a height
    don't count. The cases are those of nearest_points()."""
    near = nearest_points(points.where("z is not null and not isnan(z)"), queries, k, cell)
    w = F.when(F.col("d2") > 0, F.pow("d2", F.lit(-power / 2)))
    sums = near.groupBy("frame", "qid").agg(F.avg(F.when(F.col("d2") == 0, F.col("z"))).alias("own"), F.sum(w * F.col("z")).alias("wz"), F.sum(w).alias("w"))
    return sums.select("frame", "qid", F.coalesce("own", F.col("wz") / F.col("w")).alias("z"))
