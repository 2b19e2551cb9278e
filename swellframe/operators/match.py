"""Features and matches. Pairs are only made within a frame, which holds a bounded number of features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: str, b: str) -> Column:
    """Of two descriptors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of camera 1 for each feature of camera 0, by blocks of a matrix product; distances of a few more
    candidates are then worked out exactly."""
    one, two = (pdf[pdf.cam == c].sort_values("fid") for c in (0, 1))
    if not len(one) or not len(two):
        return pd.DataFrame({"frame": [], "fa": [], "fb": [], "d2": [], "rank": []})
    a, b, fb = np.stack(one.descriptor.tolist()).astype(float), np.stack(two.descriptor.tolist()).astype(float), two.fid.to_numpy()
    size, some = (b * b).sum(axis=1), min(k + 8, len(b))
    out = []
    for at in range(0, len(a), 512):
        part = a[at : at + 512]
        rough = size[None] - 2 * part @ b.T
        cand = np.sort(np.argpartition(rough, some - 1, axis=1)[:, :some], axis=1)
        d2 = ((part[:, None] - b[cand]) ** 2).sum(axis=2)
        best = np.argsort(d2, axis=1, kind="stable")[:, :k]
        out.append((fb[np.take_along_axis(cand, best, axis=1)], np.take_along_axis(d2, best, axis=1)))
    ids, d2 = (np.concatenate([o[n] for o in out]) for n in (0, 1))
    n = ids.shape[1]
    return pd.DataFrame({"frame": int(pdf.frame.iloc[0]), "fa": np.repeat(one.fid.to_numpy(), n), "fb": ids.ravel(), "d2": d2.ravel(), "rank": np.tile(np.arange(1, n + 1), len(ids))})


def nearest(features: DataFrame, k: int = 3) -> DataFrame:
    """features (frame, cam, fid, descriptor) -> frame, fa, fb, d2, rank: the k nearest features of camera 1 for each
    of camera 0, ties to the smaller fb."""
    rows = features.select(F.col("frame").cast("long").alias("frame"), F.col("cam").cast("int").alias("cam"), F.col("fid").cast("long").alias("fid"), "descriptor")
    return rows.groupBy("frame").applyInPandas(lambda pdf: _nearest(pdf, k), "frame long, fa long, fb long, d2 double, rank int")


def ratio_tested(knn: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Nearest neighbours closer than `ratio` times the second."""
    best = knn.groupBy("frame", "fa").agg(F.min_by("fb", "rank").alias("fb"), F.min("d2").alias("d1"), F.min(F.when(F.col("rank") == 2, F.col("d2"))).alias("d2"))
    return best.where(F.col("d1") < ratio * F.col("d2")).select("frame", "fa", "fb", "d1", "d2")


def _spatial(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("fid")
    x, y, fid = pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.fid.to_numpy()
    best, away = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), 512):
        d2 = (x[at : at + 512, None] - x) ** 2 + (y[at : at + 512, None] - y) ** 2
        d2[(x[at : at + 512, None] == x) & (y[at : at + 512, None] == y)] = np.inf
        best[at : at + 512] = d2.argmin(axis=1)
        away[at : at + 512] = d2.min(axis=1)
    found = np.isfinite(away)
    return pd.DataFrame({"frame": int(pdf.frame.iloc[0]), "fa": fid[found], "fb": fid[best[found]], "d2": away[found]})


def spatial_nearest(features: DataFrame) -> DataFrame:
    """The nearest other feature in the image, by x and y, ties to the smaller fid; features at the same place are not
    neighbours."""
    rows = features.select(F.col("frame").cast("long").alias("frame"), F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.where("x is not null and y is not null").groupBy("frame").applyInPandas(_spatial, "frame long, fa long, fb long, d2 double")


def payoffs(matches: DataFrame, decay: float = 1e-5) -> DataFrame:
    """matches (frame, m, fa, fb, ax, ay, bx, by, sin, cos, ds) -> frame, m, n, payoff for pairs m < n: 0 if they share
    a feature, else exp(-decay * the larger squared transfer error)."""
    cols = ("m", "fa", "fb", "ax", "ay", "bx", "by", "sin", "cos", "ds")
    p = matches.select("frame", *[F.col(c).alias(f"{c}1") for c in cols])
    q = matches.select("frame", *[F.col(c).alias(f"{c}2") for c in cols])

    def error(one, two):
        dx, dy = F.col(f"ax{two}") - F.col(f"ax{one}"), F.col(f"ay{two}") - F.col(f"ay{one}")
        px = F.col(f"bx{one}") + F.col(f"ds{one}") * (F.col(f"cos{one}") * dx - F.col(f"sin{one}") * dy)
        py = F.col(f"by{one}") + F.col(f"ds{one}") * (F.col(f"sin{one}") * dx + F.col(f"cos{one}") * dy)
        return (px - F.col(f"bx{two}")) ** 2 + (py - F.col(f"by{two}")) ** 2

    shared = (F.col("fa1") == F.col("fa2")) | (F.col("fb1") == F.col("fb2"))
    worst = F.greatest(error(1, 2), error(2, 1))
    return p.join(q, "frame").where("m1 < m2").select("frame", F.col("m1").alias("m"), F.col("m2").alias("n"), F.when(shared, 0.0).otherwise(F.exp(-decay * worst)).alias("payoff"))


def without_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that share neither feature with a used match of their frame."""
    return candidates.join(used.select("frame", "fa").distinct(), ["frame", "fa"], "left_anti").join(used.select("frame", "fb").distinct(), ["frame", "fb"], "left_anti")


def inside_border(features: DataFrame, width: float, height: float) -> DataFrame:
    """Features farther than a thirtieth of the width, two pixels at least, from the image's edges."""
    edge = max(width / 30, 2.0)
    return features.where((F.col("x") > edge) & (F.col("x") < width - edge) & (F.col("y") > edge) & (F.col("y") < height - edge))


def capped(features: DataFrame, per_cell: int) -> DataFrame:
    """features (frame, cell, fid, response): the strongest of each cell, in the order rank by rank, cell by cell."""
    rank = F.row_number().over(Window.partitionBy("frame", "cell").orderBy(F.desc("response"), "fid"))
    top = features.withColumn("rank", rank).where(F.col("rank") <= per_cell)
    order = F.row_number().over(Window.partitionBy("frame").orderBy("rank", "cell"))
    return top.select("frame", "cell", "fid", "rank", order.alias("place"))


def shared_out(features: DataFrame, most: int) -> DataFrame:
    """features (frame, cell, fid, response): `most` of each frame at most. Every cell may have an equal part; what some
    leave goes to the others, rank by rank, so the cells' numbers differ by one at most unless a cell has no more."""
    rank = F.row_number().over(Window.partitionBy("frame", "cell").orderBy(F.desc("response"), "fid"))
    ranked = features.withColumn("rank", rank)
    place = F.row_number().over(Window.partitionBy("frame").orderBy("rank", "cell"))
    return ranked.where(F.col("rank") <= most).withColumn("place", place).where(F.col("place") <= most).select("frame", "cell", "fid", "rank", "place")


def drawn_frames(frames: DataFrame, most: int = 50, order: Column | None = None) -> DataFrame:
    """At most `most` frames in a hashed order, returned by number."""
    return frames.select("frame").distinct().orderBy(F.xxhash64("frame") if order is None else order, "frame").limit(most).orderBy("frame")


def reprojection_stats(matches: DataFrame) -> DataFrame:
    """(frame, ax, ay, bx, by, pax, pay, pbx, pby: places and their reprojections) -> error_stats() of the mean of both
    distances."""
    away = lambda k: F.sqrt((F.col(f"{k}x") - F.col(f"p{k}x")) ** 2 + (F.col(f"{k}y") - F.col(f"p{k}y")) ** 2)
    return error_stats(matches.select("frame", ((away("a") + away("b")) / 2).alias("err")))


def _thinned(pdf: pd.DataFrame, distance: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["response", "fid"], ascending=[False, True])
    xy = pdf[["x", "y"]].to_numpy(float)
    kept: list[int] = []
    for i, p in enumerate(xy):
        if not kept or ((xy[kept] - p) ** 2).sum(axis=1).min() >= distance * distance:
            kept.append(i)
    return pdf.iloc[kept]


def thinned(features: DataFrame, distance: float = 10.0) -> DataFrame:
    """Greedy suppression in each frame's cell: a feature stays if no stronger one that stays is nearer."""
    return features.groupBy("frame", "cell").applyInPandas(lambda pdf: _thinned(pdf, distance), features.schema)


def error_stats(errors: DataFrame) -> DataFrame:
    """(frame, err) -> number, mean, population deviation and extremes."""
    return errors.groupBy("frame").agg(F.count("err").alias("n"), F.avg("err").alias("avg_err"), F.stddev_pop("err").alias("std_err"), F.min("err").alias("min_err"), F.max("err").alias("max_err"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def play(payoff: np.ndarray, rounds: int = 5_000, tolerance: float = 1e-7) -> np.ndarray:
    """Equilibrium of the game with this payoff: from the uniform population, the strategy that gains or loses most
    invades or is driven out by the best step, until none deviates by more than the tolerance."""
    n = len(payoff)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        gain = payoff @ x
        gain -= x @ gain
        up, down = gain.max(), np.where(x > 0, gain, 0).min()
        if max(up, -down) <= tolerance:
            break
        k = int(gain.argmax()) if up >= -down else int(np.where(x > 0, gain, 0).argmin())
        to = np.zeros(n)
        to[k] = 1.0
        if up < -down:  # leave the strategy: move away from it as far as it has weight
            if x[k] >= 1:
                break
            to = x + (x - to) * (x[k] / (1 - x[k]))
        step = to - x
        rise, bend = step @ payoff @ x, step @ payoff @ step
        size = 1.0 if bend >= 0 else min(1.0, -rise / bend)
        x = np.clip(x + size * step, 0, None)
        x /= x.sum()
    return x


def payoff_matrix(pdf: pd.DataFrame, decay: float) -> np.ndarray:
    """payoffs() of one frame's matches as a symmetric matrix."""
    ax, ay, bx, by, sin, cos, ds = (pdf[c].to_numpy(float) for c in ("ax", "ay", "bx", "by", "sin", "cos", "ds"))
    dx, dy = ax[None] - ax[:, None], ay[None] - ay[:, None]
    px = bx[:, None] + ds[:, None] * (cos[:, None] * dx - sin[:, None] * dy)
    py = by[:, None] + ds[:, None] * (sin[:, None] * dx + cos[:, None] * dy)
    error = (px - bx[None]) ** 2 + (py - by[None]) ** 2
    out = np.exp(-decay * np.maximum(error, error.T))
    fa, fb = pdf.fa.to_numpy(), pdf.fb.to_numpy()
    out[(fa[:, None] == fa[None]) | (fb[:, None] == fb[None])] = 0.0
    return out


def _groups(pdf: pd.DataFrame, decay: float, share: float, least: int, rounds: int) -> pd.DataFrame:
    pdf = pdf.sort_values("m")
    names, a = pdf.m.to_numpy(), payoff_matrix(pdf, decay)
    left, out = np.arange(len(names)), []
    for turn in range(rounds):
        if len(left) < least:
            break
        x = play(a[np.ix_(left, left)])
        take = x > share * x.max()
        if take.sum() < least:
            break
        out += [(int(pdf.frame.iloc[0]), int(names[k]), turn) for k in left[take]]
        left = left[~take]
    return pd.DataFrame(out, columns=["frame", "m", "turn"])


def game_selected(matches: DataFrame, decay: float = 1e-5, share: float = 0.7, least: int = 5, rounds: int = 20) -> DataFrame:
    """matches as for payoffs() -> frame, m, turn: groups of matches that agree, found turn by turn in each frame. The
    payoffs are worked out where they are used, so that only matches are shuffled."""
    rows = matches.select(F.col("frame").cast("long").alias("frame"), F.col("m").cast("long").alias("m"), "fa", "fb", "ax", "ay", "bx", "by", "sin", "cos", "ds")
    return rows.groupBy("frame").applyInPandas(lambda pdf: _groups(pdf, decay, share, least, rounds), "frame long, m long, turn int")


def centred(matches: DataFrame) -> DataFrame:
    """Matches with both sides' places moved to their mean and divided by their spread, by frame; the columns ma, mb
    (mean x, mean y, spread) tell how. Normal equations of such places keep their digits."""
    def side(k):
        spread = F.sqrt(F.var_pop(f"{k}x") + F.var_pop(f"{k}y"))
        return F.array(F.avg(f"{k}x"), F.avg(f"{k}y"), F.when(spread > 0, spread).otherwise(1.0)).alias(f"m{k}")

    x = matches.join(matches.groupBy("frame").agg(side("a"), side("b")), "frame")
    near = [((F.col(f"{k}{c}") - F.col(f"m{k}")[n]) / F.col(f"m{k}")[2]).alias(f"{k}{c}") for k in "ab" for n, c in enumerate("xy")]
    return x.select("frame", "ma", "mb", *near)


def homography_sums(matches: DataFrame) -> DataFrame:
    """Normal equations (45 sums) of the direct linear transform from (ax, ay) to (bx, by), by frame."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    zero, one = F.lit(0.0), F.lit(1.0)
    r1 = [ax, ay, one, zero, zero, zero, -bx * ax, -bx * ay, -bx]
    r2 = [zero, zero, zero, ax, ay, one, -by * ax, -by * ay, -by]
    return matches.groupBy("frame").agg(*[F.sum(r1[i] * r1[j] + r2[i] * r2[j]).alias(f"n{i}{j}") for i in range(9) for j in range(i, 9)])


def _scaling(m) -> np.ndarray:
    return np.array([[1 / m[2], 0, -m[0] / m[2]], [0, 1 / m[2], -m[1] / m[2]], [0, 0, 1]])


def homographies(matches: DataFrame) -> DataFrame:
    """frame, h (nine numbers of unit length, the last not negative): the least-squares homography of each frame."""

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((9, 9))
                for i in range(9):
                    for j in range(i, 9):
                        m[i, j] = m[j, i] = getattr(r, f"n{i}{j}")
                h = np.linalg.inv(_scaling(r.mb)) @ np.linalg.eigh(m)[1][:, 0].reshape(3, 3) @ _scaling(r.ma)
                h = h.ravel() / np.linalg.norm(h)
                out.append((r.frame, (h if h[8] >= 0 else -h).tolist()))
            yield pd.DataFrame(out, columns=["frame", "h"])

    x = centred(matches)
    scales = x.groupBy("frame").agg(F.any_value("ma").alias("ma"), F.any_value("mb").alias("mb"))
    return homography_sums(x).join(scales, "frame").mapInPandas(solve, "frame long, h array<double>")


def _reweighted(px, py, qx, qy, r: np.ndarray, t: np.ndarray, rounds: int) -> np.ndarray:
    one, nil = np.ones_like(px), np.zeros_like(px)
    a = np.stack([np.stack([one, nil, -px], 1), np.stack([nil, one, -py], 1), r[0] - qx[:, None] * r[2], r[1] - qy[:, None] * r[2]], axis=1)
    b = np.stack([nil, nil, qx * t[2] - t[0], qy * t[2] - t[1]], axis=1)
    w, out = np.ones((len(px), 4)), np.full((len(px), 3), np.nan)
    for _ in range(rounds + 1):
        aw, bw = a * w[:, :, None], b * w
        n = np.einsum("kia,kib->kab", aw, aw)
        good = np.abs(np.linalg.det(n)) > 0
        out = np.full((len(px), 3), np.nan)
        out[good] = np.linalg.solve(n[good], np.einsum("kia,ki->ka", aw, bw)[good][:, :, None])[:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            first, second = 1 / out[:, 2], 1 / (out @ r[2] + t[2])
        w = np.where(np.isfinite(v := np.stack([first, first, second, second], axis=1)), v, 0.0)
    return out


def reweighted(matches: DataFrame, r, t, rounds: int = 5) -> DataFrame:
    """Matches (..., px, py, qx, qy: normalised places) with x, y, z: least-squares points whose equations are divided
    by the depth that the round before found, which makes them distances in the image; null where they are singular."""
    r, t = np.array(r, float), np.array(t, float)

    def run(batches):
        for pdf in batches:
            p = _reweighted(*[pdf[c].to_numpy(float) for c in ("px", "py", "qx", "qy")], r, t, rounds)
            yield pdf.assign(**{c: p[:, k] for k, c in enumerate("xyz")})

    rows = matches.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema) + ", x double, y double, z double")
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "xyz"})
