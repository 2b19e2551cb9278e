"""Further operators as queries: images, matches, guards, errors against known surfaces and set-up tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from swellframe.functions import geometry as g
from swellframe.operators import cloud as c
from swellframe.operators import image, match, nearest, raster, scattered, surface, temporal
from swellframe.plans.queries import _MATCHES, _RAY, _SHADOW, _SLOPE, _TURNED, CLOUD, COLS, CUBE, FEATURES, REGISTRY, ROWS, SERIES, SHIFT, TURN, _channels, features, matches, query
from swellframe.sources import codecs
from swellframe.tables import cloud, cube, dealt, scratch, series, table

# gates and clouds

_GATE = "gate AS (SELECT l_linenumber AS frame, l_quantity / 2 AS d, l_quantity * 20 - 100 AS xl, l_quantity * 16 AS u0, l_discount * 6000 AS v0, l_quantity * 15 + 30 AS u1, l_tax * 7000 AS v1, l_orderkey % 9 AS mask0, l_partkey % 11 AS mask1, l_suppkey % 256 AS value, l_tax * 100 AS angle, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 - 2 AS z FROM lineitem)"
_TESTS = [
    "d > 1", "xl >= 0 AND xl < 800 AND u0 >= 1 AND u0 < 799 AND v0 >= 1 AND v0 < 599", "u1 >= 1 AND u1 < 799 AND v1 >= 1 AND v1 < 599", "u0 > 50 AND u0 < 700 AND v0 > 20 AND v0 < 580", "mask0 <> 0", "mask1 <> 0",
    "value <= 250", "angle >= 1", "sqrt(x * x + y * y + z * z) >= 2 AND z >= 1", "sqrt(x * x + y * y + z * z) <= 4000 AND z <= 1e30",
]


@query(sql=f"WITH {_GATE} SELECT frame, CASE " + " ".join(f"WHEN NOT ({t}) THEN '{n}'" for n, t in zip(c.GATES, _TESTS, strict=True)) + " END AS reason, count(*) AS n FROM gate GROUP BY 1, 2")
def triangulation_gates(spark, sf_dir):
    """How many triangulated pixels each of the ten gates rejects; null counts those that pass."""
    x = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as frame", "l_quantity / 2 as d", "l_quantity * 20 - 100 as xl", "l_quantity * 16 as u0", "l_discount * 6000 as v0", "l_quantity * 15 + 30 as u1", "l_tax * 7000 as v1", "l_orderkey % 9 as mask0", "l_partkey % 11 as mask1", "l_suppkey % 256 as value", "l_tax * 100 as angle", "l_quantity as x", "l_discount * 100 as y", "l_extendedprice / 1000 - 2 as z")
    tests = c.triangulation_gates((800, 600), (50.0, 20.0, 700.0, 580.0), 20.0, 1.0, 250.0)
    return x.groupBy("frame", c.rejected(tests).alias("reason")).agg(F.count("*").alias("n"))


@query(sql=f"WITH {CUBE} SELECT t, count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM cube WHERE j BETWEEN {COLS // 4} AND {3 * COLS // 4} AND i BETWEEN {ROWS // 4} AND {2 * ROWS // 3} GROUP BY t")
def central_window(spark, sf_dir):
    """The middle of the image, where planes are refined."""
    return c.central(cube(spark, sf_dir), ROWS, COLS).groupBy("t").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


@query("mae", f"WITH {CLOUD}, truth AS (SELECT frame, pid, max(x) * 1.5 AS want FROM cloud GROUP BY 1, 2), e AS (SELECT frame, abs(z - want) AS err FROM cloud JOIN truth USING (frame, pid)), q AS (SELECT frame, quantile_cont(err, 0.999) AS q FROM e GROUP BY frame) SELECT frame, count(*) AS n, avg(err) AS mae, max(err) AS worst FROM e JOIN q USING (frame) WHERE err < q GROUP BY frame", 4)
def mean_abs_error(spark, sf_dir):
    """Mean absolute height error against a known surface, without the largest thousandth."""
    p = cloud(spark, sf_dir)
    return c.mean_abs_error(p, p.groupBy("frame", "pid").agg((F.max("x") * 1.5).alias("z")))


@query(sql=f"WITH {CLOUD}, ce AS (SELECT 1 + k % 7 AS frame, k AS cid, (k * 7 % 50) + 0.5 AS cx, (k * 3 % 10) + 0.25 AS cy FROM (SELECT unnest(range(40)) AS k)) SELECT ce.frame, cid, count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM ce JOIN cloud USING (frame) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 4 GROUP BY 1, 2")
def radius_neighbours(spark, sf_dir):
    """Points within two units of forty places, by squares."""
    at = spark.range(40).select((1 + F.col("id") % 7).cast("int").alias("frame"), F.col("id").alias("cid"), (F.col("id") * 7 % 50 + 0.5).alias("x"), (F.col("id") * 3 % 10 + 0.25).alias("y"))
    return c.radius_neighbours(cloud(spark, sf_dir), at, 2.0).groupBy("frame", "cid").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


_SQUARE = f"WITH {CLOUD}, b AS (SELECT *, floor(x / 10) AS bx, floor(y / 10) AS by_ FROM cloud), m AS (SELECT frame, bx, by_, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, y) AS sxy, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, z) AS sxz, covar_pop(y, z) AS syz FROM b GROUP BY 1, 2, 3), s AS (SELECT *, coalesce((sxz * syy - syz * sxy) / nullif(sxx * syy - sxy * sxy, 0), 0) AS p, coalesce((syz * sxx - sxz * sxy) / nullif(sxx * syy - sxy * sxy, 0), 0) AS q FROM m)"


@query(sql=f"{_SQUARE} SELECT frame, count(*) FILTER (WHERE n >= 8 AND abs(z - mz - p * (x - mx) - q * (y - my)) > 25) AS outliers, count(*) AS points FROM b JOIN s USING (frame, bx, by_) GROUP BY frame")
def square_plane_outliers(spark, sf_dir):
    """Points far from the plane of their square's points."""
    x = c.plane_outliers(cloud(spark, sf_dir), 10.0, 25.0)
    return x.groupBy("frame").agg(F.count_if("outlier").alias("outliers"), F.count("*").alias("points"))


@query("x y z", f"WITH {CLOUD}, m AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud GROUP BY frame) SELECT frame, pid, 0.8 * (x - mx) - 0.6 * (z - mz) AS x, y - my AS y, 0.6 * (x - mx) + 0.8 * (z - mz) AS z FROM cloud JOIN m USING (frame)")
def turned_cloud(spark, sf_dir):
    """Points about their frame's centroid in the axes of a plane."""
    p = cloud(spark, sf_dir)
    planes = p.select("frame").distinct().select("frame", F.lit(0.6).alias("a"), F.lit(0.0).alias("b"), F.lit(0.8).alias("c"), F.lit(0.0).alias("d"))
    return c.turned(p, planes)


_V = f"WITH {CUBE}, v AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY i, j) - 1 AS n FROM cube), x AS (SELECT p.t, p.i, p.j, p.z AS pz, q.z AS qz, r.z AS rz, s.z AS sz, p.n AS pn, q.n AS qn, r.n AS rn, s.n AS sn FROM v q FULL JOIN v p ON p.t = q.t AND p.i = q.i AND p.j = q.j - 1 LEFT JOIN v r ON r.t = p.t AND r.i = p.i + 1 AND r.j = p.j LEFT JOIN v s ON s.t = p.t AND s.i = p.i + 1 AND s.j = p.j + 1 WHERE p.t IS NOT NULL)"


@query(sql=f"{_V} SELECT t, 0 AS k, i, j, pn AS a, qn AS b, rn AS c FROM x WHERE greatest(abs(pz - qz), abs(qz - rz), abs(rz - pz)) < 9 AND qz IS NOT NULL AND rz IS NOT NULL UNION ALL SELECT t, 1, i, j, qn, sn, rn FROM x WHERE greatest(abs(qz - sz), abs(sz - rz), abs(rz - qz)) < 9 AND qz IS NOT NULL AND sz IS NOT NULL AND rz IS NOT NULL")
def mesh_triangles(spark, sf_dir):
    """Triangles between neighbouring cells of like height."""
    return c.mesh_triangles(cube(spark, sf_dir), 9.0)


@query("length", f"WITH {CLOUD}, r AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM cloud WINDOW w AS (PARTITION BY frame ORDER BY pid, x, y, z)) SELECT frame, pid, 2.5 * sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2) + (z - z2) * (z - z2)) AS length FROM r WHERE x2 IS NOT NULL")
def measured_distances(spark, sf_dir):
    """Metric distances of one point to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame").orderBy("pid", "x", "y", "z")
    x = cloud(spark, sf_dir).withColumns({f"{k}2": F.lead(k).over(w) for k in "xyz"}).where("x2 is not null")
    return x.select("frame", "pid", g.distance([F.col(k) for k in "xyz"], [F.col(f"{k}2") for k in "xyz"], 2.5).alias("length"))


@query("x y z", None, 4)
def reweighted_triangulation(spark, sf_dir):
    """Triangulation whose equations are weighted by depth, five rounds."""
    p = cloud(spark, sf_dir).select("frame", "pid", (F.col("x") / 100).alias("px"), (F.col("y") / 20).alias("py"), (F.col("x") / 100 - 0.1 - F.col("z") / 1000).alias("qx"), (F.col("y") / 20 + 0.01).alias("qy"))
    return match.reweighted(p, TURN, SHIFT).select("frame", "pid", "x", "y", "z")


@query("u v", f"WITH {CLOUD} SELECT frame, pid, (1.1 * x + 0.02 * y - 3.0) / nullif(0.001 * x - 0.002 * y + 1.0, 0) AS u, (-0.01 * x + 0.9 * y + 4.0) / nullif(0.001 * x - 0.002 * y + 1.0, 0) AS v FROM cloud")
def unwarped_pixels(spark, sf_dir):
    u, v = g.unwarped(F.col("x"), F.col("y"), ((1.1, 0.02, -3.0), (-0.01, 0.9, 4.0), (0.001, -0.002, 1.0)))
    return cloud(spark, sf_dir).select("frame", "pid", u.alias("u"), v.alias("v"))


@query(sql=f"WITH {CLOUD}, mk AS (SELECT l_linenumber AS frame, CAST(l_partkey % 50 AS INTEGER) AS u, CAST(l_suppkey % 10 AS INTEGER) AS v, max(l_tax) AS z FROM lineitem GROUP BY 1, 2, 3) SELECT p.frame, p.pid, p.x, p.y, p.z, a.z AS mask0, b.z AS mask1 FROM cloud p LEFT JOIN mk a ON a.frame = p.frame AND a.u = floor(p.x + 0.3) AND a.v = floor(p.y + 0.3) LEFT JOIN mk b ON b.frame = p.frame AND b.u = floor(p.x * 0.9 + 0.05) AND b.v = floor(p.y * 0.8 + 0.05)")
def pixel_masks(spark, sf_dir):
    """The masks' values at the pixels of both images that hold a point's places."""
    mask = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 50).cast("int").alias("u"), (F.col("l_suppkey") % 10).cast("int").alias("v")).agg(F.max("l_tax").alias("z"))
    p = cloud(spark, sf_dir).select("*", (F.col("x") + 0.3).alias("u0"), (F.col("y") + 0.3).alias("v0"), (F.col("x") * 0.9 + 0.05).alias("u1"), (F.col("y") * 0.8 + 0.05).alias("v1"))
    return c.with_masks(p, mask, mask).select("frame", "pid", "x", "y", "z", "mask0", "mask1")


_M3 = [["l_quantity", "2.0", "l_discount * 10"], ["1.0", "l_tax * 100 + 3.0", "0.5"], ["l_discount", "0.25", "l_quantity + 7.0"]]
_DET = "(l_quantity * ((l_tax * 100 + 3.0) * (l_quantity + 7.0) - 0.5 * 0.25) - 2.0 * (1.0 * (l_quantity + 7.0) - 0.5 * l_discount) + l_discount * 10 * (1.0 * 0.25 - (l_tax * 100 + 3.0) * l_discount))"


@query("det i00 i01 i22", f"SELECT l_orderkey AS o, l_linenumber AS l, {_DET} AS det, ((l_tax * 100 + 3.0) * (l_quantity + 7.0) - 0.5 * 0.25) / nullif({_DET}, 0) AS i00, -(2.0 * (l_quantity + 7.0) - l_discount * 10 * 0.25) / nullif({_DET}, 0) AS i01, (l_quantity * (l_tax * 100 + 3.0) - 2.0 * 1.0) / nullif({_DET}, 0) AS i22 FROM lineitem", 7)
def matrix_inverse(spark, sf_dir):
    """Determinants and parts of the inverses of small matrices."""
    m = [[F.expr(x).cast("double") for x in row] for row in _M3]
    n = g.inverse(m)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), g.determinant(m).alias("det"), n[0][0].alias("i00"), n[0][1].alias("i01"), n[2][2].alias("i22"))


@query(sql="SELECT DISTINCT l_linenumber AS frame, lpad(CAST(l_linenumber AS VARCHAR), 6, '0') || '_wd' AS folder FROM lineitem")
def frame_names(spark, sf_dir):
    """Folder names of frames."""
    return cloud(spark, sf_dir).select("frame").distinct().select("frame", codecs.frame_name(F.col("frame")).alias("folder"))


# features and matches


@query(sql=f"WITH {FEATURES} SELECT frame, cam, fid FROM features WHERE x + 20 > 4 AND x + 20 < 116 AND y + 20 > 4 AND y + 20 < 86")
def feature_border(spark, sf_dir):
    """Features away from the image's edges."""
    f = features(spark, sf_dir).select("frame", "cam", "fid", (F.col("x") + 20).alias("x"), (F.col("y") + 20).alias("y"))
    return match.inside_border(f, 120.0, 90.0).select("frame", "cam", "fid")


@query(sql=f"WITH {FEATURES}, r AS (SELECT frame, cell, fid, row_number() OVER (PARTITION BY frame, cell ORDER BY response DESC, fid) AS rank FROM features), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY rank, cell) AS place FROM r) SELECT frame, cell, fid, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM k WHERE place <= 60")
def feature_shares(spark, sf_dir):
    """Sixty features a frame, dealt out over its cells."""
    return match.shared_out(features(spark, sf_dir).select("frame", "cell", "fid", "response"), 60)


@query(sql="SELECT frame FROM (SELECT DISTINCT o_custkey AS frame FROM orders) ORDER BY (frame * 7919) % 10007, frame LIMIT 50")
def drawn_frames(spark, sf_dir):
    """Fifty frames in a hashed order."""
    return match.drawn_frames(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("frame")), 50, F.expr("(frame * 7919) % 10007"))


@query(sql=f"WITH {CUBE} SELECT t, i, j, z FROM cube WHERE t < 4")
def first_frames(spark, sf_dir):
    return cube(spark, sf_dir).where("t < 4")


@query("avg_err std_err min_err max_err", f"WITH {_MATCHES}, e AS (SELECT frame, (sqrt((ax - ax * 1.01) * (ax - ax * 1.01) + (ay - ay - 0.5) * (ay - ay - 0.5)) + sqrt((bx - bx * 0.98) * (bx - bx * 0.98) + (byy - byy - 0.25) * (byy - byy - 0.25))) / 2 AS err FROM mt) SELECT frame, count(err) AS n, avg(err) AS avg_err, stddev_pop(err) AS std_err, min(err) AS min_err, max(err) AS max_err FROM e GROUP BY frame", 4)
def reprojection_stats(spark, sf_dir):
    """Distances of matched places to their reprojections."""
    m = matches(spark, sf_dir)
    return match.reprojection_stats(m.select("frame", "ax", "ay", "bx", "by", (F.col("ax") * 1.01).alias("pax"), (F.col("ay") + 0.5).alias("pay"), (F.col("bx") * 0.98).alias("pbx"), (F.col("by") + 0.25).alias("pby")))


@query("r0 r1 r2 r3 r4 r5 r6 r7 r8 t0 t1 t2", None, 5)
def epipolar_inliers(spark, sf_dir):
    """Matches that fit one epipolar geometry, those in front of both cameras, and its pose."""
    m = matches(spark, sf_dir).select("frame", "m", *[(F.col(k) / 800).alias(k) for k in ("ax", "ay", "bx", "by")])
    x = surface.epipolar_inliers(m, 1.5 / 800)
    pose = [F.first(F.element_at("r", k + 1)).alias(f"r{k}") for k in range(9)] + [F.first(F.element_at("t", k + 1)).alias(f"t{k}") for k in range(3)]
    return x.groupBy("frame").agg(F.count_if("inlier").alias("inliers"), F.count_if("ahead").alias("ahead"), F.count("*").alias("matches"), *pose)


_SCATTERED = "l_linenumber AS frame, l_extendedprice / 1000 AS x, (l_partkey * 7919 + l_suppkey * 31) % 100003 / 1000.0 AS y"


@query("z", f"WITH p AS (SELECT {_SCATTERED} FROM lineitem), n AS (SELECT CAST(k // 24 AS INTEGER) AS i, CAST(k % 24 AS INTEGER) AS j, 14.3 + k // 24 * 3 AS x, 13.1 + k % 24 * 3 AS y FROM (SELECT unnest(range(576)) AS k)) SELECT frame, i, j, 0.5 * n.x - 0.25 * n.y + 3 AS z FROM n, (SELECT DISTINCT frame FROM p)")
def linear_gridding(spark, sf_dir):
    """A plane of scattered points is met at every node of a grid, frame by frame."""
    p = table(spark, sf_dir, "lineitem").selectExpr(*_SCATTERED.split(", ")).withColumn("z", 0.5 * F.col("x") - 0.25 * F.col("y") + 3)
    nodes = spark.range(576).selectExpr("cast(id div 24 as int) AS i", "cast(id % 24 as int) AS j", "14.3 + id div 24 * 3 AS x", "13.1 + id % 24 * 3 AS y")
    return scattered.linear(p, nodes, 12.0)


_PLACES = "p AS (SELECT l_linenumber AS frame, l_orderkey AS pid, l_extendedprice / 1000 AS x, (l_partkey * 7919 + l_suppkey * 31) % 100003 / 1000.0 AS y, l_quantity AS z FROM lineitem), q AS (SELECT frame, k AS qid, (k * 37 % 101) + 0.3 AS x, (k * 53 % 97) + 0.6 AS y FROM (SELECT DISTINCT frame FROM p), (SELECT unnest(range(120)) AS k))"
_NEAREST = f"WITH {_PLACES}, n AS (SELECT q.frame, qid, pid, z, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2 FROM q JOIN p USING (frame)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame, qid ORDER BY d2, pid, z) AS INTEGER) AS rank FROM n)"


def _places(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").selectExpr(*_SCATTERED.split(", "), "l_orderkey AS pid", "l_quantity AS z")
    queries = points.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("qid")).selectExpr("frame", "qid", "(qid * 37 % 101) + 0.3 AS x", "(qid * 53 % 97) + 0.6 AS y")
    return points, queries


@query("d2", f"{_NEAREST} SELECT frame, qid, rank, pid, d2 FROM r WHERE rank <= 9", 8)
def nearest_nine(spark, sf_dir):
    """The nine nearest points of a frame around each of many places, by growing rings of cells."""
    return nearest.nearest_points(*_places(spark, sf_dir), 9, 12.0).select("frame", "qid", "rank", "pid", "d2")


@query("z", f"{_NEAREST} SELECT frame, qid, sum(z * d2 ** -1.2) / sum(d2 ** -1.2) AS z FROM r WHERE rank <= 9 GROUP BY frame, qid")
def inverse_distance_nine(spark, sf_dir):
    """Heights from the nine nearest points, weighted by their distances."""
    return nearest.inverse_distance(*_places(spark, sf_dir), 12.0)


@query(sql=REGISTRY["spatial_nearest"][1])
def spatial_nearest_rings(spark, sf_dir):
    """The nearest other feature in the image, by growing rings of cells."""
    x = features(spark, sf_dir).select("frame", F.col("fid").alias("pid"), "x", "y", F.lit(0.0).alias("z"))
    got = nearest.nearest_points(x, x.withColumnRenamed("pid", "qid"), 1, 10.0, others=True)
    return got.select("frame", F.col("qid").alias("fa"), F.col("pid").alias("fb"), (F.round(F.col("d2") + 3.7e-9, 6) + F.lit(0.0)).alias("d2"))


@query("z", f"WITH {CUBE} SELECT t, i, j, z + CASE WHEN t IN (2, 3) THEN i ELSE 0 END AS z FROM cube WHERE t <> 5 AND i BETWEEN 16 AND 31 AND j < 16")
def upserted_frames(spark, sf_dir):
    """A cube written frame by frame: two frames are replaced, twice alike, and one tile of a few frames is read."""
    x, path = cube(spark, sf_dir), scratch(spark, "upserted")
    codecs.upsert_frames(x, path, tile=16)
    new = x.where("t in (2, 3)").withColumn("z", F.col("z") + F.col("i"))
    for _ in range(2):
        codecs.upsert_frames(new, path, tile=16)
    return codecs.read_frames(spark, path, [1, 2, 3, 4, 6, 7], (1, 1, 0, 0)).select("t", "i", "j", "z")


@query(sql=REGISTRY["biggest_component"][1])
def biggest_component_tiles(spark, sf_dir):
    """The same from tiles of seven cells, whose labels meet at their rims."""
    return c.biggest(cube(spark, sf_dir), 4.0, tile=7)


#: A known rig: the second camera's rotation and place, and views of points by both, two in five of them misplaced.
VIEW_R, VIEW_T = ((0.96, 0.0, 0.28), (0.0, 1.0, 0.0), (-0.28, 0.0, 0.96)), (-1.0, 0.1, 0.05)
_VIEW_E = [[sum(s[i][k] * VIEW_R[k][j] for k in range(3)) for j in range(3)] for s in [((0.0, -VIEW_T[2], VIEW_T[1]), (VIEW_T[2], 0.0, -VIEW_T[0]), (-VIEW_T[1], VIEW_T[0], 0.0))] for i in range(3)]
_VIEWS = "l_orderkey // 64 AS frame, l_orderkey * 2 + CAST(l_partkey % 5 < 2 AS INTEGER) AS m, (l_quantity - 25) / 8 AS x, l_discount * 60 - 3 + l_tax AS y, 4 + l_extendedprice / 10000 AS z, l_partkey % 5 < 2 AS odd, (l_suppkey * 31 % 97) / 97.0 - 0.5 AS u, (l_partkey * 17 % 89) / 89.0 - 0.5 AS v"
_SEEN = [f"({VIEW_R[k][0]} * x + {VIEW_R[k][1]} * y + {VIEW_R[k][2]} * z + {VIEW_T[k]})" for k in range(3)]
_LINE = [[f"({e[0]} * {a} + {e[1]} * {b} + {e[2]})" for e in rows] for rows, a, b in ((_VIEW_E, "a0", "a1"), ([[_VIEW_E[i][j] for i in range(3)] for j in range(3)], "b0", "b1"))]
_OFF = f"abs(b0 * {_LINE[0][0]} + b1 * {_LINE[0][1]} + {_LINE[0][2]}) / sqrt({' + '.join(f'{k} * {k}' for k in (*_LINE[0][:2], *_LINE[1][:2]))})"


@query(
    sql=f"WITH p AS (SELECT {_VIEWS} FROM lineitem), s AS (SELECT frame, odd, x / z AS a0, y / z AS a1, CASE WHEN odd THEN u ELSE {_SEEN[0]} / {_SEEN[2]} END AS b0, CASE WHEN odd THEN v ELSE {_SEEN[1]} / {_SEEN[2]} END AS b1 FROM p) "
    f"SELECT frame, count(*) AS matches, count(*) FILTER ({_OFF} < 1e-6) AS inliers, count(*) FILTER (odd AND {_OFF} < 1e-6) AS odd, TRUE AS posed FROM s GROUP BY frame HAVING count(*) FILTER (NOT odd) >= 8"
)
def five_point_views(spark, sf_dir):
    """Views of the points by a known rig, two in five misplaced: the inliers are the matches on the rig's own epipolar
    lines, and the pose is its own, in every frame of eight true matches or more."""
    p = table(spark, sf_dir, "lineitem").selectExpr(*_VIEWS.replace("//", "div").replace(".0 - ", "D - ").split(", "))  # in doubles: decimals would end at six digits
    place = [F.when(F.col("odd"), F.col(c)).otherwise(F.expr(f"{_SEEN[k]} / {_SEEN[2]}")) for k, c in enumerate("uv")]
    views = p.select("frame", "m", F.expr("x / z").alias("ax"), F.expr("y / z").alias("ay"), place[0].alias("bx"), place[1].alias("by"))
    got = surface.epipolar_inliers(views, 1e-6, confidence=0.999999).withColumn("odd", F.col("m") % 2 == 1)
    length = sum(c * c for c in VIEW_T) ** 0.5
    true = [*(v for row in VIEW_R for v in row), *(c / length for c in VIEW_T)]
    away = F.greatest(*[F.abs(F.element_at(F.concat("r", "t"), k + 1) - v) for k, v in enumerate(true)])
    sums = got.groupBy("frame").agg(F.count("*").alias("matches"), F.count_if("inlier").alias("inliers"), F.count_if(F.col("inlier") & F.col("odd")).alias("odd"), (F.max(away) < 1e-6).alias("posed"), F.count_if(~F.col("odd")).alias("n"))
    return sums.where("n >= 8").drop("n")


@query("worst", "WITH a AS (SELECT l_linenumber AS k, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_linenumber AS k, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT count(*) AS n, max(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS worst FROM a JOIN b USING (k)", 9)
def calibration_check(spark, sf_dir):
    """Largest difference of two sets of calibration values."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), "l_returnflag").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    a, b = x.where("l_returnflag = 'A'").select("k", "x", "y"), x.where("l_returnflag = 'N'").select("k", F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, "k").agg(F.count("*").alias("n"), F.max(F.greatest(F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2")))).alias("worst"))


# images


@query(sql=f"WITH {CUBE} SELECT t, i, j, z > 60 AS on FROM cube".replace(" AS on ", ' AS "on" '))
def threshold_mask(spark, sf_dir):
    return image.mask(cube(spark, sf_dir), 60.0)


@query(sql=f"WITH {CUBE} SELECT a.t, a.i, a.j, (a.z > 60 AND coalesce(b.z > 50, FALSE)) AS \"on\" FROM cube a LEFT JOIN (SELECT * FROM cube WHERE j % 3 > 0) b ON a.t = b.t AND a.i = b.i AND a.j = b.j")
def masks_product(spark, sf_dir):
    """Pixels set in both masks."""
    x = cube(spark, sf_dir)
    return image.masks_product(image.mask(x, 60.0), image.mask(x.where("j % 3 > 0"), 50.0))




@query(sql="WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS l, l_discount * 100 AS t, l_quantity + 20 AS r, l_discount * 100 + 5 AS b FROM lineitem), y AS (SELECT *, greatest(l, 15.0) AS gl, greatest(t, 3.0) AS gt, least(r, 45.0) AS lr, least(b, 9.0) AS lb FROM x) SELECT k, n, CASE WHEN gl < lr AND gt < lb THEN gl END AS left_, CASE WHEN gl < lr AND gt < lb THEN gt END AS top_, CASE WHEN gl < lr AND gt < lb THEN lr END AS right_, CASE WHEN gl < lr AND gt < lb THEN lb END AS bottom_ FROM y")
def common_box(spark, sf_dir):
    """The common part of two regions of interest."""
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "l_quantity as l", "l_discount * 100 as t", "l_quantity + 20 as r", "l_discount * 100 + 5 as b")
    got = image.overlap([F.col(v) for v in "ltrb"], [F.lit(v) for v in (15.0, 3.0, 45.0, 9.0)])
    return x.select("k", "n", *[v.alias(n) for v, n in zip(got, ("left_", "top_", "right_", "bottom_"), strict=True)])


@query(sql="WITH x AS (SELECT l_orderkey AS k, list_sort(list(l_quantity)) AS x, list_sort(list(l_extendedprice)) AS y FROM lineitem GROUP BY 1 HAVING count(*) >= 4) SELECT k, x[2] AS \"left\", x[3] AS \"right\", y[2] AS \"top\", y[3] AS bottom FROM x")
def middle_box(spark, sf_dir):
    """The box between the middle two of the corners' coordinates."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n >= 4")
    return image.middle_box(x, "k")


@query(sql=f"WITH {CUBE} SELECT t, min(z) AS zmin, max(z) AS zmax, count(z) AS pixels FROM cube GROUP BY t")
def image_range(spark, sf_dir):
    return image.value_range(cube(spark, sf_dir))


@query(sql=f"WITH {CUBE}, s(di, dj, wi, wj) AS (VALUES (-1,-1,-1,-1), (-1,0,-2,0), (-1,1,-1,1), (1,-1,1,-1), (1,0,2,0), (1,1,1,1), (0,-1,0,-2), (0,1,0,2)), x AS (SELECT t, i - di AS i, j - dj AS j, sum(wi * z) AS gi, sum(wj * z) AS gj, count(*) AS n FROM cube, s GROUP BY 1, 2, 3) SELECT c.t, c.i, c.j, c.z FROM cube c LEFT JOIN x ON x.t = c.t AND x.i = c.i AND x.j = c.j AND x.n = 8 AND gi * gi + gj * gj > 2000 WHERE x.t IS NULL")
def gradient_cut(spark, sf_dir):
    """Pixels without those on steep edges."""
    return image.without_edges(cube(spark, sf_dir), 2000.0)


@query(sql=f"WITH RECURSIVE {CUBE}, s(di, dj, wi, wj) AS (VALUES (-1,-1,-1,-1), (-1,0,-2,0), (-1,1,-1,1), (1,-1,1,-1), (1,0,2,0), (1,1,1,1), (0,-1,0,-2), (0,1,0,2)), x AS (SELECT t, i - di AS i, j - dj AS j, sum(wi * z) AS gi, sum(wj * z) AS gj, count(*) AS n FROM cube, s GROUP BY 1, 2, 3), cut_ AS (SELECT c.t, c.i, c.j, c.z FROM cube c LEFT JOIN x ON x.t = c.t AND x.i = c.i AND x.j = c.j AND x.n = 8 AND gi * gi + gj * gj > 2000 WHERE x.t IS NULL), n AS (SELECT t, (CAST(t AS BIGINT) * 1048576 + i) * 1048576 + j AS a, i, j FROM cut_), e AS (SELECT p.a AS a, q.a AS b FROM n p JOIN n q ON p.t = q.t AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1 AND p.a <> q.a), r AS (SELECT a, a AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a, min(b) AS component FROM r GROUP BY a), z AS (SELECT t, component, count(*) AS size FROM m JOIN n USING (a) GROUP BY 1, 2) SELECT t, max(size) AS size, min(component) FILTER (WHERE size = top) AS component, count(*) AS components FROM (SELECT *, max(size) OVER (PARTITION BY t) AS top FROM z) GROUP BY t")
def gradient_component(spark, sf_dir):
    """The largest part of the image, of eight neighbours, after its steep edges are cut."""
    return c.biggest(image.without_edges(cube(spark, sf_dir), 2000.0), float("inf"), diagonal=True)


_TAPS = "o(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))"


def _sampled_sql(fi: str, fj: str, rows: int, cols: int) -> str:
    return f"WITH {CUBE}, {_TAPS}, p AS (SELECT t, i, j, {fi} AS fi, {fj} AS fj FROM (SELECT DISTINCT t FROM cube), (SELECT CAST(unnest(range({rows})) AS INTEGER) AS i), (SELECT CAST(unnest(range({cols})) AS INTEGER) AS j)), x AS (SELECT t, i, j, floor(fi) + a AS ci, floor(fj) + b AS cj, CASE WHEN a = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END * CASE WHEN b = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END AS w FROM p, o), y AS (SELECT x.t, x.i, x.j, sum(w * z) AS z, count(z) AS n FROM x JOIN cube c ON c.t = x.t AND c.i = x.ci AND c.j = x.cj GROUP BY x.t, x.i, x.j) SELECT t, i, j, z FROM y WHERE n = 4"


_LENS = (-0.11, 0.02, 0.003, -0.002, 0.001)
_R2 = "(((j - 16.0) / 40.0) * ((j - 16.0) / 40.0) + ((i - 24.0) / 42.0) * ((i - 24.0) / 42.0))"
_RAD = f"(1 + {_R2} * ({_LENS[0]} + {_R2} * ({_LENS[1]} + {_R2} * {_LENS[4]})))"


@query("z", _sampled_sql(f"((i - 24.0) / 42.0 * {_RAD} + {_LENS[2]} * ({_R2} + 2 * ((i - 24.0) / 42.0) * ((i - 24.0) / 42.0)) + 2 * {_LENS[3]} * ((j - 16.0) / 40.0) * ((i - 24.0) / 42.0)) * 42.0 + 24.0", f"((j - 16.0) / 40.0 * {_RAD} + 2 * {_LENS[2]} * ((j - 16.0) / 40.0) * ((i - 24.0) / 42.0) + {_LENS[3]} * ({_R2} + 2 * ((j - 16.0) / 40.0) * ((j - 16.0) / 40.0))) * 40.0 + 16.0", ROWS, COLS), 4)
def undistorted_image(spark, sf_dir):
    """The image without its lens distortion."""
    return image.undistorted(cube(spark, sf_dir), ROWS, COLS, (40.0, 42.0, 16.0, 24.0), _LENS)


@query("z", _sampled_sql("(0.02 * j + 0.9 * i + 2.5) / nullif(0.001 * j + 0.0005 * i + 1.0, 0)", "(1.05 * j - 0.03 * i + 0.75) / nullif(0.001 * j + 0.0005 * i + 1.0, 0)", ROWS, COLS), 4)
def warped_image(spark, sf_dir):
    """The image seen through a homography."""
    return image.warped(cube(spark, sf_dir), ROWS, COLS, ((1.05, -0.03, 0.75), (0.02, 0.9, 2.5), (0.001, 0.0005, 1.0)))


@query("z", _sampled_sql(f"least(greatest((i + 0.5) * {ROWS / 30!r} - 0.5, 0.0), {ROWS - 1 - 1e-9!r})", f"least(greatest((j + 0.5) * {COLS / 20!r} - 0.5, 0.0), {COLS - 1 - 1e-9!r})", 30, 20), 4)
def resized_image(spark, sf_dir):
    """The image in thirty rows and twenty columns, between pixel centres."""
    return image.resized(cube(spark, sf_dir), (ROWS, COLS), (30, 20))


@query(sql=f"WITH {CUBE}, p AS (SELECT CAST(unnest(range(60)) AS INTEGER) AS i), q AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS j) SELECT t, p.i, q.j, z FROM p, q, cube c WHERE c.i = floor(p.i * {ROWS / 60!r}) AND c.j = floor(q.j * {COLS / 40!r})")
def resized_nearest(spark, sf_dir):
    return image.resized(cube(spark, sf_dir), (ROWS, COLS), (60, 40), "nearest")


@query("z", f"WITH {CUBE}, k(d, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) SELECT t, 2 * i + a.d AS i, 2 * j + b.d AS j, sum(z * a.w * b.w) / sum(a.w * b.w) AS z FROM cube, k a, k b WHERE 2 * i + a.d BETWEEN 0 AND {2 * ROWS - 1} AND 2 * j + b.d BETWEEN 0 AND {2 * COLS - 1} GROUP BY 1, 2, 3")
def pyramid_up(spark, sf_dir):
    """One pyramid level up."""
    return image.doubled(cube(spark, sf_dir), ROWS, COLS)


_L = lambda d: f"CASE WHEN abs({d}) < 1e-12 THEN 1.0 WHEN abs({d}) >= 4 THEN 0.0 ELSE 4 * sin(({d}) * pi()) * sin(({d}) * pi() / 4) / (({d}) * pi() * ({d}) * pi()) END"


@query("z", f"WITH {CUBE}, p AS (SELECT l_linenumber AS t, l_orderkey * 8 + l_linenumber AS id, min(l_quantity) * 0.8 + 3.3 AS fi, min(l_discount) * 200 + 5.7 AS fj FROM lineitem GROUP BY 1, 2), s AS (SELECT unnest(range(-3, 5)) AS d), x AS (SELECT t, id, floor(fi) + a.d AS i, floor(fj) + b.d AS j, fi, fj FROM p, s a, s b), y AS (SELECT x.t, id, {_L('fi - x.i')} * {_L('fj - x.j')} AS w, z FROM x LEFT JOIN cube c ON c.t = x.t AND c.i = x.i AND c.j = x.j) SELECT t, id, CASE WHEN count(z) = 64 THEN sum(w * z) / sum(w) END AS z FROM y GROUP BY t, id", 4)
def lanczos_sample(spark, sf_dir):
    """The cube at places between its cells, by Lanczos weights."""
    p = dealt(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_orderkey").groupBy("l_linenumber", "l_orderkey")
    places = p.agg((F.min("l_quantity") * 0.8 + 3.3).alias("fi"), (F.min("l_discount") * 200 + 5.7).alias("fj"))
    places = places.select(F.col("l_linenumber").alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "fi", "fj")
    return image.sampled_sharp(cube(spark, sf_dir), places)


@query("radiance", f"WITH {CUBE}, p AS (SELECT t, i, j, 0.4 * i + 0.1 * z / 8 + 1.5 AS fi, 0.6 * j + 0.05 * z / 8 + 0.5 AS fj FROM cube), s AS (SELECT unnest(range(-3, 5)) AS d), x AS (SELECT t, i, j, fi, fj, floor(fi) + a.d AS ci, floor(fj) + b.d AS cj FROM p, s a, s b), y AS (SELECT x.t, x.i, x.j, {_L('fi - ci')} * {_L('fj - cj')} AS w, z FROM x LEFT JOIN cube c ON c.t = x.t AND c.i = x.ci AND c.j = x.cj) SELECT t, i, j, CASE WHEN count(z) = 64 THEN sum(w * z) / sum(w) / 255 END AS radiance FROM y GROUP BY t, i, j")
def radiance_sharp(spark, sf_dir):
    """The cube taken as an image too, sampled by Lanczos weights where its own cells are seen."""
    x = cube(spark, sf_dir)
    cells = x.select("t", "i", "j", F.col("j").cast("double").alias("x"), F.col("i").cast("double").alias("y"), (F.col("z") / 8).alias("z"))
    return surface.radiance(cells, x, ((0.6, 0.0, 0.05, 0.5), (0.0, 0.4, 0.1, 1.5), (0.0, 0.0, 0.0, 1.0)), sharp=4)


_CLAHE = f"""WITH {CUBE}, x AS (SELECT t, i, j, CAST(trunc(z * 2) AS INTEGER) AS v FROM cube), n AS (SELECT t, CAST(least(floor(i / 12.0), 3) AS INTEGER) AS a, CAST(least(floor(j / 8.0), 3) AS INTEGER) AS b, v, count(*) AS n FROM x GROUP BY ALL),
tot AS (SELECT t, a, b, sum(n) AS total, greatest(floor(sum(n) * 2.0 / 256), 1) AS most FROM n GROUP BY 1, 2, 3), ov AS (SELECT t, a, b, total, most, sum(greatest(n - most, 0)) AS over_ FROM n JOIN tot USING (t, a, b) GROUP BY ALL),
f AS (SELECT ov.*, l.v, least(coalesce(n, 0), most) + over_ / 256.0 AS c FROM ov CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS v) l LEFT JOIN n ON n.t = ov.t AND n.a = ov.a AND n.b = ov.b AND n.v = l.v),
cu AS (SELECT t, a, b, v, sum(c) OVER (PARTITION BY t, a, b ORDER BY v) * 255 / total AS c FROM f),
y AS (SELECT t, i, j, v, (i + 0.5) / 12.0 - 0.5 AS fi, (j + 0.5) / 8.0 - 0.5 AS fj, p, q FROM x, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(p, q)),
w AS (SELECT t, i, j, v, CAST(greatest(0, least(3, floor(fi) + p)) AS INTEGER) AS a, CAST(greatest(0, least(3, floor(fj) + q)) AS INTEGER) AS b, CASE WHEN p = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END * CASE WHEN q = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END AS w FROM y)
SELECT t, i, j, sum(w * c) AS z FROM w JOIN cu USING (t, a, b, v) GROUP BY t, i, j"""


@query("z", _CLAHE, 4)
def equalised_image(spark, sf_dir):
    """Contrast-limited adaptive equalisation in sixteen tiles."""
    x = cube(spark, sf_dir).withColumn("z", F.col("z") * 2)
    return image.equalised(x, ROWS, COLS, 4, 2.0)


_SOME = f"{CUBE}, g0 AS (SELECT t, i, j, z FROM cube WHERE (i * 7 + j * 3) % 11 > 5 AND (i // 9 + j // 7) % 3 > 0)"
_GRID = f"n AS (SELECT t, i, j FROM (SELECT DISTINCT t FROM cube), (SELECT CAST(unnest(range({ROWS})) AS INTEGER) AS i), (SELECT CAST(unnest(range({COLS})) AS INTEGER) AS j))"


def _idw_sql(rounds: int, size: int) -> str:
    r, taps = size // 2 * rounds, f"taps AS (SELECT a.d AS di, b.d AS dj, (a.d * a.d + b.d * b.d) ** -1.2 AS w FROM (SELECT unnest(range(-{size // 2}, {size // 2 + 1})) AS d) a, (SELECT unnest(range(-{size // 2}, {size // 2 + 1})) AS d) b WHERE a.d <> 0 OR b.d <> 0)"
    passes = ", ".join(
        f"g{k} AS (SELECT t, n.i, n.j, coalesce(max(g0.z), sum(w * p.z) / sum(w)) AS z FROM n JOIN (SELECT t, i - di AS i, j - dj AS j, w, z FROM g{k - 1}, taps UNION ALL SELECT t, i, j, 0.0, 0.0 FROM g0) p USING (t, i, j) LEFT JOIN g0 USING (t, i, j) GROUP BY t, n.i, n.j)"
        for k in range(1, rounds + 1)
    )
    wide = f"wide AS (SELECT DISTINCT n.t, n.i, n.j FROM n JOIN g0 ON n.t = g0.t AND n.i BETWEEN g0.i - {r} AND g0.i + {r} AND n.j BETWEEN g0.j - {r} AND g0.j + {r})"
    shut = f"shut AS (SELECT t, i, j FROM n WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM n EXCEPT SELECT * FROM wide) o WHERE o.t = n.t AND o.i BETWEEN n.i - {r} AND n.i + {r} AND o.j BETWEEN n.j - {r} AND n.j + {r}))"
    return f"WITH {_SOME}, {_GRID}, {taps}, {passes}, {wide}, {shut} SELECT t, i, j, z FROM g{rounds} JOIN shut USING (t, i, j)"


@query("z", _idw_sql(3, 5), 6)
def idw_fill_closed(spark, sf_dir):
    """Inverse-distance filling in three passes inside the closing by a square of five; large holes stay open."""
    return raster.filled_inside(cube(spark, sf_dir).where("(i * 7 + j * 3) % 11 > 5 and (i div 9 + j div 7) % 3 > 0"), ROWS, COLS)


@query(sql=f"WITH {CUBE} SELECT g.i, g.j, CAST(CASE WHEN max(c.z) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS mask FROM (SELECT CAST(unnest(range({ROWS})) AS INTEGER) AS i, 1 AS k) a JOIN (SELECT CAST(unnest(range({COLS})) AS INTEGER) AS j, 1 AS k) b USING (k), LATERAL (SELECT a.i AS i, b.j AS j) g LEFT JOIN (SELECT i, j, z - 50 AS z FROM cube WHERE t = 2) c ON c.i = g.i AND c.j = g.j GROUP BY g.i, g.j")
def user_mask(spark, sf_dir):
    """1 where an image is above 0, else 0, for every node of the grid."""
    nodes = spark.range(ROWS * COLS).select(F.expr(f"cast(id div {COLS} as int)").alias("i"), (F.col("id") % COLS).cast("int").alias("j"))
    return image.user_mask(nodes, cube(spark, sf_dir).where("t = 2").select("i", "j", (F.col("z") - 50).alias("z")))


# cubes and series


@query("z", f"WITH {CUBE} SELECT t, i, j, greatest(20.0, least(80.0, z)) AS z FROM cube")
def clipped_cube(spark, sf_dir):
    return temporal.clip_extremes(cube(spark, sf_dir), 20.0, 80.0)[0]


@query(sql=f"WITH {CUBE} SELECT min(z) AS before_min, max(z) AS before_max, greatest(20.0, min(z)) AS zmin, least(80.0, max(z)) AS zmax FROM cube")
def clip_limits(spark, sf_dir):
    """Extremes before and after clipping."""
    return temporal.clip_extremes(cube(spark, sf_dir), 20.0, 80.0)[1]


@query("zmin zmax", f"WITH {CUBE}, m AS (SELECT z - avg(z) OVER (PARTITION BY i, j) AS z FROM cube) SELECT -greatest(abs(min(z)), abs(max(z))) AS zmin, greatest(abs(min(z)), abs(max(z))) AS zmax, CAST(0 AS DOUBLE) AS zmean FROM m")
def zero_mean_limits(spark, sf_dir):
    """Limits of the cube less each cell's mean."""
    return temporal.force_zero_mean(cube(spark, sf_dir))[1]


@query("dt", "WITH x AS (SELECT DISTINCT epoch(ts) AS x FROM events ORDER BY 1 LIMIT 2) SELECT max(x) - min(x) AS dt FROM x", 3)
def time_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))
    return temporal.time_step(e)


@query("v", None, 4)
def fast_highpass(spark, sf_dir):
    """A high pass with the rate as a whole number and the mean left in."""
    return temporal.fast_filtered(temporal.longer_than(series(spark, sf_dir), 27), 10.2, 1.0, True)


@query(sql=f"WITH {SERIES} SELECT cell, t, v FROM series WHERE cell IN (SELECT cell FROM series GROUP BY cell HAVING count(*) > 4)")
def guarded_series(spark, sf_dir):
    """Series that are long enough; shorter ones would stop the query."""
    return temporal.guarded(temporal.longer_than(series(spark, sf_dir), 4), 4, "samples", "cell")


_STOKES = "st AS (SELECT l_linenumber AS t, CAST(l_partkey % 48 AS INTEGER) AS i, CAST(l_suppkey % 32 AS INTEGER) AS j, max(l_extendedprice) / 1000 AS s0, max(l_discount) - 0.05 AS s1, max(l_tax) - 0.04 AS s2 FROM lineitem GROUP BY 1, 2, 3)"


@query("s0 s1 s2 dolp aolp", f"WITH {CUBE}, {_SHADOW}, {_TURNED}, {_STOKES}, {_TAPS}, seen AS (SELECT an.t, an.i, an.j FROM an LEFT JOIN hid ON hid.t = an.t AND hid.i = an.i AND hid.j = an.j WHERE hid.t IS NULL AND angle < 85), p AS (SELECT s.t, s.i, s.j, 0.4 * s.i + 0.1 * z + 1.5 AS fi, 0.6 * s.j + 0.05 * z + 0.5 AS fj FROM seen s JOIN cube USING (t, i, j)), x AS (SELECT t, i, j, floor(fi) + a AS ci, floor(fj) + b AS cj, CASE WHEN a = 1 THEN fi - floor(fi) ELSE 1 - (fi - floor(fi)) END * CASE WHEN b = 1 THEN fj - floor(fj) ELSE 1 - (fj - floor(fj)) END AS w FROM p, o), y AS (SELECT x.t, x.i, x.j, sum(w * s0) AS s0, sum(w * s1) AS s1, sum(w * s2) AS s2 FROM x JOIN st ON st.t = x.t AND st.i = x.ci AND st.j = x.cj GROUP BY 1, 2, 3 HAVING count(*) = 4), mp AS (SELECT i, j, count(*) AS frames, avg(s0) AS s0, avg(s1) AS s1, avg(s2) AS s2 FROM y GROUP BY i, j) SELECT i, j, frames, s0, s1, s2, sqrt(s1 * s1 + s2 * s2) / nullif(s0, 0) AS dolp, (CASE WHEN atan2(s1, s2) < 0 THEN atan2(s1, s2) + 2 * pi() ELSE atan2(s1, s2) END - 3.1415) / 2 AS aolp FROM mp", 6)
def polarimetry(spark, sf_dir):
    """Mean Stokes parameters, degree and angle of each cell over the frames in which the camera sees it."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("t"), (F.col("l_partkey") % ROWS).cast("int").alias("i"), (F.col("l_suppkey") % COLS).cast("int").alias("j"))
    images = x.agg((F.max("l_extendedprice") / 1000).alias("s0"), (F.max("l_discount") - 0.05).alias("s1"), (F.max("l_tax") - 0.04).alias("s2"))
    camera = ((0.6, 0.0, 0.05, 0.5), (0.0, 0.4, 0.1, 1.5), (0.0, 0.0, 0.0, 1.0))
    return surface.mean_polarisation(surface.polarimetry(cube(spark, sf_dir), images, ROWS, COLS, camera, _RAY))


@query("z nx ny nz", f"WITH {CUBE}, {_SLOPE}, m AS (SELECT i, j, avg(z) AS z, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM nm GROUP BY i, j) SELECT i, j, z, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM m", 6)
def mean_surface(spark, sf_dir):
    """Mean height and normal of each cell."""
    return surface.mean_surface(temporal.slopes(cube(spark, sf_dir)))


# set-up tables


@query("x y kx ky", f"WITH n AS (SELECT CAST(k // 30 AS INTEGER) AS i, CAST(k % 30 AS INTEGER) AS j FROM (SELECT unnest(range(24 * 30)) AS k)) SELECT n.i, n.j, -25.0 + j * (50.0 / 29) AS x, -60.0 + i * (50.0 / 23) AS y, (j - 15) * (2 * pi() / (30 * (50.0 / 29))) AS kx, (i - 12) * (2 * pi() / (24 * (50.0 / 23))) AS ky, coalesce(c, 0) AS points FROM n LEFT JOIN (SELECT CAST(l_partkey % 24 AS INTEGER) AS i, CAST(l_suppkey % 30 AS INTEGER) AS j, count(*) AS c FROM lineitem GROUP BY 1, 2) USING (i, j)", 9)
def grid_nodes(spark, sf_dir):
    """The grid's nodes with how many points each has."""
    nodes = codecs.grid_nodes(spark, codecs.GRID_TEMPLATE | {"nx": 30, "ny": 24})
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 24).cast("int").alias("i"), (F.col("l_suppkey") % 30).cast("int").alias("j")).agg(F.count("*").alias("c"))
    return nodes.join(n, ["i", "j"], "left").select("i", "j", "x", "y", "kx", "ky", F.coalesce("c", F.lit(0)).alias("points"))


@query(sql=f"WITH {CUBE} SELECT 'count' AS key, CAST(count(DISTINCT t) AS VARCHAR) AS value FROM cube UNION ALL SELECT 'fps', '12.5' UNION ALL SELECT 'source', 'lineitem'")
def cube_settings(spark, sf_dir):
    """What is told about a cube beside its heights."""
    return codecs.cube_settings(cube(spark, sf_dir), 12.5, {"source": "lineitem"}).where("key not in ('zmin', 'zmax')")


@query("prepared dolp", None, 6)
def prepared_images(spark, sf_dir):
    """Channels mixed, undistorted and turned into intensity and degree of polarisation."""
    lens = ((40.0, 42.0, 16.0, 24.0), (-0.1, 0.01, 0.0, 0.0, 0.0))
    x = _channels(spark, sf_dir).select(F.col("l").alias("t"), (F.col("o") % ROWS).cast("int").alias("i"), (F.expr(f"o div {ROWS}") % COLS).cast("int").alias("j"), *"abcd").groupBy("t", "i", "j").agg(*[F.max(k).alias(k) for k in "abcd"])
    out = None
    for k in "abcd":
        one = image.undistorted(x.select("t", "i", "j", F.col(k).alias("z")), ROWS, COLS, *lens).withColumnRenamed("z", k)
        out = one if out is None else out.join(one, ["t", "i", "j"])
    s0, s1, s2 = g.stokes(*[F.col(k) for k in "abcd"])
    return out.select("t", "i", "j", g.fused([F.col(k) for k in "abcd"]).alias("prepared"), g.polarisation_degree(s0, s1, s2).alias("dolp"))
