"""Images, poses, quantiles and files against closed forms and plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swellframe.functions import camera
from swellframe.functions import geometry as g
from swellframe.operators import cloud, grid, image, match, raster, surface, temporal
from swellframe.sources import codecs


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=3000), 2)
    rows = [(int(k % 3), float(v)) for k, v in enumerate(x)] + [(7, 1.5), (0, None)]
    df = spark.createDataFrame(rows, "frame int, v double")
    shares = [0.0, 0.013, 0.5, 0.999, 1.0]
    got = {r.frame: r for r in grid.quantiles(df, "v", shares, ["frame"]).collect()}
    for k in range(3):
        assert np.allclose([got[k][f"q{n}"] for n in range(5)], np.quantile(x[k::3], shares))
    assert [got[7][f"q{n}"] for n in range(5)] == [1.5] * 5
    whole = grid.quantiles(df.where("frame < 3"), "v", [0.25]).first()
    assert whole.q0 == pytest.approx(np.quantile(x, 0.25))


def two_views(n, noise, outliers, seed):
    rng = np.random.default_rng(seed)
    k = np.array([[2000.0, 0, 1200], [0, 2000, 1000], [0, 0, 1]])
    r = np.array(g.plane_rotation(0.06, -0.03, math.sqrt(1 - 0.0045)))
    t = np.array([-0.97, 0.1, 0.2])
    t /= np.linalg.norm(t)
    p = rng.uniform([-6, -5, 10], [6, 5, 30], (n, 3))
    q = p @ r.T + t
    a, b = (x[:, :2] / x[:, 2:] + rng.normal(0, noise / 2000, (n, 2)) for x in (p, q))
    b[:outliers] += rng.uniform(0.02, 0.2, (outliers, 2))
    return k, r, t, a, b


def test_epipolar_inliers(spark):
    """At least 400 matches, half a pixel, the translation to 2e-2 and the rotation to 5e-3, with a fifth outliers."""
    _, r, t, a, b = two_views(800, 0.15, 160, 5)
    df = spark.createDataFrame([(3, k, *map(float, (*a[k], *b[k]))) for k in range(800)] + [(4, k, 0.1, 0.1 * k, 0.2, 0.1) for k in range(5)], "frame long, m long, ax double, ay double, bx double, by double")
    got = surface.epipolar_inliers(df, 1.5 / 2000, 300).toPandas()
    one = got[got.frame == 3]
    kept = one[one.inlier & one.ahead]
    assert len(kept) >= 400 and (kept.m >= 160).mean() > 0.98 and not got[got.frame == 4].inlier.any()
    assert np.abs(np.reshape(kept.r.iloc[0], (3, 3)) - r).max() <= 5e-3 and np.abs(np.array(kept.t.iloc[0]) - t).max() <= 2e-2
    e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    at = kept.m.to_numpy()
    assert 2000 * surface.sampson(e, a[at], b[at]).mean() <= 0.5


def test_far_planes_and_votes(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 10, (3000, 2))
    z = 0.3 * xy[:, 0] - 0.2 * xy[:, 1]
    z[:30] += 4
    rows = [(1, k, float(xy[k, 0]), float(xy[k, 1]), float(z[k])) for k in range(3000)]
    df = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double")
    far = df.where("pid >= 30").select("frame", "pid", *[(F.col(c) + 1e6).alias(c) for c in "xyz"])
    fit = cloud.fit_planes(far).first()
    n = np.array([-0.3, 0.2, 1]) / math.sqrt(1.13)
    assert np.allclose([fit.a, fit.b, fit.c], n, atol=1e-6)
    bad = {r.pid for r in cloud.voted_outliers(df, 1.0, 0.5, 40).collect()}
    assert {k for k in bad if k < 30} == bad and len(bad) >= 25
    same = {r.pid for r in cloud.plane_outliers(df, 2.0, 2.0).where("outlier").collect()}
    assert same == set(range(30))


def test_reweighted(spark):
    _, r, t, a, b = two_views(40, 0.0, 0, 7)
    df = spark.createDataFrame([tuple(map(float, (*x, *y))) for x, y in zip(a, b, strict=True)], "px double, py double, qx double, qy double")
    got = match.reweighted(df, r, t).toPandas()
    assert np.allclose(got.x / got.z, got.px) and np.allclose(got.y / got.z, got.py)


def test_fill_inside(spark):
    z = np.add.outer(np.arange(12.0), np.arange(10.0))
    rows = [(0, i, j, float(z[i, j])) for i in range(12) for j in range(10) if not (4 <= i <= 5 and 4 <= j <= 6)]
    df = spark.createDataFrame(rows, "t int, i int, j int, z double")
    got = raster.filled_inside(df, 12, 10)
    want = raster.closed(df, 12, 10)
    assert got.count() == want.count() and got.join(df, ["t", "i", "j", "z"]).count() == len(rows)


def test_visibility_and_guards(spark):
    z = np.zeros((20, 8))
    z[8] = 5.0
    df = spark.createDataFrame([(0, i, j, float(z[i, j])) for i in range(20) for j in range(8)], "t int, i int, j int, z double")
    seen = {(r.i, r.j): r.visible for r in temporal.visibility(df, 20, 8, (-20.0, 4.0, 30.0)).collect()}
    assert seen[(2, 4)] and not seen[(10, 4)]
    s = spark.createDataFrame([(1, k, 0.5) for k in range(5)], "cell long, t long, v double")
    assert temporal.guarded(s, 4, "samples", "cell").count() == 5
    with pytest.raises(Exception, match="more than 5 samples"):
        temporal.guarded(s, 5, "samples", "cell").collect()
    assert temporal.time_step(spark.createDataFrame([(3.0,), (1.0,), (1.5,)], "time double")).first().dt == 0.5
    cube, ends = temporal.force_zero_mean(df.unionByName(df.selectExpr("1 as t", "i", "j", "z + 2 as z")))
    assert ends.first().asDict() == {"zmin": -1.0, "zmax": 1.0, "zmean": 0.0} and cube.agg(F.sum("z")).first()[0] == 0


def test_images(spark):
    z = np.add.outer(2.0 * np.arange(16), np.arange(12.0))
    df = spark.createDataFrame([(0, i, j, float(z[i, j])) for i in range(16) for j in range(12)], "t int, i int, j int, z double")
    same = image.undistorted(df, 16, 12, (10.0, 10.0, 5.0, 7.0), (0.0,) * 5)
    assert same.where("i < 15 and j < 11").join(df.withColumnRenamed("z", "w"), ["t", "i", "j"]).where(F.abs(F.col("z") - F.col("w")) > 1e-9).count() == 0
    at = spark.createDataFrame([(0, 1, 7.25, 5.5), (0, 2, 0.5, 0.5)], "t int, id long, fi double, fj double")
    assert {r.id: r.z for r in image.sampled_sharp(df, at).collect()}[2] is None
    flat = df.withColumn("z", F.lit(3.0))
    assert {r.id: r.z for r in image.sampled_sharp(flat, at).collect()}[1] == pytest.approx(3.0)
    assert {round(r.z, 9) for r in image.doubled(flat, 16, 12).collect()} == {3.0}
    even = image.equalised(spark.createDataFrame([(0, i, j, float((i * 12 + j) % 256)) for i in range(16) for j in range(16)], "t int, i int, j int, z double"), 16, 16, 1, 1e9)
    assert even.agg(F.max("z")).first()[0] == pytest.approx(255.0)
    box = image.middle_box(spark.createDataFrame([(0, 1.0, 9.0), (0, 5.0, 2.0), (0, 2.0, 8.0), (0, 7.0, 1.0)], "frame int, x double, y double")).first()
    assert (box.left, box.right, box.top, box.bottom) == (2.0, 5.0, 2.0, 8.0)


def test_files(spark, tmp_path):
    m = spark.createDataFrame([(7, 0, 1.0, 2.0, 3.0, 4.5), (7, 1, 5.0, 6.0, 7.0, 8.25), (9, 0, 0.1, 0.2, 0.3, 0.4)], "frame int, m int, ax double, ay double, bx double, by double")
    codecs.write_matches(m, str(tmp_path / "m"))
    lines = [p.read_text().split("\n") for p in (tmp_path / "m" / "frame=7").glob("*.txt")]
    assert lines == [["2", "1.0 2.0 3.0 4.5", "5.0 6.0 7.0 8.25", ""]]
    for f in (12, 3, 5):
        (tmp_path / "seq" / f"{f:06d}_wd").mkdir(parents=True)
        (tmp_path / "seq" / f"{f:06d}_wd" / "plane.txt").write_text("0 0 1 2\n")
    assert [r.frame for r in codecs.workdirs(spark, str(tmp_path / "seq")).collect()] == [3, 5, 12]
    assert [r.frame for r in codecs.workdirs(spark, str(tmp_path / "seq"), 2).collect()] == [3, 5]
    (tmp_path / "list.txt").write_text("out/000003_wd out/000099_wd\nout/000012_wd/\n")
    assert codecs.known_folders(spark, str(tmp_path / "list.txt"), str(tmp_path / "seq")).count() == 2
    planes = spark.createDataFrame([(2, 0.1, 0.2, 0.9, None), (1, 0.0, 0.0, 1.0, -3.5)], "frame int, a double, b double, c double, d double")
    codecs.write_planes(planes, str(tmp_path / "planes"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "planes").glob("*.txt"))).splitlines()
    assert text[0] == "0.0 0.0 1.0 -3.5" and text[1].endswith(" nan")
    stats = match.error_stats(spark.createDataFrame([(1, 0.5), (1, 1.5)], "frame long, err double"))
    codecs.write_stats(stats, str(tmp_path / "stats"))
    back = codecs.read_stats(spark, str(tmp_path / "stats")).first()
    assert (back.n, back.avg_err, back.max_err) == (2, 1.0, 1.5)
    pose = spark.createDataFrame([([float(k) for k in range(9)], [1.0, 2.0, 3.0])], "r array<double>, t array<double>")
    codecs.write_extrinsics(pose, planes, str(tmp_path / "ext"))
    found = {(r.rows, r.cols): r["values"] for r in codecs.read_xml_matrices(spark, f"{tmp_path}/ext/frame=1/*/*.txt").collect()}
    assert found == {(3, 3): [float(k) for k in range(9)], (3, 1): [1.0, 2.0, 3.0]}
    (tmp_path / "grid.txt").write_text(codecs.grid_settings_text().replace("N=1024", "Nx = 32\nNy=16 ; lines"))
    s = codecs.grid_settings(spark, str(tmp_path / "grid.txt")).first().asDict()
    assert s == {"cx": 0.0, "cy": -35.0, "width": 50.0, "height": 50.0, "nx": 32, "ny": 16}
    with pytest.raises(Exception, match="square"):
        codecs.square_step(codecs.grid_nodes(spark, s)).collect()
    assert codecs.square_step(codecs.grid_nodes(spark, s | {"ny": 32})).first().dx == pytest.approx(50 / 31)
    cube = spark.createDataFrame([(t, 0, 0, float(t)) for t in range(4)], "t int, i int, j int, z double")
    codecs.write_cube_parts(str(tmp_path / "cube"), cube, settings=codecs.cube_settings(cube, 5.0, {"baseline": 2.5}))
    told = {r.key: r.value for r in codecs.read_cube_parts(spark, str(tmp_path / "cube"), "settings").collect()}
    assert told == {"count": "4", "zmin": "0.0", "zmax": "3.0", "fps": "5.0", "baseline": "2.5"} and codecs.read_cube_parts(spark, str(tmp_path / "cube")).count() == 4
    assert codecs.grid_setup(spark, {"P": np.eye(3, 4), "b": 2.0}).where("name = 'P'").first()["values"][5] == 1.0
    (tmp_path / "a.cfg").write_text("A=5\n")
    assert {r.key: r.value for r in codecs.read_settings(spark, str(tmp_path / "a.cfg"), {"A": "1", "B": "2"}).collect()} == {"A": "5", "B": "2"}
    assert codecs.settings_text({"A": "1"}) == "# A=1\n"
    x = np.random.default_rng(1).random((6, 5))
    assert np.allclose(codecs.decode_matches(codecs.encode_matches(x)), x)
    data = codecs.encode_triangles(np.eye(3), np.array([[0, 1, 2]]))
    assert len(data.split(b"end_header\n")[1]) == 36 + 13
    text = codecs.frustum_ply(np.eye(3), np.zeros(3)).splitlines()
    assert "element edge 7" in text and len(text) == text.index("end_header") + 1 + 8 + 7


def test_camera():
    r = np.array(g.plane_rotation(0.3, -0.2, math.sqrt(1 - 0.13)))
    q = camera.rotation_quaternion(r)
    assert np.allclose(camera.quaternion_rotation(q), r) and abs(np.linalg.norm(q) - 1) < 1e-12
    s = np.array(g.plane_rotation(-0.1, 0.4, math.sqrt(1 - 0.17)))
    assert np.allclose(camera.quaternion_rotation(camera.quaternion_product(q, camera.rotation_quaternion(s))), r @ s)
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    p, plane = camera.projection(k, np.eye(3), np.zeros(3)), (0.1, 0.2, math.sqrt(0.95), -3.0)
    to_image, to_grid = camera.grid_matrices(p, plane, 2.5, k, (640, 480))
    point = np.array([0.4, -0.3, 6.0, 1.0])
    on_grid = to_grid @ point
    seen = to_image @ on_grid
    u, v = (p @ point)[:2] / (p @ point)[2]
    assert np.allclose(seen[:2] / seen[2], [2 * u / 640 - 1, 2 * v / 480 - 1])
    corners = np.array([[0, 0, 5.0], [1, 0, 6], [1, 1, 7], [0, 1, 5.5]])
    h = camera.corner_homography(p, corners, np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]))
    one = h @ np.append((p @ np.append(corners[1], 1))[:2] / corners[1, 2], 1)
    assert np.allclose(one[:2] / one[2], [1, 0])


def test_shares_of_cells(spark):
    rows = [(0, c, 100 * c + k, float(k)) for c, n in ((1, 50), (2, 3), (3, 50)) for k in range(n)]
    got = match.shared_out(spark.createDataFrame(rows, "frame int, cell int, fid int, response double"), 23).toPandas()
    assert got.groupby("cell").size().to_dict() == {1: 10, 2: 3, 3: 10}
    inside = match.inside_border(spark.createDataFrame([(3.0, 50.0), (10.0, 50.0)], "x double, y double"), 120, 90)
    assert inside.count() == 1


def test_nearest_without_partners():
    assert list(match._nearest(pd.DataFrame({"frame": [1], "cam": [0], "fid": [5], "descriptor": [[1.0]]}), 3).columns) == ["frame", "fa", "fb", "d2", "rank"]


def test_scattered(spark):
    """Triangles whose circles are empty; a plane is met exactly inside the hull; tiles agree with the whole."""
    from swellframe.operators import scattered

    rng = np.random.default_rng(3)
    p = rng.uniform(0, 10, (400, 2))
    t = scattered.delaunay(p)
    centre, radius = scattered.circumcircles(p, t)
    away = ((p[None] - centre[:, None]) ** 2).sum(axis=2)
    assert (away >= radius[:, None] * (1 - 1e-6)).all()
    u, v = p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    area = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2
    hull = p[np.lexsort((p[:, 1], p[:, 0]))]
    ring = []
    for half in (hull, hull[::-1]):
        part = []
        for q in half:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(q)
        ring += part[:-1]
    x, y = np.array(ring).T
    assert area == pytest.approx(abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2, rel=1e-3)
    at = rng.uniform(1, 9, (200, 2))
    z = scattered.interpolated(p, 2 * p[:, 0] - p[:, 1], at)
    assert np.allclose(z[~np.isnan(z)], (2 * at[:, 0] - at[:, 1])[~np.isnan(z)]) and np.isnan(z).sum() < 5
    assert np.isnan(scattered.interpolated(p, p[:, 0], np.array([[99.0, 99.0]]))).all()
    h = np.sin(p[:, 0]) + p[:, 1] ** 2
    df = spark.createDataFrame([(1, *map(float, (*q, v))) for q, v in zip(p, h, strict=True)], "frame int, x double, y double, z double")
    nodes = spark.createDataFrame([(k, 0, *map(float, q)) for k, q in enumerate(at)], "i int, j int, x double, y double")
    got = {r.i: r.z for r in scattered.linear(df, nodes, 2.5, 3.0).collect()}
    want = scattered.interpolated(p, h, at)
    assert all(got[k] == pytest.approx(want[k]) for k in range(200) if not np.isnan(want[k]))


def test_adjustment(spark):
    """A pose that is off by degrees comes back from noisy matches, and points with it."""
    from swellframe.operators import adjust

    _, r, t, a, b = two_views(300, 0.1, 0, 9)
    df = spark.createDataFrame([(k, *map(float, (*a[k], *b[k]))) for k in range(300)], "m long, ax double, ay double, bx double, by double")
    off = adjust.turn(np.array([0.01, -0.02, 0.015])) @ r
    wrong = t + np.array([0.0, 0.05, -0.04])
    got_r, got_t, points = adjust.adjusted(df, off, wrong)
    assert np.abs(got_r - r).max() <= 5e-3 and np.abs(got_t - t).max() <= 2e-2 and points.count() >= 295
    assert np.abs(off - r).max() > np.abs(got_r - r).max()


def test_rectification():
    k, r, t, a, b = two_views(50, 0.0, 0, 4)
    h0, h1, box = camera.rectification(k, k, r, t, (2400, 2000))
    p, q = (np.c_[x, np.ones(50)] @ k.T @ h.T for x, h in ((a, h0), (b, h1)))
    assert np.allclose(p[:, 1] / p[:, 2], q[:, 1] / q[:, 2], atol=1e-6) and np.allclose([np.linalg.det(h0), np.linalg.det(h1)], 1)
    assert box[0] < box[2] and box[1] < box[3]
    with pytest.raises(ValueError, match="above"):
        camera.rectification(k, k, r, np.array([0.0, -1.0, 0.0]), (2400, 2000))


def test_five_point(spark):
    """Exact views give the matrix itself; at 60 % outliers the gates hold and draws stop early."""
    from swellframe.functions import epipolar

    _, r, t, a, b = two_views(800, 0.0, 0, 9)
    true = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    true /= np.linalg.norm(true)
    draw, e = epipolar.five_point(np.stack([a[:5], a[5:10]]), np.stack([b[:5], b[5:10]]))
    for k in (0, 1):
        assert min(min(np.abs(x - true).max(), np.abs(x + true).max()) for x in e[draw == k]) < 1e-8
    assert np.abs(np.linalg.det(e)).max() < 1e-10
    assert epipolar.draws_needed(0.4, 0.9999) == pytest.approx(np.log(1e-4) / np.log(1 - 0.4**5)) and epipolar.draws_needed(0, 0.9) == np.inf and epipolar.draws_needed(1, 0.9) == 0
    _, r, t, a, b = two_views(1200, 0.15, 720, 11)
    df = spark.createDataFrame([(7, k, *map(float, (*a[k], *b[k]))) for k in range(1200)], "frame long, m long, ax double, ay double, bx double, by double")
    got = surface.epipolar_inliers(df, 1.5 / 2000).toPandas()
    kept = got[got.inlier & got.ahead]
    assert len(kept) >= 400 and (kept.m >= 720).mean() > 0.97 and kept.draws.iloc[0] < 1000
    assert np.abs(np.reshape(kept.r.iloc[0], (3, 3)) - r).max() <= 5e-3 and np.abs(np.array(kept.t.iloc[0]) - t).max() <= 2e-2
    for n in (0, 5):
        assert epipolar.consensus(a[:n], b[:n], 1e-3, np.random.default_rng(0))[0] is None
    flat = epipolar.consensus(np.zeros((9, 2)), np.zeros((9, 2)), 1e-3, np.random.default_rng(0), rounds=40)
    assert flat[0] is None and flat[2] == 40


def test_five_point_views_near_threshold(spark, tmp_path):
    """Misplaced matches just within the threshold count as in SQL: places aren't rounded before."""
    duckdb = pytest.importorskip("duckdb")
    from swellframe.functions import epipolar
    from swellframe.plans import more

    e, rng = np.array(more._VIEW_E), np.random.default_rng(6)
    # order, part, supplier, quantity, price, discount, tax
    rows = [(k // 4, 5 * k + 2, k, *map(float, (rng.integers(1, 51), rng.integers(900, 100_000), rng.integers(0, 11) / 100, rng.integers(0, 9) / 100))) for k in range(120)]
    for part in range(0, 4_000, 5):
        supp, q, disc, tax, end = part % 997, float(part % 50 + 1), part % 11 / 100, part % 9 / 100, -1 if part % 2 else 1
        b = np.array([[(supp * 31 % 97) / 97 - 0.5, (part * 17 % 89) / 89 - 0.5]])

        def off(price):
            z = 4 + price / 10_000
            a = np.array([[(q - 25) / 8 / z, (disc * 60 - 3 + tax) / z]])
            side = np.sign(np.c_[b, 1.0] @ e @ np.c_[a, 1.0].T)[0, 0]
            return side * epipolar.sampson(e, a, b)[0], epipolar.sampson(e, a, np.round(b, 6))[0]

        low, high = 900.0, 100_000.0
        if (off(low)[0] - end * 9e-7) * (off(high)[0] - end * 9e-7) < 0 and len(rows) < 126:
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if (off(mid)[0] - end * 9e-7) * (off(low)[0] - end * 9e-7) > 0 else (low, mid)
            if off(low)[1] > 1.05e-6 and abs(abs(off(low)[0]) - 9e-7) < 1e-9:
                rows.append((part % 60, part, supp, q, low, disc, tax))
    assert len(rows) == 126
    names = [f"l_{c}" for c in "orderkey partkey suppkey quantity extendedprice discount tax".split()]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet")
    run, sql = more.REGISTRY["five_point_views"]
    got = run(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    found = db.execute(sql)
    want = [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]
    assert [r.asDict() for r in got] == want and want[0]["odd"] == 6 and want[0]["inliers"] == 126


def test_epipolar_refit_leaves_chance_inliers():
    """A misplaced match just beyond the threshold, which a turned geometry of one more inlier reaches, doesn't keep it."""
    for seed in range(10, 15):
        _, r, t, a, b = two_views(100, 0.0, 40, seed)
        e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
        line = (np.c_[a, np.ones(100)] @ e.T)[40, :2]
        aside = line / np.linalg.norm(line) * 1e-6
        b[40] += aside * 1.02e-6 / surface.sampson(e, a[40:41], b[40:41] + aside)[0]
        one = pd.DataFrame({"frame": seed, "m": range(100), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]})
        got = surface._inliers(one, 1e-6, 1000, 1, 0.999999)
        assert np.flatnonzero(got.inlier).tolist() == np.flatnonzero(surface.sampson(e, a, b) < 1e-6).tolist() == [*range(41, 100)]
        assert np.abs(np.array([*got.r[0], *got.t[0]]) - [*r.ravel(), *t / np.linalg.norm(t)]).max() < 1e-9


def test_consensus_prefers_nearer_inliers():
    """A geometry turned to one more match, just beyond the threshold, loses to the one on which the others lie."""
    from swellframe.functions import epipolar

    _, r, t, a, b = two_views(100, 0.0, 40, 12)
    e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
    line = (np.c_[a, np.ones(100)] @ e.T)[40, :2]
    aside = line / np.linalg.norm(line) * 1e-6
    b[40] += aside * 1.02e-6 / surface.sampson(e, a[40:41], b[40:41] + aside)[0]
    best, good, _ = epipolar.consensus(a, b, 1e-6, np.random.default_rng([1, 12]), 1000, 0.999999)
    assert np.flatnonzero(good).tolist() == [*range(41, 100)] and surface.sampson(best, a[41:], b[41:]).max() < 1e-9


def test_consensus_work(monkeypatch):
    """The same geometry, inliers and draws whatever the batch, and no draw is solved that does not count."""
    from swellframe.functions import epipolar

    _, _, _, a, b = two_views(250, 0.0, 100, 3)
    five, solved = epipolar.five_point, []
    monkeypatch.setattr(epipolar, "five_point", lambda x, y: solved.append(len(x)) or five(x, y))
    best, good, made = epipolar.consensus(a, b, 1e-6, np.random.default_rng(5), 1000, 0.999999)
    assert np.flatnonzero(good).tolist() == [*range(100, 250)] and sum(solved) == made == np.ceil(epipolar.draws_needed(0.6, 0.999999))
    for batch in (1, 7, 250):
        e, near, n = epipolar.consensus(a, b, 1e-6, np.random.default_rng(5), 1000, 0.999999, batch)
        assert n == made and (near == good).all() and min(np.abs(e - best).max(), np.abs(e + best).max()) < 1e-9


def test_selected(spark, monkeypatch):
    """Any place of any group, of values that share many leading bits, repeat, or span all sizes."""
    rng = np.random.default_rng(3)
    groups = {0: 1 + rng.random(900) * 1e-13, 1: np.repeat([2.5, -1.0], [700, 300]), 2: rng.normal(size=800) * 10.0 ** rng.integers(-300, 300, 800), 3: np.array([0.0, -0.0, np.inf, -np.inf, np.nan, 1.0]), None: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(0, None)], "frame int, v double")
    places = [F.lit(0), F.floor(F.col("n") / 3), F.col("n") - 1]
    for few in (grid.FEW, 20):
        monkeypatch.setattr(grid, "FEW", few)
        for r in grid.selected(df, "v", places, ["frame"]).collect():
            x = np.sort(groups[r.frame])
            assert r.n == len(x) and np.array_equal([r.v0, r.v1, r.v2], x[[0, len(x) // 3, -1]], equal_nan=True)
        one = grid.quantiles(df.where("frame < 3"), "v", [0.0, 0.31, 1.0]).first()
        assert np.allclose([one.q0, one.q1, one.q2], np.quantile(np.concatenate([groups[k] for k in range(3)]), [0, 0.31, 1]), rtol=1e-12)
    assert grid.quantiles(df.limit(0), "v", [0.5]).count() == 0 and grid.selected(df.limit(0), "v", places, ["frame"]).count() == 0


@pytest.mark.parametrize("diagonal", [False, True])
def test_component_tiles(spark, diagonal):
    """Components that wind through many tiles are named as if a frame were labelled at once."""
    rng = np.random.default_rng(5)
    snake = np.full((30, 23), np.nan)
    snake[::4] = 1.0
    for k in range(0, 28, 4):
        snake[k : k + 5, 22 if k % 8 == 0 else 0] = 1.0
    frames = [snake, np.where(rng.random((30, 23)) < 0.6, rng.integers(0, 3, (30, 23)), np.nan)]
    rows = [(t, i, j, float(z[i, j])) for t, z in enumerate(frames) for i, j in np.ndindex(z.shape) if z[i, j] == z[i, j]] + [(1, 50, 50, None)]
    mesh = spark.createDataFrame(rows, "t int, i int, j int, z double")
    whole, tiled = (sorted(map(tuple, cloud.connected(mesh, 1.0, diagonal, tile).select("t", "i", "j", "component").collect())) for tile in (512, 4))
    assert whole == tiled and len({c for t, _, _, c in whole if t == 0}) == 1 and len({c for t, _, _, c in whole if t == 1}) > 10
    assert cloud.connected(mesh.limit(0), 1.0, diagonal, 4).count() == 0


def test_recursive_parts():
    """Filtering part by part, each from the state that the last one left, is filtering at once."""
    from swellframe.functions import signal

    rng = np.random.default_rng(6)
    for cutoff, high in ((0.05, False), (1.0, False), (2.0, True)):
        sections = signal.butterworth(8, cutoff, 10.0, high)
        f, x = signal.Recursive(sections, 64), rng.normal(size=1000) + 3
        whole = signal._run(sections, x)
        state, out = f.steady * x[0], []
        for a, b in ((0, 1), (1, 300), (300, 301), (301, 900), (900, 1000)):
            y, state = f.run(x[a:b], state)
            out.append(y)
        assert np.abs(np.concatenate(out) - whole).max() < 1e-9
        rest = f.run(x[:333])[1] + f.jump(333) @ (f.steady * x[0])
        assert np.abs(rest - f.run(x[:333], f.steady * x[0])[1]).max() < 1e-9


@pytest.mark.parametrize("high", [False, True])
def test_long_filter(spark, high):
    """Long and short series, in parts over several ranges, equal the filter of each whole series."""
    from swellframe.functions import signal

    rng = np.random.default_rng(7)
    wholes = {1: np.cumsum(rng.normal(size=30_000)), 2: rng.normal(size=28), 5: rng.normal(size=777)}
    rows = pd.DataFrame([(c, 3 * k, v) for c, x in wholes.items() for k, v in enumerate(x)], columns=["cell", "t", "v"]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows, "cell long, t long, v double").union(spark.createDataFrame([(1, -5, None)], "cell long, t long, v double"))
    got = temporal.long_filtered(df, 10.0, 1.0, high, size=500, ranges=4).toPandas().sort_values(["cell", "t"])
    for cell, x in wholes.items():
        mine = got[got.cell == cell]
        want = signal.zero_phase(signal.butterworth(8, 1.0, 10.0, high), x - x.mean() if high else x)
        assert mine.t.tolist() == [3 * k for k in range(len(x))] and np.abs(mine.v.to_numpy() - want).max() < 1e-9 * max(1, np.abs(x).max())
    assert temporal.long_filtered(df.limit(0), 10.0, 1.0).count() == 0
    with pytest.raises(Exception, match="more than 27 samples"):
        temporal.long_filtered(df.where("cell = 2 and t > 0"), 10.0, 1.0).count()


def test_scattered_gap(spark):
    """Small tiles give the triangulation of all points, across a large gap and up to the hull, for every node inside it."""
    from itertools import combinations

    from swellframe.operators import scattered

    rng = np.random.default_rng(12)
    p = rng.uniform(0, 10, (150, 2))
    p = p[(np.abs(p - [5.5, 4.5]) > 2.6).any(axis=1)][:70]
    z = np.sin(3 * p[:, 0]) + p[:, 1] ** 2
    at = np.concatenate([rng.uniform(0, 10, (150, 2)), rng.uniform(4, 6, (40, 2))])
    three = np.array(list(combinations(range(len(p)), 3)))
    c, r2 = scattered.circumcircles(p, three)
    empty = np.array([((p - m) ** 2).sum(axis=1).min() >= r * (1 - 1e-9) for m, r in zip(c, r2, strict=True)])
    want = {}
    for a, b, d in three[empty]:
        m = np.linalg.solve(np.array([[*p[k], 1.0] for k in (a, b, d)]).T, np.c_[at, np.ones(len(at))].T)
        for k in np.flatnonzero((m > 1e-9).all(axis=0)):
            want[int(k)] = float(m[:, k] @ z[[a, b, d]])
    rows = [(1, *map(float, (*q, h))) for q, h in zip(p, z, strict=True)]
    rows += [(2, *q, float(2 * q[0] + q[1])) for q in [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (4.0, 4.0)]] * 2 + [(3, 1.0, 1.0, 1.0), (3, 2.0, 2.0, 5.0), (1, None, 1.0, 2.0), (1, 5.5, 4.5, None), (1, 5.5, 4.5, float("nan")), (1, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, z double")
    nodes = spark.createDataFrame([(k, 0, *map(float, q)) for k, q in enumerate(at)], "i int, j int, x double, y double")
    got = scattered.linear(df, nodes, 0.8).collect()
    mine = {r.i: r.z for r in got if r.frame == 1}
    assert len(got) == len({(r.frame, r.i) for r in got}) and len(want) > 120 and want.keys() <= mine.keys() and len(mine.keys() - want.keys()) < 3
    assert all(mine[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    square = {r.i: r.z for r in got if r.frame == 2}
    assert square.keys() == {k for k, q in enumerate(at) if (q < 4).all()} and all(v == pytest.approx(2 * at[k][0] + at[k][1]) for k, v in square.items())
    assert not [r for r in got if r.frame == 3]
    assert scattered.linear(df.limit(0), nodes, 0.8).count() == 0 and scattered.linear(df, nodes.limit(0), 0.8).count() == 0


def test_nearest_points(spark, monkeypatch):
    """Against all distances: crowded and empty regions, ties, points of one place, few points, and cells in parts."""
    from swellframe.operators import nearest

    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(5, 0.05, (150, 2)), rng.uniform(-40, 40, (60, 2)), np.repeat([[7.0, 7.0]], 30, axis=0), [[3.0, 1.0], [1.0, 3.0], [3.0, 3.0], [1.0, 1.0]]])
    q = np.concatenate([rng.uniform(-60, 60, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[2.0, 2.0], [7.0, 7.0]]])
    rows = [(1, k, float(x), float(y), float(k % 7)) for k, (x, y) in enumerate(p)] + [(2, 1, 0.0, 0.0, 4.0), (1, 999, None, 1.0, 2.0), (1, 998, float("nan"), 1.0, 2.0), (None, 5, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double")
    ask = spark.createDataFrame([(f, k, float(x), float(y)) for f in (1, 2, 3) for k, (x, y) in enumerate(q)], "frame int, qid long, x double, y double")
    d2 = ((q[:, None] - p) ** 2).sum(axis=2)
    for part, others in ((nearest.PART, False), (16, True)):
        monkeypatch.setattr(nearest, "PART", part)
        got = nearest.nearest_points(df, ask, 4, 1.0, others).collect()
        mine = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            mine.setdefault((r.frame, r.qid), []).append((r.pid, r["rank"]))
        for k in range(len(q)):
            away = np.where(d2[k] == 0, np.inf, d2[k]) if others else d2[k]
            want = np.lexsort((np.arange(len(p)), away))[:4]
            assert mine[1, k] == [(int(i), n + 1) for n, i in enumerate(want)]
            assert mine[2, k] == [(1, 1)] and (3, k) not in mine
    z = {r.qid: r.z for r in nearest.inverse_distance(df, ask, 1.0, 3).where("frame = 1").collect()}
    best = np.argsort(d2[0], kind="stable")[:3]
    assert z[0] == pytest.approx(np.average(best % 7, weights=d2[0][best] ** -1.2))
    same = np.flatnonzero((p == 7).all(axis=1))[:3]
    assert z[61] == pytest.approx(np.mean(same % 7))
    assert nearest.nearest_points(df.limit(0), ask, 3, 1.0).count() == 0 and nearest.nearest_points(df, ask.limit(0), 3, 1.0).count() == 0


def test_nearest_points_by_lots(spark, monkeypatch):
    """Few queries among many points: no call gets more than a few lots of places."""
    from swellframe.operators import nearest

    met = nearest._met

    def watched(k, others):
        run = met(k, others)

        def small(key, places, asked):
            assert len(places) <= 2_000, len(places)
            return run(key, places, asked)

        return small

    monkeypatch.setattr(nearest, "_met", watched)
    monkeypatch.setattr(nearest, "PART", 64)
    monkeypatch.setattr(nearest, "LOT", 512, raising=False)
    p, q = np.random.default_rng(8).uniform(0, 9, (6_000, 2)), np.array([[2.0, 2.0], [4.5, 4.5], [7.0, 7.5]])
    df = spark.createDataFrame([(1, k, float(x), float(y), 0.0) for k, (x, y) in enumerate(p)], "frame int, pid long, x double, y double, z double")
    ask = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(q)], "frame int, qid long, x double, y double")
    got = nearest.nearest_points(df, ask, 9, 3.0).orderBy("qid", "rank").collect()
    assert [r.pid for r in got] == np.argsort(((q[:, None] - p) ** 2).sum(axis=2), axis=1)[:, :9].ravel().tolist()


def test_long_moving_mean(spark):
    """Long, short and gappy series, in blocks over several ranges, equal the window over each whole series."""
    rng = np.random.default_rng(9)
    wholes = {1: rng.normal(size=3001) + 1e6, 2: rng.normal(size=1), 3: rng.normal(size=7), 4: np.where(rng.random(200) < 0.3, np.nan, 1.0)}
    rows = [(c, k, None if v != v else float(v)) for c, x in wholes.items() for k, v in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(map(lambda v: v if v is None else float(v) if isinstance(v, float) else int(v), r)) for r in rows], "cell long, t long, v double")
    for size, part in ((20, 64), (5, 5), (33, 1000)):
        want = {(r.cell, r.t): (r.v, r.bg) for r in temporal.moving_mean(df, size).collect()}
        got = temporal.long_moving_mean(df, size, part, 4).collect()
        assert len(got) == len(want) == len(df.collect())
        for r in got:
            v, bg = want[r.cell, r.t]
            assert r.v == v and (r.bg is None) == (bg is None) and (bg is None or r.bg == pytest.approx(bg, rel=1e-12, abs=1e-12))
    assert temporal.long_moving_mean(df.limit(0), 20).count() == 0


def test_upsert_frames(spark, tmp_path):
    """A frame written again replaces itself alone; alike runs change nothing; broken frames are left out; reads are pruned."""
    path = str(tmp_path / "cube")
    rows = [(t, i, j, float(t + i * j)) for t in range(3) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "t int, i int, j int, z double")
    twice = df.union(df.withColumn("z", F.lit(-1.0))).union(spark.createDataFrame([(None, 0, 0, 1.0)], df.schema))
    read = lambda **k: sorted((r.t, r.i, r.j, r.z) for r in codecs.read_frames(spark, path, **k).collect())
    codecs.upsert_frames(twice, path, tile=2)
    assert read() == sorted(rows)
    small = spark.createDataFrame([(1, 0, 0, 9.0), (7, 5, 5, 3.0)], df.schema)
    for _ in range(2):
        codecs.upsert_frames(small, path, tile=2)
        assert read() == sorted([r for r in rows if r[0] != 1] + [(1, 0, 0, 9.0), (7, 5, 5, 3.0)])
    codecs.upsert_frames(df.limit(0), path, tile=2)
    assert read(frames=[0, 7], tiles=(1, 2, 2, 2)) == sorted([r for r in rows if r[0] == 0 and r[1] >= 2 and r[2] >= 4] + [(7, 5, 5, 3.0)])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = codecs.read_frames(spark, path, [0], (1, 1, 1, 1))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(t" in plan or "PartitionFilters: [(t" in plan
    assert "GreaterThanOrEqual(ti,1)" in plan and "LessThanOrEqual(tj,1)" in plan
    spark.createDataFrame([(0, 0, 0, 5.0, 0, 0)], "t int, i int, j int, z double, ti int, tj int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t").parquet(f"{path}/z")
    assert {r[0] for r in read()} == {1, 2, 7}  # frame 0 was broken off before its entry
    codecs.upsert_frames(df.where("t = 0"), path, tile=2)
    assert {r[0] for r in read()} == {0, 1, 2, 7}


def shadow_frames():
    rng = np.random.default_rng(10)
    frames = [np.abs(rng.normal(size=(61, 47))).cumsum(axis=0) % 7 + rng.random((61, 47)), np.where(rng.random((61, 47)) < 0.02, 9.0, 0.5) + rng.random((61, 47)) * 0.1]
    frames[0][rng.random((61, 47)) < 0.1] = np.nan
    return frames


@pytest.mark.parametrize("eye", [(-20.0, 10.0, 30.0), (70.5, 33.0, 8.0), (20.0, 25.0, 4.0), (300.0, -200.0, 60.0)])
@pytest.mark.parametrize("tile", [3, 30])
def test_shadow_rays(eye, tile):
    """Rays that skip tiles hide what rays over whole surfaces hide; eyes near, far, inside and below the crests."""
    from swellframe.functions import signal
    from swellframe.operators import shadows

    for z in shadow_frames():
        cells = pd.DataFrame([(0, i, j, z[i, j]) for i, j in np.argwhere(~np.isnan(z))], columns=["t", "i", "j", "z"]).assign(ti=lambda d: d.i // tile, tj=lambda d: d.j // tile)
        tiles = [(a, b, d.z.max()) for (a, b), d in cells.groupby(["ti", "tj"])]
        levels = shadows.pyramid(tiles, 61, 47, tile)
        assert levels[-1].shape == (1, 1) and levels[-1].max() == np.nanmax(z)
        rays, hidden = cells[["t", "i", "j", "z"]].assign(n=1), np.zeros(z.shape, bool)
        while len(rays):
            n, ti, tj = shadows.skipped(*(rays[c].to_numpy() for c in ("i", "j", "z", "n")), eye, 61, 47, tile, levels)
            rays = rays.assign(n=n, ti=ti, tj=tj)[ti >= 0]
            met = [shadows._tested(eye, 61, 47, tile)((), r, cells[(cells.ti == a) & (cells.tj == b)]) for (a, b), r in rays.groupby(["ti", "tj"])]
            met = pd.concat(met) if met else rays.assign(hidden=False).iloc[:0]
            hidden[met.i[met.hidden], met.j[met.hidden]] = True
            rays = met[~met.hidden.astype(bool)].drop(columns="hidden")
        assert (hidden == signal.shadowed(z, eye)).all()


def test_shadow_tiles(spark, monkeypatch):
    """The same in Spark, with frames in blocks and rays of a tile in parts."""
    from swellframe.functions import signal
    from swellframe.operators import shadows

    frames, eye = shadow_frames(), (70.5, 33.0, 12.0)
    df = spark.createDataFrame([(t, i, j, float(z[i, j])) for t, z in enumerate(frames) for i, j in np.ndindex(z.shape)], "t int, i int, j int, z double")
    monkeypatch.setattr(shadows, "MAXIMA", 10)
    monkeypatch.setattr(shadows, "RAYS", 500)
    got = {(r.t, r.i, r.j): r.z for r in shadows.occluded(df, 61, 47, eye, 20).collect()}
    for t, z in enumerate(frames):
        want = signal.shadowed(z, eye)
        assert all(got[t, i, j] == want[i, j] for i, j in np.argwhere(~np.isnan(z)))
    assert len(got) == sum((~np.isnan(z)).sum() for z in frames)
    assert shadows.occluded(df.limit(0), 61, 47, eye, 8).count() == 0


def test_square_of_equal_places(spark):
    """Points of one line of x or y are judged from their mean height, however their partial sums meet."""
    from pyspark.sql import Row

    for at, (x, y) in enumerate([(50.0, None), (None, 10.0), (None, None)]):
        sizes = [49, 98, 103, 107, 161, 187]
        rows = [Row(frame=1, pid=k, x=x or 40.0 + k % 9, y=y or 10.0 + (k % 9 if x else (k % 9) / 10), z=float(k * 37 % 101)) for k in range(sum(sizes))]
        cuts = np.cumsum([0, *sizes])
        df = spark.createDataFrame(spark.sparkContext.union([spark.sparkContext.parallelize(rows[a:b], 1) for a, b in zip(cuts, cuts[1:], strict=False)]))
        got = {r.pid for r in cloud.plane_outliers(df, 100.0, 30.0).where("outlier").collect()}
        mean = np.mean([r.z for r in rows])
        assert got == {r.pid for r in rows if abs(r.z - mean) > 30.0}, at


def test_pose_of_chance_inliers():
    """A match that is misplaced but lies within the threshold by chance doesn't turn the pose."""
    from swellframe.operators import surface

    rng = np.random.default_rng(2)
    r, t = np.array([[0.96, 0.0, 0.28], [0.0, 1.0, 0.0], [-0.28, 0.0, 0.96]]), np.array([-1.0, 0.1, 0.05])
    worst = 0.0
    for seed in range(12):
        p = np.c_[rng.uniform(-3, 3, (40, 2)), rng.uniform(4, 14, 40)]
        q = p @ r.T + t
        a, b = p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]
        e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
        line = (np.c_[a, np.ones(40)] @ e.T)[:1, :2]
        b[:1] += 9e-7 * line / np.linalg.norm(line)
        b[30:] = rng.uniform(-0.5, 0.5, (10, 2))
        pdf = pd.DataFrame({"frame": seed, "m": range(40), "ax": a[:, 0], "ay": a[:, 1], "bx": b[:, 0], "by": b[:, 1]})
        got = surface._inliers(pdf, 1e-6, 1000, 1, 0.999999)
        assert got.inlier[:30].all()
        worst = max(worst, np.abs(np.array(got.r[0]).reshape(3, 3) - r).max(), np.abs(np.array(got.t[0]) - t / np.linalg.norm(t)).max())
    assert worst < 1e-9


def test_scattered_dense(spark):
    """Few nodes among many points, half of them in a cluster, need the points around the nodes alone; the hull of many
    points is that of all."""
    import time

    from swellframe.operators import scattered

    df = spark.range(400_000).selectExpr("id", "rand(1) AS a", "rand(2) AS b").selectExpr("1 AS frame", "if(id % 2 = 0, 10 * a, 3.33 + a / 100) AS x", "if(id % 2 = 0, 10 * b, 7.21 + b / 100) AS y").selectExpr("*", "2 * x - y AS z")
    at = [(0, 0, 5.0, 5.0), (1, 0, 3.335, 7.215), (2, 0, 0.2, 9.7), (3, 0, 12.0, 1.0)]
    began = time.perf_counter()
    got = {r.i: r.z for r in scattered.linear(df, spark.createDataFrame(at, "i int, j int, x double, y double"), 10.0).collect()}
    assert time.perf_counter() - began < 60  # all points in one triangulation take minutes
    assert got == {i: pytest.approx(2 * x - y, abs=1e-6) for i, _, x, y in at[:3]}
    rng = np.random.default_rng(8)
    for p in (rng.normal(size=(5000, 2)), rng.integers(0, 9, (500, 2)).astype(float), np.c_[rng.uniform(size=300), np.zeros(300)], np.ones((200, 2))):
        h = scattered.hull(p)
        assert {tuple(q) for q in h} <= {tuple(q) for q in p}
        if len(h) > 2:
            a, b = h, np.roll(h, -1, axis=0)
            side = (b[:, 0] - a[:, 0]) * (p[:, 1, None] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0, None] - a[:, 0])
            assert side.min() >= -1e-9 and (np.abs(side).min(axis=0) < 1e-9).all()


def test_sampling_without_grouping(spark):
    """Places meet the cells around them as one row: no grouping by place holds them; a null cell or place gives null."""
    cells = spark.createDataFrame([(1, i, j, float(10 * i + j) if (i, j) != (5, 5) else None) for i in range(12) for j in range(12)], "t int, i int, j int, z double")
    at = spark.createDataFrame([(1, 1, 3.25, 3.5), (1, 2, 5.0, 4.5), (1, 3, 11.5, 2.0), (1, 4, None, 2.0), (2, 5, 3.0, 3.0), (1, 6, 1e12, 3.0)], "t int, id long, fi double, fj double")
    for f, want in ((raster.sampled, {1: 36.0}), (lambda c, p: image.sampled_sharp(c.fillna(55.0), p), {1: 36.0, 2: 54.5})):
        got = f(cells, at)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate" in line and "id#" in line]
        z = {r.id: r.z for r in got.collect()}
        assert len(z) == 6 and {k for k, v in z.items() if v is not None} == want.keys() and all(z[k] == pytest.approx(v, abs=0.2) for k, v in want.items())
