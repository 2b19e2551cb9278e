"""Kernels and operators against closed forms and plain versions."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swellframe.functions import geometry as g
from swellframe.functions import signal
from swellframe.operators import cloud, graph, grid, match, raster, temporal
from swellframe.sources import codecs
from swellframe.streaming import gridding


def cube_of(spark, z, t=0):
    rows = [(t, int(i), int(j), float(z[i, j])) for i, j in np.argwhere(~np.isnan(z))]
    return spark.createDataFrame(rows, "t int, i int, j int, z double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.i, r.j] = r.z
    return out


def test_plane_rotation():
    n = np.array([0.2, -0.3, 0.9])
    n /= np.linalg.norm(n)
    r = np.array(g.plane_rotation(*n))
    assert np.allclose(r @ n, [0, 0, 1]) and np.allclose(r @ r.T, np.eye(3)) and g.plane_rotation(0, 0, 1)[0][0] == 1.0


def test_triangulation_and_projection(spark):
    rng = np.random.default_rng(1)
    r = np.array([[0.96, 0, 0.28], [0, 1, 0], [-0.28, 0, 0.96]])
    t = np.array([-1.0, 0.1, 0.05])
    p = rng.uniform([-2, -2, 8], [2, 2, 20], (50, 3))
    q = p @ r.T + t
    df = spark.createDataFrame([(*map(float, a[:2] / a[2]), *map(float, b[:2] / b[2]), *map(float, a)) for a, b in zip(p, q, strict=True)], "a double, b double, c double, d double, x double, y double, z double")
    got = g.triangulated(*[F.col(k) for k in "abcd"], r.tolist(), t.tolist())
    worst = df.select(F.max(sum((F.abs(v - F.col(k)) for v, k in zip(got, "xyz", strict=True)), F.lit(0.0)))).first()[0]
    assert worst < 1e-9


def test_plane_fit_and_ransac(spark):
    rng = np.random.default_rng(2)
    n = np.array([0.1, -0.2, 1.0])
    n /= np.linalg.norm(n)
    xy = rng.uniform(-20, 20, (2000, 2))
    z = (-5 - xy @ n[:2]) / n[2]
    z[:200] += rng.uniform(5, 20, 200)
    df = spark.createDataFrame([(1, k, *map(float, (*xy[k], z[k]))) for k in range(2000)], "frame int, pid long, x double, y double, z double")
    best = cloud.ransac_planes(df, 24, 0.05).first()
    assert best.inliers == 1800 and best.ok and np.allclose([best.a, best.b, best.c], n, atol=1e-6)
    near = cloud.near_plane(df, (best.a, best.b, best.c, best.d), 0.05)
    fit = cloud.fit_planes(near).first()
    assert np.allclose([fit.a, fit.b, fit.c, fit.d], [*n, 5.0], atol=1e-6)


def test_components_of_a_mesh(spark):
    z = np.full((30, 30), np.nan)
    z[:12, :12] = 1.0
    z[15:22, 15:22] = 2.0
    z[12, 3] = 2.0  # a gap equal to the limit is no link
    got = cloud.biggest(cube_of(spark, z), 1.0).first()
    assert got["size"] == 144 and got["components"] == 3
    path = graph.components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"))
    assert path.where("comp = 0").count() == 51
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_index_percentile(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(200)] + [(2, 5.0)], "t int, v double")
    for p in (0, 50, 99, 100):
        got = {r.t: r.value for r in cloud.index_percentile(df, "t", "v", p).collect()}
        assert got == {1: float(min(int(p / 100 * 200), 199)), 2: 5.0}


def test_rasters(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(1, 2, (9, 8))
    z[rng.random(z.shape) < 0.2] = np.nan
    df = cube_of(spark, z)
    pad = np.pad(z, 1, constant_values=np.nan)
    win = np.lib.stride_tricks.sliding_window_view(pad, (3, 3)).reshape(9, 8, 9)
    med = np.where(np.isnan(z), np.nan, np.nanmedian(win, axis=2))
    assert np.allclose(array_of(raster.median_blurred(df), z.shape), med, equal_nan=True)
    count = (~np.isnan(np.delete(win, 4, axis=2))).sum(axis=2)
    mean = np.nanmean(np.delete(win, 4, axis=2), axis=2)
    want = np.where(np.isnan(z), np.where(count > 1, mean, np.nan), z)
    assert np.allclose(array_of(raster.zero_dilated(df, 9, 8), z.shape), want, equal_nan=True)
    filled = array_of(raster.filled(df, 9, 8), z.shape)
    assert not np.isnan(filled).any() and np.allclose(filled[~np.isnan(z)], z[~np.isnan(z)])
    full = cube_of(spark, np.add.outer(3.0 * np.arange(9), 2.0 * np.arange(8)))
    at = spark.createDataFrame([(0, 1, 2.25, 3.5), (0, 2, 8.5, 0.0)], "t int, id long, fi double, fj double")
    assert {r.id: r.z for r in raster.sampled(full, at).collect()} == {1: pytest.approx(13.75), 2: None}
    assert {round(r.g2, 6) for r in raster.gradient_squared(full).collect()} == {(8 * 6.0 * 1) ** 2 / 4 + (8 * 4.0) ** 2 / 4}


def test_slopes_of_a_ramp(spark):
    z = np.add.outer(0.5 * np.arange(6), -0.25 * np.arange(7))
    rows = temporal.slopes(cube_of(spark, z)).collect()
    n = np.array([0.25, -0.5, 1]) / math.sqrt(1 + 0.0625 + 0.25)
    assert all(abs(r.sy - 0.5) < 1e-12 and abs(r.sx + 0.25) < 1e-12 and np.allclose([r.nx, r.ny, r.nz], n) for r in rows)


def test_grid(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, v) for v in (1.0, 5.0, 9.0)] + [(0, 9.99, 9.99, 4.0), (0, -3.0, 0.0, 7.0)], "frame int, x double, y double, z double")
    got = {(r.i, r.j): (r.z, r.n) for r in grid.binned(df, (0.0, 10.0, 11), (0.0, 10.0, 11)).collect()}
    assert got == {(0, 0): (5.0, 3), (10, 10): (4.0, 1)}
    with pytest.raises(ValueError):
        grid.wavenumber(F.lit(0), 5, 1.0)


def test_filters():
    t = np.arange(4096) / 10
    low, high = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 3 * t)
    y = signal.zero_phase(signal.butterworth(8, 1.0, 10.0), np.stack([low + high, low]))
    assert np.abs(y[0, 100:-100] - low[100:-100]).max() < 1e-3 and y.shape == (2, 4096)
    z = signal.zero_phase(signal.butterworth(8, 1.0, 10.0, high=True), low + high)
    assert np.abs(z[100:-100] - high[100:-100]).max() < 1e-3
    assert np.allclose(signal.zero_phase(signal.butterworth(8, 1.0, 10.0), np.full(40, 3.0)), 3.0)
    with pytest.raises(ValueError):
        signal.zero_phase(signal.butterworth(8, 1.0, 10.0), np.zeros(27))
    sos = signal.butterworth(8, 1.0, 10.0)
    w = np.exp(-2j * np.pi * 1.0 / 10.0)
    gain = np.prod([abs((b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w)) for b0, b1, b2, _, a1, a2 in sos])
    assert abs(gain - math.sqrt(0.5)) < 1e-9


def test_spectra(spark):
    t = np.arange(4096) / 10
    v = 2 * np.sin(2 * np.pi * 0.2 * t)
    series = spark.createDataFrame([(c, k, float(x)) for c in (1, 2) for k, x in enumerate(v)], "cell long, t long, v double")
    s = temporal.welch_spectra(series, 10.0)
    m = temporal.spectral_moments(s).collect()
    assert len(m) == 2 and all(abs(r.hm0 - 4 * 2 / math.sqrt(2)) < 0.05 and abs(r.peak_freq - 0.2) < 0.02 for r in m)
    rows = [v[:n] + n for n in (28, 100, 64, 333)]
    sos = signal.butterworth(8, 1.0, 10.0)
    for x, y in zip(rows, signal.zero_phase_rows(sos, rows), strict=True):
        assert np.allclose(y, signal.zero_phase(sos, x))
    for x, (f, p) in zip(rows, signal.welch_rows(rows, 10.0, 64), strict=True):
        n = min(64, len(x))
        parts = [x[a : a + n] - x[a : a + n].mean() for a in range(0, len(x) - n + 1, n - n // 2)]
        want = np.mean([np.abs(np.fft.rfft(q * signal.hann_periodic(n))) ** 2 for q in parts], axis=0) / (10 * (signal.hann_periodic(n) ** 2).sum())
        want[1 : -1 if n % 2 == 0 else None] *= 2
        assert np.allclose(p, want) and f[1] == pytest.approx(10 / n)


def test_spectrum3d(spark):
    """Place and level of a plane wave's peak, against a plain transform of whole segments."""
    rows, frames, rate, step = 18, 80, 4.0, 0.5
    r0, c0, side = signal.centre_window(rows, rows)
    nt = signal.segment_length(frames)
    i, j, t = np.arange(rows)[:, None], np.arange(rows)[None], np.arange(frames)[:, None, None]
    z = 0.7 * np.cos(2 * np.pi * (2 * j / side + i * 0 - 2 * t / nt)) + 5
    z[3, 4, 5] = np.nan
    df = spark.createDataFrame([(int(a), int(b), int(c), float(z[a, b, c])) for a, b, c in np.ndindex(z.shape)], "t int, i int, j int, z double")
    got = np.zeros((nt, side, side))
    for r in temporal.spectrum3d(df, rows, rows, frames, rate, step).collect():
        got[r.fi + nt // 2, r.ki + side // 2, r.kj + side // 2] = r.s
    window = np.hanning(nt)[:, None, None] * np.hanning(side)[None, :, None] * np.hanning(side)
    parts = []
    for s in range(0, frames - nt + 1, nt // 2):
        x = z[s : s + nt, r0 : r0 + side, c0 : c0 + side]
        x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
        h = np.fft.fftshift(np.fft.fftn((x - x.mean()) * window, norm="ortho")) / x.size
        dk, df_ = 2 * np.pi / (step * (side - 1)), rate / nt
        parts.append(np.abs(h) ** 2 / (dk * dk * df_) / np.mean(np.hanning(side) ** 2) ** 2 / np.mean(np.hanning(nt) ** 2))
    assert np.allclose(got, np.mean(parts, axis=0), rtol=1e-6, atol=1e-15)
    f, ky, kx = np.unravel_index(got.argmax(), got.shape)
    assert abs(f - nt // 2) == 2 and ky == side // 2 and abs(kx - side // 2) == 2


def test_low_pass_and_fill():
    z = np.fromfunction(lambda i, j: np.sin(2 * np.pi * i / 64) + np.sin(2 * np.pi * i / 4), (64, 64))
    gain = signal.low_pass_gain(64, 64, 1.0, 0.25)
    y = np.fft.ifft2(np.fft.fft2(z) * gain).real
    assert gain[0, 0] == 1 and np.abs(y).max() < np.abs(z).max()
    surface = np.fromfunction(lambda i, j: np.cos(np.pi * (i + 0.5) / 24) + 0.5 * np.cos(np.pi * 2 * (j + 0.5) / 24), (24, 24))
    holes = surface.copy()
    holes[np.random.default_rng(4).random(holes.shape) < 0.3] = np.nan
    assert np.abs(signal.cosine_fill(holes, 6) - surface).max() < 0.05


def test_shadows():
    flat = np.zeros((40, 10))
    assert not signal.shadowed(flat, (-30.0, 5.0, 20.0)).any()
    wall = flat.copy()
    wall[10] = 4.0
    hidden = signal.shadowed(wall, (-30.0, 5.0, 20.0))  # the ray over the wall falls 4 in 10 cells
    assert hidden[11:20, 5].all() and not hidden[22:, 5].any() and not hidden[:10].any()


def test_moving_mean_and_segments(spark):
    v = np.random.default_rng(5).random(50)
    s = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v)], "cell long, t long, v double")
    pad = np.concatenate([v[:5][::-1], v, v[-5:][::-1]])
    want = [pad[k : k + 10].mean() for k in range(50)]
    got = [r.bg for r in temporal.moving_mean(s, 10).orderBy("t").collect()]
    assert np.allclose(got, want)
    seg = temporal.segments(s, 16).groupBy("segment").count().collect()
    assert {r.segment: r["count"] for r in seg} == {k: 16 for k in range(5)}


def test_threshold(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(9, 1, 100)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = temporal.automatic_threshold(temporal.histogram(df, "v")).first()
    assert 1.5 < got.threshold < 7


def test_matches(spark):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(40, 8))
    rows = [(0, 0, k, d[k].tolist()) for k in range(40)] + [(0, 1, 100 + k, (d[k] + rng.normal(0, 0.01, 8)).tolist()) for k in rng.permutation(40).tolist()]
    f = spark.createDataFrame(rows, "frame long, cam long, fid long, descriptor array<double>")
    got = {(r.fa, r.fb) for r in match.ratio_tested(match.nearest(f)).collect()}
    assert got == {(k, 100 + k) for k in range(40)}


def test_game():
    a = np.zeros((12, 12))
    a[:8, :8] = 1 - np.eye(8)
    a[8:, 8:] = 0.3 * (1 - np.eye(4))
    x = match.play(a)
    assert np.allclose(x[:8], 1 / 8, atol=1e-3) and x[8:].max() < 1e-3
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 100, (12, 2))
    shift = np.where(np.arange(12)[:, None] < 8, [[5.0, 1.0]], [[40.0, -30.0]])
    pdf = pd.DataFrame({"frame": 0, "m": range(12), "fa": range(12), "fb": range(12), "ax": xy[:, 0], "ay": xy[:, 1], "bx": (xy + shift)[:, 0], "by": (xy + shift)[:, 1], "sin": 0.0, "cos": 1.0, "ds": 1.0})
    groups = match._groups(pdf, 1e-2, 0.7, 4, 20)
    assert set(groups[groups.turn == 0].m) == set(range(8)) and set(groups[groups.turn == 1].m) == set(range(8, 12))
    assert match.payoff_matrix(pdf, 1e-2)[0, 1] == pytest.approx(1.0) and match.payoff_matrix(pdf, 1e-2)[0, 0] == 0.0


def test_homography(spark):
    h = np.array([[1.1, 0.1, 3], [-0.05, 0.9, 2], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(8).uniform(0, 100, (30, 2))
    q = np.c_[p, np.ones(30)] @ h.T
    q = q[:, :2] / q[:, 2:]
    df = spark.createDataFrame([(0, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)], "frame long, ax double, ay double, bx double, by double")
    got = np.array(match.homographies(df).first().h).reshape(3, 3)
    assert np.allclose(got / got[2, 2], h, atol=1e-4)


def test_codecs(spark, tmp_path):
    rng = np.random.default_rng(9)
    p = rng.uniform(-5, 5, (500, 3))
    r = np.array(g.plane_rotation(0.1, 0.2, math.sqrt(0.95)))
    data = codecs.encode_cloud(p, r, np.array([0, 0, 2.0]))
    assert len(data) == 148 + 6 * 500 and np.abs(codecs.decode_cloud(data) - p).max() < 3e-4
    (tmp_path / "000007_wd").mkdir()
    (tmp_path / "000007_wd" / "mesh_cam.xyzC").write_bytes(data)
    (tmp_path / "000008_wd").mkdir()
    (tmp_path / "000008_wd" / "mesh_cam.xyzC").write_bytes(codecs.encode_cloud(np.empty((0, 3)), np.eye(3), np.zeros(3)))
    (tmp_path / "000007_wd" / "plane.txt").write_text(f"0.1\n0.2\n{math.sqrt(0.95)}\n-3\n")
    (tmp_path / "000008_wd" / "plane.txt").write_text("nan\nnan\nnan\nnan\n")
    got = codecs.read_clouds(spark, str(tmp_path))
    assert got.count() == 500 and got.first().frame == 7
    assert {r.frame: r.d for r in codecs.read_planes(spark, f"{tmp_path}/*/plane.txt").collect()} == {7: -3.0, 8: None}
    back = codecs.encoded_clouds(got, codecs.read_planes(spark, f"{tmp_path}/*/plane.txt")).first()
    assert np.abs(np.sort(codecs.decode_cloud(bytes(back.content))[:, 0]) - np.sort(p[:, 0])).max() < 1e-3
    assert np.allclose(codecs.decode_plain(codecs.encode_plain(p)), p, atol=1e-5)
    q, c = codecs.decode_ply(codecs.encode_ply(p, np.full((500, 3), 7)))
    assert np.allclose(q, p, atol=1e-5) and (c == 7).all()
    f = rng.random((5, 68)).astype("f4")
    assert (codecs.decode_features(codecs.encode_features(f)) == f).all()
    (tmp_path / "000007_wd" / "matches.txt").write_text("2\n1 2 3 4\n5 6 7 8\n")
    assert [(r.m, r.ax, r.by) for r in codecs.read_matches(spark, f"{tmp_path}/*/matches.txt").orderBy("m").collect()] == [(0, 1.0, 4.0), (1, 5.0, 8.0)]
    (tmp_path / "k.xml").write_text('<?xml version="1.0"?><opencv_storage><K type_id="opencv-matrix"><rows>2</rows><cols>2</cols><dt>d</dt><data>1. 2.\n 3e1 4.</data></K></opencv_storage>')
    assert codecs.read_xml_matrices(spark, str(tmp_path / "k.xml")).first()["values"] == [1.0, 2.0, 30.0, 4.0]
    (tmp_path / "c.cfg").write_text("A=1\n# B=2\nC = x # note\n")
    assert {r.key: r.value for r in codecs.read_settings(spark, str(tmp_path / "c.cfg")).collect()} == {"A": "1", "C": "x"}


def test_cube_and_describe(spark, tmp_path):
    z = np.arange(20.0).reshape(4, 5)
    codecs.write_cube(cube_of(spark, z).union(cube_of(spark, z)), str(tmp_path / "cube"), tile=2)
    back = codecs.read_cube(spark, str(tmp_path / "cube"))
    assert back.count() == 20 and np.allclose(array_of(back, z.shape), z)
    assert {r.column: r["values"] for r in codecs.described(back.select("t", "z")).collect()} == {"t": 20, "z": 20}
    with pytest.raises(ValueError):
        codecs.renamed(back, "z", "t")


def test_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, k), float(k), 0.0, float(k)) for k in range(20)]
    spark.createDataFrame(rows, "ts timestamp, x double, y double, z double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double, y double, z double").parquet(str(tmp_path / "in"))
    q = gridding.windowed_cells(stream, (0.0, 20.0, 3), (0.0, 1.0, 2)).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("cells").agg(F.sum("n")).first()[0] == 20


def test_poses_and_camera(spark):
    from swellframe.functions import camera
    from swellframe.operators import surface

    rng = np.random.default_rng(11)
    r = np.array(g.plane_rotation(0.05, 0.02, math.sqrt(1 - 0.0029)))
    t = np.array([-0.9, 0.3, 0.1])
    t /= np.linalg.norm(t)
    p = rng.uniform([-3, -3, 8], [3, 3, 20], (60, 3))
    q = p @ r.T + t
    df = spark.createDataFrame([(4, *map(float, a[:2] / a[2]), *map(float, b[:2] / b[2])) for a, b in zip(p, q, strict=True)], "frame long, ax double, ay double, bx double, by double")
    got = surface.poses(df).first()
    assert got.votes == 60 and np.allclose(np.reshape(got.r, (3, 3)), r, atol=1e-6) and np.allclose(got.t, t, atol=1e-6)
    k = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
    f = camera.fundamental(k, k, r, t)
    a, b = p @ k.T, q @ k.T
    assert np.abs(np.einsum("ni,ij,nj->n", b / b[:, 2:], f, a / a[:, 2:])).max() < 1e-8
    back = camera.inverse_pose(*camera.inverse_pose(r, t))
    assert np.allclose(back[0], r) and np.allclose(back[1], t) and camera.rescaled(k, 0.5)[2, 2] == 1.0
    plane = (0.1, 0.2, math.sqrt(0.95), -3.0)
    x, y, z = (np.array(v) for v in zip(*[(c[0], c[1], c[2]) for c in p], strict=True))
    m = camera.plane_pose(plane) @ np.c_[p, np.ones(60)].T
    metric = np.vstack([2.5 * m[0], 2.5 * m[1], -2.5 * m[2], np.ones(60)])
    one = camera.plane_camera(camera.projection(k, np.eye(3), np.zeros(3)), plane, 2.5) @ metric
    assert np.allclose(one[:2] / one[2], a[:, :2].T / a[:, 2])
    corners = np.array([[0, 0], [10, 0], [10, 5], [0, 5.0]])
    h = camera.homography(corners, corners * 2 + 1)
    assert np.allclose(h, [[2, 0, 1], [0, 2, 1], [0, 0, 1]])


def test_radiance_and_polarisation(spark):
    from swellframe.operators import surface

    image = cube_of(spark, np.add.outer(10.0 * np.arange(20), np.arange(30.0)))
    cells = spark.createDataFrame([(0, 1, 1, 4.0, 2.0, 2.0), (0, 1, 2, 900.0, 2.0, 2.0)], "t int, i int, j int, x double, y double, z double")
    got = {r.j: r.radiance for r in surface.radiance(cells, image, ((1.0, 0, 0, 1.0), (0, 1.0, 0, 1.0), (0, 0, 1.0, 0))).collect()}
    assert got[1] == pytest.approx((15 + 2.5) / 255) and got[2] is None
    rows = [(t, 0, 0, 2.0, 0.6, 0.8, t < 2) for t in range(3)]
    p = surface.mean_polarisation(spark.createDataFrame(rows, "t int, i int, j int, s0 double, s1 double, s2 double, visible boolean")).first()
    assert p.frames == 2 and p.dolp == pytest.approx(0.5)
