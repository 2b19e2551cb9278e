"""Readers and writers of the sequence's files as DataFrames.

Binary clouds are read with Spark's binaryFile source, one file a row, and decoded by Arrow batches; text files with
the text source. The frame number is the number in the folder's name (000012_wd).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swellframe.tables import cut, discard

#: Image endings in the order in which they are tried (fixed values).
ENDINGS = ("tif", "tiff", "png", "jpg", "jpeg")
POINTS = "frame int, pid long, x double, y double, z double"


def frame_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)_wd", 1).try_cast("int")


def frame_name(frame: Column) -> Column:
    """The folder of a frame: six digits at least, then _wd."""
    return F.concat(F.format_string("%06d", frame), F.lit("_wd"))


def encode_cloud(points: np.ndarray, rotation: np.ndarray, shift: np.ndarray) -> bytes:
    """Points (n, 3) as 16-bit steps of their box in the plane's axes. Header: u32 n; f64 scale and least of each axis;
    f64 inverse rotation, row by row; f64 inverse shift."""
    p = points @ rotation.T + shift
    low = p.min(axis=0, initial=np.inf) if len(p) else np.zeros(3)
    scale = 65535.0 / np.where((size := (p.max(axis=0) if len(p) else low) - low) > 0, size, 1.0)
    q = np.clip((p - low) * scale, 0, 65535).astype("<u2")
    return struct.pack("<I", len(p)) + np.concatenate([scale, low, rotation.T.ravel(), -rotation.T @ shift]).astype("<f8").tobytes() + q.tobytes()


def decode_cloud(data: bytes) -> np.ndarray:
    """The points of encode_cloud(), to within one step of each axis."""
    n = struct.unpack_from("<I", data)[0]
    head = np.frombuffer(data, "<f8", 18, 4)
    q = np.frombuffer(data, "<u2", 3 * n, 148).reshape(n, 3)
    return (q / head[:3] + head[3:6]) @ head[6:15].reshape(3, 3).T + head[15:18]


def encode_plain(points: np.ndarray) -> bytes:
    return struct.pack("<I", len(points)) + points.astype("<f4").tobytes()


def decode_plain(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<f4", 3 * n, 4).reshape(n, 3).astype(float)


def encode_ply(points: np.ndarray, colours: np.ndarray) -> bytes:
    """Binary PLY of points (n, 3) with colours (n, 3) of 8 bits."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    rows = np.zeros(len(points), np.dtype([("p", "<f4", 3), ("c", "u1", 3)]))
    rows["p"], rows["c"] = points, colours
    return head.encode() + rows.tobytes()


def decode_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, _, body = data.partition(b"end_header\n")
    n = int(head.split(b"element vertex ")[1].split(b"\n")[0])
    rows = np.frombuffer(body, np.dtype([("p", "<f4", 3), ("c", "u1", 3)]), n)
    return rows["p"].astype(float), rows["c"]


def encode_triangles(points: np.ndarray, faces: np.ndarray) -> bytes:
    """Binary PLY of points (n, 3) and triangles (m, 3) of their numbers."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\n" + "".join(f"property float {c}\n" for c in "xyz") + f"element face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(faces), np.dtype([("n", "u1"), ("f", "<i4", 3)]))
    rows["n"], rows["f"] = 3, faces
    return head.encode() + points.astype("<f4").tobytes() + rows.tobytes()


def frustum_ply(r: np.ndarray, t: np.ndarray, size: float = 1.0) -> str:
    """ASCII PLY of a camera at pose (r, t): the four corners of its frame, then its centre and the ends of its axes."""
    centre = -r.T @ t
    corners = [centre + size * r.T @ np.array([a, b, 1.0]) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]
    points = [*corners, centre, *[centre + size * row for row in r]]
    edges = [(k, (k + 1) % 4) for k in range(4)] + [(4, 5), (4, 6), (4, 7)]
    head = ["ply", "format ascii 1.0", f"element vertex {len(points)}", *[f"property float {c}" for c in "xyz"], f"element edge {len(edges)}", "property int vertex1", "property int vertex2", "end_header"]
    return "\n".join(head + [" ".join(f"{v:.9g}" for v in p) for p in points] + [f"{a} {b}" for a, b in edges]) + "\n"


def encode_matches(matches: np.ndarray) -> bytes:
    """u32 number of matches, then f8 ax, ay, bx, by and score of each."""
    return struct.pack("<I", len(matches)) + matches.astype("<f8").tobytes()


def decode_matches(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<f8", 5 * n, 4).reshape(n, 5)


def encode_features(features: np.ndarray) -> bytes:
    """Rows of x, y, scale, angle and the descriptor."""
    return struct.pack("<2I", len(features), features.shape[1] - 4) + features.astype("<f4").tobytes()


def decode_features(data: bytes) -> np.ndarray:
    n, d = struct.unpack_from("<2I", data)
    return np.frombuffer(data, "<f4", n * (4 + d), 8).reshape(n, 4 + d)


def _decoder(decode):
    def run(batches):
        for batch in batches:
            for frame, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = decode(data)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * len(p), pa.int32()), pa.array(np.arange(len(p))), *[pa.array(p[:, k].astype(float)) for k in range(3)]], names=["frame", "pid", "x", "y", "z"])

    return run


def read_clouds(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """All clouds under a path as POINTS."""
    ending = "*.xyzC" if compressed else "*.xyzbin"
    files = spark.read.format("binaryFile").option("pathGlobFilter", ending).option("recursiveFileLookup", "true").load(path)
    return files.select(frame_of(F.col("path")).alias("frame"), "content").mapInArrow(_decoder(decode_cloud if compressed else decode_plain), POINTS)


def encoded_clouds(points: DataFrame, planes: DataFrame) -> DataFrame:
    """points and planes (frame, a, b, c, d) -> frame, content: one compressed cloud a frame; a frame without a plane
    keeps its axes. A frame's points meet in one task, as its file does."""
    from swellframe.functions.geometry import plane_rotation

    def run(pdf):
        a, b, c, d = pdf[["a", "b", "c", "d"]].iloc[0]
        known = a == a and a is not None
        r = np.array(plane_rotation(a, b, c)) if known else np.eye(3)
        data = encode_cloud(pdf[["x", "y", "z"]].to_numpy(float), r, np.array([0.0, 0.0, d if known else 0.0]))
        return type(pdf)({"frame": [pdf.frame.iloc[0]], "content": [data]})

    return points.join(planes, "frame", "left").select("frame", "x", "y", "z", "a", "b", "c", "d").groupBy("frame").applyInPandas(run, "frame int, content binary")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Files of numbers between blanks -> path, values."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return text.select("path", F.transform(parts, lambda x: x.try_cast("double")).alias("values"))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """Plane files -> frame, a, b, c, d; "nan" becomes null."""
    rows = read_numbers(spark, path).withColumn("frame", frame_of(F.col("path")))
    return rows.select("frame", *[F.nanvl(F.try_element_at("values", F.lit(k + 1)), F.lit(None).cast("double")).alias(c) for k, c in enumerate("abcd")])


def read_xml_matrices(spark: SparkSession, path: str) -> DataFrame:
    """XML files of one matrix -> path, rows, cols, values (row by row)."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    part = lambda tag: F.regexp_extract("v", f"<{tag}>\\s*([^<]*?)\\s*</{tag}>", 1)
    values = F.transform(F.filter(F.split(part("data"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return text.select("path", part("rows").cast("int").alias("rows"), part("cols").cast("int").alias("cols"), values.alias("values"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Files of a count and then four numbers a line -> frame, m, ax, ay, bx, by."""
    rows = read_numbers(spark, path).select(frame_of(F.col("path")).alias("frame"), F.slice("values", 2, F.size("values")).alias("v"))
    m = rows.select("frame", "v", F.explode(F.expr("sequence(0, size(v) div 4 - 1)")).alias("m")).where("size(v) >= 4")
    return m.select("frame", "m", *[F.element_at("v", (F.col("m") * 4 + k + 1).cast("int")).alias(c) for k, c in enumerate(("ax", "ay", "bx", "by"))])


def read_settings(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """KEY=value lines -> key, value; comments are left out, and defaults stand for keys that are missing."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).where("v like '%=%'")
    found = lines.select(F.trim(F.split_part("v", F.lit("="), F.lit(1))).alias("key"), F.trim(F.substring_index("v", "=", -1)).alias("value"))
    if not defaults:
        return found
    known = spark.createDataFrame(list(defaults.items()), "key string, fallback string")
    return found.join(known, "key", "full").select("key", F.coalesce("value", "fallback").alias("value"))


def settings_text(defaults: dict[str, str]) -> str:
    """A settings file that names every key, commented out, with its default."""
    return "".join(f"# {k}={v}\n" for k, v in defaults.items())


def write_text_cloud(points: DataFrame, path: str, stride: int = 1) -> None:
    """x y z lines of every stride-th point of each frame, a folder a frame."""
    w = Window.partitionBy("frame").orderBy("pid")
    x = points.withColumn("n", F.row_number().over(w) - 1).where(F.col("n") % stride == 0)
    x.select("frame", F.concat_ws(" ", *[F.format_string("%.15g", c) for c in "xyz"]).alias("value")).write.partitionBy("frame").text(path)


def workdirs(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Frame folders (000012_wd) under a path that hold files: frame, path, in order; the first ones only if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"^(.*/\d+_wd)/", 1).alias("path"))
    found = files.where("path <> ''").distinct().select(frame_of(F.concat("path", F.lit("/"))).alias("frame"), "path").orderBy("frame")
    return found if first is None else found.limit(first)


def known_folders(spark: SparkSession, listed: str, path: str) -> DataFrame:
    """The folders named in a text file (one a token) that exist as frame folders under the path: path."""
    names = spark.read.text(listed).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''").distinct()
    found = workdirs(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return found.join(names.select(F.element_at(F.split(F.regexp_replace("name", "/+$", ""), "/"), -1).alias("name")), "name", "left_semi").select("path")


def write_lines(df: DataFrame, path: str, columns: list[str], form: str | None = None, by: str = "frame", gap: str = " ", count: bool = False) -> None:
    """One text file of numbers a group, in the order of all columns, a folder a group; `count` puts the number of rows
    first. Numbers have the digits that tell them apart, or those of a format. A group is one file, as its readers
    expect, and so one task writes it."""
    text = lambda x: x.cast("string") if form is None else F.format_string(form, x)
    line = F.concat_ws(gap, *[F.coalesce(text(F.col(c).cast("double")), F.lit("nan")) for c in columns])
    order = [c for c in df.columns if c != by and c not in columns] + columns
    x = df.select(by, *[F.col(c) for c in order], line.alias("value")).withColumn("k", F.lit(1))
    if count:
        head = df.groupBy(by).agg(F.count("*").alias("n")).select(by, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order], F.col("n").cast("string").alias("value"), F.lit(0).alias("k"))
        x = head.unionByName(x)
    x.repartition(by).sortWithinPartitions(by, "k", *order).select(by, "value").write.partitionBy(by).text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """matches (frame, m, ax, ay, bx, by) -> a count and then a match a line."""
    write_lines(matches.select("frame", "m", "ax", "ay", "bx", "by"), path, ["ax", "ay", "bx", "by"], count=True)


def write_planes(planes: DataFrame, path: str) -> None:
    """planes (frame, a, b, c, d) -> one line a frame in the order of frames, "nan" for what is missing, in few files."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan")) for c in "abcd"])
    planes.repartitionByRange("frame").sortWithinPartitions("frame").select(line.alias("value")).write.text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """error_stats() rows as CSV with semicolons and a header."""
    stats.write.option("sep", ";").option("header", "true").csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", "true").schema("frame long, n long, avg_err double, std_err double, min_err double, max_err double").csv(path)


def xml_matrix(name: Column, rows: int, cols: int, values: Column) -> Column:
    """The XML text of one matrix, as read_xml_matrices() takes it."""
    numbers = F.array_join(F.transform(values, lambda x: F.format_string("%.16e", x)), " ")
    return F.format_string('<?xml version="1.0"?>\n<opencv_storage>\n<%s type_id="opencv-matrix">\n  <rows>%d</rows>\n  <cols>%d</cols>\n  <dt>d</dt>\n  <data>\n    %s</data></%s>\n</opencv_storage>\n', name, F.lit(rows), F.lit(cols), numbers, name)


def write_extrinsics(pose: DataFrame, frames: DataFrame, path: str) -> None:
    """pose (r nine, t three), one row, and frames (frame) -> ext_R and ext_T as XML text for every frame's folder."""
    both = F.array(F.struct(F.lit("ext_R").alias("name"), xml_matrix(F.lit("ext_R"), 3, 3, F.col("r")).alias("value")), F.struct(F.lit("ext_T").alias("name"), xml_matrix(F.lit("ext_T"), 3, 1, F.col("t")).alias("value")))
    rows = frames.select("frame").distinct().crossJoin(F.broadcast(pose.select("r", "t").limit(1)))  # one row
    rows.select("frame", F.explode(both).alias("m")).select("frame", "m.*").write.partitionBy("frame", "name").option("lineSep", "\n").text(path)


def grid_settings(spark: SparkSession, path: str) -> DataFrame:
    """An [Area] file -> one row: cx, cy, width, height, nx, ny. `area_size` and `N` stand for both directions; what is
    missing has the template's value."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[#;].*", "")).alias("v")).where("v like '%=%'")
    pair = lines.select(F.lower(F.trim(F.split_part("v", F.lit("="), F.lit(1)))).alias("k"), F.trim(F.substring_index("v", "=", -1)).try_cast("double").alias("x"))
    of = lambda *names: F.coalesce(*[F.max(F.when(F.col("k") == n, F.col("x"))) for n in names])
    known = {"cx": of("area_center_x"), "cy": of("area_center_y"), "width": of("area_size_x", "area_size"), "height": of("area_size_y", "area_size"), "nx": of("nx", "n"), "ny": of("ny", "n")}
    return pair.agg(*[F.coalesce(v, F.lit(GRID_TEMPLATE[n])).cast("int" if n in ("nx", "ny") else "double").alias(n) for n, v in known.items()])


#: The grid that a new settings file describes (fixed values).
GRID_TEMPLATE = {"cx": 0.0, "cy": -35.0, "width": 50.0, "height": 50.0, "nx": 1024.0, "ny": 1024.0}


def grid_settings_text() -> str:
    g = GRID_TEMPLATE
    return f"[Area]\narea_center_x={g['cx']}\narea_center_y={g['cy']}\narea_size={g['width']}\nN={int(g['nx'])}\n"


def grid_nodes(spark: SparkSession, settings: dict) -> DataFrame:
    """i, j, x, y, kx, ky of every node of a grid: lines from one end of the area to the other, and the wavenumbers of
    a centred spectrum (even numbers of lines)."""
    from swellframe.operators.grid import axis, wavenumber

    nx, ny = int(settings["nx"]), int(settings["ny"])
    left, low = settings["cx"] - settings["width"] / 2, settings["cy"] - settings["height"] / 2
    dx, dy = settings["width"] / (nx - 1), settings["height"] / (ny - 1)
    ij = spark.range(nx * ny).select(F.expr(f"cast(id div {nx} as int)").alias("i"), (F.col("id") % nx).cast("int").alias("j"))
    return ij.select("i", "j", axis(F.col("j"), nx, left, left + settings["width"]).alias("x"), axis(F.col("i"), ny, low, low + settings["height"]).alias("y"), wavenumber(F.col("j"), nx, dx).alias("kx"), wavenumber(F.col("i"), ny, dy).alias("ky"))


def square_step(nodes: DataFrame) -> DataFrame:
    """nodes (i, j, x, y) -> dx: the distance of neighbouring nodes; reading it fails unless cells are square."""
    ends = nodes.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "ijxy" for f in (F.min, F.max)])
    step = lambda x, n: (F.col(f"max_{x}") - F.col(f"min_{x}")) / F.nullif(F.col(f"max_{n}") - F.col(f"min_{n}"), F.lit(0))
    square = F.abs(step("x", "j") - step("y", "i")) <= 1e-6 * F.abs(step("x", "j"))
    return ends.select(F.when(square, step("x", "j")).otherwise(F.raise_error(F.lit("the grid's cells aren't square")).cast("double")).alias("dx"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder in order: n, path. The first ending with more than one file counts; otherwise none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = files.withColumn("e", F.array_position(F.array(*[F.lit(e) for e in ENDINGS]), ending)).where("e > 0")
    first = known.groupBy("e").agg(F.count("*").alias("m")).where("m > 1").agg(F.min("e").alias("e"))
    return known.join(F.broadcast(first), "e").select(F.row_number().over(Window.orderBy("path")).alias("n"), "path")


def _once_a_cell(cube: DataFrame, tile: int) -> DataFrame:
    """One row for each t, i, j, with its tile: of several the one whose other columns come last in order, whatever the
    order of the rows."""
    others = [c for c in cube.columns if c not in ("t", "i", "j")]
    x = cube.groupBy("t", "i", "j").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_r")) if others else cube.select("t", "i", "j").distinct()
    at = {"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")}
    return x.select("t", "i", "j", *[F.col(f"_r.`{c}`").alias(c) for c in others]).withColumns(at)


def write_cube(cube: DataFrame, path: str, tile: int = 128) -> None:
    """A cube (t, i, j, ...) by tiles of cells, sorted so that row groups hold short ranges of t; of rows with the same
    t, i, j one stays."""
    x = _once_a_cell(cube, tile)
    x.repartition("ti", "tj", F.floor(F.col("t") / 512)).sortWithinPartitions("ti", "tj", "t", "i", "j").write.partitionBy("ti", "tj").parquet(path)


def upsert_frames(cube: DataFrame, path: str, tile: int = 512) -> None:
    """Frames (t, i, j, ...) into the cube at `path`, which begins with them: those that it has are replaced whole, by
    their index, and no others are touched, so a repeated run changes nothing.

    A frame is a partition of `path`/z, its tiles are sorted within (ti, tj); of rows with the same t, i, j one stays, rows of null t are left
    out, and an empty table changes nothing. `path`/manifest, written last, holds each frame's cells and a digest of its
    rows: read_frames() leaves out frames that a broken run left without a matching entry, until they are written again."""
    x = cut(_once_a_cell(cube.where("t is not null"), tile), "frames")
    dynamic = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t")
    dynamic(x.repartition("t", "ti", "tj").sortWithinPartitions("t", "ti", "tj", "i", "j")).parquet(f"{path}/z")
    dynamic(_digests(x).repartition("t")).parquet(f"{path}/manifest")
    discard(x)


def _digests(frames: DataFrame) -> DataFrame:
    columns = sorted(c for c in frames.columns if c != "t")
    return frames.groupBy("t").agg(F.count("*").alias("cells"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("digest"))


def read_frames(spark: SparkSession, path: str, frames: list[int] | None = None, tiles: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The whole frames of upsert_frames(), or some of them, or of these the tiles (ti from, ti to, tj from, tj to, ends
    included). Frames are partitions and tiles sorted columns, so only what is asked for is read."""
    z, manifest = spark.read.parquet(f"{path}/z"), spark.read.parquet(f"{path}/manifest")
    if frames is not None:
        z, manifest = z.where(F.col("t").isin(frames)), manifest.where(F.col("t").isin(frames))
    whole = _digests(z).join(manifest, ["t", "cells", "digest"]).select("t")
    if tiles is not None:
        z = z.where(F.col("ti").between(*tiles[:2]) & F.col("tj").between(*tiles[2:]))
    return z.join(whole, "t", "left_semi")


def write_cube_parts(path: str, cube: DataFrame, nodes: DataFrame | None = None, frames: DataFrame | None = None, settings: DataFrame | None = None) -> None:
    """A cube with what belongs to it: nodes (i, j, x, y, kx, ky, mask), frames (t, time, workdir) and settings
    (key, value), each a table beside the heights."""
    write_cube(cube, f"{path}/z")
    for name, part in (("nodes", nodes), ("frames", frames), ("settings", settings)):
        if part is not None:
            part.write.parquet(f"{path}/{name}")


def read_cube_parts(spark: SparkSession, path: str, name: str = "z") -> DataFrame:
    """One of the tables of write_cube_parts()."""
    return spark.read.parquet(f"{path}/{name}")


def cube_settings(cube: DataFrame, rate: float, more: dict[str, str] | None = None) -> DataFrame:
    """key, value: number of frames, limits of the heights, rate, and whatever else is told."""
    ends = cube.agg(F.count_distinct("t").alias("count"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    known = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("count", "zmin", "zmax")]
    told = [F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in {"fps": rate, **(more or {})}.items()]
    return ends.select(F.explode(F.array(*known, *told)).alias("r")).select("r.*")


def grid_setup(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """Named scalars and matrices of a grid's setup -> name, rows, cols, values (row by row)."""
    rows = [(k, *np.atleast_2d(np.asarray(v, float)).shape, np.atleast_2d(np.asarray(v, float)).ravel().tolist()) for k, v in values.items()]
    return spark.createDataFrame(rows, "name string, rows int, cols int, values array<double>")


def write_spectrum(spectrum: DataFrame, stats: DataFrame, path: str) -> None:
    """A spectrum and one row of its statistics and origin."""
    spectrum.write.parquet(f"{path}/spectrum")
    stats.write.parquet(f"{path}/stats")


def write_frames(products: DataFrame, path: str, by: str = "t") -> None:
    """Products of frames, such as polarimetry()'s rows, in a folder a frame."""
    products.repartition(by).sortWithinPartitions(by).write.partitionBy(by).parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def described(df: DataFrame) -> DataFrame:
    """column, type, rows and values that aren't null, one row a column."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"c{k}").alias("values")) for k, (c, t) in enumerate(df.dtypes)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """Fails if the column is missing or the new name is taken."""
    if old not in df.columns:
        raise ValueError(f"no column {old}")
    if new in df.columns:
        raise ValueError(f"column {new} exists")
    return df.withColumnRenamed(old, new)
