"""Readers: segment JSON, camera CSV, point clouds and CAD models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.sources.writers import scratch

CAMERA_SCHEMA = "image_name string, qx double, qy double, qz double, qw double, tx double, ty double, tz double"
CLOUD_SCHEMA = "point_id long, x double, y double, z double, r double, g double, b double"
_ARROW = pa.schema([("point_id", pa.int64()), *((c, pa.float64()) for c in "xyzrgb")])
_COLUMNS = ("x", "y", "z", "red", "green", "blue")
# The scalar types of the PLY format.
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def segments_json(spark: SparkSession, path: str) -> DataFrame:
    """(seg_id, x1, y1, x2, y2) of a JSON array of {start, end}, by position; a third coordinate is dropped."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.posexplode(F.from_json("value", "array<struct<start:array<double>,end:array<double>>>")).alias("seg_id", "s"))
    at = lambda side, k: F.element_at(F.col(f"s.{side}"), k)
    return listed.select(F.col("seg_id").cast("long"), at("start", 1).alias("x1"), at("start", 2).alias("y1"), at("end", 1).alias("x2"), at("end", 2).alias("y2"))


def cameras_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CAMERA_SCHEMA)


def images_named(cameras: DataFrame, name: str) -> DataFrame:
    """The images whose name (second path part, without .JPG) is ``name``."""
    part = F.split(F.split("image_name", r"\.JPG")[0], "/")
    return cameras.where(F.get(part, F.lit(1)) == name)


def _ply_head(lines: list[str]) -> tuple[str, list[str], list[str], int]:
    """(format, names, types, count) of the vertices."""
    kind = next(x.split()[1] for x in lines if x.startswith("format"))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {kind} is not supported")
    names, types, count, inside = [], [], 0, False
    for line in map(str.split, lines):
        if line[:1] == ["element"]:
            inside = line[1] == "vertex"
            count = int(line[2]) if inside else count
        elif line[:1] == ["property"] and inside:
            types.append(_PLY[line[1]])
            names.append(line[2])
    return kind, names, types, count


def binary_ply(data, part: int = 65536):
    """(first id, [n, 6] positions and colours from 0 to 1; 0 where there are none) by parts of a little-endian PLY file; nothing of other files."""
    head, found, _ = bytes(data[: 1 << 20]).partition(b"end_header")
    if not head.startswith(b"ply") or not found:
        return
    kind, names, types, count = _ply_head(head.decode("ascii", "replace").split("\n"))
    if kind == "ascii":
        return
    body = bytes(data[: 1 << 20]).index(b"\n", len(head)) + 1
    table = np.frombuffer(data, np.dtype([(n, "<" + t) for n, t in zip(names, types, strict=True)]), count, body)
    for at in range(0, count, part):
        rows = table[at : at + part]
        out = np.zeros((len(rows), 6))
        for i, n in enumerate(_COLUMNS):
            if n in names:
                out[:, i] = rows[n] / (255.0 if i >= 3 and types[names.index(n)] == "u1" else 1.0)
        yield at, out


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files that are neither blank nor start with #, numbered in their file.

    Files are read in splits. Their lines are written once, since another scan may split the files otherwise; a file's splits, one row each, are broadcast.
    """
    meta = lambda c, name: F.col(f"_metadata.{c}").alias(name)
    lines = spark.read.text(path).select("value", meta("file_path", "file"), meta("file_block_start", "block"))
    # The numbers of one split's lines follow each other.
    lines = lines.where(F.trim("value") != "").where(~F.col("value").startswith("#")).withColumn("at", F.monotonically_increasing_id())
    out = scratch(spark, "lines")
    lines.write.parquet(out)
    lines = spark.read.schema(lines.schema).parquet(out)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    blocks = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _ply_points(spark: SparkSession, lines: DataFrame, heads: dict[str, list[str]]) -> DataFrame:
    """The points of ASCII PLY files, a line each."""
    rows = []
    for file, head in heads.items():
        _, names, types, count = _ply_head(head)
        at = [names.index(n) + 1 if n in names else None for n in _COLUMNS]
        unit = [255.0 if i >= 3 and k is not None and types[k - 1] == "u1" else 1.0 for i, k in enumerate(at)]
        rows.append((file, len(head), count, at, unit))
    known = F.broadcast(spark.createDataFrame(rows, "file string, start long, count long, places array<int>, units array<double>"))
    there = lines.join(known, "file").where((F.col("line") >= F.col("start")) & (F.col("line") < F.col("start") + F.col("count")))
    short = known.join(there.groupBy("file").agg(F.count("*").alias("n")), "file", "left").where(F.coalesce("n", F.lit(0)) < F.col("count")).first()
    if short is not None:
        raise ValueError(f"{short.file} has {short.n or 0} of {short['count']} vertices")
    parts = there.withColumn("parts", F.split(F.trim("value"), r"\s+"))
    value = lambda k: F.coalesce(F.element_at("parts", F.col("places")[k]).cast("double") / F.col("units")[k], F.lit(0.0))
    return parts.select((F.col("line") - F.col("start")).alias("point_id"), *(value(k).alias(c) for k, c in enumerate("xyzrgb")))


def _xyz_points(lines: DataFrame) -> DataFrame:
    """Points of lines x y z [r g b]; colours count as bytes in files where one is above 1."""
    parts = lines.withColumn("parts", F.split(F.trim("value"), r"[,\s]+"))
    points = parts.select("file", F.col("line").alias("point_id"), *(F.coalesce(F.get("parts", F.lit(k)).cast("double"), F.lit(0.0)).alias(c) for k, c in enumerate("xyzrgb")))
    units = points.groupBy("file").agg(F.when(F.max(F.greatest("r", "g", "b")) > 1, 255.0).otherwise(1.0).alias("unit"))
    return points.join(F.broadcast(units), "file").select("point_id", "x", "y", "z", *((F.col(c) / F.col("unit")).alias(c) for c in "rgb"))


def point_cloud(spark: SparkSession, path: str, downsample: int | None = None, remove_outliers: tuple[int, float] | None = None) -> DataFrame:
    """The points of PLY or XYZ files with their position in the file as id.

    ``downsample`` keeps points 0, k, 2k, ...; ``remove_outliers`` is (neighbours, deviations). ASCII files are read in
    splits, without Python. A binary file is held by one task, so large ones are best converted to Parquet once.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                for at, rows in binary_ply(memoryview(content.as_buffer())):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows))), *(pa.array(rows[:, k].copy()) for k in range(6))], schema=_ARROW)

    lines = _text_lines(spark, path)
    files = {r.file for r in lines.select("file").distinct().collect()}
    plys = {r.file for r in lines.where((F.col("line") == 0) & F.trim("value").startswith("ply")).collect()}
    found = lines.where(F.col("value").rlike(r"^(ply|format|comment|obj_info|element|property|end_header)\b")).orderBy("file", "line").collect() if plys else []
    heads: dict[str, list[str]] = {}
    for r in found:
        head = heads.setdefault(r.file, [])
        if r.file in plys and len(head) == r.line and (not head or head[-1].strip() != "end_header"):
            head.append(r.value)
    heads = {f: head for f, head in heads.items() if f in plys}
    text = {f: head for f, head in heads.items() if _ply_head(head)[0] == "ascii"}
    points = spark.createDataFrame([], CLOUD_SCHEMA)
    if text:
        points = points.unionByName(_ply_points(spark, lines, text))
    if files - plys:
        others = lines.join(F.broadcast(spark.createDataFrame([(f,) for f in sorted(plys)], "file string")), "file", "left_anti")
        points = points.unionByName(_xyz_points(others))
    if len(text) < len(plys):
        points = points.unionByName(spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, CLOUD_SCHEMA))
    if downsample is not None:
        points = down_sampled(points, downsample)
    if remove_outliers is not None:
        from prospecta.operators.graphs import without_outliers

        points = without_outliers(points, *remove_outliers)
    return points


def down_sampled(points: DataFrame, k: int) -> DataFrame:
    return points.where(F.col("point_id") % k == 0)


def polyline_segments(vertices: DataFrame) -> DataFrame:
    """(curve_id, part, x1..z2): consecutive vertices (curve_id, vertex_idx, x, y, z) as segments."""
    order = Window.partitionBy("curve_id").orderBy("vertex_idx")
    out = vertices.withColumns({f"{a}2": F.lead(a).over(order) for a in "xyz"} | {"part": F.row_number().over(order) - 1})
    return out.where("x2 is not null").select("curve_id", "part", *(F.col(a).alias(f"{a}1") for a in "xyz"), "x2", "y2", "z2")


def curve_chords(vertices: DataFrame) -> DataFrame:
    """(curve_id, x1..z2): one segment from the first to the last vertex."""
    end = lambda f, k: [f(F.col(a), F.col("vertex_idx")).alias(f"{a}{k}") for a in "xyz"]
    return vertices.groupBy("curve_id").agg(*end(F.min_by, 1), *end(F.max_by, 2))


def curve_segments(vertices: DataFrame, is_polyline: DataFrame) -> DataFrame:
    """Polylines as their parts, other curves (is_polyline false in (curve_id, is_polyline)) as chords."""
    kind = vertices.join(is_polyline, "curve_id")
    parts = polyline_segments(kind.where("is_polyline").drop("is_polyline"))
    chords = curve_chords(kind.where("not is_polyline")).withColumn("part", F.lit(0))
    return parts.unionByName(chords)


def plan_view(segments: DataFrame) -> DataFrame:
    return segments.drop("z1", "z2")


def matching_layer(layers: DataFrame, name_or_path: str) -> int:
    """The smallest index of the layers (layer_index, name, full_path) with that short name or full path."""
    found = layers.where((F.col("name") == name_or_path) | (F.col("full_path") == name_or_path)).agg(F.min("layer_index")).first()[0]
    if found is None:
        raise ValueError(f"layer {name_or_path!r} not found")
    return found


def items_of(collection):
    """Elements of a collection that counts with Count and indexes, or iterates."""
    if hasattr(collection, "Count"):
        n = collection.Count() if callable(collection.Count) else collection.Count
        return [collection[i] for i in range(n)]
    return list(collection)


def xyz(point) -> tuple[float, float, float]:
    return float(point.X), float(point.Y), float(point.Z)


def polyline_of(geometry) -> list:
    """Vertices of a geometry that says it is a polyline, directly or as (ok, polyline); [] otherwise."""
    probe = getattr(geometry, "TryGetPolyline", None)
    got = probe() if probe is not None else None
    if isinstance(got, tuple):
        got = got[1] if got and got[0] else None
    return [xyz(p) for p in items_of(got)] if got else []


def geometry_segments(geometry) -> list[tuple]:
    """Parts of a polyline, else the chord of anything with end points, else nothing."""
    vertices = polyline_of(geometry)
    if len(vertices) > 1:
        return list(zip(vertices, vertices[1:], strict=False))
    ends = getattr(geometry, "PointAtStart", None), getattr(geometry, "PointAtEnd", None)
    return [] if None in ends else [tuple(map(xyz, ends))]


def from_rhino(spark: SparkSession, source, layer_name: str | None = None, save_path: str | None = None) -> DataFrame:
    """(seg_id, x1, y1, x2, y2) of a .3dm file, or of a model object that is already open; optionally kept as 3D JSON."""
    if isinstance(source, str):
        import rhino3dm

        source = rhino3dm.File3dm.Read(source)
    layers = [(i, x.Name, x.FullPath) for i, x in enumerate(items_of(source.Layers))]
    only = None if layer_name is None else matching_layer(spark.createDataFrame(layers, "layer_index int, name string, full_path string"), layer_name)
    found = [s for o in items_of(source.Objects) if only is None or o.Attributes.LayerIndex == only for s in geometry_segments(o.Geometry)]
    rows = [(i, *a, *b) for i, (a, b) in enumerate(found)]
    segments = spark.createDataFrame(rows, "seg_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    if save_path is not None:
        from prospecta.sources.writers import save_segments_json

        save_segments_json(segments, save_path)
    return plan_view(segments)
